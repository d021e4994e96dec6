from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from clickweave.llm import secrets
from clickweave.llm.queries import op3_secrets

LETTERS = "Tion was thanonontioniner es the heea is hees of ".split()


def plain_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for i, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        found += [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def test_against_plain_patterns(spark, oracle_dir):
    got = {row.doc_id: row for row in op3_secrets(spark, oracle_dir).collect()}
    docs = spark.read.parquet(f"{oracle_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    hits = 0
    for row in docs:
        want, mine = plain_spans(row.text), got[row.doc_id]
        hits += len(want)
        assert mine.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert (mine.n_assign, mine.n_access, mine.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in secrets.KINDS)
        spans = mine.spans.split(",") if mine.spans else []
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(spans)
        starts = [int(span.split(":")[1]) for span in spans]
        assert starts == sorted(starts)
    assert hits > 10


def test_short_and_mixed_case_matches():
    assert secrets.base_spans("PassWord: 'abc' SECRET=abcdef Api_Key = x.y-z9") == [
        (16, 29, "assign"), (30, 46, "assign")]
    assert secrets.base_spans("ſecret=abcdef toKen=abcdef") == []
    assert secrets.base_spans("AKIA" + "A" * 15 + " AKIA" + "B" * 16) == [(20, 40, "access")]


def test_battery_tells_random_from_prose():
    rng = random.Random(3)
    alphabet = secrets.ALPHABETS["base62"]
    random_runs = ["".join(rng.choice(alphabet) for _ in range(64)) for _ in range(200)]
    passed = [r for r in random_runs if any(p < 1e-3 for *_, p in secrets.battery_spans(r, []))]
    print(len(passed))
    assert len(passed) > 160
    wordy = ["".join(rng.choice(LETTERS).title() for _ in range(9)) for _ in range(500)]
    assert sum(any(p < 1e-4 for *_, p in secrets.battery_spans(r, [])) for r in wordy) == 0


def test_discovery_control():
    counts = [("hex", 20, 100, 10), ("hex", 20, 0, 990), ("base62", 40, 10, 5), ("base62", 40, 0, 100000)]
    assert secrets.thresholds(counts, 1e-3) == {("hex", 20): 100}
    assert secrets.thresholds([], 1e-3) == {}


def test_planted_secret_and_odd_rows(spark):
    rng = random.Random(5)
    secret = "".join(rng.choice(secrets.ALPHABETS["base62"]) for _ in range(80))
    rows = [(1, f"Tion was {secret} of the", 1), (2, None, 2), (3, "", 3), (4, "Tion was the hees", 4), (4, "Tion was the hees", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.find_secrets(docs).collect())
    assert got == [(1, [(9, 89, "random")]), (2, []), (3, []), (4, []), (4, [])]
    assert secrets.find_secrets(docs.limit(0)).collect() == []


def plain_ordinary(run):
    """Chance by a table lookup per sign, multiplied as whole numbers of a logarithm only at the end."""
    total, before = 0.0, None
    for sign in run:
        kind = "0" if sign.isdigit() else "a" if sign.islower() else "A" if sign.isupper() else "-"
        if kind in "aA":
            chance = 0.95 * secrets.PROSE[sign.lower()] / sum(secrets.PROSE.values()) + 0.05 / 26
        else:
            chance = 0.1 if kind == "0" else 0.2
        total += math.log10(chance * (secrets.NEXT_KIND[before][kind] if before else 0.25))
        before = kind
    return total


def plain_battery(run, signs):
    """Joint p-value of the three tests, each written out from its definition."""
    import numpy as np
    n, k = len(run), len(signs)
    values = np.array([signs.index(c) for c in run])
    counts = np.bincount(values, minlength=k)
    chi2 = float(((counts - n / k) ** 2 / (n / k)).sum())
    spread = 2 * (n - 1) / n / (9 * (k - 1))
    p1 = math.erfc(abs((chi2 / (k - 1)) ** (1 / 3) - 1 + spread) / math.sqrt(spread) / math.sqrt(2))
    above = values >= np.sort(values)[n // 2]
    n1 = int(above.sum())
    p2 = p3 = 0.0
    if 0 < n1 < n:
        mean = 1 + 2 * n1 * (n - n1) / n
        variance = (mean - 1) * (mean - 2) / (n - 1)
        stretches = 1 + int((above[1:] != above[:-1]).sum())
        p2 = math.erfc(abs(stretches - mean) / math.sqrt(2 * variance)) if variance > 0 else 1.0
    centred = values - values.mean()
    if (centred ** 2).sum():
        r = float((centred[1:] * centred[:-1]).sum() / (centred ** 2).sum())
        p3 = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    product = max(p1, 1e-100) * max(p2, 1e-100) * max(p3, 1e-100)
    x = -math.log(product)
    return min(1.0, product * (1 + x + x * x / 2))


def plain_added(texts, rate=1e-2):
    """The battery's spans by a mask of base spans, and discovery control by sorting."""
    strata = defaultdict(list)
    for i, text in enumerate(texts):
        text = text or ""
        masked = list(text)
        for _, start, end in plain_spans(text):
            masked[start:end] = " " * (end - start)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", "".join(masked), re.A):
            core = m[0].rstrip("=")
            if len(core) < 20:
                continue
            name = next(name for name, signs in secrets.ALPHABETS.items() if set(core) <= set(signs))
            signs = secrets.ALPHABETS[name]
            ratio = -len(core) * math.log10(len(signs)) - max(plain_ordinary(core), plain_ordinary(core.swapcase())) - math.log10(9)
            evidence = ratio + math.log10(plain_battery(core, signs)) if ratio > 0 else 0.0
            band = [b for b in (20, 28, 40, 64, 128, 1024) if b <= len(core)][-1]
            strata[name, band].append((math.floor(10 * min(30.0, max(0.0, evidence))), i, m.start(), m.end()))
    added = defaultdict(set)
    for runs in strata.values():
        runs.sort(reverse=True)
        good = [k for k, run in enumerate(runs) if 10 ** (-run[0] / 10) <= rate * sum(r[0] >= run[0] for r in runs) / len(runs)]
        for _, i, start, end in runs[:max(good) + 1 if good else 0]:
            added[i].add(("random", start, end))
    return added


def planted(n, length, seed):
    """Texts of prose and compounds; each of the first ``n`` per encoding holds one random string."""
    rng = random.Random(seed)
    texts, spans = [], defaultdict(list)
    for name, signs in secrets.ALPHABETS.items():
        for _ in range(n):
            run = "".join(rng.choice(signs.rstrip("=")) for _ in range(rng.randrange(length, length + 30)))
            texts.append(f"Tion was {run} of the")
            spans[name].append((len(texts) - 1, 9, 9 + len(run)))
    words = [rng.choice(LETTERS).lower() for _ in range(5000)]
    ordinary = len(texts)
    for style in ("".join, "_".join, "/".join, lambda w: "".join(map(str.title, w)), lambda w: "_".join(w).upper(), lambda w: "".join(w).upper(),
                  lambda w: "-".join(w) + "-2024-07-29-" + str(rng.randrange(10**6))):
        texts += ["the " + style(rng.sample(words, 9)) + " was" for _ in range(150)]
    return texts, spans, ordinary


def test_recall_of_each_encoding_and_false_rate(spark):
    texts, spans, ordinary = planted(60, 32, 17)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {tuple(s)[:2] for s in r.spans} for r in secrets.find_secrets(docs).collect()}
    for name, places in spans.items():
        assert sum((start, end) in got[i] or any(s <= start and e >= end for s, e in got[i]) for i, start, end in places) >= 0.9 * len(places), name
    assert sum(bool(got[i]) for i in range(ordinary, len(texts))) < 0.01 * (len(texts) - ordinary)


@pytest.mark.parametrize("seed", [1, 2])
def test_added_spans_against_plain_ones(spark, seed):
    texts, _, _ = planted(8, 20, seed)
    rng = random.Random(seed)
    signs = secrets.ALPHABETS["base62"]
    mixed = "".join(rng.choice(signs) for _ in range(60))
    texts += [None, "", "AKIA" + "B7" * 8 + "/" + mixed, "0123456789abcdef" * 2 + "/" + mixed + "==", mixed + "token=abcdef", "=" * 30, "-" * 50,
              "a" * 25, "12345678901234567890123", "ACGTGTCAGTCAGTACGATCGATCAGCTACGATCAG", "abcdefghijklmnopqrstuvwxyz0123456789", mixed, mixed]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_added(texts)
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans if s.kind == "random"} for r in secrets.find_secrets(docs).collect()}
    assert {i: spans for i, spans in got.items() if spans} == dict(want)
    assert sum(map(len, got.values())) > 40
    cleaned = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    at = texts.index("AKIA" + "B7" * 8 + "/" + mixed)
    assert got[at] and mixed not in cleaned[at]


def test_added_spans_of_the_table(spark, oracle_dir):
    rows = spark.read.parquet(f"{oracle_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain_added([r.text for r in rows])
    got = {r.doc_id: {s for s in (r.spans or "").split(",") if s.startswith("random")} for r in op3_secrets(spark, oracle_dir).collect()}
    assert got == {r.doc_id: {f"random:{s}:{e}" for _, s, e in want.get(i, ())} for i, r in enumerate(rows)}


def test_battery_is_even_on_uniform_draws():
    rng = random.Random(9)
    for name, signs in secrets.ALPHABETS.items():
        p = [secrets.battery("".join(rng.choice(signs) for _ in range(48)), name) for _ in range(1000)]
        assert 0.35 < sum(x < 0.5 for x in p) / len(p) < 0.65 and sum(x < 0.01 for x in p) / len(p) < 0.05


def test_very_long_texts(spark):
    rng = random.Random(4)
    run = "".join(rng.choices(secrets.ALPHABETS["base62"], k=200_000))
    text = "Tion was " * 200_000 + run + " the hees" + " password=abcdefgh" * 50_000
    [row] = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_assign == 50_000 and Counter(s.kind for s in row.spans) == {"assign": 50_000, "random": 1}
