"""Secret scans: fixed patterns, and a battery of randomness tests for strings of unknown kinds.

Base kinds are found by pattern, leftmost first and without overlap inside a kind; a match that is too short is dropped:
``assign`` (a value given to a password, secret, token or key), ``access`` (AKIA keys), ``hex`` (long lower-case hex).

The battery looks at every unbroken run of 20 or more letters, digits and ``+/_=-``; what base spans leave of a run is looked at by
itself. The narrowest fitting alphabet is inferred. Two questions are put:

* Does the run look like uniform draws from that alphabet? Chi-squared of the counts of signs, Wald-Wolfowitz runs about the middle
  sign and the serial correlation of neighbours each give a two-sided p-value, which Fisher's rule joins.
* Is it an ordinary string instead? Null hypothesis: a chain of kinds of signs (small letters, capitals, digits, others) that seldom
  changes, letters as frequent as in prose. The same chain with small letters and capitals exchanged is ordinary, too.

The evidence is the likelihood ratio of uniform against ordinary, divided by the number of alphabets (as the fitting one is chosen) and
multiplied by the joint p-value. Under the null hypothesis its mean is at most one at every length, so one divided by it is a valid p-value
without approximation: a run that is unlike prose but not uniform either (rules of signs, counting, repeats) has no evidence left.
Benjamini-Hochberg control picks the runs to report, separately by alphabet and length band, from counts over all documents.

Null and empty texts have no spans. Repeated rows are scanned each; an empty table gives an empty result. Columns other
than those named are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.llm.shared import in_arrow, materialized, rows_in_arrow

KINDS = ("assign", "access", "hex")
BATTERY = "random"
#: Stands in redacted texts for a secret.
MARK = "<secret>"

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.ASCII)
#: Words of which one stands in every match of ASSIGN; looked for first, as that is much faster.
ASSIGN_WORDS = ("passw", "secret", "token", "api")

DIGITS, SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from narrow to wide.
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "small": SMALL,
    "CAPITAL": SMALL.upper(),
    "base32": SMALL.upper() + "234567",
    "base36": DIGITS + SMALL,
    "BASE36": DIGITS + SMALL.upper(),
    "base62": DIGITS + SMALL.upper() + SMALL,
    "base64": SMALL.upper() + SMALL + DIGITS + "+/_-=",
}
#: Per cent of the letters e t a o i n s h r d l c u m w f g y p b v k j x q z in prose.
PROSE = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (
    12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.15,
    0.15, 0.1, 0.07), strict=True))
#: Share of letters that are drawn alike, whatever the language.
ANY_LETTER = 0.05
#: Chances in ordinary strings of the next sign's kind (small letter, capital, digit, other), by the kind before.
NEXT_KIND = {
    "a": {"a": 0.86, "A": 0.05, "0": 0.04, "-": 0.05},
    "A": {"a": 0.46, "A": 0.44, "0": 0.05, "-": 0.05},
    "0": {"a": 0.06, "A": 0.05, "0": 0.80, "-": 0.09},
    "-": {"a": 0.35, "A": 0.15, "0": 0.20, "-": 0.30},
}

#: -log10 of the p-values is counted in steps of 1/10, up to this many steps.
STEPS = 300
BANDS = (20, 28, 40, 64, 128, 1024)


def infer_alphabet(run: str) -> str:
    signs = set(run)
    return next(name for name, alphabet in ALPHABETS.items() if signs <= set(alphabet))


def length_band(n: int) -> int:
    return max(b for b in BANDS if b <= n)


def _kind(sign: str) -> str:
    return "0" if sign in DIGITS else "a" if sign in SMALL else "A" if sign.lower() in SMALL else "-"


def _sign_chance(sign: str) -> float:
    """Of a sign among those of its kind, in ordinary strings."""
    kind = _kind(sign)
    if kind in "aA":
        return (1 - ANY_LETTER) * PROSE[sign.lower()] / sum(PROSE.values()) + ANY_LETTER / len(SMALL)
    return 1 / len(DIGITS) if kind == "0" else 1 / len("+/_-=")


_SIGNS = ALPHABETS["base64"]
_FIRST = {sign: math.log(_sign_chance(sign) / len(NEXT_KIND)) for sign in _SIGNS}
_NEXT = {before + sign: math.log(_sign_chance(sign) * NEXT_KIND[_kind(before)][_kind(sign)]) for before in _SIGNS for sign in _SIGNS}


def ordinary_likelihood(run: str) -> float:
    """Natural logarithm of the chance of ``run`` among ordinary strings of its length, in small letters or in capitals, whichever is likelier."""
    return max(_FIRST[case[0]] + sum(_NEXT[case[i:i + 2]] for i in range(len(case) - 1)) for case in (run, run.swapcase()))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(run: str, alphabet: str) -> float:
    """Two-sided p-value of the chi-squared statistic of the counts of signs, uniform draws assumed.

    Its mean and variance for this number of signs are exact; the cube root of a gamma variable with these is nearly normal.
    """
    k, n = len(ALPHABETS[alphabet]), len(run)
    if n < 2:
        return 1.0
    chi2 = sum(c * c for c in Counter(run).values()) * k / n - n
    mean, variance = k - 1, 2 * (k - 1) * (n - 1) / n
    spread = variance / (9 * mean * mean)
    return _two_sided((math.cbrt(chi2 / mean) - (1 - spread)) / math.sqrt(spread))


def _ranks(run: str, alphabet: str) -> list[int]:
    rank = {sign: i for i, sign in enumerate(ALPHABETS[alphabet])}
    return [rank[sign] for sign in run]


def runs_test(run: str, alphabet: str) -> float:
    """Two-sided p-value of the number of stretches above and below the middle sign; 0 if there is but one stretch."""
    values = _ranks(run, alphabet)
    middle = sorted(values)[len(values) // 2]
    above = [v >= middle for v in values]
    n1, n2 = sum(above), len(above) - sum(above)
    if not n1 or not n2:
        return 0.0
    n = n1 + n2
    mean = 1 + 2 * n1 * n2 / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    stretches = 1 + sum(a != b for a, b in zip(above, above[1:], strict=False))
    return _two_sided((stretches - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_correlation(run: str, alphabet: str) -> float:
    """Two-sided p-value of the correlation of neighbouring signs; 0 if all are the same."""
    values = _ranks(run, alphabet)
    n = len(values)
    mean = sum(values) / n
    square = sum((v - mean) ** 2 for v in values)
    if n < 3 or not square:
        return 0.0
    r = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:], strict=False)) / square
    return _two_sided((r + 1 / n) * math.sqrt(n))


def battery(run: str, alphabet: str) -> float:
    """Fisher's joint p-value of the three tests, uniform draws assumed."""
    product = 1.0
    for test in (uniformity, runs_test, serial_correlation):
        product *= max(1e-100, test(run, alphabet))
    x = -math.log(product)
    return min(1.0, product * (1 + x + x * x / 2))


def randomness(run: str, alphabet: str) -> float:
    """P-value of an ordinary string having as much evidence of being random as ``run``; for long runs at least 1e-300."""
    ratio = -len(run) * math.log(len(ALPHABETS[alphabet])) - ordinary_likelihood(run) - math.log(len(ALPHABETS))
    if ratio <= 0:
        return 1.0
    return math.exp(-max(0.0, min(690.0, ratio + math.log(battery(run, alphabet)))))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    lower = text.lower()
    found = []
    if any(word in lower for word in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def parts_outside(start: int, end: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What the spans, which come by start, leave of the stretch from ``start`` to ``end``."""
    parts = []
    for s, e, _ in base:
        if s >= end:
            break
        if e > start:
            if s > start:
                parts.append((start, s))
            start = max(start, e)
    return [*parts, (start, end)] if start < end else parts


def battery_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int, float]]:
    """(start, end, alphabet, length band, p-value) of every run, or part of one, outside the base spans."""
    found, near, at = [], [], 0
    for m in RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            near.append(base[at])
            at += 1
        near = [span for span in near if span[1] > m.start()]
        for start, end in parts_outside(m.start(), m.end(), near):
            core = text[start:end].rstrip("=")
            if len(core) >= BANDS[0]:
                alphabet = infer_alphabet(core)
                found.append((start, end, alphabet, length_band(len(core)), randomness(core, alphabet)))
    return found


def _step(p: float) -> int:
    return min(STEPS, int(-10 * math.log10(max(p, 1e-300))))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_FOUND = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
          "base array<struct<start:int,end:int,kind:string>>, "
          "runs array<struct<start:int,end:int,alphabet:string,band:int,step:int>>")


def _scan(batches):
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs"]
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    runs_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("alphabet", pa.string()),
                                    ("band", pa.int32()), ("step", pa.int32())]))
    for batch in batches:
        bases, runs = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            bases.append(base := base_spans(text))
            runs.append([(s, e, a, b, _step(p)) for s, e, a, b, p in battery_spans(text, base)])
        kinds = [Counter(kind for _, _, kind in base) for base in bases]
        columns = [batch.column(0)] + [pa.array([k[kind] for k in kinds], pa.int64()) for kind in KINDS]
        columns.append(pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base in bases]))
        columns.append(pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in base] for base in bases], base_type))
        columns.append(pa.array([[dict(zip(("start", "end", "alphabet", "band", "step"), r, strict=True)) for r in row]
                                 for row in runs], runs_type))
        yield pa.RecordBatch.from_arrays(columns, names=names)


def thresholds(counts: list[tuple[str, int, int, int]], rate: float) -> dict[tuple[str, int], int]:
    """Benjamini-Hochberg on binned p-values: per (alphabet, band) the lowest step that is still reported."""
    strata: dict[tuple[str, int], Counter] = {}
    for alphabet, band, step, n in counts:
        strata.setdefault((alphabet, band), Counter())[step] += n
    lowest = {}
    for stratum, steps in strata.items():
        total, so_far = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            so_far += steps[step]
            if 10 ** (-step / 10) <= rate * so_far / total:
                lowest[stratum] = step
    return lowest


def find_secrets(documents: DataFrame, rate: float = 1e-2) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (structs start, end, kind, by start).

    ``rate`` is the false-discovery rate of the battery. The counts by alphabet, band and step have a fixed number of rows.
    """
    found = materialized(
        in_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan, _FOUND), "secrets")
    run = F.col("run")
    counts = found.select(F.explode("runs").alias("run")).groupBy(run.alphabet.alias("a"), run.band.alias("b"), run.step.alias("s")).count()
    lowest = thresholds([tuple(row) for row in counts.collect()], rate)

    def reported(run: Column) -> Column:
        chosen = F.lit(False)
        for (alphabet, band), step in sorted(lowest.items()):
            chosen = chosen | ((run.alphabet == alphabet) & (run.band == band) & (run.step >= step))
        return chosen

    extra = F.transform(F.filter("runs", reported), lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), F.lit(BATTERY).alias("kind")))
    order = F.create_map(*[F.lit(x) for i, kind in enumerate((*KINDS, BATTERY)) for x in (kind, i)])
    keyed = F.transform(F.concat("base", extra), lambda s: F.struct(
        s["start"].alias("start"), F.element_at(order, s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.transform(
        F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def redacted_text(text: str, spans: list[tuple[int, int]], mark: str = MARK) -> str:
    """``text`` with every span, or union of spans that touch, replaced by ``mark``."""
    out, at, covered = [], 0, -1
    for start, end in sorted(spans):
        if start > covered:
            out += [text[at:start], mark]
        covered = max(covered, end)
        at = covered
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, rate: float = 1e-2) -> DataFrame:
    """``documents`` with all secrets in ``text`` replaced, and ``n_chars``, if there is such a column, counted anew.

    Documents without secrets stay as they are. The texts are read twice: to count the battery's p-values, and to replace.
    """
    counts_type = "alphabet string, band int, step int, n long"

    def count(batches):
        n = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    n.update((alphabet, band, _step(p)) for _, _, alphabet, band, p in battery_spans(text, base_spans(text)))
        keys = list(n)
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        columns = list(zip(*[(*key, n[key]) for key in keys], strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["alphabet", "band", "step", "n"])

    counts = in_arrow(documents.select("text"), count, counts_type).groupBy("alphabet", "band", "step").agg(F.sum("n")).collect()
    lowest = thresholds([tuple(row) for row in counts], rate)
    text_at = documents.columns.index("text")
    chars_at = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def replace(batches):
        for batch in batches:
            texts, changed = batch.column(text_at).to_pylist(), {}
            for i, text in enumerate(texts):
                if text:
                    base = base_spans(text)
                    spans = [(s, e) for s, e, _ in base]
                    spans += [(s, e) for s, e, a, b, p in battery_spans(text, base) if _step(p) >= lowest.get((a, b), STEPS + 1)]
                    if spans:
                        changed[i] = redacted_text(text, spans)
            if changed:
                columns = batch.columns
                columns[text_at] = pa.array([changed.get(i, text) for i, text in enumerate(texts)], columns[text_at].type)
                if chars_at is not None:
                    sizes = columns[chars_at].to_pylist()
                    columns[chars_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(sizes)], columns[chars_at].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return rows_in_arrow(documents, replace)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
