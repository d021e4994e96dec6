"""Fill-in-middle transformation: each text is cut at two of its unit boundaries and its parts are put in another order.

A unit is a run of letters A-Z and a-z, or any other single code point. Where a text is cut, and into which form, is decided by hashes of its
doc_id, so reruns agree. ``Wavelet`` is a wavelet matrix over classes of the UTF-8 bytes: byte inside a code point, other sign, letter that
begins a run, letter that continues one. The units before a byte are the sum of two of its rank queries, the code points a sum of three;
a cut behind a number of units is found by bisection on these ranks, for all texts of a stretch at once.

Forms: ``plain`` (the text), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle), each part behind its mark. A text that holds
a mark stays plain, so ``restored`` rebuilds every text from its output and form alone.

Null texts count as empty; empty texts stay plain. Rows without doc_id are cut by the hash of no number. Repeated rows are returned each.
Texts of any length are taken whole; a text longer than a stretch is a stretch by itself. An empty table gives an empty
result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.llm import bytescan

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # per cent of the hash: plain from here on; of the others, spm below
_INSIDE, _OTHER, _BEGINS, _GOES_ON = range(4)
_OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Wavelet:
    """Wavelet matrix of values below ``2 ** bits``: how often a value stands before a place, in ``bits`` steps."""

    def __init__(self, values: np.ndarray, bits: int = 2):
        self.bits, self.levels = bits, []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, int(len(values) - ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, below = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & below)

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before each of the places ``at``."""
        low, high = np.zeros_like(at), at
        for depth, (words, before, zeros) in enumerate(self.levels):
            low_ones, high_ones = self._ones(words, before, low), self._ones(words, before, high)
            if value >> (self.bits - 1 - depth) & 1:
                low, high = zeros + low_ones, zeros + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return high - low


def byte_classes(chunk: bytescan.Chunk) -> np.ndarray:
    data = chunk.data
    lowered = data | 0x20
    letter = (lowered >= ord("a")) & (lowered <= ord("z"))
    follows = np.zeros(len(data), bool)
    follows[1:] = letter[:-1]
    opens = chunk.bounds[:-1]
    follows[opens[opens < len(data)]] = False
    classes = np.where(letter, np.where(follows, _GOES_ON, _BEGINS), np.where(data & 0xC0 == 0x80, _INSIDE, _OTHER))
    return classes.astype(np.uint8)


class Boundaries:
    """Unit and code point boundaries of a stretch of texts."""

    def __init__(self, chunk: bytescan.Chunk):
        self.size = len(chunk.data)
        self.wavelet = Wavelet(byte_classes(chunk))

    def units(self, at: np.ndarray) -> np.ndarray:
        """Units that begin before each place."""
        return self.wavelet.rank(_OTHER, at) + self.wavelet.rank(_BEGINS, at)

    def signs(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before each place."""
        return self.units(at) + self.wavelet.rank(_GOES_ON, at)

    def behind(self, count: np.ndarray) -> np.ndarray:
        """The place behind the first ``count`` units of the stretch: where the next one begins, or the end."""
        low, high = np.zeros_like(count), np.full_like(count, self.size)
        while (low < high).any():
            middle = (low + high) >> 1
            reached = self.units(np.minimum(middle + 1, self.size)) > count
            open_ = low < high
            high = np.where(open_ & reached, middle, high)
            low = np.where(open_ & ~reached, middle + 1, low)
        return low


def _transform(batches):
    """Rows doc_id, text, h1 to h4 as rows of ``_OUTPUT``."""
    for batch in batches:
        hashes = [batch.column(i).to_numpy() for i in range(2, 6)]
        for chunk in bytescan.chunks(batch.column(1)):
            rows = slice(chunk.first, chunk.first + len(chunk.bounds) - 1)
            h1, h2, h3, h4 = (h[rows] for h in hashes)
            found = Boundaries(chunk)
            bounds = chunk.bounds.astype(np.int64)
            begins, ends = bounds[:-1], bounds[1:]
            base = found.units(begins)
            n = found.units(ends) - base
            first, second = h1 % (n + 1), h2 % (n + 1)
            cuts = [np.minimum(found.behind(base + k), ends) for k in (np.minimum(first, second), np.maximum(first, second))]
            signs = [found.signs(at) for at in (begins, *cuts)]
            data = chunk.data.tobytes()
            forms, outputs = [], []
            for i, (begin, one, two, end) in enumerate(zip(begins.tolist(), cuts[0].tolist(), cuts[1].tolist(), ends.tolist(), strict=True)):
                text = data[begin:end]
                if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3[i] % 100 >= PLAIN_FROM:
                    forms.append("plain")
                    outputs.append(text)
                    continue
                prefix, middle, suffix = data[begin:one], data[one:two], data[two:end]
                if h4[i] % 100 < SPM_BELOW:
                    forms.append("spm")
                    outputs.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
            plain = np.array([form == "plain" for form in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(rows.start, rows.stop - rows.start), pa.array(n), pa.array(forms, pa.string()),
                 pa.array(signs[1] - signs[0], mask=plain), pa.array(signs[2] - signs[1], mask=plain),
                 pa.array(outputs, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, n (units), form, prefix_chars, middle_chars (null where plain), output."""
    sha = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    groups = [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *groups)
    return rows.mapInArrow(_transform, _OUTPUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))) \
        .when(form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))).otherwise(output)


ORACLE = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
    FROM documents),
numbers AS (
    SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
           CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
           CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM hashed),
cut AS (
    SELECT doc_id, text, n,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
           array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
           array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix
    FROM numbers)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
