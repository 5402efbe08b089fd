"""Fill-in-the-middle texts, cut by rank and select over packed bitvectors.

The ends of a batch's units (lines, or characters) are one bitvector of a bit for each byte
of its texts, packed, with a directory of the bits set before each block. Rank at a text's
two ends gives how many units it has; select of two ranks gives the bytes where it is cut;
a second bitvector, of the bytes that begin a character, turns bytes into code points.
Nothing is split, and no object is made for a unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import slices, texts_of

#: What stands before prefix, suffix and middle: fixed values of the format.
MARKS = ("<P>", "<S>", "<M>")
#: Bits of a block of the directory.
BLOCK = 512


class BitVector:
    """Packed bits with a directory: rank and select for many places at once."""

    def __init__(self, bits: np.ndarray) -> None:
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        room = -(-(self.size + 1) // BLOCK) * BLOCK // 8  # one bit more than there are, so that rank(size) has a block
        self.words = np.zeros(room // 8, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        #: Bits set before each block, and in all.
        self.before = np.r_[0, np.cumsum(counts.reshape(-1, BLOCK // 64).sum(axis=1))]

    def _blocks(self, block: np.ndarray) -> np.ndarray:
        return self.words.reshape(-1, BLOCK // 64)[block]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place (0 to size)."""
        at = np.asarray(at, np.int64)
        block, inside = at // BLOCK, at % BLOCK
        kept = np.clip(inside[:, None] - 64 * np.arange(BLOCK // 64), 0, 64)
        low = np.where(kept == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(kept, 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(self._blocks(block) & low).astype(np.int64).sum(axis=1)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The places of the set bits with ``k`` set ones before them."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, "right") - 1
        words = self._blocks(block)
        sums = np.cumsum(np.bitwise_count(words).astype(np.int64), axis=1)
        left = k - self.before[block]
        word = (sums <= left[:, None]).sum(axis=1)
        row = np.arange(len(k))
        left = left - np.where(word > 0, sums[row, np.maximum(word - 1, 0)], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(len(k), 8), axis=1, bitorder="little")
        return block * BLOCK + 64 * word + (np.cumsum(bits, axis=1) == (left + 1)[:, None]).argmax(axis=1)


def unit_ends(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes end a unit: line feeds and the last byte of each text, or the last byte of each character."""
    if unit == "line":
        ends = data == 0x0A
    elif unit == "char":
        ends = np.r_[(data[1:] & 0xC0) != 0x80, True][: len(data)]
    else:
        raise ValueError(f"unit {unit!r} is neither 'line' nor 'char'")
    full = offsets[1:] > offsets[:-1]
    ends[offsets[1:][full] - 1] = True
    return ends


def cuts(column: pa.Array, draws: np.ndarray, unit: str = "line") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number of units n, the two bytes (from the batch's first) where it is cut, and
    the code points of prefix and middle. ``draws`` has two numbers a text, each taken modulo n + 1."""
    data, offsets = texts_of(column)
    ends = BitVector(unit_ends(data, offsets, unit))
    below = ends.rank(offsets)
    n = np.diff(below)
    ranks = np.sort(draws % (n + 1)[:, None], axis=1)
    at = np.repeat(offsets[:-1, None], 2, axis=1)
    some = ranks > 0
    if some.any():
        at[some] = ends.select((below[:-1, None] + ranks - 1)[some]) + 1
    chars = BitVector((data & 0xC0) != 0x80)
    points = np.stack([chars.rank(x) for x in (offsets[:-1], at[:, 0], at[:, 1])], axis=1)
    return n, at, points[:, 1] - points[:, 0], points[:, 2] - points[:, 1]


def draw(key: Column, seed: int) -> list[Column]:
    """The first four groups of eight hexadecimal digits of sha256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, rate: int = 100, spm: int = 50, seed: int = 7, unit: str = "line", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text cut into prefix, middle and suffix at two of its units' ends, and put in another order.

    The draws depend on key and seed only. ``rate`` percent of the texts are transformed, of
    these ``spm`` percent with the suffix first; a text that is empty or holds one of ``MARKS``
    stays plain. Null texts count as empty; null keys draw as an empty key; repeated rows each
    give their row, with the same cuts if the texts are equal; texts of any length are cut whole;
    an empty table gives no rows; other columns are not read. Returns key, n (units), form (plain,
    psm or spm), prefix_chars, middle_chars (code points, null if plain), output.
    """
    marks = [m.encode() for m in MARKS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = texts_of(part.column("text"))
                raw = data.tobytes()
                draws = np.stack([part.column(f"h{i}").to_numpy() for i in range(1, 5)], axis=1)
                n, at, prefix, middle = cuts(part.column("text"), draws[:, :2], unit)
                forms, texts = [], []
                turned = (draws[:, 2] % 100 < rate) & (offsets[1:] > offsets[:-1])
                for a, b, (x, y), change, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), at.tolist(), turned.tolist(), (draws[:, 3] % 100 < spm).tolist(), strict=True):
                    if not change or any(raw.find(m, a, b) >= 0 for m in marks):
                        forms.append("plain")
                        texts.append(raw[a:b])
                    elif last:
                        forms.append("spm")
                        texts.append(b"".join((marks[1], raw[y:b], marks[0], raw[a:x], marks[2], raw[x:y])))
                    else:
                        forms.append("psm")
                        texts.append(b"".join((marks[0], raw[a:x], marks[1], raw[y:b], marks[2], raw[x:y])))
                plain = np.array([f == "plain" for f in forms], bool)
                columns = [part.column("key"), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draw(F.col(key), seed), 1)))
    out = rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone: the three pieces between the marks, in their old order."""
    pieces = F.split(F.substring(output, F.lit(len(MARKS[0]) + 1), F.length(output)), "|".join(MARKS), -1)
    order = lambda *at: F.concat(*(F.get(pieces, F.lit(i)) for i in at))
    return F.when(form == "psm", order(0, 2, 1)).when(form == "spm", order(1, 2, 0)).otherwise(output)


def oracle_sql(seed: int = 7, rate: int = 100, spm: int = 50) -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, [('0x' || h[8 * i + 1:8 * i + 8])::UBIGINT::BIGINT FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, len(l)::BIGINT AS n, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS b FROM l),
p AS (SELECT doc_id, t, n, array_to_string(l[1:a], '') AS x, array_to_string(l[a + 1:b], '') AS y, array_to_string(l[b + 1:], '') AS z,
  CASE WHEN t = '' OR contains(t, '{MARKS[0]}') OR contains(t, '{MARKS[1]}') OR contains(t, '{MARKS[2]}') OR h[3] % 100 >= {rate} THEN 'plain' WHEN h[4] % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{MARKS[0]}' || x || '{MARKS[1]}' || z || '{MARKS[2]}' || y ELSE '{MARKS[1]}' || z || '{MARKS[0]}' || x || '{MARKS[2]}' || y END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
