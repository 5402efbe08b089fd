"""A quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its words, and the form of each: its case and digits, what stands between
it and the next word, and whether it repeats the word before. Both are hashed to buckets and
weighed by square roots of counts and inverse document frequencies over all documents; words
count less than forms. The singular vectors of a bounded sample of labelled texts span the
latent space. The sample's vectors go to all tasks, each document's vector is multiplied with
all of them, in blocks, and the nearest ones vote with weights that grow with their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import persist_table
from lodestone.llm.words import ALNUM, Words, map_texts, mix, slices, split_words, texts_of

#: Buckets of words, and of forms; the words' part in a text's vector, and the dimensions of the latent space.
WORDS, FORMS = 4096, 1024
WORD_PART, DIMENSIONS = 0.3, 32
#: Documents whose cosines are formed at once.
ROWS = 1024


def bucket_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of a batch's texts, in that order; buckets of forms follow those of words."""
    data, offsets = texts_of(column)
    words = split_words(column, ALNUM, lower=True)
    word, text = words.hashes(), words.text
    until = np.minimum(np.r_[words.start[1:], len(data)], offsets[1:][text]) if len(word) else words.end
    between = Words(words.data, words.end, until, words.first).hashes(1)
    within = lambda low, high: np.r_[0, np.cumsum((data >= low) & (data <= high))]
    upper, digit = (x[words.end] - x[words.start] for x in (within(0x41, 0x5A), within(0x30, 0x39)))
    shape = np.where(digit > 0, 3, np.minimum(upper, 2))
    again = np.r_[False, (word[1:] == word[:-1]) & (text[1:] == text[:-1])] if len(word) else np.zeros(0, bool)
    form = mix(between ^ mix((2 * shape + again + 11).astype(np.uint64)))
    at = [(h >> np.uint64(40)).astype(np.int64) % n for h, n in ((word, WORDS), (form, FORMS))]
    size = WORDS + FORMS
    pair, count = np.unique(np.r_[text * size + at[0], text * size + WORDS + at[1]], return_counts=True)
    return pair // size, pair % size, count


def weighed(text: np.ndarray, bucket: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """The values of a text's buckets: words and forms have each one length in all texts that have any."""
    value = np.sqrt(count) * idf[bucket]
    group = 2 * text + (bucket >= WORDS)
    norm = np.sqrt(np.bincount(group, value * value, 2 * n))
    return value / np.maximum(norm, 1e-12)[group] * np.where(bucket < WORDS, WORD_PART, 1.0)


@dataclass
class Voters:
    """Inverse document frequencies, the latent space, and the labelled texts' vectors in it."""

    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    neighbours: int
    power: float

    def latent(self, text: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Unit vectors of texts (zero for those without terms, or with none in the space)."""
        out = np.zeros((n, self.space.shape[1]))
        if len(text):
            value = weighed(text, bucket, count, self.idf, n)
            head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            out[text[head]] = np.add.reduceat(value[:, None] * self.space[bucket], head, axis=0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 1e-9, norm, np.inf)

    def votes(self, vectors: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest neighbours, all that are as near as the last
        one included; the share among all where none has a positive cosine."""
        prior = self.label.mean() if len(self.label) else 0.5
        out = np.full(len(vectors), prior)
        if not len(self.label):
            return out
        k = min(self.neighbours, len(self.label))
        for at in range(0, len(vectors), ROWS):
            near = np.maximum(np.round(vectors[at : at + ROWS] @ self.vectors.T, 6), 0)
            last = np.partition(near, -k, axis=1)[:, -k, None]
            weight = np.where(near >= last, near, 0) ** self.power
            total = weight.sum(axis=1)
            some = np.flatnonzero(total > 0)
            out[at + some] = (weight @ self.label)[some] / total[some]
        return np.clip(out, 0, 1)


def latent_space(sample: np.ndarray, dimensions: int = DIMENSIONS, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """The first right singular vectors of ``sample``, by powers of its range from a random start."""
    rng = np.random.default_rng(seed)
    k = min(dimensions, *sample.shape)
    q = np.linalg.qr(sample @ rng.standard_normal((sample.shape[1], min(k + 16, len(sample)))).astype(sample.dtype))[0]
    for _ in range(rounds):
        q = np.linalg.qr(sample @ (sample.T @ q))[0]
    return np.linalg.svd(q.T @ sample, full_matrices=False)[2][:k].T


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts of ``docs`` (text) have each bucket, and how many there are: summed in tasks, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(WORDS + FORMS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                sums += np.bincount(bucket_counts(part.column("text"))[1], minlength=len(sums))
                rows += part.num_rows
        bucket = np.r_[np.flatnonzero(sums), len(sums)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.r_[sums, rows][bucket])], ["bucket", "df"])

    found = docs.select("text").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(WORDS + FORMS + 1, np.int64)
    for r in found:
        out[r.bucket] = r.df
    return out[:-1], int(out[-1])


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> pa.Table:
    """(key, label, buckets, counts): at most ``fit_rows`` labelled texts of smallest hash outside the held-out fold."""
    fold = F.crc32(F.col("key").cast("string").cast("binary")) % 5
    known = labels.filter((fold != 0) & F.col("label").isin(0, 1)).groupBy("key").agg(F.max(F.col("label").cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(fit_rows)
    texts = docs.filter(F.length("text") > 0).join(F.broadcast(known), "key").groupBy("key").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("row"))

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        text, bucket, count = bucket_counts(part.column("text"))
        cut = np.searchsorted(text, np.arange(part.num_rows + 1))
        blobs = [pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (bucket.astype(np.uint16), count.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), *blobs], ["key", "label", "buckets", "counts"])

    kind = docs.schema["key"].dataType.simpleString()
    hashed = persist_table(map_texts(texts.select("key", "row.label", "row.text"), kernel, f"key {kind}, label int, buckets binary, counts binary"), "quality-sample")
    return hashed.orderBy(F.xxhash64("key"), "key").toArrow()


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, neighbours: int = 11, power: float = 8.0) -> Voters:
    """The voters of ``docs`` (key, text) and ``labels`` (key, label)."""
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + np.where(np.arange(len(df)) < WORDS, 0, 0.3)
    sample = fit_sample(docs, labels, fit_rows)
    buckets = [np.frombuffer(x, np.uint16).astype(np.int64) for x in sample["buckets"].to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in sample["counts"].to_pylist()]
    rows = len(buckets)
    if not rows:
        return Voters(idf, np.zeros((len(df), 1)), np.zeros((0, 1)), np.zeros(0), neighbours, power)
    text, bucket, count = np.repeat(np.arange(rows), [len(x) for x in buckets]), np.concatenate(buckets), np.concatenate(counts)
    matrix = np.zeros((rows, len(df)), np.float32)
    matrix[text, bucket] = weighed(text, bucket, count, idf, rows)
    out = Voters(idf, latent_space(matrix).astype(float), np.zeros((0, 1)), np.zeros(0), neighbours, power)
    vectors = out.latent(text, bucket, count, rows)
    some = np.linalg.norm(vectors, axis=1) > 0
    out.vectors, out.label = vectors[some], sample["label"].to_numpy().astype(float)[some]
    return out


def score_quality(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, neighbours: int = 11, power: float = 8.0, least: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Scores every whole text; one row for each row, no shuffle of the texts.

    At most ``fit_rows`` labelled rows of smallest hash vote, whatever the size of the tables; the
    terms' document frequencies are those of all documents. A text without terms (null, empty, or
    without letters and digits) has no neighbours and the share of label 1 among the voters as its
    score; without voters that is 0.5. Labels that are null or neither 0 nor 1 don't count, of
    repeated ones the larger does, of rows that repeat a labelled key the text of smallest hash
    votes. Neighbours that are as near as the last one vote as well. Null keys and repeated rows
    each give their row; texts of any length are read whole; an empty table gives no rows; other
    columns are not read. Returns key, held_out (crc32 of the key as text mod 5 is 0; false for a
    null key), score, predicted (1 from ``least`` on).
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    voters = docs.sparkSession.sparkContext.broadcast(fit(rows, labels.select(F.col(key).alias("key"), F.col(label).alias("label")), fit_rows=fit_rows, neighbours=neighbours, power=power))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = voters.value.votes(voters.value.latent(*bucket_counts(part.column("text")), part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(score), pa.array((score >= least).astype(np.int32))], ["key", "score", "predicted"])

    out = rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(F.col("key").alias(key), held.alias("held_out"), "score", "predicted")
