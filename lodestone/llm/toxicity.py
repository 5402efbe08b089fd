"""A convolutional text classifier in numpy.

Words are hashed to embeddings, one table for whole words and one for word beginnings.
Filters of several widths run over the word sequence of a whole text, each is pooled by
its maximum, and a logistic layer gives the score. The first embedding dimensions start
from how much more often a bucket occurs in texts of label 1 than expected; then all
weights are trained by Adam on logistic loss. Thresholds are calibrated by language on all
labelled rows that training and the held-out fold leave; language is no input of the score.

The classifier is fitted on a bounded sample, ``fit_rows`` labelled rows of smallest
hash with at most ``fit_words`` words; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import persist_table
from lodestone.llm.words import ALNUM, Words, map_texts, slices, split_words

#: Buckets of each embedding table, dimensions, and filters of each width.
BUCKETS, DIM, FILTERS = 1 << 16, 4, 6
WIDTHS = (1, 2, 3)
#: Bytes of a word's beginning.
BEGIN = 6
#: Labelled rows that calibration needs in a language, of each label, to have its own threshold.
CALIBRATE = 15


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    begin = Words(words.data, words.start, np.minimum(words.end, words.start + BEGIN), words.first)
    return ((words.hashes() >> np.uint64(48)).astype(np.int64), (begin.hashes(1) >> np.uint64(48)).astype(np.int64))


@dataclass
class Network:
    word: np.ndarray
    begin: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: np.ndarray
    #: Keys of the rows that the weights are trained on.
    trained: list

    @classmethod
    def fresh(cls, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:  # one filter follows each of the first two dimensions
            f[:, 0, 0] += 1
            f[:, 1, 1] += 1
        n = FILTERS * len(WIDTHS)
        return cls(np.zeros((BUCKETS, DIM), np.float32), np.zeros((BUCKETS, DIM), np.float32), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(n, 0.1, np.float32), np.full(1, -2, np.float32), [])

    def pooled(self, a: np.ndarray, b: np.ndarray, first: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of each filter over each text, and the words they start at. Past a text's end lie zeros."""
        n = len(first) - 1
        full = np.flatnonzero(np.diff(first) > 0)
        out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        place = np.full(out.shape, -1, np.int64) if where else None
        if not len(full):
            return out, place
        x = self.word[a] + self.begin[b]
        text = np.repeat(np.arange(n), np.diff(first))
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            y = x @ f[0] + self.bias[k]
            for j in range(1, w):
                part = x[j:] @ f[j]
                part[text[j:] != text[:-j]] = 0
                y[: len(part)] += part
            s = slice(k * FILTERS, (k + 1) * FILTERS)
            top = np.maximum.reduceat(y, first[:-1][full], axis=0)
            out[full, s] = np.maximum(top, 0)
            if place is not None:
                row, col = np.nonzero(y == out[text, s])
                keep = np.flatnonzero(np.r_[True, np.diff(text[row] * FILTERS + col) != 0]) if len(row) else row
                place[text[row[keep]], k * FILTERS + col[keep]] = row[keep]
        return out, place

    def score(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.pooled(a, b, first)[0].astype(np.float64) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _start(net: Network, table: np.ndarray, column: int, which: np.ndarray, text: np.ndarray, label: np.ndarray) -> None:
    """Standardised surplus of a bucket's texts of label 1, in one dimension of its embedding."""
    pair = np.unique(which.astype(np.int64) * len(label) + text)
    bucket, owner = pair // len(label), pair % len(label)
    seen = np.bincount(bucket, minlength=BUCKETS)
    hits = np.bincount(bucket, weights=label[owner], minlength=BUCKETS)
    rate = label.mean()
    table[:, column] = (hits - rate * seen) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1)) / 3
    table[seen < 2, column] = 0


def fit(batch: pa.Table, rounds: int = 6, size: int = 64, rate: float = 0.01, penalty: float = 1e-4, seed: int = 3) -> Network:
    """Trains on ``batch`` (key, label, turn, words, begins), but for a fifth of its rows, which is left to calibration.

    Rows are taken in order of ``turn``; ``words`` and ``begins`` are bucket numbers as bytes.
    """
    net = Network.fresh(seed)
    turn, keys = batch["turn"].to_pylist(), list(map(str, batch["key"].to_pylist()))
    batch = batch.take(pa.array(sorted(range(batch.num_rows), key=lambda i: (turn[i], keys[i])), pa.int64()))
    label = batch["label"].to_numpy().astype(np.float32)
    if not len(label) or label.min() == label.max():
        net.shift[:] = 0 if not len(label) else (4 if label[0] else -4)
        return net
    rows = [[np.frombuffer(x, np.uint16) for x in batch[c].to_pylist()] for c in ("words", "begins")]
    a, b = (np.concatenate(x) for x in rows)
    counts = np.array([len(x) for x in rows[0]])
    first, text = np.r_[0, np.cumsum(counts)], np.repeat(np.arange(len(label), dtype=np.int32), counts)
    held = np.arange(len(label)) % 5 == 0
    train = np.flatnonzero(~held)
    inside = ~held[text]
    for table, column, which in ((net.word, 0, a), (net.begin, 1, b)):
        _start(net, table, column, which[inside], text[inside], label)
    params = [net.word, net.begin, *net.filters, *net.bias, net.out, net.shift]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    rng = np.random.default_rng(seed)
    step = 0
    for _ in range(max(rounds, min(60, 4000 // max(len(train) // size, 1) // 10))):
        rng.shuffle(train)
        for at in range(0, len(train), size):
            rows = train[at : at + size]
            step += 1
            index = np.concatenate([np.arange(first[i], first[i + 1]) for i in rows])
            local = np.r_[0, np.cumsum(first[rows + 1] - first[rows])]
            wa, wb = a[index], b[index]
            pooled, place = net.pooled(wa, wb, local, True)
            z = pooled @ net.out + net.shift
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows)
            grads = [None, None] + [np.zeros_like(f) for f in net.filters] + [np.zeros_like(x) for x in net.bias] + [pooled.T @ d + penalty * net.out, d.sum(keepdims=True)]
            touched, moved = [], []
            for k, w in enumerate(WIDTHS):
                s = slice(k * FILTERS, (k + 1) * FILTERS)
                i, c = np.nonzero((place[:, s] >= 0) & (pooled[:, s] > 0))
                p = place[i, c + k * FILTERS]
                g = d[i] * net.out[c + k * FILTERS]
                np.add.at(grads[2 + len(WIDTHS) + k], c, g)
                for j in range(w):
                    ok = p + j < local[i + 1]
                    q, gc, cc = p[ok] + j, g[ok], c[ok]
                    x = net.word[wa[q]] + net.begin[wb[q]]
                    np.add.at(grads[2 + k], (j, slice(None), cc), gc[:, None] * x)
                    touched.append(q)
                    moved.append(gc[:, None] * net.filters[k][j][:, cc].T)
                grads[2 + k] += penalty * net.filters[k]
            q, m = np.concatenate(touched), np.concatenate(moved)
            for n, p in enumerate(params):
                if n < 2:  # only the rows that the maxima touch
                    which, back = np.unique((wa, wb)[n][q], return_inverse=True)
                    g = np.zeros((len(which), DIM), np.float32)
                    np.add.at(g, back, m)
                    g += penalty * p[which]
                else:
                    which, g = slice(None), grads[n]
                one, two = state[n]
                one[which] = 0.9 * one[which] + 0.1 * g
                two[which] = 0.99 * two[which] + 0.01 * g * g
                p[which] -= rate * (one[which] / (1 - 0.9**step)) / (np.sqrt(two[which] / (1 - 0.99**step)) + 1e-6)
    net.trained = batch["key"].take(pa.array(np.sort(train))).to_pylist()
    return net


#: Thresholds that are tried; the first with fewest errors is taken.
GRID = (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7)


def calibrate(scored: DataFrame, labels: DataFrame, trained: list, *, key: str, label: str) -> dict[str | None, float]:
    """By language, the threshold of ``GRID`` with fewest errors over all labelled rows outside
    the held-out fold that the weights weren't trained on; None stands for all languages.

    A language with fewer than ``CALIBRATE`` rows of either label has no threshold of its own.
    """
    known = _known(labels, key, label)
    kind = known.schema["key"].dataType.simpleString()
    seen = known.sparkSession.createDataFrame([(k,) for k in trained], f"key {kind}")
    rows = scored.join(known.join(F.broadcast(seen), "key", "left_anti"), "key")
    wrong = [F.count_if((F.col("score") >= t) != (F.col("label") == 1)).alias(f"e{i}") for i, t in enumerate(GRID)]
    counts = rows.rollup("lang").agg(F.grouping("lang").alias("every"), F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"), *wrong)
    found = counts.filter((F.least("n1", "n0") >= CALIBRATE) & ((F.col("every") == 1) | F.col("lang").isNotNull())).collect()
    return {None: 0.5} | {r.lang: GRID[int(np.argmin([r[f"e{i}"] for i in range(len(GRID))]))] for r in found}


def _known(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label) of the labelled keys whose crc32 as text mod 5 isn't 0."""
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % 5
    return labels.filter((fold != 0) & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))


def fit_sample(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, fit_words: int = 8_000_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> pa.Table:
    """At most ``fit_rows`` labelled texts whose crc32(key as text) mod 5 isn't 0, as bucket numbers.

    Tasks hash the texts; the driver gets two bytes for each word and table. Rows are
    taken whole, in order of hash, while they have ``fit_words`` words in all at most.
    """
    known = _known(labels, key, label)
    known = known.orderBy(F.xxhash64("key"), "key").limit(fit_rows)
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(known), "key").groupBy("key").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("row"))
    turn = F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("row.text")).cast("binary"))

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(part.column("text"), ALNUM, lower=True)
        both = [x.astype(np.uint16) for x in _buckets(words)]
        blobs = [pa.array([x[i:j].tobytes() for i, j in zip(words.first[:-1], words.first[1:], strict=True)], pa.binary()) for x in both]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "label", "turn")), pa.array(words.counts), *blobs], ["key", "label", "turn", "n_words", "words", "begins"])

    kind = docs.schema[key].dataType.simpleString()
    hashed = map_texts(texts.select("key", "row.label", turn.alias("turn"), "row.text"), kernel, f"key {kind}, label int, turn long, n_words long, words binary, begins binary")
    hashed = persist_table(hashed, "toxic-sample")
    sizes = hashed.select("key", "n_words").orderBy(F.xxhash64("key"), "key").toArrow()
    inside = np.flatnonzero(np.cumsum(sizes["n_words"].to_numpy()) <= fit_words)
    if len(inside) < sizes.num_rows:
        chosen = docs.sparkSession.createDataFrame([(k,) for k in sizes["key"].take(pa.array(inside)).to_pylist()], f"key {kind}")
        hashed = hashed.join(F.broadcast(chosen), "key")
    return hashed.select("key", "label", "turn", "words", "begins").toArrow()


def score_toxicity(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, fit_words: int = 8_000_000, key: str = "doc_id", text: str = "text", lang: str | None = "lang", label: str = "toxic", keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores every whole text; one row for each row, no shuffle of the texts.

    Null and empty texts are scored as texts without words; null keys and repeated rows
    each give their row; an empty table gives none. Labels that are null or neither 0 nor
    1 don't count; without labels of both kinds scores are constant. A null or unknown
    language has the threshold of all. Columns named in ``keep`` are passed on, others not
    read. Returns key, held_out (crc32 of the key as text mod 5 is 0; false for a null
    key), score, predicted (1 from 0.5 on), threshold (by language), rejected (score at or
    above it), and what is kept.
    """
    net = docs.sparkSession.sparkContext.broadcast(fit(fit_sample(docs, labels, fit_rows=fit_rows, fit_words=fit_words, key=key, text=text, label=label)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"), ALNUM, lower=True)
                score = net.value.score(*_buckets(words), words.first)
                names = ["key", "lang", *own_names]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    own_names = [f"own{i}" for i in range(len(keep))]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"), *(F.col(c).alias(n) for c, n in zip(keep, own_names, strict=True)))
    own_kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(keep, own_names, strict=True))
    out = persist_table(rows.mapInArrow(run, f"key {kind}, lang string, {own_kinds}score double, predicted int"), "toxic-scores")
    limits = calibrate(out, labels, net.value.trained, key=key, label=label) if net.value.trained else {None: 0.5}
    own = F.create_map(*(F.lit(x) for k, v in limits.items() if k is not None for x in (k, v)))
    limit = F.coalesce(own[F.col("lang")], F.lit(limits[None])) if len(limits) > 1 else F.lit(limits[None])
    out = out.withColumn("threshold", limit).withColumn("rejected", F.col("score") >= F.col("threshold"))
    held = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(F.col("key").alias(key), held.alias("held_out"), "score", "predicted", "threshold", "rejected", *(F.col(n).alias(c) for c, n in zip(keep, own_names, strict=True)))
