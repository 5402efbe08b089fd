"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits at the median of a random projection, again and again; vectors close
to a split (within ``spill``) go to both sides. Equal vectors count as one class
first. Vectors of one label are compared with each other inside each leaf, by exact
cosine in double precision. A pair may meet in several leaves; it is counted in the
first it shares, so no pair is written out, only sums and a spanning set of links.

The splits are fitted on a bounded sample (``FIT_ROWS`` classes, smallest hashes);
every vector is indexed and compared. How many trees there are follows from the share of
the sample's pairs that meet; groups of near copies aren't split. A leaf above ``BLOCK`` vectors is compared in
pairs of blocks, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.graph import connected_components
from lodestone.llm.groups import local_components, map_groups
from lodestone.llm.storage import persist_table

#: Classes of equal vectors that the trees are fitted on, at most.
FIT_ROWS = 20_000
#: A node with fewer vectors of the sample isn't split.
LEAF_ROWS = 64
#: Vectors in a block.
BLOCK = 800
#: Projections that a node tries, and the shares of its vectors that may go left.
TRIES, PLACES = 6, (0.2, 0.35, 0.5, 0.65, 0.8)
#: A node isn't split if every split parts a larger share of pairs, set against its balance.
MOST_PARTED = 0.1
#: The measured share of pairs that must meet, and the trees that may be grown for it.
MEET, MOST_TREES = 0.999, 32
#: Below this measured share trees aren't used: all vectors of a label are compared.
LEAST_MEET = 0.9
#: Rows of the sample whose pairs are measured, and their pairs at most.
PROBES, MOST_PAIRS = 1000, 100_000


def _tail(x: np.ndarray) -> np.ndarray:
    """The chance that a standard normal exceeds ``x`` >= 0, within 2e-5 (Abramowitz and Stegun 26.2.16)."""
    t = 1 / (1 + 0.33267 * x)
    return np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.4361836 + t * (-0.1201676 + t * 0.9372980))


def _by_row(met: np.ndarray, row: np.ndarray) -> float:
    """Mean over rows of the share of their pairs that met."""
    if not len(met):
        return 1.0
    n = np.bincount(row)
    return float((np.bincount(row, weights=met)[n > 0] / n[n > 0]).mean())


def _known_pairs(sample: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs to measure recall on: of ``PROBES`` rows with rows of the sample (numbered by row),
    and with a made-up partner at the threshold itself (numbered -1)."""
    probe = rng.permutation(len(sample))[:PROBES]
    x = sample[probe]
    near = x @ sample.T >= threshold
    near[np.arange(len(probe)), probe] = False
    i, j = np.nonzero(near)
    if len(i) > MOST_PAIRS:
        some = rng.permutation(len(i))[:MOST_PAIRS]
        i, j = i[some], j[some]
    away = rng.standard_normal(x.shape).astype(np.float32)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-30)
    made = threshold * x + math.sqrt(max(1 - threshold**2, 0)) * away
    return np.concatenate([x[i], x]), np.concatenate([sample[j], made]), np.r_[i, np.full(len(x), -1)]


class Forest:
    """Trees as arrays: nodes in heap order, one projection and one threshold each.

    A node tries a few projections and places of the split, and takes the one that parts
    fewest vectors from a partner at cosine ``threshold`` for the balance it gives. A node
    where every split parts many (a group of near copies) stays whole: its vectors all go
    left. Trees are added to the first ``trees`` until pairs of the sample, and made-up
    partners at cosine ``threshold``, meet as often as ``MEET`` asks. If ``MOST_TREES`` don't reach
    ``LEAST_MEET``, the forest is one leaf that holds all.
    """

    def __init__(self, sample: np.ndarray, trees: int, spill: float, seed: int, threshold: float):
        rng = np.random.default_rng(seed)
        self.spill = spill
        n, dim = sample.shape
        self.depth = max(0, int(np.log2(max(n, 1) / LEAF_ROWS)) if n > LEAF_ROWS else 0)
        self.planes = np.zeros((0, (1 << self.depth) - 1, dim), np.float32)
        self.at = np.zeros((0, (1 << self.depth) - 1), np.float32)
        # The difference of two projections at that cosine, as a normal deviation.
        gap = math.sqrt(max(2 * (1 - threshold), 1e-12) / max(dim, 1))
        left, right, row = _known_pairs(sample, threshold, rng)
        met = np.zeros(len(left), bool)
        self.recall = 1.0
        for t in range(MOST_TREES if self.depth else 1):
            self._grow(sample, gap, rng)
            if self.depth:
                met |= self._meet(t, left, right)
                real = row >= 0
                self.recall = min(met[~real].mean(), _by_row(met[real], row[real]), met[real].mean() if real.any() else 1.0)
            if t + 1 >= trees and self.recall >= MEET:
                break
        if self.recall < LEAST_MEET:  # one leaf, which is compared whole in pairs of blocks
            self.depth, self.recall = 0, 1.0
            self.planes, self.at = np.zeros((1, 0, dim), np.float32), np.zeros((1, 0), np.float32)

    def _grow(self, sample: np.ndarray, gap: float, rng: np.random.Generator) -> None:
        """Adds a tree that is fitted on the sample."""
        n, dim = sample.shape
        nodes = self.at.shape[1]
        planes, at = np.zeros((nodes, dim), np.float32), np.full(nodes, np.inf, np.float32)
        where = np.zeros(n, np.int64)
        for node in range(nodes):
            inside = np.flatnonzero(where == node)
            where[inside] = 2 * node + 1
            if len(inside) < LEAF_ROWS:
                continue
            tried = rng.standard_normal((dim, TRIES)).astype(np.float32)
            tried /= np.maximum(np.linalg.norm(tried, axis=0), 1e-30)
            p = sample[inside] @ tried
            some = p[:: max(1, len(p) // PROBES)]
            x = np.quantile(some, PLACES, axis=0).astype(np.float32)  # place, projection
            off = np.abs(some - x[:, None])
            parted = np.where(off > self.spill, _tail((off + self.spill) / gap), 0).mean(axis=1)
            parted /= 2 * np.minimum(PLACES, 1 - np.array(PLACES))[:, None]
            place, k = np.unravel_index(parted.argmin(), parted.shape)
            if parted[place, k] <= MOST_PARTED:
                planes[node], at[node] = tried[:, k], x[place, k]
                where[inside] += p[:, k] >= at[node]
        self.planes = np.concatenate([self.planes, planes[None]])
        self.at = np.concatenate([self.at, at[None]])

    def _meet(self, t: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair shares a leaf of a tree."""
        size = (self.at.shape[1] + (1 << self.depth)) * len(self.at)
        both = []
        for side in (left, right):
            row, cell = self.leaves(side, t)
            both.append(row * size + cell)
        out = np.zeros(len(left), bool)
        out[np.intersect1d(*both) // size] = True
        return out

    def leaves(self, vectors: np.ndarray, only: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf): each leaf in each tree, or in one, that a vector is in."""
        rows, cells = [], []
        trees, nodes = self.at.shape
        for t in range(trees) if only is None else (only,):
            row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                gap = np.empty(len(row), np.float32)
                order = np.argsort(node, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(node[order]) > 0, True])
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    i = order[a:b]
                    whole = np.isinf(self.at[t, node[i[0]]])
                    gap[i] = -np.inf if whole else vectors[row[i]] @ self.planes[t, node[i[0]]] - self.at[t, node[i[0]]]
                left, right = gap < self.spill, gap >= -self.spill
                row, node = np.r_[row[left], row[right]], np.r_[2 * node[left] + 1, 2 * node[right] + 2]
            rows.append(row)
            cells.append(t * (nodes + (1 << self.depth)) + node)
        return np.concatenate(rows), np.concatenate(cells)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision; rows of different lengths are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), int(sizes.max()) if len(sizes) else 0))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    scale = np.abs(out).max(axis=1, initial=0)  # first by the largest, so that squares stay finite
    out /= np.where(scale > 0, scale, 1)[:, None]
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]


def _met_before(lists: pa.ListArray, leaf: int) -> np.ndarray:
    """The leaves below ``leaf`` that each row is in, as a matrix of 0 and 1: the product
    of two rows counts the earlier leaves that they share."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    row, flat = row[flat < leaf], flat[flat < leaf]
    which, column = np.unique(flat, return_inverse=True)
    out = np.zeros((len(sizes), len(which)), np.float32)
    out[row, column] = 1
    return out


def _compare(table: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Links within one cell, or between its two blocks: (rep, links counted here, linked rep)."""
    if table.num_rows < 2:
        return None
    rep = table["rep"].to_numpy()
    weight = table["n"].to_numpy()
    side = table["side"].to_numpy()
    leaf = table["leaf"][0].as_py()
    vectors = _matrix(table["embedding"])
    met = _met_before(table["leaves"].combine_chunks(), leaf)
    within = (side == 0).all()
    x, y = (np.arange(len(rep)), np.arange(len(rep))) if within else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    # Pairs within the earlier leaf that most rows share were compared there.
    done = met[:, met.sum(axis=0).argmax()] > 0 if met.shape[1] else np.zeros(len(rep), bool)
    near = np.zeros((len(x), len(y)), bool)
    new, old = ~done[x], done[x]
    near[new] = vectors[x[new]] @ vectors[y].T >= threshold
    near[np.ix_(old, ~done[y])] = vectors[x[old]] @ vectors[y[~done[y]]].T >= threshold
    if within:
        np.fill_diagonal(near, False)
    if not near.any():
        return None
    i, j = np.nonzero(near)
    i, j = x[i], y[j]
    here = near & (met[x] @ met[y].T == 0)
    links = np.zeros(len(rep), np.int64)
    links[x] = here @ weight[y]
    if not within:
        links[y] = here.T @ weight[x]
    top = local_components(len(rep), i, j)
    linked = np.flatnonzero((links > 0) | (top != np.arange(len(rep))))
    return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(links[linked]), pa.array(rep[top[linked]])], ["rep", "links", "other"])


def near_vectors(vectors: DataFrame, *, threshold: float = 0.93, trees: int = 8, spill: float = 0.012, seed: int = 7, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Links between vectors of one label with cosine at or above ``threshold``.

    Vectors that are null, empty, zero or hold null or non-finite components, and those
    with a null label or key, link with nothing. Rows that repeat a key count as vectors
    of their own. Vectors of different lengths never link. An empty table gives none, and
    other columns are not read. One row for each row: key, n_links (other vectors linked
    directly), component_id (smallest key reachable by links, itself included), kept.
    """
    v = F.col("v")
    number = "float" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(embedding).cast(f"array<{number}>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.col("key").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size("v") > 0) & fine
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("kind", F.when(F.col("fine"), F.concat_ws(":", F.size("v"), "label"))).withColumn("h1", F.when(F.col("fine"), F.xxhash64("kind", "v"))).withColumn("h2", F.when(F.col("fine"), F.xxhash64(F.lit(3), "v", "kind")))
    classes = persist_table(rows.filter("fine").groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count("*").alias("n"), F.first("kind").alias("kind"), F.first("v").alias("embedding")), "vec-classes")

    sample = classes.select("h1", "embedding").orderBy("h1").limit(FIT_ROWS).select("embedding").toArrow().column(0)
    fitted = _matrix(sample).astype(np.float32) if len(sample) else np.zeros((0, 1), np.float32)
    forest = vectors.sparkSession.sparkContext.broadcast(Forest(fitted, trees, spill, seed, threshold))
    width = fitted.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("embedding")).astype(np.float32)
            m = np.pad(m, ((0, 0), (0, max(0, width - m.shape[1]))))[:, :width]
            row, cell = forest.value.leaves(m)
            order = np.lexsort((cell, row))
            offsets = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell[order]))], [*batch.schema.names, "leaves"])

    placed = persist_table(classes.select("rep", "h1", "n", "kind", "embedding").mapInArrow(place, f"rep long, h1 long, n long, kind string, embedding array<{number}>, leaves array<long>"), "vec-leaves")
    cells = placed.select("rep", "h1", "kind", F.explode("leaves").alias("leaf"))
    large = cells.groupBy("kind", "leaf").count().filter(F.col("count") > BLOCK).select("kind", "leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = persist_table(large, "vec-large")
    held = placed.select("*", F.explode("leaves").alias("leaf"))
    held = held.join(F.broadcast(large), ["kind", "leaf"], "left") if large.count() <= 100_000 else held.join(large, ["kind", "leaf"], "left")
    # A row of a large leaf goes to each pair of blocks that its block is in.
    block = F.pmod("h1", F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(block, k.cast("long")).alias("x"), F.greatest(block, k.cast("long")).alias("y"), F.when(k == block, 0).when(block < k, 1).otherwise(2).alias("side")))
    pairs = F.when(F.col("blocks").isNotNull(), pairs).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("side"))))
    held = held.withColumn("pair", F.explode(pairs))
    held = held.select(F.xxhash64("kind", "leaf", "pair.x", "pair.y").alias("cell"), "pair.side", "leaf", "rep", "n", "embedding", "leaves")
    found = persist_table(map_groups(held, "cell", lambda t: _compare(t, threshold), "rep long, links long, other long"), "vec-links")

    links = persist_table(found.groupBy("rep").agg(F.sum("links").alias("links")), "vec-sums")
    top = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = classes.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(top, F.col("rep") == F.col("node"), "left")
    known = persist_table(known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "vec-known")
    out = rows.select("key", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component", "key")
    kind = vectors.schema[key].dataType
    return out.select(F.col("key").cast(kind).alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
