"""Near-duplicate texts by fast similarity sketches.

A sketch has ``BINS`` bins. In each round, every element of a set is hashed to a bin,
and a bin keeps the least (round, hash) that it sees; a set is done once its bins are
full. In rounds ``BINS`` to ``2 * BINS - 1`` all elements go to one bin each, so that
every bin fills for any set that isn't empty. Two sets agree in a bin with probability
equal to their similarity.

Sets that share all bins of a band are in a bucket. Texts with equal sets count as one
first. Every set is verified on full sets in two rounds, and only confirmed links are
closed to components:

1. With one hub, the first set of the bucket that it shares most bands with. A hub's
   many sets are dealt to cells of ``STAR``.
2. In buckets that the links so far don't hold together, every pair but those of the
   bucket's largest part, which is linked already. A bucket above ``BLOCK`` sets or
   ``BLOCK_SHINGLES`` shingles is verified in pairs of blocks, whole; buckets of the same
   sets are verified once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.graph import connected_components
from lodestone.llm.groups import local_components, map_groups
from lodestone.llm.storage import persist_table
from lodestone.llm.words import NON_SPACE, as_long, lists, map_texts, mix, seeds, shingles, split_words

BINS = 128
#: Bands and bins in a band: a pair of similarity 0.8 is found with probability 0.998,
#: one of 0.85 with 0.99995.
BANDS, ROWS = 21, 6
#: Sets in a cell of a hub, and sets and shingles in a block.
STAR, BLOCK, BLOCK_SHINGLES = 100, 250, 1_000_000
#: Candidates up to this number are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 250_000

_U = np.uint64
_ROUNDS = seeds(2 * BINS, 101)
_BAND_SEEDS = seeds(BANDS, 103)


def sketch(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The sketches of ``n`` sets, given as elements ``value`` of sets ``owner`` (sorted)."""
    empty = np.uint32(0xFFFFFFFF)
    out = np.full(n * BINS, empty, np.uint32)
    for i in range(2 * BINS):
        if not len(value):
            break
        h = mix(value ^ _ROUNDS[i])
        at = (h % _U(BINS)).astype(np.int64) if i < BINS else i - BINS
        np.minimum.at(out, owner * BINS + at, np.uint32(i << 24) | (h >> _U(40)).astype(np.uint32))
        full = (out.reshape(n, BINS) != empty).all(axis=1)
        more = ~full[owner]
        if not more.all():
            owner, value = owner[more], value[more]
    return out.reshape(n, BINS)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sketches), BANDS), _U) + _BAND_SEEDS
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = mix(keys * _U(0x9E3779B97F4A7C15) + sketches[:, r : BANDS * ROWS : ROWS])
    return keys


def _set_sums(owner: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
    """Two 64-bit hashes of each set."""
    first = np.searchsorted(owner, np.arange(n + 1))
    out = []
    with np.errstate(over="ignore"):
        for k in (1, 2):
            sums = np.r_[_U(0), np.cumsum(mix(value ^ _U(k)), dtype=_U)]
            out.append(sums[first[1:]] - sums[first[:-1]])
    return out


def sketch_table(docs: DataFrame, n: int) -> DataFrame:
    """(key, n_shingles, h1, h2, bands) for each row of ``docs`` (key, text)."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        owner, value = shingles(split_words(part.column("text"), NON_SPACE, lower=True), n)
        size = np.bincount(owner, minlength=part.num_rows)
        h1, h2 = _set_sums(owner, value, part.num_rows)
        keys = as_long(band_keys(sketch(owner, value, part.num_rows))).ravel()
        bands = lists(keys, np.arange(part.num_rows + 1) * BANDS)
        return pa.RecordBatch.from_arrays([part.column("key"), pa.array(size), pa.array(as_long(h1)), pa.array(as_long(h2)), bands], ["key", "n_shingles", "h1", "h2", "bands"])

    return map_texts(docs, kernel, f"key {docs.schema['key'].dataType.simpleString()}, n_shingles long, h1 long, h2 long, bands array<long>")


def _set_table(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, rep, h1, h2), from a text of the key ``rep`` with that set."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        owner, value = shingles(split_words(part.column("text"), NON_SPACE, lower=True), n)
        h1, h2 = _set_sums(owner, value, part.num_rows)
        right = (as_long(h1) == part.column("h1").to_numpy()) & (as_long(h2) == part.column("h2").to_numpy())
        sets = lists(as_long(value), np.searchsorted(owner, np.arange(part.num_rows + 1)))
        return pa.RecordBatch.from_arrays([part.column("node"), sets], ["node", "shingles"]).filter(pa.array(right))

    wanted = docs.join(_sent(nodes), docs["key"] == nodes["rep"]).select("node", "h1", "h2", "text")
    # Rows that repeat a text meet here, most of them before the shuffle.
    return map_texts(wanted, kernel, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _sent(table: DataFrame) -> DataFrame:
    """A written table, sent to every task if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _shared(values: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of these sets share."""
    flat = np.concatenate(values)
    row = np.repeat(np.arange(len(values)), [len(v) for v in values])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times[column] > 1
    row, column = row[often], column[often]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(values), len(values)), np.float32)
    width = 4096
    for a in range(0, int(column.max(initial=-1)) + 1, width):
        i, j = np.searchsorted(column, [a, a + width])
        part = np.zeros((len(values), width), np.float32)
        part[row[i:j], column[i:j] - a] = 1
        out += part @ part.T
    return out


def _verify(table: pa.Table, hundredths: int) -> pa.RecordBatch | None:
    """Links within one cell, or between its two blocks, as (key, linked key)."""
    if table.num_rows < 2:
        return None
    key, side = table["node"].to_numpy(), table["side"].to_numpy()
    column = table["shingles"].combine_chunks()
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sets = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    size = np.diff(offsets)
    shared = np.rint(_shared(sets)).astype(np.int64)
    near = 100 * shared >= hundredths * (size[:, None] + size[None, :] - shared)
    if not (side == 0).all():
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    top = local_components(len(key), i, j)
    moved = np.flatnonzero(top != np.arange(len(key)))
    return pa.RecordBatch.from_arrays([pa.array(key[moved]), pa.array(key[top[moved]])], ["a", "b"])


def _best_hubs(buckets: DataFrame) -> DataFrame:
    """(node, hub): of the hubs of a node's buckets, the one that it shares most bands with."""
    shared = buckets.filter("node <> hub").groupBy("node", "hub").count()
    return persist_table(shared.groupBy("node").agg(F.max_by("hub", F.struct("count", F.bitwise_not("hub"))).alias("hub")), "near-stars")


def _stars(best: DataFrame) -> DataFrame:
    """(cell, side, node): each node with its hub, in cells of ``STAR``."""
    salts = best.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    salts = persist_table(salts, "near-salts")
    cell = lambda salt: F.xxhash64("hub", salt).alias("cell")
    members = best.join(_sent(salts), "hub").select(cell(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")), F.lit(2).alias("side"), "node")
    hubs = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(cell(F.col("salt")), F.lit(1).alias("side"), F.col("hub").alias("node"))
    return members.unionByName(hubs)


def _rest(buckets: DataFrame, best: DataFrame, linked: DataFrame) -> DataFrame:
    """(cell, side, node): the buckets with more than one component of ``linked`` (node, component),
    but for pairs that are verified already."""
    parts = buckets.join(_sent(linked), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = parts.join(_sent(best.withColumnRenamed("hub", "best")), "node", "left").withColumn("fresh", (F.col("node") != F.col("hub")) & (F.col("best") != F.col("hub")))
    sizes = first.groupBy("band", "component").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("sum"), F.bit_xor("node").alias("nodes"), F.sum(F.xxhash64("node") % (1 << 30)).alias("hashes"), F.max("fresh").alias("fresh"))
    total = F.struct("count", F.bitwise_not("component"))
    sizes = sizes.groupBy("band").agg(F.max_by("component", total).alias("most"), F.max("count").alias("first"), F.max_by("sum", total).alias("first_sum"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.bit_xor("nodes").alias("nodes"), F.sum("hashes").alias("hashes"), F.max("fresh").alias("fresh"), F.count("*").alias("components"))
    open_ = sizes.filter("components > 1 AND (count > 2 OR fresh)")
    one = open_.groupBy("count", "sum", "nodes", "hashes").agg(F.min_by(F.struct("band", "most", "first", "first_sum"), "band").alias("of")).select("of.*", "count", "sum")
    blocks = lambda count, total: F.ceil(F.greatest(count / BLOCK, total / BLOCK_SHINGLES)).cast("int")
    one = one.withColumn("whole", (F.col("count") <= BLOCK) & (F.col("sum") <= BLOCK_SHINGLES))
    one = one.select("band", "most", "whole", blocks(F.col("first"), F.col("first_sum")).alias("large"), blocks(F.col("count") - F.col("first"), F.col("sum") - F.col("first_sum")).alias("small"))
    placed = parts.select("band", "component", "node").join(_sent(persist_table(one, "near-rest")), "band")
    at = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    # Blocks of the rest are numbered from 0, those of the largest part from -1 down.
    place = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"))
    within = F.transform(F.sequence(F.lit(0), F.col("small") - 1), lambda k: F.struct(F.least(at("small"), k).alias("x"), F.greatest(at("small"), k).alias("y"), F.when(k == at("small"), 0).when(at("small") < k, 1).otherwise(2).alias("side")))
    across = F.transform(F.sequence(F.lit(1), F.col("large")), lambda k: F.struct((-k).alias("x"), at("small").alias("y"), F.lit(2).alias("side")))
    most = F.transform(F.sequence(F.lit(0), F.col("small") - 1), lambda k: F.struct((-at("large") - 1).alias("x"), k.alias("y"), F.lit(1).alias("side")))
    pairs = F.when(F.col("whole"), F.array(place)).when(F.col("component") == F.col("most"), most).otherwise(F.concat(within, across))
    return placed.withColumn("pair", F.explode(pairs)).select(F.xxhash64("band", "pair.x", "pair.y").alias("cell"), "pair.side", "node")


def near_texts(docs: DataFrame, *, n: int = 5, hundredths: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Links texts whose sets of ``n``-word shingles have 100 * intersection >= hundredths * union.

    Words are runs of anything but ASCII white space, ASCII letters in lower case. A text
    with fewer than ``n`` words is one shingle; a null, empty or blank one has no shingle
    and links with nothing. Keys may be of any type that can be ordered. Rows that repeat a
    key are each judged by their own text. A null key links only through an equal set, and
    is kept only if nothing else has that set. An empty table gives none; other columns are
    not read. One row for each row: key, n_shingles, component_id (smallest key reachable,
    itself included), kept.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    table = persist_table(sketch_table(rows, n), "near-sketches")
    full = table.filter("n_shingles > 0")
    classes = full.groupBy("h1", "h2", "n_shingles").agg(F.min("key").alias("rep"), F.first("bands").alias("bands"))
    classes = persist_table(classes.withColumn("node", F.xxhash64("h1", "h2", "n_shingles")), "near-classes")
    members = classes.filter("rep is not null").select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    buckets = members.join(_sent(persist_table(shared, "near-hubs")), "band")
    buckets = persist_table(buckets, "near-buckets")
    nodes = persist_table(classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "rep", "h1", "h2"), "near-nodes")
    sets = persist_table(_set_table(rows, nodes, n), "near-sets")

    def confirmed(cells: DataFrame) -> DataFrame:
        held = sets.join(_sent(persist_table(cells, "near-cells")), "node").select("cell", "side", "node", "shingles")
        return persist_table(map_groups(held, "cell", lambda t: _verify(t, hundredths), "a long, b long"), "near-links")

    best = _best_hubs(buckets)
    links = confirmed(_stars(best))
    top = persist_table(connected_components(links), "near-top")
    more = confirmed(_rest(buckets, best, top))
    if not more.isEmpty():
        top = persist_table(connected_components(links.unionByName(more)), "near-top")
    whole = top.unionByName(top.select(F.col("component").alias("node"), "component").distinct())
    names = whole.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("name"))
    named = persist_table(whole.join(names, "component").select("node", "name"), "near-names")
    placed = classes.join(_sent(named), "node", "left").select("h1", "h2", "n_shingles", F.coalesce("name", "rep").alias("component"))
    out = table.select("key", "n_shingles", "h1", "h2").join(placed, ["h1", "h2", "n_shingles"], "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
