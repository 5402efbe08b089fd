"""What keeps searches and scans within bounds on large tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, postings
from lodestone.operators.postings import PostingIndex, occurrences, pack, unpack


def _chunks(spark, texts, parts=1):
    return lexical.index_chunks(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, body string").coalesce(parts), ("body",))


@pytest.mark.parametrize("values", [[], [0], [255], [3, 256], [70000, 1], [5_000_000_000]])
def test_packed_numbers_come_back(values):
    assert unpack(pa.scalar(pack(np.array(values, np.int64)), pa.binary())).tolist() == values


def test_blocks_of_a_segment_and_bucket_are_one_row(spark):
    index = PostingIndex.of(_chunks(spark, [f"w{i} w{i + 1} all" for i in range(90)] + ["", None]), size=40, buckets=4)
    assert index.blocks.filter(F.col("bucket") != postings.OWN).count() <= 3 * 4
    asked = spark.createDataFrame([(1, ["w7", "all"]), (2, ["w1*"]), (3, ["nothing"])], "query_id int, terms array<string>")
    got = {(r.query_id, r.chunk_id, r.hits) for r in occurrences(index, lexical.asked_phrases(asked)).collect()}
    begun = [(2, i, sum(f"w{k}".startswith("w1") for k in (i, i + 1))) for i in range(90)]
    assert got == {(1, 6, 1), *(x for x in begun if x[2])}


def test_segments_have_their_size_in_any_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = postings.build_blocks(_chunks(spark, ["one two"] * 50), size=20)
        assert sorted(r.n for r in rows.filter(F.col("bucket") == postings.OWN).select(F.size("chunks").alias("n")).collect()) == [10, 20, 20]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scans_hold_few_scores_and_keep_what_can_be_first():
    from lodestone.operators.similarity import _Best, slices

    batch = pa.record_batch({"chunk_id": pa.array(range(1000))})
    parts = list(slices(iter([batch]), 50, pairs=2000))
    assert [p.num_rows for p in parts] == [40] * 25 and pa.Table.from_batches(parts)["chunk_id"].to_pylist() == list(range(1000))
    rng = np.random.default_rng(2)
    score = rng.integers(0, 6, (1000, 7)) / 6
    room = np.array([3, 5, 10, 1, 50, 2000, 7])
    order = rng.permutation(1000)
    best = _Best(room)
    for at in range(0, 1000, 64):
        best.add(score[order[at : at + 64]], pa.array(order[at : at + 64]))
    got = sorted(zip(best.query.tolist(), (-best.score).tolist(), best.ids.to_pylist(), strict=True))
    want = sorted((q, -score[i, q], int(i)) for q in range(7) for i in np.lexsort((np.arange(1000), -score[:, q]))[: room[q]])
    assert got == want


@pytest.mark.parametrize("kind", ["cosine", "hamming"])
@pytest.mark.parametrize("key", ["bigint", "string"])
def test_a_task_keeps_the_first_of_each_query(spark, monkeypatch, kind, key):
    from lodestone.operators import similarity

    rng = np.random.default_rng(4)
    one = [[float(x) for x in v] for v in rng.normal(size=(40, 8))]
    rows = spark.createDataFrame([(i, one[i % 40]) for i in range(400)], "chunk_id long, embedding array<double>").withColumn("chunk_id", F.col("chunk_id").cast(key)).coalesce(1)
    asked = spark.createDataFrame([(q, one[q]) for q in range(5)], "query_id int, query array<double>")
    lines = lambda: sorted((r.query_id, r.vec_rank, r.chunk_id, round(r.score, 9)) for r in similarity.vector_scan(rows, asked, limit=12, kind=kind).collect())
    whole = lines()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    seen = []
    monkeypatch.setattr(similarity, "ranked", lambda df, *a, **k: seen.append(df.count()) or lexical.ranked(df, *a, **k))
    try:
        assert lines() == whole and [r[1] for r in whole] == list(range(1, 13)) * 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    if key == "bigint" and kind == "hamming":
        assert seen == [60]


def test_markdown_chunks_leave_a_task_in_small_batches(monkeypatch):
    from lodestone.operators import markdown

    texts = [None if i % 5 == 0 else "" if i % 7 == 0 else f"# h{i}\n" + f"word{i} " * 500 for i in range(40)]
    monkeypatch.setattr(markdown, "HELD", 9000)
    out = list(markdown.chunk_batches(iter([pa.record_batch({"key": pa.array(range(40)), "body": pa.array(texts, pa.string())})])))
    want = [(i, c["seq_id"], c["text"]) for i, t in enumerate(texts) if t for c in markdown.chunk_markdown(t)]
    assert [(r["key"], r["seq_id"], r["text"]) for b in out for r in b.to_pylist()] == want
    assert len(out) > 5 and max(len(set(b.column("key").to_pylist())) for b in out) <= 3


def test_catalog_sessions_hand_small_batches_to_workers(spark):
    from lodestone.operators.tables import BATCH_BYTES
    from lodestone.plans import catalog

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    catalog.documents(spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)


def test_texts_of_hits_are_not_shuffled(spark, monkeypatch):
    """Few hits are sent to the chunks; many are dealt by chunk, with the same result."""
    from lodestone.operators import search

    texts = [f"red fish {i} " + "blue bird " * (i % 3) for i in range(60)]
    chunks = spark.createDataFrame([(i, "c", f"p{i}", 0, "t", x) for i, x in enumerate(texts)], "chunk_id long, collection string, path string, seq_id int, title string, text string")
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(60)], "chunk_id long, embedding array<double>")
    corpus = search.Corpus(chunks, PostingIndex.of(lexical.index_chunks(chunks.withColumnRenamed("text", "body"), ("body",))), vectors)
    asked = spark.createDataFrame([(1, "red bird", [1.0, 0.0]), (2, "blue fish", [0.0, 1.0])], "query_id int, query string, vector array<double>")
    monkeypatch.setattr(search, "written", lambda df, *a: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = []
        for most in (search.SENT_HITS, 0):
            monkeypatch.setattr(search, "SENT_HITS", most)
            hits = search.hybrid_search(corpus, asked, search.Options(rerank=search.overlap_reranker))
            made.append((sorted(map(tuple, hits.select("query_id", "chunk_id", "rank", "score").collect())), hits._jdf.queryExecution().sparkPlan().toString()))
        assert made[0][0] == made[1][0] and len(made[0][0]) == 20
        assert "BroadcastHashJoin [chunk_id" in made[0][1] and "BroadcastHashJoin [chunk_id" not in made[1][1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
