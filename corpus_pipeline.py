"""A pipeline over ``documents``: five operators, each over what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Between stages the rows are written as Parquet.

In every stage a row stands for itself: it is known by its doc_id and a hash of its text.
Rows with a null doc_id are judged like others and stay if they are clean; of rows that
repeat a doc_id each is judged by its own text; rows that repeat both share one fate, and
near-copy removal keeps one of them. Null texts count as empty and are clean. An empty
table passes through. Other columns than those of ``documents`` are dropped by the first
stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontam import benchmark_hits
from lodestone.llm.minhash import BROADCAST_ROWS, near_texts
from lodestone.llm.mixing import mix_sources
from lodestone.llm.pii import find_personal_data
from lodestone.llm.storage import persist_table, scratch
from lodestone.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Bytes of rows that Spark hands to a Python worker at once; buffers on both sides follow it (the default is 64 MB).
BATCH_BYTES = 1 << 20
#: Rows that a Parquet reader decodes at once (the default is 4,096, of texts some 10 MB in one array).
READ_ROWS = 256
#: Bytes of a row group, which a writer holds until it is full and a reader takes in at once (the default is 128 MB).
GROUP_BYTES = 4 << 20


def _bounded(spark: SparkSession) -> None:
    """Keeps Arrow batches, decoded batches and row groups small in this session: an executor's heap grows with its largest arrays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("parquet.block.size", str(GROUP_BYTES))


def _row() -> Column:
    """What a row is known by; null doc_ids come last in order."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"))


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("row", _row())


def _met(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Joins ``docs`` to a table by ``row``, sent to all tasks only if it is small."""
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "row", how)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return _met(docs, persist_table(gone.select("row").distinct(), "dropped"), "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects at their language's threshold."""
    _bounded(spark)
    docs = _known(docs)
    judged = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("row",))
    return _without(docs, judged.filter("rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more.

    It is the one of smallest doc_id, a null one only if the group has no other.
    """
    _bounded(spark)
    docs = _known(docs)
    found = persist_table(near_texts(docs, n=5, hundredths=80, key="row"), "near-found")
    left = _met(docs, persist_table(found.filter("not kept").select("row").distinct(), "dropped"), "left_anti")
    repeated = persist_table(found.filter("kept").groupBy("row").count().filter("count > 1").select("row"), "repeated")
    if not repeated.isEmpty():
        one = _met(left, repeated, "left_semi").dropDuplicates(["row"])
        left = _met(left, repeated, "left_anti").unionByName(one)
    return left.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window of ten words."""
    _bounded(spark)
    docs = _known(docs)
    hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row")
    return _without(docs, hits.filter("contaminated"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; keeps every document."""
    _bounded(spark)
    rows = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("row"), "text")
    found = find_personal_data(rows, key="row")
    size = F.when(F.length("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select("row.doc_id", F.col("redacted").alias("text"), "row.lang", "row.source", size.alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the columns of ``documents``, how many whole copies of
    each are taken (``copies``) and how many words of one more (``part``)."""
    _bounded(spark)
    docs = _known(docs)
    taken = persist_table(mix_sources(docs, key="row").filter("taken > 0").dropDuplicates(["row"]), "mixed")
    return _met(docs, taken, "inner").select(*COLUMNS, "size", "source_size", "target", "copies", "part", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("source mix", source_mix),
]

#: The classifier, the random field and the sampling draws can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return docs
