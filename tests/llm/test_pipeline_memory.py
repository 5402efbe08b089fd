"""What the pipeline's stages hold at once in an executor's heap is bounded."""

import random

import corpus_pipeline
import pyarrow.parquet as pq


def test_stages_write_and_read_in_small_runs(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefghijklmnop ", k=6000)), "en", "a", 6000) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    corpus_pipeline.personal_data(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    groups = [(m.num_rows, m.row_group(k).total_byte_size) for f in (tmp_path / "out").glob("*.parquet") for m in [pq.read_metadata(f)] for k in range(m.num_row_groups)]
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)
    assert max(size for _, size in groups) <= 2 * corpus_pipeline.GROUP_BYTES
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= corpus_pipeline.READ_ROWS
