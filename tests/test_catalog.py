import math

import duckdb
import pytest

from lodestone.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return tuple(map(one, v)) if isinstance(v, (list, tuple)) else v

    return sorted(names), sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    got = _plain([tuple(r) for r in df.collect()], df.columns)
    if name in catalog.oracle_sql():
        r = duck.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in r.description]
        assert got == _plain(r.fetchall(), names)
    else:
        assert got[1]


def test_fusion_arithmetic(spark):
    from lodestone.operators.fusion import reciprocal_rank_fusion

    a = spark.sql("SELECT * FROM VALUES (1, 1, 2.0, 1), (1, 2, 1.0, 2) AS v(query_id, chunk_id, score, fts_rank)")
    b = spark.sql("SELECT * FROM VALUES (1, 2, 0.9, 1), (1, 3, 0.8, 2) AS v(query_id, chunk_id, score, vec_rank)")
    got = {r.chunk_id: r.rrf_score for r in reciprocal_rank_fusion(a, b).collect()}
    assert got[2] == pytest.approx(1.35 * (1 / 61 + 0.02 + 1 / 60 + 0.05))
    assert got[1] == pytest.approx(1 / 60 + 0.05)


def test_entry_without_the_optional_subpackage(spark):
    import __spark_entry__

    assert "f1_hybrid" in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).columns[0] == "query_id"
