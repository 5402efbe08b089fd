"""Registered queries over the given tables, and the same results in SQL.

``documents`` serve as a corpus: the language is the collection, source and number make
the path. Scores are rounded to six digits at output and ties broken by chunk number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import chunks as C
from lodestone.operators import fusion, hierarchy, inspect, lexical, maintenance, markdown, search, sessions, similarity
from lodestone.operators.postings import PostingIndex, occurrences, search_blocks
from lodestone.operators.tables import small_batches, stamp
from lodestone.operators.vector_index import VectorIndex
from lodestone.sources import files, render

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- the corpus ------------------------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    small_batches(spark)
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", F.col("lang").alias("collection"), F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"), T.content_hash(F.col("text")).alias("hash"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.with_chunk_ids(C.window_chunks(documents(spark, d)))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def benchmark_terms(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of each benchmark item as a query."""
    rows = spark.read.parquet(f"{d}/benchmark.parquet")
    return rows.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, text): the sentences of the benchmark items."""
    rows = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.posexplode(F.split("text", "[.\\n]+")).alias("at", "text"))
    return rows.select((F.col("item_id") * 1000 + F.col("at")).alias("query_id"), "text")


def queries_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark items as queries; the vector of an item's number stands for its embedding."""
    rows = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rows.join(vectors(spark, d).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")


def corpus(spark: SparkSession, d: str) -> search.Corpus:
    """The chunks with their index; the vectors of documents stand for those of their first chunks."""
    rows = chunks(spark, d)
    of_first = vectors(spark, d).join(rows.filter("seq_id = 0").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    of_first = of_first.select((F.col("vec_id") * C.MOST_CHUNKS).alias("chunk_id"), "embedding")
    return search.Corpus(rows.withColumnRenamed("body", "text"), index(spark, d), of_first)


#: Indexes of this application, by the state of the table that they are of.
_INDEXES: dict[tuple[str, str], PostingIndex] = {}


def index(spark: SparkSession, d: str) -> PostingIndex:
    """The stored index of the chunks: written by the first query of an application that needs it, read by all."""
    key = (spark.sparkContext.applicationId, stamp(spark, f"{d}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = PostingIndex.of(lexical.index_chunks(chunks(spark, d)))
    return _INDEXES[key]


_CORPUS = """c AS (SELECT doc_id, lang AS collection, source || '/doc_' || doc_id || '.md' AS path, 'Doc ' || doc_id AS title, text AS body, sha256(text) AS hash FROM documents),
k AS (SELECT doc_id, collection, path, title, hash, seq_id, substr(body, seq_id * 800 + 1, 1000) AS body, doc_id * 16777216 + seq_id AS chunk_id FROM (SELECT *, unnest(range(CASE WHEN length(body) <= 1000 THEN 1 ELSE ceil((length(body) - 200) / 800.0)::INT END))::INT AS seq_id FROM c WHERE length(body) > 0))"""
def _tok(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


# A mark ends each column.
_INDEX = f"""{_CORPUS},
x0 AS (SELECT chunk_id, {_tok('collection')} || [chr(1)] || {_tok('path')} || [chr(1)] || {_tok('title')} || [chr(1)] || {_tok('body')} || [chr(1)] AS terms FROM k),
x AS (SELECT chunk_id, terms, len(terms) - 4 AS len FROM x0)"""
_BTOK = _tok("text")


def _bm25(leaves: str) -> str:
    """Weights ``w`` (key, chunk_id, weight) of the phrases of ``l`` (query_id, tier, leaf, toks)."""
    return f"""{_INDEX}, l AS ({leaves}),
f AS (SELECT DISTINCT array_to_string(toks, ' ') AS key, toks FROM l),
fp AS (SELECT key, len(toks) AS n, unnest(toks) AS term, unnest(range(len(toks))) AS o FROM f),
t AS (SELECT chunk_id, len, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM x),
m AS (SELECT key, chunk_id, n, pos - o AS s, any_value(len) AS len, count(DISTINCT o) AS met FROM t JOIN fp ON fp.term = t.term GROUP BY key, chunk_id, n, pos - o),
p AS (SELECT key, chunk_id, any_value(len) AS len, count(*) AS tf FROM m WHERE met = n GROUP BY key, chunk_id),
sn AS (SELECT key, count(*) AS seen FROM p GROUP BY key),
g AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM x),
w AS (SELECT p.key, chunk_id, (CASE WHEN ln((n - seen + 0.5) / (seen + 0.5)) > 0 THEN ln((n - seen + 0.5) / (seen + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS weight FROM p JOIN sn ON sn.key = p.key, g),
hl AS (SELECT query_id, tier, chunk_id, greatest(1e-4, sum(weight)) AS score, count(*) AS met FROM l JOIN w ON w.key = array_to_string(toks, ' ') GROUP BY query_id, tier, chunk_id),
nl AS (SELECT query_id, tier, count(*) AS n FROM l GROUP BY query_id, tier)"""


def _terms(source: str, columns: str = "item_id AS query_id") -> str:
    """The distinct tokens of texts as leaves."""
    return f"SELECT query_id, 0 AS tier, 0 AS leaf, [t] AS toks FROM (SELECT {columns}, unnest(list_distinct({_BTOK})) AS t FROM {source})"


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
#: Whole query texts as leaves: all words but stop words in tier 0, any of them in tier 1.
_LEAVES = rf"""SELECT query_id, tier, leaf, toks FROM (SELECT query_id, tier, leaf, {_tok('w')} AS toks FROM (
  SELECT query_id, 0 AS tier, unnest(ws) AS w, unnest(range(len(ws))) AS leaf FROM (SELECT query_id, CASE WHEN len(list_filter(ws, lambda y: lower(y) NOT IN ({_STOPS}))) > 0 THEN list_filter(ws, lambda y: lower(y) NOT IN ({_STOPS})) ELSE ws END AS ws
    FROM (SELECT item_id AS query_id, list_filter(regexp_split_to_array(replace(text, '"', ''), '\s+'), lambda y: y <> '') AS ws FROM benchmark))
  UNION ALL SELECT query_id, 1, unnest(ws), unnest(range(len(ws))) FROM (SELECT item_id AS query_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda y: len(y) > 1 AND y NOT IN ({_STOPS})) AS ws FROM benchmark) WHERE len(ws) > 1)) WHERE len(toks) > 0"""
_SENTENCES = r"(SELECT item_id * 1000 + unnest(range(len(p))) AS query_id, unnest(p) AS text FROM (SELECT item_id, regexp_split_to_array(text, '[.\n]+') AS p FROM benchmark))"


def _top(source: str, limit: int, rank: str = "fts_rank") -> str:
    return f"SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS {rank} FROM {source}) WHERE {rank} <= {limit}"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# -- structure and scalars ---------------------------------------------------------------


@_register("c9_window_chunks", f"WITH {_CORPUS} SELECT doc_id, seq_id, body FROM k")
def _c9(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("doc_id", "seq_id", "body")


@_register("d1_tokens", f"WITH {_INDEX} SELECT chunk_id, len::INT AS length, array_to_string(terms, ' ') AS terms FROM x")
def _d1(spark: SparkSession, d: str) -> DataFrame:
    return lexical.index_chunks(chunks(spark, d)).select("chunk_id", "length", F.array_join("terms", " ").alias("terms"))


@_register("j1_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _j1(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", "hash")


@_register("j3_redact_pii", f"SELECT doc_id, regexp_replace(regexp_replace(text, '{T.EMAIL}', '{T.REDACTED}', 'g'), '{T.PHONE}', '{T.REDACTED}', 'g') AS text FROM documents")
def _j3(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.redact_pii(F.col("body")).alias("text"))


@_register("j4_slug", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def _j4(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.slug(F.col("url")).alias("slug"))


@_register("j9_highlight", "SELECT doc_id, regexp_replace(text, '(?i)(tion|the)', '<m>\\1</m>', 'g') AS text FROM documents")
def _j9(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.highlight(F.col("body"), ["the", "tion"]).alias("text"))


@_register("j10_escape_xml", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM pages")
def _j10(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.escape_xml(F.col("html")).alias("html"))


@_register("a17_markdown_table", r"SELECT doc_id, '| key | text |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '|', '\|') || ' |' AS md FROM documents")
def _a17(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(F.array(F.lit("key"), F.lit("text")), F.array(F.col("doc_id").cast("string"), F.col("body")))
    return documents(spark, d).select("doc_id", T.markdown_table(rows).alias("md"))


# -- lexical ---------------------------------------------------------------------------


_ANY = "SELECT query_id, chunk_id, score FROM hl"
_ALL = "SELECT hl.* FROM hl JOIN nl ON nl.query_id = hl.query_id AND nl.tier = hl.tier AND nl.n = hl.met"


@_register("d3_bm25_any", f"WITH {_bm25(_terms('benchmark'))} SELECT query_id, chunk_id, round(score, 6) AS score, fts_rank FROM ({_top('hl', 10)})")
def _d3(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.match(index(spark, d), benchmark_terms(spark, d), every=False, limit=10)
    return _rounded(lexical.ranked(hits, 10), "score")


@_register("d5_boolean_and", f"WITH {_bm25(_terms(_SENTENCES, 'query_id'))}, h AS ({_ALL}) SELECT query_id, chunk_id, round(score, 6) AS score, fts_rank FROM ({_top('h', 50)})")
def _d5(spark: SparkSession, d: str) -> DataFrame:
    terms = sentences(spark, d).select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return _rounded(lexical.ranked(lexical.match(index(spark, d), terms, limit=50), 50), "score")


@_register("d5_boolean_not", f"WITH {_INDEX} SELECT 1 AS query_id, chunk_id FROM x WHERE list_contains(terms, 'the') AND NOT list_contains(terms, 'and')")
def _d5n(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d, "the NOT and").select("query_id", "chunk_id")


@_register("d6_phrase", f"WITH {_bm25(f'SELECT query_id, 0 AS tier, 0 AS leaf, {_BTOK} AS toks FROM {_SENTENCES} WHERE len({_BTOK}) > 0')} SELECT query_id, chunk_id, tf::BIGINT AS hits FROM l JOIN p ON p.key = array_to_string(toks, ' ')")
def _d6(spark: SparkSession, d: str) -> DataFrame:
    asked = sentences(spark, d).select("query_id", T.tokens(F.col("text")).alias("terms")).filter("size(terms) > 0")
    return occurrences(index(spark, d), lexical.asked_phrases(asked)).select("query_id", "chunk_id", "hits")


def _asked(spark: SparkSession, d: str, expression: str) -> DataFrame:
    """Hits of one match expression, without relaxation."""
    one = spark.createDataFrame([(1, expression)], "query_id int, query string")
    return search_blocks(index(spark, d), lexical.compile_queries(one).filter("NOT last"))



@_register("d4_boolean_tree", rf"""WITH {_bm25("SELECT 1 AS query_id, 0 AS tier, 0 AS leaf, unnest([['the'], ['ing'], ['there', 'is'], ['of']]) AS toks")}
SELECT 1 AS query_id, chunk_id, round(score, 6) AS score FROM hl WHERE chunk_id IN (SELECT chunk_id FROM x WHERE (list_contains(terms, 'the') AND NOT list_contains(terms, 'of')) OR list_contains(terms, 'ing') OR chunk_id IN (SELECT chunk_id FROM p WHERE key = 'there is'))""")
def _d4(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_asked(spark, d, 'ing OR the NOT of OR "there is"').select("query_id", "chunk_id", "score"), "score")


@_register("d7_column", f"WITH {_CORPUS} SELECT 1 AS query_id, chunk_id FROM k WHERE list_contains({_tok('title')}, '7') OR list_contains({_tok('title')}, '77') OR {_tok('path')}[1] = 'src3'")
def _d7c(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d, "title:(7 OR 77) OR path: ^src3").select("query_id", "chunk_id")


@_register("d7_near", f"WITH {_INDEX}, u AS (SELECT chunk_id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM x) SELECT DISTINCT 1 AS query_id, a.chunk_id FROM u a JOIN u b ON b.chunk_id = a.chunk_id AND a.term = 'the' AND b.term = 'of' AND abs(a.pos - b.pos) - 1 <= 2")
def _d7n(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d, "NEAR(the of, 2) AND the").select("query_id", "chunk_id")


@_register("d7_prefix", f"WITH {_INDEX}, t AS (SELECT chunk_id, unnest(terms) AS term FROM x) SELECT 1 AS query_id, chunk_id, count(*) AS hits FROM t WHERE starts_with(term, 'thes') GROUP BY chunk_id")
def _d7(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.sql("SELECT 1 AS query_id, array('thes*') AS terms")
    return occurrences(index(spark, d), lexical.asked_phrases(asked)).select("query_id", "chunk_id", "hits")


#: NEAR groups of three and four parts; a clump spans at most the distance between its first part's end and its last part's start.
_NEAR = {1: (["the", "of", "in"], 4), 2: (["de", "la", "que", "el"], 6), 3: (["und", "der", "die"], 10)}


def _near_sql() -> str:
    """Leaves' places ``u``; every place that ends a clump ``v``; what is kept of each leaf, and BM25 by the leaf's own frequency."""
    rows = ", ".join(f"({q}, {k}, '{t}', {n}, {len(ts)})" for q, (ts, n) in _NEAR.items() for k, t in enumerate(ts))
    return f"""WITH {_INDEX}, q AS (SELECT * FROM (VALUES {rows}) v(query_id, leaf, term, dist, parts)),
t AS (SELECT chunk_id, len, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM x),
u AS (SELECT query_id, leaf, q.term, dist, parts, chunk_id, len, pos FROM t JOIN q ON q.term = t.term),
v AS (SELECT a.query_id, a.chunk_id, a.pos AS last, any_value(a.dist) AS dist FROM u a JOIN u b ON b.query_id = a.query_id AND b.chunk_id = a.chunk_id AND b.pos <= a.pos AND b.pos >= a.pos - 1 - a.dist GROUP BY a.query_id, a.chunk_id, a.pos HAVING count(DISTINCT b.leaf) = any_value(a.parts)),
k2 AS (SELECT DISTINCT u.query_id, u.leaf, u.term, u.chunk_id, u.len, u.pos FROM u JOIN v ON v.query_id = u.query_id AND v.chunk_id = u.chunk_id AND u.pos <= v.last AND u.pos >= v.last - 1 - v.dist),
p2 AS (SELECT query_id, leaf, term, chunk_id, any_value(len) AS len, count(*) AS tf FROM k2 GROUP BY ALL),
sn AS (SELECT term, count(DISTINCT chunk_id) AS seen FROM t GROUP BY term), g AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM x)
SELECT query_id, chunk_id, round(greatest(1e-4, sum((CASE WHEN ln((n - seen + 0.5) / (seen + 0.5)) > 0 THEN ln((n - seen + 0.5) / (seen + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)))), 6) AS score
FROM p2 JOIN sn ON sn.term = p2.term, g GROUP BY query_id, chunk_id"""


@_register("d7_near_groups", _near_sql())
def _d7g(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(q, "NEAR({}, {})".format(" ".join(f'"{t}"' for t in ts), n)) for q, (ts, n) in _NEAR.items()], "query_id int, query string")
    hits = search_blocks(index(spark, d), lexical.compile_queries(asked).filter("NOT last"))
    return _rounded(hits.select("query_id", "chunk_id", "score"), "score")


@_register("d9_metadata_filter", f"WITH {_CORPUS} SELECT doc_id FROM c WHERE collection = 'en' AND contains(lower(title), 'doc 1') AND (contains(path, 'src1/') OR contains(path, 'src7/'))")
def _d9(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter(lexical.metadata_filter("en", "doc 1", "src1/, src7/")).select("doc_id")


def _gated(where: str = "true") -> str:
    """The lexical list ``fa`` of whole query texts over chunks (of ``k``) that fit ``where``."""
    return f"""{_bm25(_LEAVES)},
h AS (SELECT hl.query_id, hl.tier, hl.chunk_id, hl.score FROM hl JOIN nl ON nl.query_id = hl.query_id AND nl.tier = hl.tier JOIN k ON k.chunk_id = hl.chunk_id WHERE (hl.tier = 1 OR hl.met = nl.n) AND ({where})),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY round(score, 9) DESC, chunk_id) AS r FROM h) WHERE r <= 50),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY tier) AS u FROM b) WHERE u = 1),
f2 AS (SELECT query_id, tier, coalesce(sum(count(*)) OVER (PARTITION BY query_id ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e GROUP BY query_id, tier),
fa AS (SELECT e.query_id, chunk_id, e.tier, score * CASE WHEN e.tier = 1 THEN 0.5 ELSE 1 END AS score, row_number() OVER (PARTITION BY e.query_id ORDER BY e.tier, r) AS fts_rank FROM e JOIN f2 ON f2.query_id = e.query_id AND f2.tier = e.tier WHERE f2.before < 3)"""


@_register("d14_gated_tiers", f"WITH {_gated()} SELECT query_id, chunk_id, tier, round(score, 6) AS score, fts_rank FROM fa")
def _d14(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.lexical_search(corpus(spark, d), queries_with_vectors(spark, d)), "score")


# -- vectors ---------------------------------------------------------------------------

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_SCAN = f"SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"


def _vector_hits(spark: SparkSession, d: str, limit: int, kind: str = "cosine") -> DataFrame:
    rows = vectors(spark, d)
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return similarity.vector_scan(rows.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked, limit=limit, kind=kind)


@_register("e1_cosine_scan", f"WITH s AS ({_SCAN}) SELECT query_id, chunk_id, round(score, 6) AS score, vec_rank FROM ({_top('s', 10, 'vec_rank')})")
def _e1(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_vector_hits(spark, d, 10), "score")


def vector_index(spark: SparkSession, d: str) -> VectorIndex:
    """The partitioned index of the vectors, written once in an application."""
    key = (spark.sparkContext.applicationId, stamp(spark, f"{d}/embeddings.parquet"))
    if key not in _CELLS:
        _CELLS[key] = VectorIndex.of(vectors(spark, d).select(F.col("vec_id").alias("chunk_id"), "embedding"))
    return _CELLS[key]


_CELLS: dict[tuple[str, str], VectorIndex] = {}


@_register("e2_partitioned_vectors", f"WITH s AS ({_SCAN}) SELECT query_id, chunk_id, round(score, 6) AS score, vec_rank FROM ({_top('s', 10, 'vec_rank')})")
def _e2(spark: SparkSession, d: str) -> DataFrame:
    asked = vectors(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return _rounded(vector_index(spark, d).search(asked, limit=10), "score")


@_register("e5_int8", "SELECT vec_id, list_transform(embedding, lambda x: greatest(-128, least(127, round_even(x::DOUBLE * 127, 0)::INT))) AS q FROM embeddings")
def _e5(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("vec_id", V.to_int8(F.col("embedding")).alias("q"))


@_register("e6_bits", "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS q FROM embeddings")
def _e6(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("vec_id", V.to_bits(F.col("embedding")).alias("q"))


@_register("e9_prompts", "SELECT doc_id, 'title: Doc ' || doc_id || ' | text: ' || text AS prompt FROM documents")
def _e9(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.concat(F.lit("title: "), "title", F.lit(" | text: "), "body").alias("prompt"))


# -- hybrid search and what builds on it ---------------------------------------------------------


def _hybrid(where: str = "true", rerank: bool = False) -> str:
    """Fused and deduplicated hits ``dd`` of whole query texts, with their places and texts."""
    scored = """sc AS (SELECT f.*, f.rrf_score AS score FROM fused f)"""
    if rerank:
        scored = f"""ov AS (SELECT f.*, f.fts_rank IS NOT NULL AND f.vec_rank IS NOT NULL AS dual, len(list_intersect(list_distinct({_tok('q.text')}), list_distinct({_tok('k.body')}))) / len(list_distinct({_tok('q.text')})) AS rr FROM fused f JOIN k ON k.chunk_id = f.chunk_id JOIN benchmark q ON q.item_id = f.query_id),
mm AS (SELECT *, min(rrf_score) OVER v AS l1, max(rrf_score) OVER v AS h1, min(rr) OVER v AS l2, max(rr) OVER v AS h2 FROM ov WINDOW v AS (PARTITION BY query_id)),
nn AS (SELECT *, CASE WHEN h1 > l1 THEN (rrf_score - l1) / (h1 - l1) ELSE 1.0 END AS n1, CASE WHEN h2 > l2 THEN (rr - l2) / (h2 - l2) ELSE 0.5 END AS n2 FROM mm),
sc AS (SELECT *, CASE WHEN dual THEN greatest(0.5 * n1 + 0.5 * n2, 0.8 * n1) + 0.15 ELSE 0.5 * n1 + 0.5 * n2 END AS score FROM nn)"""
    return rf"""{_gated(where)},
qv AS (SELECT item_id AS query_id, a.embedding FROM benchmark JOIN embeddings a ON a.vec_id = item_id),
vs AS (SELECT a.query_id, k.chunk_id, {_COS} AS score FROM qv a, embeddings b JOIN k ON k.chunk_id = b.vec_id * 16777216 WHERE {where}), va AS ({_top('vs', 50, 'vec_rank')}),
u AS (SELECT coalesce(f.query_id, v.query_id) AS query_id, coalesce(f.chunk_id, v.chunk_id) AS chunk_id, fts_rank, vec_rank,
  coalesce(1 / (60 + fts_rank - 1.0) + CASE WHEN fts_rank = 1 THEN 0.05 WHEN fts_rank <= 3 THEN 0.02 ELSE 0 END, 0) + coalesce(1 / (60 + vec_rank - 1.0) + CASE WHEN vec_rank = 1 THEN 0.05 WHEN vec_rank <= 3 THEN 0.02 ELSE 0 END, 0) AS s
  FROM fa f FULL OUTER JOIN va v ON v.query_id = f.query_id AND v.chunk_id = f.chunk_id),
rr AS (SELECT *, s * CASE WHEN fts_rank IS NOT NULL AND vec_rank IS NOT NULL THEN 1.35 ELSE 1 END AS rrf_score FROM u),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, fts_rank ASC NULLS LAST, vec_rank ASC NULLS LAST) AS rrf_rank FROM rr) WHERE rrf_rank <= 20),
{scored},
dd AS (SELECT * FROM (SELECT s.query_id, s.chunk_id, s.score, k.collection, k.path, k.seq_id, k.title, k.body, row_number() OVER (PARTITION BY query_id, sha256(regexp_replace(k.body, '^\s+|\s+$', '', 'g')) ORDER BY round(s.score, 9) DESC, s.chunk_id) AS turn FROM sc s JOIN k ON k.chunk_id = s.chunk_id) WHERE turn = 1)"""


_RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dd"
_SHOWN = ("query_id", "chunk_id", "collection", "path", "seq_id", "score", "rank")


def _hits_sql(where: str = "true", rerank: bool = False, limit: int = 10) -> str:
    return f"WITH {_hybrid(where, rerank)} SELECT query_id, chunk_id, collection, path, seq_id, round(score, 6) AS score, rank FROM ({_RANKED}) WHERE rank <= {limit}"


@_register("f2_rrf", f"WITH {_hybrid()} SELECT query_id, chunk_id, fts_rank, vec_rank, round(rrf_score, 6) AS rrf_score, rrf_rank FROM fused")
def _f2(spark: SparkSession, d: str) -> DataFrame:
    own, asked = corpus(spark, d), queries_with_vectors(spark, d)
    fused = fusion.reciprocal_rank_fusion(search.lexical_search(own, asked), search.vector_search(own, asked))
    return _rounded(fused, "rrf_score").select("query_id", "chunk_id", "fts_rank", "vec_rank", "rrf_score", "rrf_rank")


_FIRST = "regexp_extract(text, '^[^.\\n]*', 0)"


@_register(
    "f11_four_lists",
    f"""WITH {_bm25(f"SELECT query_id, list AS tier, 0 AS leaf, [t] AS toks FROM (SELECT item_id AS query_id, 0 AS list, unnest(list_distinct({_BTOK})) AS t FROM benchmark UNION ALL SELECT item_id, 1, unnest(list_distinct({_tok(_FIRST)})) FROM benchmark)")},
fl AS (SELECT * FROM (SELECT query_id, chunk_id, 'fts' AS kind, row_number() OVER (PARTITION BY query_id, tier ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM hl) WHERE rank <= 50),
vs AS (SELECT item_id AS query_id, b.vec_id AS chunk_id, v.n, {_COS} AS score FROM benchmark CROSS JOIN (VALUES (0), (1)) v(n) JOIN embeddings a ON a.vec_id = item_id + v.n CROSS JOIN embeddings b),
vl AS (SELECT * FROM (SELECT query_id, chunk_id * 16777216 AS chunk_id, 'vec' AS kind, row_number() OVER (PARTITION BY query_id, n ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs) WHERE rank <= 50),
s AS (SELECT query_id, chunk_id, count(*) AS entries, min(rank) FILTER (kind = 'fts') AS fts_rank, min(rank) FILTER (kind = 'vec') AS vec_rank, sum(1 / (60 + rank - 1.0) + CASE WHEN rank = 1 THEN 0.05 WHEN rank <= 3 THEN 0.02 ELSE 0 END) AS t FROM (SELECT * FROM fl UNION ALL SELECT * FROM vl) GROUP BY query_id, chunk_id),
r AS (SELECT *, t * CASE WHEN fts_rank IS NOT NULL AND vec_rank IS NOT NULL THEN 1.35 ELSE 1 END AS rrf_score FROM s)
SELECT query_id, chunk_id, entries, round(rrf_score, 6) AS rrf_score, rrf_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, fts_rank ASC NULLS LAST, vec_rank ASC NULLS LAST, chunk_id) AS rrf_rank FROM r) WHERE rrf_rank <= 20""",
)
def _f11(spark: SparkSession, d: str) -> DataFrame:
    """Two lexical lists (whole items, their first sentences) and two of vectors, fused at once."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    texts = items.select(F.col("item_id"), F.explode(F.array(F.struct(F.lit(0).alias("list"), "text"), F.struct(F.lit(1).alias("list"), F.regexp_extract("text", r"^[^.\n]*", 0).alias("text")))).alias("x"))
    terms = texts.select(F.struct("item_id", "x.list").alias("query_id"), F.explode(F.array_distinct(T.tokens(F.col("x.text")))).alias("term"))
    fts = lexical.ranked(lexical.match(index(spark, d), terms, every=False, limit=50), 50)
    rows = vectors(spark, d)
    asked = items.select("item_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("list")).join(rows.withColumn("query", F.col("embedding")), F.col("vec_id") == F.col("item_id") + F.col("list"))
    vec = similarity.vector_scan(rows.select((F.col("vec_id") * C.MOST_CHUNKS).alias("chunk_id"), "embedding"), asked.select(F.struct("item_id", "list").alias("query_id"), "query"), limit=50)
    lists = fusion.as_list(fts, "fts").unionByName(fusion.as_list(vec, "vec")).withColumn("query_id", F.col("query_id.item_id"))
    return _rounded(fusion.fuse_lists(lists), "rrf_score").select("query_id", "chunk_id", "entries", "rrf_score", "rrf_rank")


@_register("f1_hybrid", _hits_sql())
def _f1(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.hybrid_search(corpus(spark, d), queries_with_vectors(spark, d)), "score").select(*_SHOWN)


_WHERE = "k.collection = 'en' AND (contains(k.path, 'src1/') OR contains(k.path, 'src7/') OR contains(k.path, 'src4/'))"


@_register("e11_filtered_hybrid", _hits_sql(_WHERE))
def _e11(spark: SparkSession, d: str) -> DataFrame:
    options = search.Options(where=lexical.metadata_filter("en", None, "src1/, src7/, src4/"))
    return _rounded(search.hybrid_search(corpus(spark, d), queries_with_vectors(spark, d), options), "score").select(*_SHOWN)


@_register("e3_filtered_vectors", f"WITH {_CORPUS}, qv AS (SELECT item_id AS query_id, a.embedding FROM benchmark JOIN embeddings a ON a.vec_id = item_id), s AS (SELECT a.query_id, k.chunk_id, {_COS} AS score FROM qv a, embeddings b JOIN k ON k.chunk_id = b.vec_id * 16777216 WHERE {_WHERE}) SELECT query_id, chunk_id, round(score, 6) AS score, vec_rank FROM ({_top('s', 10, 'vec_rank')})")
def _e3(spark: SparkSession, d: str) -> DataFrame:
    options = search.Options(vec_limit=10, where=lexical.metadata_filter("en", None, "src1/, src7/, src4/"))
    return _rounded(search.vector_search(corpus(spark, d), queries_with_vectors(spark, d), options), "score")


@_register("f8_rerank_blend", _hits_sql(rerank=True))
def _f8(spark: SparkSession, d: str) -> DataFrame:
    options = search.Options(rerank=search.overlap_reranker)
    return _rounded(search.hybrid_search(corpus(spark, d), queries_with_vectors(spark, d), options), "score").select(*_SHOWN)


_SEEN_WHERE = "NOT EXISTS (SELECT 1 FROM conversations v JOIN documents d ON d.doc_id = v.conv_id WHERE v.conv_id % 7 = {0} % 7 AND k.doc_id = d.doc_id AND k.seq_id = v.turn % 3)"


def _by_session(where: str) -> str:
    """The hybrid query with a filter that names the query's number."""
    return _hits_sql(where.format("hl.query_id")).replace("hl.query_id % 7 AND k.doc_id = d.doc_id AND k.seq_id = v.turn % 3)), va AS", "a.query_id % 7 AND k.doc_id = d.doc_id AND k.seq_id = v.turn % 3)), va AS").replace("WHERE NOT EXISTS (SELECT 1 FROM conversations v JOIN documents d ON d.doc_id = v.conv_id WHERE v.conv_id % 7 = hl.query_id % 7", "WHERE NOT EXISTS (SELECT 1 FROM conversations v JOIN documents d ON d.doc_id = v.conv_id WHERE v.conv_id % 7 = a.query_id % 7")


@_register("i4_search_unseen", _by_session(_SEEN_WHERE))
def _i4h(spark: SparkSession, d: str) -> DataFrame:
    seen = _results(spark, d).withColumn("session_id", F.col("session_id") % 7)
    asked = queries_with_vectors(spark, d).withColumn("session_id", F.col("query_id") % 7)
    hits = search.hybrid_search(corpus(spark, d), asked, search.Options(seen=seen))
    return _rounded(hits, "score").select(*_SHOWN)


def _discover_sql(source: str) -> str:
    return f"bb AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection, path ORDER BY round(score, 9) DESC, chunk_id) AS r, count(*) OVER (PARTITION BY query_id, collection, path) AS match_count FROM ({source})) SELECT query_id, collection, path, chunk_id, seq_id, round(score, 6) AS score, match_count, rank FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bb WHERE r = 1) WHERE rank <= 10"


_FOUND = ("query_id", "collection", "path", "chunk_id", "seq_id", "score", "match_count", "rank")


@_register("g8_discover", f"WITH {_hybrid()}, " + _discover_sql(f"SELECT * FROM ({_RANKED}) WHERE rank <= 60"))
def _g8(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.discover(corpus(spark, d), queries_with_vectors(spark, d)), "score").select(*_FOUND)


def _w2n(limit: int) -> str:
    """The pool ``po`` of the wide-to-narrow search."""
    return f"""hd AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM ({_RANKED}) WHERE rank <= {max(50, 5 * limit)}),
td AS (SELECT * FROM (SELECT query_id, collection, path, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 9) DESC, collection, path) AS r FROM hd GROUP BY query_id, collection, path) WHERE r <= 3),
tr AS (SELECT * FROM (SELECT query_id, collection, dir, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score) * 0.75, 9) DESC, collection, dir) AS r FROM hd WHERE dir <> '' GROUP BY query_id, collection, dir) WHERE r <= 3),
bo AS (SELECT hd.*, td.r IS NOT NULL OR tr.r IS NOT NULL AS boosted, CASE WHEN td.r IS NOT NULL THEN 1.35 WHEN tr.r IS NOT NULL THEN 1.15 ELSE 1 END AS boost FROM hd LEFT JOIN td USING (query_id, collection, path) LEFT JOIN tr USING (query_id, collection, dir)),
en AS (SELECT * EXCLUDE (rank), count(*) FILTER (boosted) OVER (PARTITION BY query_id) >= {limit} AS enough, row_number() OVER (PARTITION BY query_id, collection, path, substr(body, 1, 50) ORDER BY boosted DESC, round(score, 9) DESC, chunk_id) AS alike FROM bo),
po AS (SELECT * FROM (SELECT * REPLACE (score * boost AS score), row_number() OVER (PARTITION BY query_id ORDER BY round(score * boost, 9) DESC, chunk_id) AS rank FROM en WHERE boosted OR (NOT enough AND alike = 1)) WHERE rank <= {2 * limit})"""


@_register("g1_wide_to_narrow", f"WITH {_hybrid()}, {_w2n(10)} SELECT query_id, chunk_id, boosted, round(score, 6) AS score, rank FROM po WHERE rank <= 10")
def _g1(spark: SparkSession, d: str) -> DataFrame:
    hits = search.wide_to_narrow_search(corpus(spark, d), queries_with_vectors(spark, d))
    return _rounded(hits, "score").select("query_id", "chunk_id", "boosted", "score", "rank")


@_register("g2_wide_phase", _hits_sql(limit=50))
def _g2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.hybrid_search(corpus(spark, d), queries_with_vectors(spark, d), search.Options(limit=50)), "score").select(*_SHOWN)


@_register(
    "g7_reranked_pool",
    f"""WITH {_hybrid()}, {_w2n(10)}, ov AS (SELECT p.*, len(list_intersect(list_distinct({_tok('q.text')}), list_distinct({_tok('p.body')}))) / len(list_distinct({_tok('q.text')})) AS rr FROM po p JOIN benchmark q ON q.item_id = p.query_id),
mm AS (SELECT *, min(score) OVER v AS l1, max(score) OVER v AS h1, min(rr) OVER v AS l2, max(rr) OVER v AS h2 FROM ov WINDOW v AS (PARTITION BY query_id)),
nn AS (SELECT query_id, chunk_id, 0.5 * CASE WHEN h1 > l1 THEN (score - l1) / (h1 - l1) ELSE 1.0 END + 0.5 * CASE WHEN h2 > l2 THEN (rr - l2) / (h2 - l2) ELSE 0.5 END AS score FROM mm)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM nn) WHERE rank <= 10""",
)
def _g7(spark: SparkSession, d: str) -> DataFrame:
    hits = search.wide_to_narrow_search(corpus(spark, d), queries_with_vectors(spark, d), search.Options(rerank=search.overlap_reranker))
    return _rounded(hits, "score").select("query_id", "chunk_id", "score", "rank")


@_register("g8_discover_narrow", f"WITH {_hybrid()}, {_w2n(60)}, " + _discover_sql("SELECT * FROM po WHERE rank <= 60"))
def _g8n(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.discover(corpus(spark, d), queries_with_vectors(spark, d), narrow=True), "score").select(*_FOUND)


@_register("g9_group_by_document", f"WITH {_hybrid()}, hh AS (SELECT * FROM ({_RANKED}) WHERE rank <= 20), bb AS (SELECT * EXCLUDE (turn), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS turn, greatest(count(*) OVER (PARTITION BY query_id) - 5, 0) AS omitted FROM hh) SELECT query_id, collection, path, round(max(score) FILTER (turn <= 5), 6) AS score, list(seq_id ORDER BY seq_id) FILTER (turn <= 5) AS seqs, max(omitted) AS omitted, row_number() OVER (PARTITION BY query_id ORDER BY round(max(score) FILTER (turn <= 5), 9) DESC, collection, path) AS rank FROM bb GROUP BY query_id, collection, path HAVING count(*) FILTER (turn <= 5) > 0")
def _g9(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.group_by_document(search.hybrid_search(corpus(spark, d), queries_with_vectors(spark, d), search.Options(limit=20)), cap=5)
    return _rounded(out.select("query_id", "collection", "path", "score", F.transform("chunks", lambda c: c["seq_id"]).alias("seqs"), "omitted", "rank"), "score")


# -- inspection --------------------------------------------------------------------------


@_register("h8_grep", f"WITH {_CORPUS}, l AS (SELECT collection, path, title, unnest(string_split(body, chr(10))) AS line_text, unnest(range(1, len(string_split(body, chr(10))) + 1))::INT AS line_number FROM c) SELECT collection, path, title, line_number, line_text, regexp_extract(line_text, '(?i)token = .[0-9a-f]+', 0) AS match_text FROM l WHERE regexp_matches(line_text, '(?i)token = .[0-9a-f]+') ORDER BY collection, path, line_number LIMIT 50")
def _h8(spark: SparkSession, d: str) -> DataFrame:
    return inspect.grep(documents(spark, d), "token = .[0-9a-f]+", is_regex=True)


@_register("h6_read_window", f"WITH {_CORPUS} SELECT collection, path, seq_id, body FROM k WHERE doc_id % 50 = 0 AND seq_id <= 3")
def _h6(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d)
    targets = documents(spark, d).filter("doc_id % 50 = 0").select("collection", "path", F.lit(1).alias("seq_id"))
    return inspect.read_window(rows, targets, window=2).select("collection", "path", "seq_id", "body")


@_register("h7_tree", f"WITH {_CORPUS}, n AS (SELECT collection, unnest([{{'depth': 0, 'parent': '', 'name': split_part(path, '/', 1), 'type': 'directory'}}, {{'depth': 1, 'parent': split_part(path, '/', 1), 'name': split_part(path, '/', 2), 'type': 'file'}}]) AS s FROM c WHERE contains(lower(path), '_1') OR contains(lower(title), '_1')) SELECT collection, s.depth AS depth, s.parent AS parent, s.name AS name, s.type AS type, count(*) AS files FROM n GROUP BY ALL")
def _h7(spark: SparkSession, d: str) -> DataFrame:
    return inspect.tree(documents(spark, d), pattern="_1")


@_register("h9_raw_document", f"WITH {_CORPUS} SELECT doc_id, body FROM c WHERE path = 'src3/doc_3.md'")
def _h9(spark: SparkSession, d: str) -> DataFrame:
    return inspect.raw_document(documents(spark, d), None, "src3/doc_3.md").select("doc_id", "body")


@_register("h10_collection_counts", "SELECT n AS collection, count(d.lang) AS documents FROM (VALUES ('en'), ('de'), ('it')) v(n) LEFT JOIN documents d ON d.lang = n GROUP BY n")
def _h10(spark: SparkSession, d: str) -> DataFrame:
    return inspect.collection_counts(documents(spark, d), spark.sql("SELECT * FROM VALUES ('en'), ('de'), ('it') AS v(collection)"))


# -- maintenance: the old snapshot lacks some documents, has others changed, moved or gone ---------

_SNAP = f"WITH {_CORPUS}, cur AS (SELECT doc_id, collection, path, title, hash FROM c), old AS (SELECT doc_id, collection, CASE WHEN doc_id % 11 = 0 THEN 'old/' || path ELSE path END AS path, title, CASE WHEN doc_id % 5 = 0 THEN 'x' || hash ELSE hash END AS hash FROM c WHERE doc_id % 3 <> 0)"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = documents(spark, d).select("doc_id", "collection", "path", "title", "hash")
    old = rows.filter("doc_id % 3 <> 0").withColumn("path", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path"))).withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")))
    return rows, old


@_register(
    "b1_change_detection",
    f"""{_SNAP}, g AS (SELECT collection, hash, min(path) AS old_path FROM old o WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.collection = o.collection AND cur.path = o.path) GROUP BY collection, hash),
j AS (SELECT cur.collection, cur.path, cur.hash, old.hash AS oh, g.old_path AS op, row_number() OVER (PARTITION BY cur.collection, cur.hash, old.hash IS NULL ORDER BY cur.path) AS turn FROM cur LEFT JOIN old ON old.collection = cur.collection AND old.path = cur.path LEFT JOIN g ON g.collection = cur.collection AND g.hash = cur.hash),
s AS (SELECT *, CASE WHEN oh = hash THEN 'unchanged' WHEN oh IS NOT NULL THEN 'changed' WHEN op IS NOT NULL AND turn = 1 THEN 'moved' ELSE 'new' END AS state FROM j)
SELECT collection, path, hash, state, CASE WHEN state = 'moved' THEN op END AS old_path FROM s""",
)
def _b1(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.classify(*_snapshots(spark, d))


@_register("b3_unseen_content", f"{_SNAP} SELECT DISTINCT hash FROM cur WHERE hash NOT IN (SELECT hash FROM old)")
def _b3(spark: SparkSession, d: str) -> DataFrame:
    cur, old = _snapshots(spark, d)
    return maintenance.unseen_content(cur, old.select("hash").distinct())


@_register("b4_upsert", f"{_SNAP} SELECT doc_id, collection, path, hash, version FROM (SELECT *, row_number() OVER (PARTITION BY collection, path ORDER BY version DESC) AS r FROM (SELECT *, 2 AS version FROM cur UNION ALL SELECT *, 1 FROM old)) WHERE r = 1")
def _b4(spark: SparkSession, d: str) -> DataFrame:
    cur, old = _snapshots(spark, d)
    return maintenance.latest(cur.withColumn("version", F.lit(2)).unionByName(old.withColumn("version", F.lit(1))), ["collection", "path"], "version").drop("title")


@_register("b5_stale", f"{_SNAP} SELECT doc_id, collection, path FROM old o WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.collection = o.collection AND cur.path = o.path)")
def _b5(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.stale(*_snapshots(spark, d)).select("doc_id", "collection", "path")


@_register("b6_pruned", f"{_SNAP} SELECT doc_id FROM old WHERE collection NOT IN ('en', 'fr')")
def _b6(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.pruned(_snapshots(spark, d)[1], spark.sql("SELECT * FROM VALUES ('en'), ('fr') AS v(collection)")).select("doc_id")


@_register("b7_orphans", f"{_SNAP} SELECT DISTINCT hash FROM old WHERE hash NOT IN (SELECT hash FROM cur)")
def _b7(spark: SparkSession, d: str) -> DataFrame:
    cur, old = _snapshots(spark, d)
    return maintenance.orphans(old.select("hash").distinct(), cur)


@_register("b9_backfill", f"WITH {_CORPUS}, f AS (SELECT hash, arg_min(collection, doc_id) AS collection, arg_min(path, doc_id) AS path FROM c GROUP BY hash), u AS (SELECT DISTINCT hash, seq_id FROM k) SELECT u.hash, seq_id, collection, path FROM u JOIN f ON f.hash = u.hash")
def _b9(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.backfill(chunks(spark, d).select("hash", "seq_id").distinct(), documents(spark, d)).drop("title")


# -- sessions: conversations as sessions whose turns read chunks ------------------------------------


_SEEN = "r AS (SELECT conv_id AS session_id, lang AS collection, source || '/doc_' || doc_id || '.md' AS path, (turn % 3)::INT AS seq_id FROM conversations JOIN documents ON doc_id = conv_id)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    talks = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("session_id"), (F.col("turn") % 3).cast("int").alias("seq_id"))
    return talks.join(documents(spark, d), F.col("doc_id") == F.col("session_id")).select("session_id", "collection", "path", "seq_id")


@_register("i3_seen_set", f"WITH {_SEEN} SELECT DISTINCT * FROM r")
def _i3(spark: SparkSession, d: str) -> DataFrame:
    return sessions.seen(_results(spark, d))


@_register("i4_exclude_seen", f"WITH {_CORPUS}, {_SEEN} SELECT chunk_id FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.collection = k.collection AND r.path = k.path AND r.seq_id = k.seq_id)")
def _i4(spark: SparkSession, d: str) -> DataFrame:
    return sessions.exclude_seen(chunks(spark, d), sessions.seen(_results(spark, d))).select("chunk_id")


@_register("i4_exclusion_stats", f"WITH {_CORPUS}, {_SEEN} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM k WHERE EXISTS (SELECT 1 FROM r WHERE r.collection = k.collection AND r.path = k.path AND r.seq_id = k.seq_id)")
def _i4s(spark: SparkSession, d: str) -> DataFrame:
    return sessions.exclusion_stats(chunks(spark, d), _results(spark, d))


@_register("i8_session_info", f"WITH {_SEEN} SELECT e.session_id, e.n AS events, coalesce(x.n, 0) AS results, coalesce(x.d, 0) AS documents FROM (SELECT conv_id AS session_id, count(*) AS n FROM conversations GROUP BY 1) e LEFT JOIN (SELECT session_id, count(*) AS n, count(DISTINCT collection || path) AS d FROM r GROUP BY 1) x ON x.session_id = e.session_id")
def _i8(spark: SparkSession, d: str) -> DataFrame:
    talks = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("session_id"))
    return sessions.session_info(talks, _results(spark, d))


@_register("i1_touch_session", "SELECT user_id AS session_id, min(ts) AS created_at, max(ts) AS last_active_at FROM events GROUP BY user_id")
def _i1(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"), F.col("ts").alias("last_active_at"))
    return sessions.touch(rows.limit(0), rows)


@_register("i7_json_round_trip", "SELECT doc_id, lang, n_chars FROM documents")
def _i7(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("j"))
    return rows.select(F.from_json("j", "doc_id long, lang string, n_chars long").alias("r")).select("r.*")


# -- scalars and formats over results ---------------------------------------------------


@_register("a3_supported_types", "SELECT page_id, url, lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('md', 'markdown', 'txt', 'csv', 'html', 'htm', 'epub', 'docx', 'xlsx', 'pptx', 'pdf') AS supported FROM pages")
def _a3(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", files.is_supported(F.col("url")).alias("supported"))


@_register("c2_strip_links", r"SELECT doc_id, regexp_replace(regexp_replace('see ![' || lang || '](i.png) and [' || source || '](u) ' || text, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g') AS text FROM documents")
def _c2(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet")
    linked = F.concat(F.lit("see !["), "lang", F.lit("](i.png) and ["), "source", F.lit("](u) "), "text")
    return rows.select("doc_id", T.strip_links(linked).alias("text"))


@_register("e2_hamming", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, 1 / (1 + len(list_filter(list_zip(a.embedding, b.embedding), lambda p: (p[1] > 0) <> (p[2] > 0)))) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) SELECT query_id, chunk_id, round(score, 6) AS score, vec_rank FROM ({_top('s', 10, 'vec_rank')})")
def _e2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_vector_hits(spark, d, 10, "hamming"), "score")


_INT8 = "list_transform(b.embedding, lambda x: greatest(-128, least(127, round_even(x::DOUBLE * 127, 0)::INT)) / 127.0::DOUBLE)"


@_register("e7_asymmetric", f"WITH s AS (SELECT query_id, chunk_id, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.embedding::DOUBLE[] AS x, {_INT8}::DOUBLE[] AS y FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) SELECT query_id, chunk_id, round(score, 6) AS score, vec_rank FROM ({_top('s', 10, 'vec_rank')})")
def _e7(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_vector_hits(spark, d, 10, "int8"), "score")


@_register("h5_read_by_id", f"WITH {_CORPUS} SELECT chunk_id, collection, path, seq_id FROM k WHERE doc_id IN (3, 7) AND seq_id <= 2")
def _h5(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d)
    targets = rows.filter(F.col("chunk_id").isin(3 * C.MOST_CHUNKS + 1, 7 * C.MOST_CHUNKS + 1)).select("collection", "path", "seq_id")
    both = targets.unionByName(documents(spark, d).filter("doc_id IN (3, 7)").select("collection", "path", F.lit(1).alias("seq_id")))
    return inspect.read_window(rows, both, window=1).select("chunk_id", "collection", "path", "seq_id")


@_register("j11_sanitized_term", "SELECT doc_id, translate('\"' || text || '*^?', '\"'':?*^~', '') AS term FROM documents")
def _j11(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.sanitize_term(F.concat(F.lit('"'), "body", F.lit("*^?"))).alias("term"))


@_register("j13_clean_header", r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS clean, regexp_replace(lower(text), '[^\p{L}\p{N}_]', '', 'g') AS plain FROM documents")
def _j13(spark: SparkSession, d: str) -> DataFrame:
    head = T.clean_header(F.concat(F.lit(" ## "), "body", F.lit(" ")))
    return documents(spark, d).select("doc_id", head.alias("clean"), T.normalized(head).alias("plain"))


@_register("k7_grep_xml", f"""WITH {_CORPUS}, l AS (SELECT collection, path, title, unnest(string_split(body, chr(10))) AS t, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS n FROM c)
SELECT collection, path, '  <document uri="lode://' || collection || '/' || path || '" title="' || title || '">' || chr(10) || string_agg('    <match line="' || n || '">' || replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</match>', chr(10) ORDER BY n) || chr(10) || '  </document>' AS xml
FROM l WHERE regexp_matches(t, '(?i)token = .[0-9a-f]+') GROUP BY collection, path, title""")
def _k7(spark: SparkSession, d: str) -> DataFrame:
    return render.grep_xml(inspect.grep(documents(spark, d), "token = .[0-9a-f]+", is_regex=True, limit=None))


# -- operators that SQL can't express ---------------------------------------------------------------


@_register("a10_html_to_markdown")
def _a10(spark: SparkSession, d: str) -> DataFrame:
    return files.pages_to_markdown(spark.read.parquet(f"{d}/pages.parquet"))


@_register("c6_markdown_chunks")
def _c6(spark: SparkSession, d: str) -> DataFrame:
    return markdown.markdown_chunks(documents(spark, d))


def markdown_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents with headings and code fences made of their lines."""
    rows = documents(spark, d)
    line = lambda x, i: F.when(i % 11 == 5, F.lit("```")).when(i % 3 == 0, F.concat(F.lit("## "), x)).when(i % 5 == 1, F.concat(F.lit("### "), x)).otherwise(x)
    body = F.concat(F.lit("# "), "title", F.lit("\n"), F.array_join(F.transform(F.split("body", "\n"), line), "\n"))
    return rows.withColumn("body", body)


_MD = r"""md AS (SELECT doc_id, collection, path, title, '# ' || title || chr(10) || array_to_string(list_transform(string_split(body, chr(10)), lambda x, i: CASE WHEN (i - 1) % 11 = 5 THEN '```' WHEN (i - 1) % 3 = 0 THEN '## ' || x WHEN (i - 1) % 5 = 1 THEN '### ' || x ELSE x END), chr(10)) AS body FROM c),
li AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS x, unnest(range(1, len(string_split(body, chr(10))) + 1))::INT AS n FROM md),
fe AS (SELECT *, sum(CASE WHEN starts_with(ltrim(x), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS fences, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_offset FROM li),
hd AS (SELECT doc_id, n AS line_num, length(regexp_extract(x, '^(#+)', 1))::INT AS level, trim(regexp_extract(x, '^#+\s+(.*)', 1)) AS text, char_offset FROM fe WHERE fences % 2 = 0 AND regexp_matches(x || chr(10), '^#+\s'))"""


@_register("c3_headings", f"WITH {_CORPUS}, {_MD} SELECT * FROM hd")
def _c3(spark: SparkSession, d: str) -> DataFrame:
    return inspect.headings(markdown_documents(spark, d))


@_register(
    "h4_outline",
    f"""WITH {_CORPUS}, {_MD}, pa AS (SELECT doc_id, length(body) AS chars, greatest(ceil(length(body) / 200.0)::INT, 1) - 1 AS last FROM md),
st AS (SELECT hd.*, pa.chars, pa.last, least(char_offset // 200, last)::INT AS start_seq FROM hd JOIN pa ON pa.doc_id = hd.doc_id),
ne AS (SELECT a.*, (SELECT arg_min(b.start_seq, b.line_num) FROM st b WHERE b.doc_id = a.doc_id AND b.line_num > a.line_num AND b.level <= a.level) AS nxt FROM st a),
en AS (SELECT *, CASE WHEN nxt IS NULL THEN last ELSE greatest(nxt - 1, start_seq) END AS end_seq FROM ne)
SELECT doc_id, line_num, level, text, start_seq, end_seq, (least((end_seq + 1) * 200, chars) - start_seq * 200)::BIGINT AS char_count FROM en""",
)
def _h4(spark: SparkSession, d: str) -> DataFrame:
    rows = markdown_documents(spark, d)
    parts = C.window_chunks(rows, size=200, overlap=0).select("doc_id", "seq_id", (F.col("seq_id") * 200).alias("start"), F.length("body").alias("chars"))
    return inspect.outline(inspect.headings(rows), parts)


@_register("h1_document_outline", f"""WITH {_CORPUS}, {_MD}, one AS (SELECT * FROM md WHERE path = 'src3/doc_3.md') SELECT collection, path, title, greatest(ceil(length(body) / 300.0)::INT, 1)::BIGINT AS total_chunks, length(body)::BIGINT AS total_chars, (SELECT count(*) FROM hd WHERE hd.doc_id = one.doc_id)::INT AS n_headings FROM one""")
def _h1(spark: SparkSession, d: str) -> DataFrame:
    rows = markdown_documents(spark, d)
    parts = C.window_chunks(rows, size=300, overlap=0).select("collection", "path", "seq_id", F.col("body").alias("text"))
    out = inspect.document_outline(rows, parts, None, "src3/doc_3.md")
    return out.select("collection", "path", "title", "total_chunks", "total_chars", F.size("headings").alias("n_headings"))


@_register("c1_markdown_chunks")
def _c1(spark: SparkSession, d: str) -> DataFrame:
    return markdown.markdown_chunks(markdown_documents(spark, d))


@_register("g10_merged_snippets")
def _g10(spark: SparkSession, d: str) -> DataFrame:
    hits = search.hybrid_search(corpus(spark, d), queries_with_vectors(spark, d), search.Options(limit=20))
    return markdown.merged_snippets(hits.withColumn("headers", F.lit("")))
