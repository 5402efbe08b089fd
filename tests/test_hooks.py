"""Globs, image windows, expansions, partitioned vectors, and what is kept of scores and results."""

import io
import pathlib
import threading
import time
import zipfile

import numpy as np
import pytest

from lodestone.engine import Engine
from lodestone.functions import globs
from lodestone.functions.embed import pair_scores
from lodestone.functions.parse import expansions
from lodestone.operators import search
from lodestone.operators.similarity import vector_scan
from lodestone.operators.vector_index import VectorIndex
from lodestone.settings import Collection, Settings
from lodestone.sources import files

PATTERNS = ("*.md", "sub/*.md", "**/*.md", "**/a/*.md", "a/**/b.md", "*/*.md", "**/?.md", "**/[ab].md", "**/[!a].md", "sub/a/*", "none/*.md", "**/x.y/*.md", "sub/**", "**/a/**/*.md", "a*/b*.md", "./sub/*.md", "sub/*.m[dk]*")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name in ("a.md", "b.md", "c.txt", ".h.md", "sub/a.md", "sub/b.md", "sub/a/b.md", "sub/a/c.md", "a/b.md", "a/x/b.md", "a/x/y/b.md", "x.y/d.md", "sub/x.y/e.md", "ab/bc.md", "sub/[a].md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    return root


@pytest.mark.parametrize("pattern", PATTERNS)
def test_globs_are_those_of_python(spark, tree, pattern):
    want = sorted(str(p.relative_to(tree)) for p in tree.glob(pattern) if p.is_file())
    every = [str(p.relative_to(tree)) for p in tree.rglob("*") if p.is_file()]
    import re

    assert sorted(p for p in every if re.match(globs.compiled(pattern).regex, p)) == want
    got = sorted(r.path for r in files.scan(spark, str(tree), "c", glob=pattern).select("path").collect())
    assert [p for p in got if "/." not in f"/{p}"] == [p for p in want if "/." not in f"/{p}"]  # Spark lists no hidden files


def test_only_folders_that_can_match_are_listed(spark, tree):
    assert globs.compiled("sub/a/*.md") == globs.Glob("sub/a", r"^sub/a/[^/]*\.md$", False, "*.md")
    assert {pathlib.Path(f).parent.name for f in files.scan(spark, str(tree), "c", glob="sub/*.md").inputFiles()} == {"sub"}


def test_images_in_order_with_a_window_of_calls(spark):
    live, most, lock = 0, 0, threading.Lock()

    def slow(data):
        nonlocal live, most
        with lock:
            live += 1
            most = max(most, live)
        time.sleep(0.02 if data[0] % 3 else 0.06)
        with lock:
            live -= 1
        if data[0] == 7:
            raise ValueError("unreadable")
        return f"seen {data[0]}"

    got = list(files.in_window(slow, [bytes([i]) for i in range(20)], 4))
    assert got == [(None, "ValueError: unreadable") if i == 7 else (f"seen {i}", None) for i in range(20)]
    assert 2 <= most <= 4
    assert list(files.in_window(slow, [], 4)) == []


def test_descriptions_stand_below_their_images(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i/one.png" media-type="image/png"/><item id="j" href="i/two.png" media-type="image/png"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("O/a.xhtml", '<html><body><p>before</p><img src="i/one.png" alt="x"/><p>between</p><img src="i/two.png" alt="y"/><p>after</p></body></html>')
        z.writestr("O/i/one.png", b"1")
        z.writestr("O/i/two.png", b"2")

    def describe(content):
        if content == b"2":
            raise ValueError("no")
        return "a red\n fox"

    df = spark.createDataFrame([("c", "b.epub", bytearray(data.getvalue())), ("c", "n.md", bytearray(b"plain ![x](one.png)"))], "collection string, path string, content binary")
    got = {r.path: r.body for r in files.to_markdown(df, describe, 2).collect()}
    text = got["b.epub"]
    assert text.index("before") < text.index("one.png") < text.index("> a red fox") < text.index("between") < text.index("two.png") < text.index("after")
    assert got["n.md"] == "plain ![x](one.png)"


def test_expansions_of_an_answer():
    assert expansions("lex: red   fox\nnoise\n vec: a fox\nlex: red fox\nhyde:\nhyde: it runs") == [("lex", "red fox"), ("vec", "a fox"), ("hyde", "it runs")]


def counted(path, name="counted"):
    """A scorer that counts its pairs in a file, since it runs in other processes."""

    class Counted:
        model, log = name, str(path)

        def score(self, pairs):
            with open(self.log, "a") as f:
                f.write("x" * len(pairs))
            return [float(len(set(q.split()) & set(t.split()))) for q, t in pairs]

    return Counted()


def test_pairs_are_scored_once(spark, tmp_path):
    scorer = counted(tmp_path / "log")
    hits = spark.createDataFrame([(1, 10, "a b", "a c"), (1, 11, "a b", "a b"), (2, 10, "a b", "a c"), (3, 12, None, "x"), (3, 13, "a b", None)], "query_id int, chunk_id int, query string, text string")
    scores, fresh = pair_scores(hits, scorer)
    rows = fresh.collect()
    assert len(rows) == 2 and (tmp_path / "log").read_text() == "xx"
    kept = spark.createDataFrame(rows, fresh.schema)
    scores, again = pair_scores(hits, scorer, kept)
    assert again.count() == 0
    assert sorted((r.query_id, r.chunk_id, r.rerank_score) for r in scores.collect() if r.rerank_score is not None) == [(1, 10, 1.0), (1, 11, 2.0), (2, 10, 1.0)]
    assert pair_scores(hits, counted(tmp_path / "other", "b"), kept)[1].count() == 2


def test_an_engine_keeps_scores_and_results(spark, tmp_path):
    (tmp_path / "n").mkdir()
    for i, t in enumerate(("red fox runs", "blue fox sleeps", "green bird sings")):
        (tmp_path / "n" / f"{i}.md").write_text(t)
    settings = Settings(collections={"n": Collection(str(tmp_path / "n"))}, index=str(tmp_path / "ix"))
    scorer = counted(tmp_path / "log")
    one = Engine(spark, settings, scorer=scorer)
    one.update()
    first = one.find("fox runs", deep=True)[0]
    scored = (tmp_path / "log").read_text()
    assert first[0]["path"] == "0.md" and 0 < len(scored) <= 3
    two = Engine(spark, settings, scorer=scorer)  # as another process: nothing in its memory
    assert two.find("fox runs", deep=True)[0] == first and (tmp_path / "log").read_text() == scored
    assert one.store.table("cached").count() == 1
    two.find("fox runs", deep=True, limit=2)  # another request, the same pairs
    assert (tmp_path / "log").read_text() == scored
    more = Engine(spark, settings, expander=lambda queries: ["lex: bird\nvec: green bird" for _ in queries])
    assert {h["path"] for h in more.find("fox runs", fts_limit=1, vec_limit=1)[0]} >= {"0.md", "2.md"}


def test_partitioned_vectors_equal_a_scan(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = [c + 0.15 * rng.normal(size=16) for c in centres for _ in range(60)]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(900, [0.0] * 16), (901, None), (902, [1.0, 2.0]), (903, rows0 := [float(y) for y in x[0]]), (904, rows0)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = vectors.filter("chunk_id % 50 = 0 AND chunk_id < 720").selectExpr("chunk_id AS query_id", "embedding AS query")
    index = VectorIndex.of(vectors, cells=12)
    best = lambda df: sorted((r.query_id, r.vec_rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    want = best(vector_scan(vectors, asked, limit=7))
    for probes in (1, 3):
        assert best(index.search(asked, limit=7, probes=probes)) == want
    assert index.probes_for(asked, 0.9, limit=7) <= 4  # close groups need few cells
    small = best(index.search(asked, limit=2000, probes=1))
    assert small == best(vector_scan(vectors, asked, limit=2000))
    assert best(VectorIndex.of(vectors.limit(0)).search(asked, limit=3)) == []


def test_expanded_lists_are_fused(spark):
    from lodestone.operators import lexical
    from lodestone.operators.postings import PostingIndex

    texts = ["red fox", "blue bird", "green fish", "old stone"]
    chunks = spark.createDataFrame([(i, "c", f"p{i}", 0, "t", t) for i, t in enumerate(texts)], "chunk_id long, collection string, path string, seq_id int, title string, text string")
    vectors = spark.createDataFrame([(i, [float(i == k) for k in range(4)]) for i in range(4)], "chunk_id long, embedding array<float>")
    corpus = search.Corpus(chunks, PostingIndex.of(lexical.index_chunks(chunks.withColumnRenamed("text", "body"), ("body",))), vectors)
    queries = spark.createDataFrame([(1, "fox", [1.0, 0.0, 0.0, 0.0])], "query_id long, query string, vector array<float>")
    expand = lambda rows: search.expanded(rows, lambda qs: ["lex: bird\nvec: x\nhyde: y" for _ in qs])
    embed = lambda rows: rows.selectExpr("query_id", "query", "array(0F, 0F, IF(query = 'x', 1F, 0F), IF(query = 'y', 1F, 0F)) AS vector")
    got = search.hybrid_search(corpus, queries, search.Options(vec_limit=1, expand=expand, embed=embed)).collect()
    share = 1 / 60 + 0.05
    assert {r.chunk_id: round(r.score, 9) for r in got} == {0: round(1.35 * 2 * share, 9), 1: round(share, 9), 2: round(share, 9), 3: round(share, 9)}
