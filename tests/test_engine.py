"""The stored index, the engine on it, and its surfaces: commands, batches, web and tool requests."""

import io
import json
import random
import sqlite3
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli, server
from lodestone.engine import Engine
from lodestone.functions.embed import HashingEmbedder, document_prompt, embedded, embedded_queries, with_context
from lodestone.functions.stem import fold, porter
from lodestone.operators import lexical, postings, search
from lodestone.operators.postings import PostingIndex, search_blocks
from lodestone.operators.similarity import vector_scan
from lodestone.operators.store import LAYOUT, Store
from lodestone.settings import Collection, Settings, load


def counting(path):
    """An embedder that counts its texts in a file, since it runs in other processes."""

    class Counting(HashingEmbedder):
        log = path

        def embed(self, texts):
            with open(self.log, "a") as f:
                f.write("x" * len(texts))
            return HashingEmbedder.embed(self, texts)

    return Counting()


def _write(folder, **texts):
    for name, text in texts.items():
        path = folder / name.replace("__", "/")
        path = path.with_suffix(".md")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text)


def spark_words(spark, words):
    return spark.createDataFrame([(w, w) for w in words], "query_id string, term string")


def scored(store, words):
    hits = search_blocks(store.postings(), lexical.asked_terms(spark_words(store.spark, words), every=False))
    return sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in hits.collect())


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    _write(root / "notes", **{"engine__guide": "# Python Guide\nintro\n## Installation\n```bash\n# comment\n```\n### Windows\nrun the installer twice\n## Usage\n" + "call the engine with care. " * 30, "engine__api": "# API\nThe engine has one call. Mail bob@example.com for help.", "fox": "The quick brown fox jumps over the lazy dog", "copy_of_fox": "The quick brown fox jumps over the lazy dog"})
    _write(root / "other", zebra="# Zebra\nstripes and running zebras", broken=b"\0\1\2")
    settings = Settings(collections={"notes": Collection(str(root / "notes"), "**/*.md"), "other": Collection(str(root / "other"), extensions=("MD",))}, index=str(root / "index"), target_chunk_size=80, max_chunk_size=160)
    made = Engine(spark, settings, embedder=counting(str(root / "log")))
    made.root = root
    made.first = made.update()
    return made


def test_update_counts_and_failures(engine):
    assert engine.first == {"new": 5, "deleted": 0, "failed": 1}
    store = engine.store
    assert [r.path for r in store.table("failed").collect()] == ["broken.md"]
    assert store.documents().count() == 5 and store.meta()["version"] == 0
    # equal content is chunked and embedded once, and found at both places
    hashes = store.documents().filter("path LIKE '%fox%'").select("hash").distinct().count()
    assert hashes == 1 and store.chunks().filter("path LIKE '%fox%'").count() == 2
    assert len((engine.root / "log").read_text()) == store.table("chunks").select("text", "headers").distinct().count()
    assert {r.title for r in store.documents().collect()} >= {"Copy Of Fox", "Guide"}


def test_search_and_sessions(engine):
    hits, about = engine.find("brown fox", session="s1")
    assert {h["path"] for h in hits} == {"copy_of_fox.md"} or {h["path"] for h in hits[:1]} <= {"fox.md", "copy_of_fox.md"}
    first = {(h["path"], h["seq_id"]) for h in hits}
    again, about = engine.find("brown fox", session="s1")
    assert not first & {(h["path"], h["seq_id"]) for h in again} and about.excluded_chunks == len(first)
    shown, _ = engine.find("brown fox", session="s1", include_seen=True)
    assert {(h["path"], h["seq_id"]) for h in shown} == first
    other, _ = engine.find("brown fox", session="s2")
    assert {(h["path"], h["seq_id"]) for h in other} == first
    info = engine.session("s1")
    assert info["events"] == 3 and info["documents"] >= 1
    assert engine.session("nobody")["events"] == 0


def test_stems_filters_and_expressions(engine):
    top = lambda q, **k: [h["path"] for h in engine.find(q, vec_limit=1, **k)[0]]
    assert "zebra.md" in top("run", collection="other")
    assert top("engine", path="api, nothing")[0] == "engine/api.md"
    assert set(top('"one call" NOT zebra')) >= {"engine/api.md"}
    assert set(top("in:other stripes")) == {"zebra.md"}
    assert engine.find("one ? AND \"", limit=1)[0] is not None
    assert engine.find("engine", redact=True, path="api")[0][0]["text"].count("<redacted>") == 1
    reranked, _ = engine.find("engine call", deep=True, broad=True)
    assert reranked and [h["rank"] for h in reranked] == list(range(1, len(reranked) + 1))
    found, _ = engine.find("engine", mode="discover")
    assert len({(h["collection"], h["path"]) for h in found}) == len(found) and found[0]["match_count"] >= 1


def test_results_are_kept_by_version(engine):
    before = len(engine.cache.held)
    engine.find("quick lazy")
    engine.find("quick lazy")
    assert len(engine.cache.held) == before + 1


def test_outline_read_grep_tree(engine):
    o = engine.outline("engine/guide.md")
    assert [(h["level"], h["text"]) for h in o["headings"]] == [(1, "Python Guide"), (2, "Installation"), (3, "Windows"), (2, "Usage")]
    assert o["headings"][0]["start_seq"] == 0 and o["headings"][0]["end_seq"] == o["total_chunks"] - 1
    assert engine.outline("notes:guide")["path"] == "engine/guide.md" and engine.outline("nowhere") is None
    rows, about = engine.read("notes:engine/guide.md:0-5", max_chunks=2)
    assert [r["seq_id"] for r in rows] == [0, 1] and about.resume == "lodestone read 'notes:engine/guide.md:2-3'"
    assert [r["seq_id"] for r in engine.read("engine/guide.md", window=1)[0]] == [0, 1]
    number = engine.store.chunks().filter("path = 'zebra.md'").first().chunk_id
    by_id = engine.store.chunks().filter(F.col("chunk_id") == number).count()
    assert by_id == 1
    assert [(m["path"], m["line_number"]) for m in engine.grep("ENGINE", path="api")] == [("engine/api.md", 2)]
    with pytest.raises(ValueError):
        engine.grep("(", is_regex=True)
    tree = engine.tree("notes")[0]["tree"]
    assert [c["name"] for c in tree["children"]] == ["engine", "copy_of_fox.md", "fox.md"]
    assert engine.tree("notes", max_depth=1)[0]["tree"]["children"][0]["children"] == []


def test_commands_batches_and_servers(engine):
    for line in ("search fox", "discover engine", "outline engine/guide.md", "read notes:engine/guide.md:0-1", "tree", "grep engine", "search fox --flat", "guide"):
        fine, said = cli.run_line(engine, f"lodestone {line}")
        assert fine and ElementTree.fromstring(said) is not None, line
    assert json.loads(cli.run_line(engine, "search fox --json")[1])
    fine, said = cli.run_line(engine, "read nowhere.md")
    assert not fine and said.startswith("Error")
    assert not cli.run_line(engine, "no such command")[0]
    bundle = ElementTree.fromstring(cli.batch(engine, "<think>lodestone tree</think>\n1. `lodestone collections`\n- lodestone read nowhere.md"))
    assert [c.get("status") for c in bundle] == ["success", "error"]
    assert "engine/" in cli.execute(engine, cli._parser().parse_args(["tree", "--plain"]))
    assert "\x1b[" in cli.execute(engine, cli._parser().parse_args(["search", "fox"]))
    assert "\x1b[" not in cli.execute(engine, cli._parser().parse_args(["search", "fox", "--plain", "-v"]))
    assert server.answer(engine, "POST", "/api/search", b'{"query": "fox"}')[0] == 200
    assert server.answer(engine, "POST", "/api/search", b"{}")[0] == 400
    assert server.answer(engine, "GET", "/api/outline?path=nowhere")[0] == 404
    assert server.answer(engine, "GET", "/api/collections/tree?collection=notes")[1][0]["collection"] == "notes"
    assert server.answer(engine, "GET", "/nothing")[0] == 404
    sink = io.StringIO()
    server.tools(engine, io.StringIO('{"jsonrpc":"2.0","id":1,"method":"tools/list"}\n{"jsonrpc":"2.0","method":"notice"}\n{"jsonrpc":"2.0","id":2,"method":"tools/call","params":{"name":"lodestone","arguments":{"command":"grep fox"}}}\n'), sink)
    said = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [x["id"] for x in said] == [1, 2] and "grep_results" in said[1]["result"]["content"][0]["text"]


def test_later_updates(engine):
    notes = engine.root / "notes"
    logged = len((engine.root / "log").read_text())
    assert engine.update() == {"unchanged": 5, "deleted": 0, "failed": 1} and engine.store.meta()["version"] == 0
    (notes / "fox.md").rename(notes / "renamed.md")
    _write(notes, engine__api="# API\nNow with two calls")
    (engine.root / "other" / "zebra.md").unlink()
    assert engine.update() == {"unchanged": 2, "changed": 1, "moved": 1, "deleted": 1, "failed": 1}
    store = engine.store
    assert store.meta()["version"] == 1 and len((engine.root / "log").read_text()) == logged + 1
    words = ("python", "two", "fox", "zebra", "mail")
    indexed = lambda: {(r.query_id, r.path) for r in search_blocks(store.postings(), lexical.asked_terms(spark_words(engine.spark, words), every=False)).join(store.chunks(), "chunk_id").collect()}
    assert {p for _, p in indexed()} == {"engine/guide.md", "engine/api.md", "copy_of_fox.md", "renamed.md"}
    assert {p for q, p in indexed() if q == "two"} == {"engine/api.md"} and not {q for q, _ in indexed()} & {"zebra", "mail"}
    hits = [h["path"] for h in engine.find("two calls", vec_limit=1)[0]]
    assert "engine/api.md" in hits[:2] and not engine.find("zebra", vec_limit=1, lex="zebra AND stripes")[0][1:]
    before, scores = indexed(), scored(store, words)
    store.compact()
    assert indexed() == before and scored(store, words) == scores and store.table("content").count() == 3 and store.table("dead").count() == 0
    gone = Engine(engine.spark, Settings(collections={"other": Collection(str(engine.root / "other"))}, index=engine.settings.index), embedder=engine.embedder)
    assert gone.update()["deleted"] == 4 and gone.store.documents().count() == 0


def test_quantised_stores_and_layout(spark, tmp_path):
    files = spark.createDataFrame([("c", "a.md", "A", "h1", "red fish", None), ("c", "b.md", "B", "h2", "blue bird", None)], "collection string, path string, title string, hash string, body string, error string")
    for kind in ("int8", "bit"):
        store = Store(spark, str(tmp_path / kind), Settings(vector_quantization=kind))
        store.create()
        assert store.meta() is None and store.documents().count() == 0
        store.update(files, HashingEmbedder())
        assert store.meta()["quantization"] == kind
        kept = {r.chunk_id: bytes(r.embedding) for r in store.corpus().vectors.collect()}
        assert [len(x) for x in kept.values()] == [64 if kind == "int8" else 8] * 2
        # packed codes score as the numbers that they stand for
        exact = {r.chunk_id: np.array(r.embedding) for r in embedded(store.chunks().withColumn("prompt", document_prompt(F.col("title"), with_context(F.col("headers"), F.col("text")))), "prompt", HashingEmbedder(), out="embedding").collect()}
        want = {k: np.clip(np.rint(x * 127), -128, 127) if kind == "int8" else np.where(x > 0, 1.0, -1.0) for k, x in exact.items()}
        asked = spark.createDataFrame([(1, [float(x) for x in HashingEmbedder().embed(["red bird"])[0]])], "query_id int, query array<float>")
        unit = lambda x: np.asarray(x, float) / np.linalg.norm(x)
        q = asked.first().query
        for r in vector_scan(store.corpus().vectors, asked).collect():
            assert abs(r.score - unit(want[r.chunk_id]) @ unit(q)) < 1e-6
        if kind == "bit":
            for r in vector_scan(store.corpus().vectors, asked, kind="hamming").collect():
                assert abs(r.score - 1 / (1 + ((want[r.chunk_id] > 0) != (np.array(q) > 0)).sum())) < 1e-9
    late = spark.sql(f"SELECT 9L AS version, {LAYOUT + 1} AS layout, current_timestamp() AS updated_at, 'none' AS quantization, 4 AS dim, true AS stem")
    late.write.mode("append").parquet(str(tmp_path / "bit" / "meta"))
    with pytest.raises(ValueError):
        store.meta()


def test_scores_of_sqlite(spark):
    """BM25, phrases, prefixes, NEAR, columns and stems against SQLite's full-text index."""
    texts = ["the running dogs ran home", "a dog runs; the café is near", "cafés and houses, house of cards", "nothing here at all", "near the house of the running man", "state-of the art is of the state"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(collection, path, title, body, headers, tokenize='porter unicode61')")
    rows = [(i, "c", f"p{i}.md", f"Title {i}", x, "") for i, x in enumerate(texts)]
    db.executemany("INSERT INTO t(rowid, collection, path, title, body, headers) VALUES (?, ?, ?, ?, ?, ?)", rows)
    index = PostingIndex.of(lexical.index_chunks(spark.createDataFrame(rows, "chunk_id long, collection string, path string, title string, body string, headers string"), stem=True))
    asked = ['"run" AND "dog"', "house OR cafe", '"state of"', "hous*", "run NOT dog", '"p 1"', "title : 4 OR body : art", "NEAR(house run, 3)", "^the", "(dog OR house) AND the", "running man", "body:^state + of"]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id int, query string")
    compiled = lexical.compile_queries(queries, stem=True).filter("NOT last")
    got = {}
    for r in search_blocks(index, compiled).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    for i, q in enumerate(asked):
        text = q if any(x in q for x in ('"', " AND ", " OR ", " NOT ")) else " AND ".join(f'"{w}"' for w in q.split()) if i in (3, 7, 8, 10, 11) and False else q
        if not any(x in q for x in ('"', " AND ", " OR ", " NOT ")):
            continue
        want = {r[0]: max(1e-4, -r[1]) for r in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (text,))}
        assert got.get(i, {}).keys() == want.keys(), q
        assert all(abs(got[i][k] - v) < 1e-6 for k, v in want.items()), q
    every = spark.createDataFrame([(i, f'{q} OR "zzz"') for i, q in enumerate(asked)], "query_id int, query string")
    got = {}
    for r in search_blocks(index, lexical.compile_queries(every, stem=True).filter("NOT last")).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    for i, q in enumerate(asked):
        want = {r[0] for r in db.execute("SELECT rowid FROM t WHERE t MATCH ?", (f'{q} OR "zzz"',))}
        assert got.get(i, set()) == want, q


def test_porter_of_sqlite():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators university flies dying is as yes apology analogy logic being said".split()
    for w in words:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (w,))
        assert [r[0] for r in db.execute("SELECT term FROM v")] == [porter(w)], w
    assert fold("cafés") == "cafes" and porter("überraschung") == "überraschung"


def test_query_vectors_are_kept(spark):
    q = spark.createDataFrame([(1, "red"), (2, "blue"), (3, "red")], "query_id int, query string")
    asked, fresh = embedded_queries(q, HashingEmbedder(dim=8))
    assert fresh.count() == 2 and asked.filter("size(vector) = 8").count() == 3
    kept = fresh.withColumn("vector", F.array(F.lit(0.5).cast("float")))
    asked, fresh = embedded_queries(q, HashingEmbedder(dim=8), kept)
    assert fresh.count() == 0 and asked.filter("size(vector) = 1").count() == 3
    assert embedded_queries(q, HashingEmbedder(dim=8, model="x"), kept)[1].count() == 2
    rows = embedded(spark.createDataFrame([("a b",), (None,), ("",)], "t string"), "t", HashingEmbedder(dim=4)).collect()
    assert rows[1].embedding is None and sum(x * x for x in rows[0].embedding) == pytest.approx(1)


def test_settings(tmp_path):
    at = tmp_path / "s.json"
    at.write_text(json.dumps({"collections": {"a": {"path": "/x", "extensions": "md"}}, "fts_limit": 7, "index": "here"}))
    s = load(str(at), {"LODESTONE_FTS_LIMIT": "9", "LODESTONE_XML": "yes"})
    assert (s.fts_limit, s.xml, s.vec_limit, s.index) == (9, True, 50, str(tmp_path / "here"))
    assert s.collections["a"].extensions == ("md",)
    at.write_text('{"fts_limt": 7}')
    with pytest.raises(ValueError):
        load(str(at), {})
    assert load(None, {}) == Settings()


def test_near_groups_of_sqlite(spark):
    """Clumps of two to four parts, with phrases and beginnings, against SQLite's full-text index."""
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randint(5, 40))) for _ in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    db.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", list(enumerate(texts)))
    asked = [f"NEAR({' '.join(parts)}, {n})" for parts in (['"a"', '"b"'], ['"a"', '"b"', '"c"'], ['"a b"', '"c"', '"d"'], ['"a"', '"a"', '"b"'], ['"a"', '"b"', '"c"', '"d"'], ['"a b"', '"b c"'], ['"a"*', '"g f"', '"c"']) for n in (0, 1, 3, 6)]
    index = PostingIndex.of(lexical.index_chunks(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, body string"), ("body",)), size=50)
    compiled = lexical.compile_queries(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), columns=("body",)).filter("NOT last")
    got = {}
    for x in search_blocks(index, compiled).collect():
        got.setdefault(x.query_id, {})[x.chunk_id] = x.score
    for i, q in enumerate(asked):
        want = {x[0]: max(1e-4, -x[1]) for x in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (q,))}
        assert got.get(i, {}).keys() == want.keys(), q
        assert all(abs(got[i][k] - v) < 1e-6 for k, v in want.items()), q


@pytest.mark.parametrize("size", [7, 1000])
def test_first_hits_are_those_of_all(spark, size):
    """Skipping blocks by their bounds loses none of the first hits, with ties, filters and exclusions."""
    r = random.Random(3)
    texts = [" ".join(f"w{min(int(r.expovariate(0.15)), 30)}" for _ in range(r.randint(1, 30))) for _ in range(300)] + ["w1 w2"] * 20
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, body string").repartition(3)
    index = PostingIndex.of(lexical.index_chunks(chunks, ("body",)), size=size, buckets=3)
    queries = spark.createDataFrame([(i, f"w{r.randint(0, 30)}") for i in range(25) for _ in range(r.randint(1, 8))], "query_id int, term string")
    allowed, excluded = chunks.filter("chunk_id % 3 > 0"), spark.createDataFrame([(q, c) for q in range(25) for c in range(q, 320, 5)], "query_id int, chunk_id long")
    for every in (True, False):
        asked = lexical.asked_terms(queries, every=every)
        hits = search_blocks(index, asked)
        some = hits.join(allowed, "chunk_id", "left_semi").join(excluded, ["query_id", "chunk_id"], "left_anti")
        for want, got in ((hits, search_blocks(index, asked, limit=6)), (some, search_blocks(index, asked, limit=6, allowed=allowed, excluded=excluded)), (hits, search_blocks(index, asked, limit=6, block=20))):
            best = lambda x: sorted((y.query_id, y.fts_rank, y.chunk_id, round(y.score, 9)) for y in lexical.ranked(x, 6).collect())
            assert best(got) == best(want)


def test_searches_read_asked_buckets_only(spark):
    index = PostingIndex.of(lexical.index_chunks(spark.createDataFrame([(i, f"w{i} all") for i in range(50)], "chunk_id long, body string"), ("body",)), buckets=8)
    plan = postings.Plan.of(lexical.asked_terms(spark.createDataFrame([(1, "w7")], "query_id int, term string")).toArrow())
    text = postings._asked_rows(index, plan)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in text.replace("isnotnull(bucket#", "bucket#") and "places" not in text
    read = {r[0] for r in postings._asked_rows(index, plan).select(F.input_file_name()).distinct().collect()}
    assert len({x.split("bucket=")[1].split("/")[0] for x in read}) == 2


def test_tiers_ask_only_for_queries_that_lack(spark, monkeypatch):
    texts = ["red fish", "red fish two", "red fish three", "blue bird", "bird of paradise", "fish"]
    rows = [(i, "c", f"p{i}", i, "t", x) for i, x in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, collection string, path string, seq_id int, title string, text string")
    corpus = search.Corpus(chunks, PostingIndex.of(lexical.index_chunks(chunks.withColumnRenamed("text", "body"), ("body",))), None)
    seen, plain = [], search.search_blocks
    monkeypatch.setattr(search, "search_blocks", lambda index, asked, **k: seen.append(sorted((r.query_id, r.tier) for r in asked.collect())) or plain(index, asked, **k))
    got = search.lexical_search(corpus, spark.createDataFrame([(1, "red fish"), (2, "blue bird")], "query_id int, query string")).collect()
    assert seen == [[(1, 0), (2, 0)], [(2, 1)]]
    assert sorted((r.query_id, r.chunk_id, r.tier) for r in got) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 3, 0), (2, 4, 1)]


def test_an_update_that_fails_or_competes_leaves_the_index_whole(spark, tmp_path):
    kinds = "collection string, path string, title string, hash string, body string, error string"
    files = lambda *xs: spark.createDataFrame([("c", f"{x}.md", x, f"h{x}", f"word{x} common", None) for x in xs], kinds)
    store = Store(spark, str(tmp_path / "s"))
    store.update(files("a", "b"), HashingEmbedder())
    with store._claimed(1), pytest.raises(RuntimeError):
        store.update(files("a", "c"), HashingEmbedder())

    class Broken(HashingEmbedder):
        def embed(self, texts):
            raise ValueError("no model")

    with pytest.raises(Exception, match="no model"):
        store.update(files("a", "c"), Broken())
    assert store.meta()["version"] == 0 and {r.path for r in store.documents().collect()} == {"a.md", "b.md"}
    terms = ("worda", "wordb", "wordc", "common")
    assert {q for q, _, _ in scored(store, terms)} == {"worda", "wordb", "common"}
    store.update(files("a", "c"), HashingEmbedder())
    fresh = Store(spark, str(tmp_path / "f"))
    fresh.update(files("a", "c"), HashingEmbedder())
    assert scored(store, terms) == scored(fresh, terms)  # statistics too don't count what is dead
    plan = store.chunks()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
