"""Operators that SQL can't express, against plain loops; and odd tables for all of them."""

import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import licenses, mixing, pii, queries, tokens, toxicity
from lodestone.llm.decontam import benchmark_hits
from lodestone.llm.forest import near_vectors
from lodestone.llm.minhash import near_texts
from lodestone.llm.storage import scratch, shared_dir
from lodestone.llm.substrings import remove_repeats
from lodestone.llm.tokens import token_counts
from lodestone.llm.urls import judge_urls

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("states", [300, 120_000])
def test_long_pieces_by_chunk_maps(states, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_STATES", states)
    tok, r = Tokenizer.from_file(PATH), random.Random(5)
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    texts = ["a" * 30_001, "-" * 9000, of("abc", 9000), of("abcdefghijklmnopqrstuvwxyz", 9000), "".join(chr(r.randint(0x4E00, 0x5FFF)) for _ in range(3000)), " " * 9000 + "x", of("01", 9000), "ab" * 4000 + "=" * 5000 + "thequickbrownfox" * 500]
    texts += [texts[0] + " " + texts[2], "", "short"]
    _, got = tokens.TokenCounter(PATH).count(pa.array(texts))
    assert got.tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def _mixed(rows, liking, draws):
    """{row number: (copies, part)} by plain loops."""
    size, out = defaultdict(int), {}
    for s, n in rows:
        size[s] += n
    names = sorted(s for s in size if s is not None) + ([None] if None in size else [])
    left, open_, target = 1.5 * sum(size.values()), {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}
    while open_:
        unit = left / sum(open_.values())
        over = [s for s in open_ if unit * open_[s] > 2 * size[s]]
        for s in over or list(open_):
            target[s] = 2 * size[s] if over else unit * open_[s]
            left -= target[s] if over else 0
            del open_[s]
    for s in names:
        mine = [i for i, x in enumerate(rows) if x[0] == s]
        step = {i: 2 ** (math.floor(math.log2(liking(rows[i][1])) * mixing.STEPS + 0.5) / mixing.STEPS) for i in mine}
        low, high = 0.0, 1e9
        for _ in range(200):  # the unit of liking at which the wanted words reach the target
            unit = (low + high) / 2
            low, high = (unit, high) if sum(rows[i][1] * min(2, unit * step[i]) for i in mine) < target[s] else (low, unit)
        times = {i: min(2.0, high * step[i]) for i in mine}
        times = {i: round(t) if abs(t - round(t)) < 1e-9 else t for i, t in times.items()}
        room = math.floor(target[s] + 0.5) - sum(int(times[i]) * rows[i][1] for i in mine)
        odds = {i: draws[i] / (1 - draws[i]) / ((times[i] % 1) / (1 - times[i] % 1)) for i in mine if times[i] % 1 and rows[i][1]}
        out |= {i: (int(times[i]), 0) for i in mine}
        for i in sorted(odds, key=odds.get):
            if rows[i][1] > room:
                out[i] = (int(times[i]), room)
                break
            out[i] = (int(times[i]) + 1, 0)
            room -= rows[i][1]
    return out


def test_mix_by_plain_draws(spark):
    r = random.Random(11)
    rows = [(r.choice(["a", "b", "c", "d", None]), r.randint(0, 90)) for _ in range(400)] + [("few", 3000), ("small", 40), ("small", 7)]
    docs = spark.createDataFrame([(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate(rows)], "doc_id long, source string, text string")
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(1), "doc_id", F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long")), 11) + 0.5) / float(1 << 53)
    draws = {x.doc_id: x.draw for x in docs.select("doc_id", draw.alias("draw")).collect()}
    want = _mixed(rows, lambda n: max(n, 1) ** 0.5, draws)
    got = {x.doc_id: (x.copies, x.part) for x in mixing.mix_sources(docs).collect()}
    assert {i: v for i, v in got.items() if v != want[i] and rows[i][1]} == {}
    assert any(len({got[i][0] for i, x in enumerate(rows) if x[0] == s}) > 1 for s in "abcd")
    few = [x for x in mixing.mix_sources(docs).collect() if x.size == 3000][0]
    assert abs(few.taken - few.target) <= 0.5 and few.taken <= 2 * 3000
    liked = mixing.mix_sources(docs.withColumn("liking", F.when(F.col("doc_id") % 2 == 0, 5.0)), preference="liking").join(docs, "doc_id")
    sums = liked.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(x.taken - x.target) <= 1 for x in sums)


def test_viterbi_by_every_path():
    crf = pii.trained()
    for words, _ in pii.labelled_table(40, 21):
        chain = words[:5]
        score = crf.scores(chain)
        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(chain)), key=lambda p: sum(score[i, y] for i, y in enumerate(p)) + sum(crf.move[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(crf.decode([chain])[0]) == best


def test_added_spans_by_decoding_every_word():
    crf, r, texts = pii.trained(), random.Random(9), []
    filler = lambda: ["".join(r.choice("aeinrstlo") for _ in range(r.randint(2, 8))) for _ in range(r.randint(0, 8))]
    for words, _ in pii.labelled_table(600, 91):
        texts.append(" ".join(filler() + words + filler()))
    texts += ["jane at example dot com", "jane[at]example.com", "see jane(at)example.net", "mail jane at example dot com or 12", "x" * 5000 + "1 " + "y" * 300 + "[at]example.com", ""]
    part = pa.record_batch([pa.array(texts)], ["text"])
    pruned, whole = pii._kernel(part, crf), pii._kernel(part, crf, None)
    assert pruned == whole and sum(not s[3] for x in whole for s in x) > 100
    assert all(any(s[0] == "email" for s in x) for x in pruned[-6:-1])


def _plain_score(net, text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())  # bytes are lower-cased as ASCII
    a, b = toxicity._buckets(toxicity.split_words(pa.array([text]), toxicity.ALNUM, lower=True))
    assert len(a) == len(words)
    x = [net.word[i].astype(float) + net.begin[j] for i, j in zip(a, b, strict=True)]
    z = float(net.shift[0])
    for k, (width, f) in enumerate(zip(toxicity.WIDTHS, net.filters, strict=True)):
        for c in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(x)):
                y = float(net.bias[k][c]) + sum(float(x[at + j][e]) * float(f[j, e, c]) for j in range(width) if at + j < len(x) for e in range(toxicity.DIM))
                best = max(best, y)
            z += best * float(net.out[k * toxicity.FILTERS + c])
    return 1 / (1 + math.exp(-z))


def test_classifier_scores_by_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit(toxicity.fit_sample(docs, labels))
    assert len(toxicity.fit_sample(docs, labels, fit_words=2000)["key"]) < len(toxicity.fit_sample(docs, labels)["key"])
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, labels).collect()}
    rows = [(x.doc_id, x.text) for x in docs.collect() if len(x.text) < 1500][:30]
    assert all(abs(got[i] - _plain_score(net, t)) < 1e-4 for i, t in rows)


def _plain_licenses(text, least=0.8):
    words = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split()
    pairs = [f"{a} {b}" for a, b in itertools.pairwise(words)]
    found = []
    for k, (name, t) in enumerate(licenses.TEMPLATES, 1):
        size, own = licenses._bigrams_of(t)
        for s in range(len(pairs)):
            w = set(pairs[s : s + size])
            dice = 2 * len(w & set(own)) / (len(w) + len(own))
            if pairs[s] in own and dice >= least:
                found.append((-dice, -size, k, s, s + len(pairs[s : s + size]), name))
    kept = []
    for w in sorted(found):
        if all(w[4] < x[3] or x[4] < w[3] for x in kept):
            kept.append(w)
    return sorted((w[3] + 1, w[4] - w[3] + 1, w[5], w[2], round(-w[0], 6)) for w in kept)


def test_licenses_by_every_window(spark):
    r = random.Random(3)
    noise = lambda n: " ".join(r.choice(["the", "of", "in", "permission", "software", "license", "zu", "ka"]) for _ in range(n))
    texts = []
    for _, t in licenses.TEMPLATES:
        words = t.split()
        texts.append(f"{noise(9)}\n" + "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7)) + f"\n{noise(20)}")
        texts.append(" ".join(w for w in words if r.random() > 0.06) + " " + noise(5))
    texts += [" ".join(texts[:4]), "", "word", noise(400), "Released under the MIT License. " * 50, "a b " * 5000, None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x")], "doc_id long, text string, template string")
    got = defaultdict(list)
    for x in licenses.scan_licenses(df).collect():
        got[x.doc_id].append((x.word, x.n_words, x.license, x.template, x.dice))
    assert all(sorted(got[i]) == _plain_licenses(t or "") for i, t in enumerate(texts))
    assert sorted(got[None]) == sorted(got[0]) and sum(map(len, got.values())) > 60
    assert licenses.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_by_sql(spark, small, name):
    d, con = small
    df = queries.queries()[name](spark, d)
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(x[c] for c in names) for x in df.collect()) == sorted(want)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, repeated and null keys, null, empty and long texts, and clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "another text with the same number of words as that"), (None, "nobody's words are here"), (None, "nobody's words are here"), (None, None), (2, None), (3, ""), (4, long), (5, long)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "CAST(NULL AS string) AS source", "1 AS node", "2 AS component", "3 AS score", "4 AS h1", "5 AS size", "6 AS rank", "7 AS row", "8 AS segment", "length(text) AS n_chars")


def test_odd_tables(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (None, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (None, "one"), (2, None)], "item_id long, text string")
    runs = {"tokens": lambda x: token_counts(x, PATH), "mix": mixing.mix_sources, "texts": near_texts, "repeats": remove_repeats, "bench": lambda x: benchmark_hits(x, bench), "pii": pii.find_personal_data, "toxic": lambda x: toxicity.score_toxicity(x, labels)}
    for name, f in runs.items():
        assert f(odd).count() == n, name
        assert f(odd.limit(0)).count() == 0, name
    got = near_texts(odd).orderBy("doc_id", "n_shingles").collect()
    assert [(x.doc_id, x.component_id, x.kept) for x in got if x.doc_id in (4, 5)] == [(4, 4, True), (5, 4, False)]
    assert {x.kept for x in got if x.doc_id == 1} == {True}
    hits = {(x.doc_id, x.n_hit) for x in benchmark_hits(odd, bench).collect()}
    assert (1, 1) in hits and (1, 0) in hits and (2, 0) in hits


def test_odd_urls_and_vectors(spark):
    rows = [(1, "https://a.com/en/" + "x" * 20_000), (1, "https://a.com/en/" + "x" * 20_000), (None, "https://b.net/de/q"), (2, None), (3, "")]
    urls = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS id", "2 AS gram", "3 AS score", "4 AS padded")
    assert sorted((x.page_id or -1, x.verdict) for x in judge_urls(urls).collect()) == [(-1, "allow"), (1, "block"), (1, "block"), (2, "allow"), (3, "allow")]
    vectors = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1e200, 0.0], 0), (3, [1e200, 1e190], 0), (4, [0.930000002, math.sqrt(1 - 0.930000002**2)], 0), (5, [0.929999998, -math.sqrt(1 - 0.929999998**2)], 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS leaf", "2 AS n", "3 AS kind", "4 AS rep")
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in near_vectors(df).collect())
    assert got == [(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (5, 0, 5)]


def test_pipeline_rows_stand_for_themselves(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    leak = bench.select(F.col("text")).first()[0]
    clean = docs.filter("length(text) > 600").orderBy("doc_id").limit(3).collect()
    add = [(None, "rare words of nobody at all " + "so it stays", "en", "s", 1), (None, leak, "en", "s", 1), (7001, leak, "en", "s", 1), (7001, "a clean text under the same number", "en", "s", 1), (7002, "said twice and kept once only", "en", None, 1), (7002, "said twice and kept once only", "en", None, 1), (7003, None, "en", "s", 1), (None, clean[0].text, "en", "s", 1)]
    all_ = docs.unionByName(spark.createDataFrame(add, docs.schema)).withColumn("row", F.lit(1))
    now = all_
    for name, stage in corpus_pipeline.STAGES[:4]:
        with scratch(spark) as keep:
            now = keep(stage(spark, now, d))
        assert now.columns == list(corpus_pipeline.COLUMNS), name
        assert stage(spark, all_.limit(0), d).count() == 0, name
    got = [(x.doc_id, x.text) for x in now.collect()]
    assert got.count((None, add[0][1])) == 1 and (None, leak) not in got and (7001, leak) not in got
    assert (7001, add[3][1]) in got and got.count((7002, add[4][1])) == 1 and (7003, None) in got
    assert (None, clean[0].text) not in got
    mixed = corpus_pipeline.source_mix(spark, now, d)
    assert corpus_pipeline.source_mix(spark, all_.limit(0), d).count() == 0
    assert mixed.filter("doc_id is null").count() > 0 and mixed.filter("taken <= 0").count() == 0
    assert mixed.columns[:5] == list(corpus_pipeline.COLUMNS)


def test_scratch_and_shared_folder(spark, monkeypatch):
    from lodestone.llm import storage

    with scratch(spark) as keep:
        gone = storage.persist_table(spark.range(3).toDF("x"), "gone")
        kept = keep(gone)
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()

    class Cluster:
        master, applicationId = "spark://host:7077", "a"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext, conf = Cluster(), {}

    with pytest.raises(ValueError):
        shared_dir(Session())
