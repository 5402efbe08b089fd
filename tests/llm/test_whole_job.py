import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestone.llm import decontam, licenses, pii, toxicity, urls
from lodestone.llm.forest import near_vectors
from lodestone.llm.words import ALNUM, split_words


def test_vectors_with_a_third_in_one_group(spark):
    rng = np.random.default_rng(1)
    n, dim, cos = 6000, 64, 0.932
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x[-1]
    e = x[: n // 3] - (x[: n // 3] @ c)[:, None] * c
    x[: n // 3] = np.sqrt(cos) * c + np.sqrt(1 - cos) * e / np.linalg.norm(e, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    assert want.sum() > 1_000_000
    assert sum(abs(want[i] - got[i]) for i in range(n)) <= 0.001 * want.sum()


def test_url_scores_by_the_counts_of_each_gram(spark):
    r = random.Random(6)
    word = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    rows = [(i, f"https://{word(8)}.example.{('com/en', 'net/de', 'info/fr')[i % 3]}/{word(9)}") for i in range(3000)]
    padded = spark.createDataFrame(rows, "page_id long, url string").withColumn("padded", urls._padded(F.col("url"))).withColumn("held", urls._held())
    known = {x.page_id: x for x in padded.collect()}
    got = {x.page_id: x for x in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    count, context = {v: Counter() for v in ("block", "allow")}, {v: Counter() for v in ("block", "allow")}
    n = urls.ORDER
    for i, x in known.items():
        if got[i].rule and not x.held:
            for e in range(n, len(x.padded) + 1):
                for k in range(1, n + 1):
                    count[got[i].verdict][x.padded[e - k : e]] += 1
                    context[got[i].verdict][k, x.padded[e - k : e - 1]] += 1
    assert sum(len(g) == n for g in count["block"] | count["allow"]) > 16384

    def score(t):
        total = 0.0
        for e in range(n, len(t) + 1):
            p = defaultdict(lambda: 1 / 256)
            for v in count:
                for k in range(1, n + 1):
                    p[v] = (count[v][t[e - k : e]] + urls.PRIOR * p[v]) / (context[v][k, t[e - k : e - 1]] + urls.PRIOR)
            total += math.log(p["block"] / p["allow"])
        return total / (len(t) - n + 1)

    assert all(abs(got[i].score - score(known[i].padded)) < 1e-6 for i in range(2, 3000, 3))


def test_mail_spelled_out_without_digits(spark):
    forms = ["anna at host dot com", "anna[at]host.com", "anna(at)host.net"]
    rows = [(i, f"please write to {x} soon") for i, x in enumerate(forms)] + [(9, "he looked at us. then we met at noon"), (10, "that dotted hat"), (11, "inhe at and. At")]
    got = {r.doc_id: r.redacted for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "please write to <email> soon" for i in range(3)), got
    assert got[9] == rows[3][1] and got[10] == rows[4][1] and got[11] == rows[5][1]


def test_thresholds_by_all_labelled_rows(spark):
    r = random.Random(8)
    plain = ["".join(r.choice("aeiounrst") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(3000):
        lang, toxic = ("es", int(r.random() < 0.1)) if i % 6 == 0 else ("en", int(r.random() < 0.1))
        said = toxic if r.random() < 0.85 else 1 - toxic
        rows.append((i, " ".join(r.choice(plain) for _ in range(20)) + " grumble" * said, lang, toxic))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, labels, fit_rows=300).collect()}
    trained = set(toxicity.fit(toxicity.fit_sample(docs, labels, fit_rows=300)).trained)
    assert len(trained) == 240
    for lang in ("es", "en"):
        use = [x for x in rows if x[2] == lang and x[0] not in trained and not got[x[0]].held_out]
        assert sum(x[3] for x in use) >= toxicity.CALIBRATE
        wrong = [sum((got[x[0]].score >= t) != (x[3] == 1) for x in use) for t in toxicity.GRID]
        assert {got[x[0]].threshold for x in rows if x[2] == lang} == {toxicity.GRID[int(np.argmin(wrong))]}


def test_index_of_one_task_is_stored_in_small_row_groups(spark, monkeypatch):
    r = random.Random(3)
    some = [" ".join("".join(r.choice("aeiounrst") for _ in range(5)) for _ in range(4000)) for _ in range(50)]
    rows = [(i, " ".join(r.choice(some) for _ in range(5))) for i in range(200)]
    rows.append((200, " ".join(some[3].split()[100:112])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(some[3].split()[100:112]))], "item_id long, text string")
    stored, persist = {}, decontam.persist_table
    monkeypatch.setattr(decontam, "persist_table", lambda df, name, *a: stored.setdefault(name, persist(df, name, *a)))
    got = {x.doc_id: x.n_hit for x in decontam.benchmark_hits(docs, bench).collect()}
    assert got == {i: 12 * t.count(rows[200][1]) for i, t in rows}
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in stored["index"].inputFiles()]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 30
    assert max(g.total_byte_size for g in groups) < 2 * 2**22


def _lookup(texts, windows, n, slop, step):
    words = split_words(pa.array(texts), ALNUM, lower=True)
    h = words.hashes()
    at = np.argsort(h, kind="stable")
    h = h[at]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    known = dict(zip("0123", split_words(pa.array(list("0123")), ALNUM).hashes().view(np.int64).tolist(), strict=True))
    table = pa.table({"item": [str(i) for i in range(len(windows))], "terms": pa.array([[known[c] for c in w] for w in windows], pa.list_(pa.int64()))})
    q = decontam.Queries.of(table, n)
    return {(int(w), int(s)) for a, b in q.matches(h[new], np.r_[new, len(h)], at, words.first, slop, step) for w, s in zip(a, b, strict=True)}


def test_few_words_against_many_windows_in_bounded_steps():
    r = random.Random(2)
    texts = [" ".join(r.choice("0123") for _ in range(k)) for k in (900, 3, 0, 1500)]
    windows = ["".join(r.choice("0123") for _ in range(r.randint(1, 5))) for _ in range(60)]
    flat = [(t.split(), sum(len(x.split()) for x in texts[:i])) for i, t in enumerate(texts)]
    exact = {(k, base + i) for k, w in enumerate(windows) for ws, base in flat for i in range(len(ws) - len(w) + 1) if ws[i : i + len(w)] == list(w)}
    near = {(k, base + i) for k, w in enumerate(windows) for ws, base in flat for i in range(len(ws)) if not Counter(w) - Counter(ws[i : i + len(w) + 2])}
    for step in (7, 500, 1 << 19):
        assert _lookup(texts, windows, 5, None, step) == exact
        assert _lookup(texts, windows, 5, 2, step) == near


def _apart(windows):
    """The windows (far, size, template, first, last) that overlap none before them, by plain loops."""
    kept = []
    for w in sorted(windows):
        if all(w[4] < k[3] or k[4] < w[3] for k in kept):
            kept.append(w)
    return kept


def test_statements_that_repeat_and_overlap(spark):
    r = random.Random(4)
    templates = (("A", "alpha beta gamma delta"), ("B", "beta gamma delta alpha beta"), ("C", "gamma alpha"))
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "x"]) for _ in range(k)) for k in (2, 9, 63, 64, 65, 300, 4100, 9000)]
    texts += ["alpha beta gamma delta " * k for k in (1, 50, 1100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = defaultdict(list)
    for x in licenses.scan_licenses(docs, templates=templates, least=0.6).collect():
        got[x.doc_id].append((x.word - 1, x.n_words, x.template))
    for i, t in enumerate(texts):
        words, found = t.split(), []
        for turn, (_, template) in enumerate(templates, 1):
            own = template.split()
            grams = set(zip(own, own[1:], strict=False))
            for at in range(len(words) - 1):
                if (words[at], words[at + 1]) in grams:
                    part = words[at : at + len(own)]
                    mine = set(zip(part, part[1:], strict=False))
                    dice = 2 * len(mine & grams) / (len(mine) + len(grams))
                    if dice >= 0.6:
                        found.append((-dice, -(len(own) - 1), turn, at, at + len(part) - 1))
        assert sorted(got[i]) == sorted((w[3], w[4] - w[3] + 1, w[2]) for w in _apart(found)), i


def test_a_long_text_of_statements_takes_seconds(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License. " * 12_000)], "doc_id int, text string")
    began = time.perf_counter()
    assert licenses.scan_licenses(docs).count() == 12_000
    assert time.perf_counter() - began < 60


def test_a_forest_that_misses_pairs_is_not_used(spark, monkeypatch):
    """Without spill, one tree parts many pairs: all are compared instead, and none is lost."""
    from lodestone.llm import forest

    monkeypatch.setattr(forest, "MOST_TREES", 1)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((700, 12))
    x = np.repeat(base, 2, axis=0) + 0.02 * rng.standard_normal((1400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = forest.Forest(x.astype(np.float32), 1, 0.0, 7, 0.93)
    assert made.depth == 0 and made.leaves(x.astype(np.float32))[1].tolist() == [0] * len(x)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors(df, trees=1, spill=0.0).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()
