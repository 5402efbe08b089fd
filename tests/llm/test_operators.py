import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from lodestone.llm import decontam, pii
from lodestone.llm.forest import near_vectors
from lodestone.llm.graph import connected_components
from lodestone.llm.minhash import near_texts
from lodestone.llm.mixing import mix_sources
from lodestone.llm.substrings import remove_repeats
from lodestone.llm.tokens import TokenCounter, token_counts
from lodestone.llm.toxicity import score_toxicity
from lodestone.llm.urls import judge_urls

PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and blank texts, copies, repeated rows, a long text, and clashing names."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = [text(r.randint(1, 120)) for _ in range(40)]
    rows = [(i, t, r.choice(["a", "b", None])) for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "a") for i in range(10)]
    rows += [(200 + i, base[i] + " extra", "b") for i in range(10)]
    rows += [(300, text(60) + " " + base[30] + " " + text(50), "c"), (301, text(20000), "c"), (400, "", "a"), (401, None, "a"), (402, " \n\t ", None), (403, base[3], "a"), (403, base[3], "a"), (None, base[4], "b"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS key", "'x' AS component", "'en' AS lang", "length(text) AS n_chars")


def known(docs):
    return [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]


def test_token_counts(docs):
    tok = Tokenizer.from_file(PATH)
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = token_counts(docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_token_machine_on_odd_texts():
    tok, r = Tokenizer.from_file(PATH), random.Random(1)
    texts = ["don't  we'll 'r 'v", "<|endoftext|>a  <|endoftext|> b", "a" * 5000, " \n\n 's", "日本語😀", "　 x\x85"]
    texts += ["".join(r.choice("  \n\t'srtvmledaB1é½² !.-日😀") for _ in range(r.randint(0, 3000))) for _ in range(200)]
    _, got = TokenCounter(PATH).count(pa.array(texts))
    assert got.tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_mix(docs):
    rows = mix_sources(docs).collect()
    assert len(rows) == docs.count()
    size = defaultdict(int)
    for r in docs.collect():
        size[r.source] += len(words(r.text))
    names = sorted((s for s in size if s is not None)) + [None]
    target, open_ = {}, dict(zip(names, [3, 1, 2, 3], strict=True))
    left = 1.5 * sum(size.values())
    while open_:  # share again what sources can't take
        unit = left / sum(open_.values())
        over = [s for s in open_ if unit * open_[s] > 2 * size[s]]
        if not over:
            target |= {s: unit * w for s, w in open_.items()}
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            del open_[s]
    assert sorted({(r.source_size, round(r.target, 6)) for r in rows}) == sorted({(size[s], round(target[s], 6)) for s in names})
    taken = defaultdict(int)
    for r in rows:
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part
        taken[r.target] += r.taken
    assert all(abs(t - taken[t]) <= 1.5 for t in taken)
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs).collect()))
    assert mix_sources(docs.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(size=8) * 0.1], i % 3) for i in range(600)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(20)] + [(2000, None, 0), (2001, [0.0] * 8, 0), (2002, [float("nan")] * 8, 0), (2003, rows[0][1], None), (2004, [None] * 8, 0), (2005, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fine = [(k, np.float32(v).astype(float), y) for k, v, y in rows if k is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for a, va, ya in fine:
        for b, vb, yb in fine:
            if a != b and ya == yb and va @ vb / np.sqrt(va @ va) / np.sqrt(vb @ vb) >= 0.93:
                links[a].add(b)
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert len(got) == len(rows)
    missed = sum(abs(len(links[k]) - got[k].n_links) for k, _, _ in rows if k is not None)
    assert missed <= 0.01 * sum(map(len, links.values()))
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (2000, 2001, 2002, 2003, 2004, 2005))
    assert near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 540)] + [(7, 7), (None, 3)]
    up = {x: x for e in edges for x in e if x is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up if top(x) != x}


def test_near_texts(docs):
    sets = defaultdict(set)
    for i, t in known(docs):
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] |= {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = near_texts(docs, n=3, hundredths=85).collect()
    assert len(got) == docs.count()
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), top(r.doc_id)) for r in got if r.doc_id is not None)
    assert near_texts(docs.limit(0)).count() == 0


def test_substrings(docs):
    first, seen = {}, dict(known(docs))
    rows = {i: words(t) for i, t in sorted(seen.items())}
    for i, w in rows.items():
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    want = {}
    for i, w in rows.items():
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (i, k):
                gone |= set(range(k, k + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    for cells in (None, 1 << 16):
        got = remove_repeats(docs, cells=cells).collect()
        assert len(got) == docs.count()
        assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_urls(spark):
    rows = [(i, f"https://{'spam-pills' if i % 2 else 'good-news'}{i}.example.{'com/en' if i % 2 else 'net/de'}/{i % 7}{i}") for i in range(400)]
    rows += [(1000, "http://spam-pills9.other.info/en/5"), (1001, "http://good-news8.other.info/de/5"), (1002, None), (1003, "no scheme/en/"), (1004, ""), (1005, "HTTP://WWW.Example.COM/en/7x?q=/"), (None, "https://a.org/es/1#x"), (1006, "https://xcom/en/")]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    assert (got[1005].host, got[1005].path, got[1005].rule, got[1005].verdict) == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[None].rule, got[None].verdict) == ("org/es/", "block")
    assert got[1006].rule is None
    assert (got[1000].verdict, got[1001].verdict) == ("block", "allow")
    assert all(got[k].host == got[k].path == "" and got[k].rule is None for k in (1002, 1003, 1004))
    assert got[1002].verdict == got[1004].verdict == "allow"
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_decontamination(spark, docs):
    texts = [t for _, t in known(docs) if t]
    items = [(1, " ".join(words(texts[30])[:25])), (2, "nowhere to be found in any of these many documents at all"), (3, words(texts[5])[0]), (4, None), (5, ""), (6, " ".join(words(texts[30])[3:14])), (7, "A B c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            wins[tuple(w[k : k + 10])].add(str(i))

    def judge(t):
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[k : k + n])):
                    found |= ids
                    hit |= set(range(k, k + n))
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    want = sorted((r.doc_id or -1, *judge(r.text)) for r in docs.collect())
    for size in (200_000, 7):
        decontam.BLOCK_WINDOWS = size
        got = decontam.benchmark_hits(docs, bench).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    decontam.BLOCK_WINDOWS = 200_000

    def loosely(t, slop):
        w, hit, found = split(t), set(), set()
        for win, ids in wins.items():
            need = Counter(win)
            for k in range(len(w)):
                span = w[k : k + len(win) + slop]
                if win[0] in span and not need - Counter(span):
                    found |= ids
                    hit |= set(range(k, k + len(span)))
        return len(w), len(hit), sorted(found)

    rows = [r for r in docs.collect() if len(r.text or "") < 2000] + [Row(doc_id=900, text="c x b a"), Row(doc_id=901, text="b b a"), Row(doc_id=902, text="a b q c c")]
    some = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    loose = decontam.benchmark_hits(some, bench.unionByName(spark.sql("SELECT 8L AS item_id, 'b a b' AS text")), slop=2).collect()
    wins[("b", "a", "b")].add("8")
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in loose) == sorted((r.doc_id or -1, *loosely(r.text, 2)) for r in rows)
    assert decontam.benchmark_hits(docs.limit(0), bench).count() == 0
    assert decontam.benchmark_hits(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_base_spans_against_plain_patterns():
    def plain(x):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    r = random.Random(2)
    for _ in range(20_000):
        x = "".join(r.choice("a1.@+- 5(é.@12") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(x) == plain(x), x


def test_personal_data(spark):
    crf = pii.trained()
    test = pii.labelled_table(200, 77)
    paths = crf.decode([w for w, _ in test])
    assert np.mean(np.concatenate([p == np.array(y) for p, (_, y) in zip(paths, test, strict=True)])) > 0.97
    rows = [(1, "é mail a.b@c.org ip 10.0.0.1 card 4111 1111 1111 1111 tel +1 (310) 555-4510"), (2, "call (310) 555-4510 now"), (3, "in 2023 at 10:30, 12.5 percent"), (4, None), (5, ""), (None, "x@y.z")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].redacted == "é mail <email> ip <ip> card <card> tel <phone>"
    assert got[2].n_phone == 0 and got[2].redacted == "call <phone> now"
    assert got[3].spans == got[4].spans == got[5].spans == "" and got[None].n_email == 1
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_toxicity(spark):
    r = random.Random(3)
    plain = ["".join(r.choice("aeiounrst") for _ in range(5)) for _ in range(200)]
    rows = [(i, " ".join(r.choice(plain) for _ in range(30)) + (" grumble" if i % 5 == 0 else ""), "en", int(i % 5 == 0)) for i in range(500)]
    docs = spark.createDataFrame([x[:3] for x in rows] + [(900, None, "en"), (901, "", None), (None, "grumble", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows] + [(None, 1), (3, None), (900, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    held = [x for x in rows if got[x[0]].held_out]
    assert 60 < len(held) < 140
    assert np.mean([got[x[0]].predicted == x[3] for x in held]) > 0.97
    assert got[None].predicted == 1 and got[900].predicted == 0 and got[901].predicted == 0
    constant = score_toxicity(docs, labels.limit(0)).select("score").distinct().count()
    assert constant == 1


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, d)
        docs.cache()
        assert 0 < docs.count() <= before, name
        assert docs.columns[:5] == list(corpus_pipeline.COLUMNS), name


#: Of each kind, spans in every form that the random field is trained on.
FORMS = {
    "email": ["bob[at]site.com", "jane(at)other.net", "tom at example dot org", "ANN AT place DOT com"],
    "ip": ["[10].[0].[0].[1]", "10-20-30-41", "[192].[168].[7].[255]"],
    "card": ["4111.1111.1111.1111", "5500/0000/0000/0004", "4000.0000.0000.0002"],
    "phone": ["555-123-4567", "(555) 123-4567", "555.987.6543", "(212)555-0188", "1 (555) 222-3333"],
}


def _neighbours():
    for kind, forms in FORMS.items():
        for a in forms:
            for b in forms:
                for between in (" ", ", ", "; ", " and "):
                    yield kind, a, b, between


def test_neighbours_of_one_kind_are_both_found():
    cases = list(_neighbours())
    texts = [f"note {a}{between}{b} below" for _, a, b, between in cases]
    for (kind, a, b, between), text, spans in zip(cases, texts, pii._kernel(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), pii.trained()), strict=True):
        assert [(k, text[x:y]) for k, x, y, _ in spans] == [(kind, a), (kind, b)], text


def test_no_neighbour_leaks_through_the_pipeline(spark):
    import corpus_pipeline

    cases = list(_neighbours())
    docs = spark.createDataFrame([(i, f"note {a}{between}{b} below", "en", "s", 1) for i, (_, a, b, between) in enumerate(cases)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in corpus_pipeline.personal_data(spark, docs, None).collect():
        kind, a, b, between = cases[r.doc_id]
        assert r.text == f"note <{kind}>{between}<{kind}> below", (r.text, a, b)


def test_plain_words_are_no_addresses():
    texts = ["we met at noon dot com boom", "look at dot com", "they are at home dot net", "he arrived at paris. dot com is", "item 12-34 and 2024-05-06 at 10:30", "v1.2.3 of 10.5", "pages 100-200-300"]
    assert pii._kernel(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), pii.trained()) == [[] for _ in texts]


def test_a_long_run_of_neighbours_is_cut_in_linear_time():
    text = "555-123-4567 " * 5000
    [spans] = pii._kernel(pa.RecordBatch.from_arrays([pa.array([text])], ["text"]), pii.trained())
    assert len(spans) == 5000
