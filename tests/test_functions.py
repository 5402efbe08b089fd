import pytest

from lodestone.functions import parse
from lodestone.operators.markdown import chunk_markdown, merge_snippets, parse_blocks, partition, split_block
from lodestone.operators.sessions import cache_key, exclusion_policy
from lodestone.sources.files import convert, csv_to_markdown, html_to_markdown, matrix_to_markdown, read_text


def test_int_ranges():
    assert parse.int_ranges("234-237") == [234, 235, 236, 237]
    assert parse.int_ranges("22,40, 25-27") == [22, 25, 26, 27, 40]
    assert parse.int_ranges(42) == [42]
    assert parse.int_ranges("a.md") is None and parse.int_ranges("2020-01-01") is None


def test_targets():
    assert parse.target("lode://docs/a/b.md:3-4") == parse.Target("docs", "a/b.md", [3, 4])
    assert parse.target("docs:a.md:2") == parse.Target("docs", "a.md", [2])
    assert parse.target("a.md:2", "main") == parse.Target("main", "a.md", [2])
    assert parse.target("10-12").row_ids == [10, 11, 12]
    assert parse.target('"docs:R&amp;D.md"') == parse.Target("docs", "R&D.md")
    assert parse.target(r"C:\x.md").path == r"C:\x.md"


def test_directives():
    clean, found = parse.directives('find this title:"My Doc" in:notes n:5 rerank:on seen:exclude http://x.y')
    assert clean == "find this http://x.y"
    assert found == {"title": "My Doc", "collection": "notes", "limit": 5, "rerank": True, "exclude_seen": True}


def test_match_expressions():
    assert parse.all_terms("the fox is") == ["fox"] and parse.all_terms("the is") == ["the", "is"]
    assert parse.any_terms("state-of the art") == ["state", "art"]
    assert parse.tiers(["Ada"], ["engine"], "q") == ['"Ada" AND "engine"', '"Ada"']
    leaf = lambda *t, **k: parse.Leaf(t, **k)
    assert parse.expression('"a b" OR c NOT d') == parse.Expression((leaf("a", "b"), leaf("c"), leaf("d")), (0, 1, 2, parse.NOT, parse.OR))
    assert parse.expression("a AND (b OR c)").program == (0, 1, 2, parse.OR, parse.AND)
    assert parse.expression("a OR b AND c").program == (0, 1, 2, parse.AND, parse.OR)
    assert parse.expression("a b NOT c").program == (0, 1, parse.AND, 2, parse.NOT)
    assert parse.expression('title:x* {path title}: "p q" ^first').leaves == (leaf("x", prefix=True, columns=("title",)), leaf("p", "q", columns=("path", "title")), leaf("first", first=True))
    assert parse.expression('NEAR("a b" c, 5) AND "-"') == parse.Expression((leaf("a", "b", near=(1, 5)), leaf("c", near=(1, 5)), leaf()), (0, 1, parse.AND))
    for bad in ("AND", "a AND", "(a", "a ? b", "NEAR(a, x)", ""):
        with pytest.raises(ValueError):
            parse.expression(bad)
    assert parse.compiled('a ? AND "b') == parse.Expression((leaf("a", "and", "b"),), (0,))
    assert parse.compiled("the state-of art").leaves == (leaf("state", "of"), leaf("art")) and parse.compiled(" ").program == ()
    assert parse.relaxed("the fox") == parse.Expression((), ()) and parse.relaxed("red fox").program == (0, 1, parse.OR)
    assert parse.batch_commands("<think>lodestone x</think>\n1. `lodestone search a`\n- lodestone grep b") == ["lodestone search a", "lodestone grep b"]


def test_blocks_and_chunks():
    text = "intro\n# A\nx [t](u) ![i](v)\n```\n# no\n```\n## B\ny\n"
    blocks = parse_blocks(text)
    assert [(b.level, b.header, b.line) for b in blocks] == [(0, "Preface", 1), (1, "A", 2), (2, "B", 7)]
    assert "x t i" in blocks[1].content and "# no" in blocks[1].content
    chunks = chunk_markdown("\n".join(f"# H{i}\n" + "word " * 30 for i in range(6)), 200, 400)
    assert [c["seq_id"] for c in chunks] == list(range(len(chunks))) and all(len(c["text"]) <= 404 for c in chunks)
    assert chunk_markdown("") == []


def test_partition_counts_the_last_separator_after_the_first_run():
    assert partition([10, 10], [2, 2], 22, 22) == [2]  # 10 + 2 + 10, no separator at the end
    assert partition([20, 10, 10], [2, 2, 2], 24, 24) == [1, 3]  # 10 + 2 + 10 + 2: later runs count it
    assert partition([20, 10, 10], [2, 2, 2], 23, 23) == [1, 2, 3]
    assert partition([10, 30], [2, 2], 20, 30) == [1, 2]  # the last alone: measured without


def test_split_block_prefers_paragraphs():
    block = parse_blocks("# T\n" + "a" * 30 + "\n\n" + "b" * 30)[0]
    pieces = split_block(block, 50)
    assert [p.header for p in pieces] == ["T", "T (cont.)"] and pieces[1].content == "b" * 30


def test_snippets():
    assert merge_snippets([(1, "b"), (0, "a"), (4, "c")]) == ["a", "b", "(... 2 chunks skipped ...)", "c"]
    common = "x" * 25
    assert merge_snippets([(0, "start " + common), (1, common + " end")]) == [f"start {common} end"]
    assert merge_snippets([(-1, "only")]) == ["only"]


def test_converters():
    assert csv_to_markdown(b"Name,Age\n\nAlice, 30\n") == "| Name | Age |\n| --- | --- |\n| Alice | 30 |"
    assert html_to_markdown("<h1>Title</h1><p>some text</p><ul><li>Item 1</li></ul><script>x</script>") == "# Title\n\nsome text\n\n- Item 1"
    assert matrix_to_markdown([["a", "b"], ["1|2"]]) == "| a | b |\n| --- | --- |\n| 1\\|2 |  |"
    assert convert("a.txt", "hé".encode("latin-1")) == "hé"
    with pytest.raises(ValueError):
        read_text(b"\0\1")


def test_sessions():
    assert exclusion_policy("s") and not exclusion_policy("s", include_seen=True) and not exclusion_policy(None)
    assert cache_key(a=1, b=2) == cache_key(b=2, a=1) != cache_key(a=1, b=3)
