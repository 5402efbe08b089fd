"""Markdown chunks and merged snippets against plain loops and golden cases."""

import itertools
import random

from lodestone.operators.markdown import breadcrumbs, chunk_markdown, markdown_chunks, merge_snippets, merged_snippets, parse_blocks, partition, split_block


def _every_partition(sizes, joiners, target, most):
    """The cheapest runs by trying every way to cut; None if none is allowed."""
    n, best = len(sizes), None
    for k in range(n):
        for inner in itertools.combinations(range(1, n), k):
            cuts = [0, *inner, n]
            cost = 0
            for a, b in itertools.pairwise(cuts):
                size = sum(sizes[a:b]) + sum(joiners[a:b] if a else joiners[a : b - 1])
                cost += (size - target) ** 2 if size <= most else float("inf")
            if cost < float("inf") and (best is None or cost < best[0]):
                best = (cost, cuts[1:])
    return best


def test_partition_is_the_cheapest():
    r = random.Random(1)
    found = 0
    for _ in range(300):
        n = r.randint(1, 9)
        sizes, joiners = [r.randint(1, 30) for _ in range(n)], [r.choice([0, 1, 2]) for _ in range(n)]
        best = _every_partition(sizes, joiners, 25, 40)
        if best:
            found += 1
            cost, at = 0, 0
            for cut in partition(sizes, joiners, 25, 40):
                size = sum(sizes[at:cut]) + sum(joiners[at:cut] if at else joiners[at : cut - 1])
                cost, at = cost + (size - 25) ** 2, cut
            assert cost == best[0], (sizes, joiners)
    assert found > 200


def test_partition_golden():
    assert partition([30, 0, 29], [2, 2, 2], 20, 30) == [1, 3]  # of the last runs that fit, the cheapest
    assert partition([50, 10, 50], [2, 2, 2], 20, 30) == [1, 2, 3]  # greedy: nothing fits
    assert partition([40, 15, 10, 12, 3], [0] * 5, 20, 30) == [1, 3, 5]  # greedy closes at the target


def test_breadcrumbs():
    blocks = parse_blocks("intro\n# A\nx\n### C\ny\n## B\nz\n# D\n####### deep\n")
    assert list(breadcrumbs(blocks).values()) == [[], [" Preface", "# A"], ["# A", "### C"], ["# A", "## B"], [" Preface", "# D"], ["# D", "####### deep"]]
    assert [c["headers"] for c in chunk_markdown("intro\n# A\n" + "x" * 80 + "\n## B\n" + "y" * 80, 60, 90)] == ["", "Preface", "A"]
    assert [c["headers"] for c in chunk_markdown("# C# guide\n" + "x " * 40 + "\n## B\n" + "y " * 40, 60, 90)] == ["", "C# guide"]


def test_split_oversized():
    block = parse_blocks("# T\n" + "a" * 30 + "   \n\n   \n\n" + "b" * 30)[0]
    pieces = split_block(block, 45)
    assert [p.content for p in pieces] == ["# T\n" + "a" * 30, "b" * 30] and pieces[-1].joiner == block.joiner
    words = split_block(parse_blocks("w " * 60)[0], 21)
    assert all(len(p.content) <= 21 and p.content == p.content.strip() for p in words)
    assert [p.content for p in split_block(parse_blocks("x" * 50)[0], 20)] == ["x" * 20, "x" * 20, "x" * 10]
    assert [p.content for p in split_block(parse_blocks("One. Two? Three! Four.")[0], 11)] == ["One. Two?", "Three!", "Four."]
    assert split_block(parse_blocks("# " + "h" * 40 + "\nbody")[0], 20)[0].content == "# " + "h" * 40


def test_chunks_hold_all_words():
    r = random.Random(2)
    for _ in range(40):
        lines = [r.choice(["# h{}", "## h{}", "w{} v", "", "```", "| a{} | b |"]).format(i) for i in range(r.randint(1, 60))]
        text = "\n".join(lines)
        assert " ".join(c["text"] for c in chunk_markdown(text, 60, 90)).split() == text.split()


def test_merged_snippets(spark):
    assert merge_snippets([(2, "two", ""), (0, "zero", ""), (1, "zer", ""), (5, "five", "")]) == ["zero", "(... 1 chunk skipped ...)", "two", "(... 2 chunks skipped ...)", "five"]
    assert merge_snippets([(3, "text", "T > A > B"), (4, "# B\nmore", "T > A > B")], "T") == ["(... 3 chunks skipped ...)", "## A > B\n\ntext", "# B\nmore"]
    assert merge_snippets([(0, "# B\nx", "A > B")]) == ["## A\n\n# B\nx"]
    assert merge_snippets([(0, "a", ""), (-1, "b", ""), (-1, "a", "")]) == ["a", "(... chunks skipped ...)", "b"]
    for n in (19, 20, 250, 251):
        tail = "".join(chr(0x4E00 + i) for i in range(n))
        assert len(merge_snippets([(0, "start " + tail, ""), (1, tail + " end", "")])) == (1 if 20 <= n <= 250 else 2)
    rows = spark.createDataFrame([(1, "c", "p", "T", 1, "b", ""), (1, "c", "p", "T", 0, "a", ""), (2, "c", "p", None, 4, "z", None)], "query_id int, collection string, path string, title string, seq_id int, text string, headers string")
    assert sorted((x.query_id, x.snippets) for x in merged_snippets(rows).collect()) == [(1, ["a", "b"]), (2, ["(... 4 chunks skipped ...)", "z"])]


def test_markdown_chunks_of_a_table(spark):
    rows = spark.createDataFrame([(1, "# A\nx"), (2, None), (3, ""), (None, "y")], "doc_id long, body string")
    got = sorted((x.doc_id or 0, x.seq_id, x.text) for x in markdown_chunks(rows).collect())
    assert got == [(0, 0, "y"), (1, 0, "# A\nx")]
