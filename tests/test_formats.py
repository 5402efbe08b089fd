from xml.etree import ElementTree

from lodestone.functions.parse import Word, lexical_terms, tiered_terms, tiers
from lodestone.sources import formats as out
from lodestone.sources.formats import About, Terminal


def _hit(seq, text="some <b> text", **more):
    return {"collection": "c", "path": "a/b.md", "title": 'T "x"', "seq_id": seq, "text": text, "score": 0.5, "rank": 1, "headers": "A > B"} | more


def test_gaps_of_documents():
    doc = _hit(0) | {"chunks": [_hit(20, "z"), _hit(10, "x"), _hit(13, "y"), _hit(10, "again")]}
    gaps = [(g.get("omitted_chunks"), g.get("from_seq"), g.get("to_seq"), g.get("expand")) for g in ElementTree.fromstring(out.documents_xml([doc], About(query="q"))).iter("gap")]
    assert gaps == [("10", "0", "9", None), ("2", "11", "12", "lodestone read 'c:a/b.md:11-12'"), ("6", "14", "19", None)]
    assert ElementTree.fromstring(out.documents_xml([])).get("total_documents") == "0"


def test_results_and_sessions():
    about = About(query='a "b"', session="s", seen=4, excluded_chunks=2, excluded_docs=1, omitted=3, cap=30)
    root = ElementTree.fromstring(out.results_xml([_hit(0, "plain", fts_score=1.0, fts_rank=2)], about, verbose=True))
    assert root.attrib == {"query": 'a "b"', "total_matches": "1", "session_id": "s", "seen_chunks": "4", "next_query_hint": "--session s", "excluded_chunks": "2", "excluded_docs": "1"}
    result = root.find("result")
    assert (result.get("prev_seq"), result.get("next_seq"), result.get("read"), result.get("fts_rank")) == ("0", "1", "lodestone read 'c:a/b.md:0'", "2")
    assert root.find("truncation").get("omitted_chunks") == "3"
    root = ElementTree.fromstring(out.discover_xml([_hit(2, "plain", match_count=3)], about))
    assert root.find("document").get("match_count") == "3" and root.find("truncation").get("omitted_documents") == "3"


def test_chunks_outline_tree_grep():
    root = ElementTree.fromstring(out.chunks_xml([_hit(1, "x"), _hit(4, "y")], About(omitted=1, cap=2, resume="lodestone read 'x'")))
    assert [x.tag for x in root] == ["chunk", "gap", "chunk", "truncation"]
    outline = {"collection": "", "path": "p.md", "title": "P", "total_chunks": 2, "total_chars": 9, "headings": [{"level": 2, "text": "A & B", "start_seq": 0, "end_seq": 1, "char_count": 9}]}
    head = ElementTree.fromstring(out.outline_xml(outline)).find("heading")
    assert head.text == "A & B" and head.get("read") == "lodestone read 'p.md:0-1'"
    tree = [{"collection": "c", "tree": {"children": [{"type": "directory", "name": "d", "children": [{"type": "file", "name": "f.md", "title": "F", "path": "d/f.md"}]}, {"type": "directory", "name": "e", "children": []}]}}]
    assert ElementTree.fromstring(out.tree_xml(tree)).find("directory/file").get("path") == "d/f.md"
    assert ElementTree.fromstring(out.tree_xml(tree * 2)).tag == "collections"
    match = {"collection": "c", "path": "p", "title": "p", "line_number": 3, "line_text": "a < b", "match_text": "<"}
    assert ElementTree.fromstring(out.grep_xml([match], "<")).find("document/match").text == "a < b"
    plain, colour = Terminal(False), Terminal()
    assert plain.tree(tree) == "c/\n├── d/\n│   └── f.md (F)\n└── e/" and "\x1b[" in colour.tree(tree)
    assert plain.grep([match]) == "Found 1 match:\nlode://c/p\n     3: a < b"
    assert "[seq: 0-1]" in plain.outline(outline) and plain.chunks([]) == "No chunks found."
    assert "\x1b[33msome\x1b[0m" in colour.results([_hit(1)], About(query="some"))


def test_terms_of_queries():
    assert lexical_terms('the "red fox" runs') == {'the "red fox" runs', "red fox", "runs"} - {""} or lexical_terms('the "red fox" runs') >= {"red fox", "runs"}
    assert lexical_terms("the a") == {"the a"}
    read = [Word("Ada", "PROPN", entity=0), Word("Lovelace", "PROPN", entity=0), Word("the", "DET", stop=True, phrase=1), Word("first", "ADJ", phrase=1), Word("things", "NOUN", "thing", phrase=1), Word("wrote", "VERB")]
    assert tiered_terms(read) == (["Ada Lovelace"], ["first", "wrote"])
    assert tiers(*tiered_terms(read), "q") == ['"Ada Lovelace" AND "first" AND "wrote"', '"Ada Lovelace"']
    assert tiered_terms(None) == ([], []) and tiered_terms([Word("thing", "NOUN")]) == ([], ["thing"])
