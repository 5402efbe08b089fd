import io
import zipfile
from xml.etree import ElementTree

from lodestone.sources import render
from lodestone.sources.files import convert
from lodestone.streaming import ingest

OFFICE = "http://schemas.openxmlformats.org"
R = f'xmlns:r="{OFFICE}/officeDocument/2006/relationships"'


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _links(target):
    return f'<Relationships xmlns="{OFFICE}/package/2006/relationships"><Relationship Id="rId1" Target="{target}"/></Relationships>'


def test_xlsx():
    m = f'xmlns="{OFFICE}/spreadsheetml/2006/main"'
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>b|c</t></is></c></row><row><c r="A2"/></row><row><c r="A3"><v>3.5</v></c></row>'
    data = _zip({"xl/workbook.xml": f'<workbook {m} {R}><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _links("worksheets/sheet1.xml"), "xl/sharedStrings.xml": f"<sst {m}><si><t>a</t></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet {m}><sheetData>{rows}</sheetData></worksheet>"})
    assert convert("x.xlsx", data) == "## Sheet: One\n\n| a | | b\\|c |\n| --- | --- | --- |\n| 3.5 | | |"


def test_pptx():
    ns = f'xmlns:a="{OFFICE}/drawingml/2006/main" xmlns:p="{OFFICE}/presentationml/2006/main"'
    sp = lambda kind, body: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>'
    slide = sp('<p:ph type="title"/>', "<a:p><a:r><a:t>Plan</a:t></a:r></a:p>") + sp("", '<a:p><a:r><a:t>one</a:t></a:r></a:p><a:p><a:pPr lvl="1"/><a:r><a:t>two</a:t></a:r></a:p>')
    data = _zip({"ppt/presentation.xml": f'<p:presentation {ns} {R}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": _links("slides/slide1.xml"), "ppt/slides/slide1.xml": f"<p:sld {ns}>{slide}</p:sld>"})
    assert convert("x.pptx", data) == "## Slide 1: Plan\n\n- one\n  - two"


def test_formats(spark):
    hits = spark.sql("""SELECT 1 AS query_id, 1 AS rank, 0.5D AS score, 'c' AS collection, 'a/b.md' AS path, 0 AS seq_id, 'T "x" & y' AS title, 'line\\none' AS text""")
    xml = render.whole(render.results_xml(hits), "search_results", query="a<b")
    root = ElementTree.fromstring(xml)
    assert root.get("query") == "a<b" and root.get("total") == "1"
    assert root[0].get("title") == 'T "x" & y' and root[0].get("document") == "lode://c/a/b.md" and root[0].get("next_seq") == "1"
    assert render.as_json(hits, "rank").first().json.startswith('{"query_id":1,"rank":1,"score":0.5')
    assert render.results_text(hits).first().text.split("\n")[0] == '1. T "x" & y (lode://c/a/b.md)'
    lines = spark.sql("SELECT * FROM VALUES ('c', 'p', 't', 10, 'a<b'), ('c', 'p', 't', 2, 'z') AS v(collection, path, title, line_number, line_text)")
    found = ElementTree.fromstring(render.grep_xml(lines).first().xml)
    assert [(e.get("line"), e.text) for e in found] == [("2", "z"), ("10", "a<b")]
    nodes = spark.sql("SELECT 'c' AS collection, 0 AS depth, '' AS parent, 'src' AS name, 'directory' AS type")
    assert render.tree_xml(nodes).first().xml == '  <node name="src" type="directory" depth="0" />'


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A")
    (tmp_path / "in" / "skip.bin").write_text("x")
    run = lambda: ingest.ingest(ingest.arriving(spark, str(tmp_path / "in"), "c"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    run()
    (tmp_path / "in" / "b.csv").write_text("k,v\n1,2\n")
    run()
    got = {r.path.rsplit("/", 1)[-1]: r.body for r in ingest.snapshot(spark, str(tmp_path / "out")).collect()}
    assert got == {"a.md": "# A", "b.csv": "| k | v |\n| --- | --- |\n| 1 | 2 |"}


def _pdf(pages, compress=True):
    """A small file of pages, each a list of (size, text)."""
    import zlib

    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} /Resources << /Font << /F1 3 0 R >> >> >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    out = b"%PDF-1.4\n" + b"".join(f"{i} 0 obj\n{o}\nendobj\n".encode() for i, o in enumerate(objects, 1))
    for i, page in enumerate(pages):
        content = "BT " + " ".join(f"/F1 {size} Tf 0 -20 Td ({t}) Tj" for size, t in page) + " ET"
        data = zlib.compress(content.encode()) if compress else content.encode()
        out += f"{4 + 2 * i} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * i} 0 R >>\nendobj\n{5 + 2 * i} 0 obj\n<< /Length {len(data)}{' /Filter /FlateDecode' if compress else ''} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    return out


def test_pdf_text_and_headings():
    import pytest

    from lodestone.sources.pdf import pdf_to_markdown

    pages = [[(20, "Title"), (10, "first line of \\(some\\) text"), (14, "Part")], [(10, "second page"), (10, "and its \\101 end")]]
    want = "# Title\n\nfirst line of (some) text\n\n## Part\n\nsecond page\nand its A end"
    assert pdf_to_markdown(_pdf(pages)) == want == pdf_to_markdown(_pdf(pages, False))
    for bad in (b"no", _pdf([]), b"%PDF /Encrypt"):
        with pytest.raises(ValueError):
            pdf_to_markdown(bad)


def test_books_images_and_formulas(spark):
    import io
    import zipfile
    from xml.etree import ElementTree

    from lodestone.sources.files import described, docx_to_markdown, epub_images, epub_to_markdown, levelled

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>My Book</dc:title><manifest><item id="b" href="t/b.xhtml"/><item id="a" href="t/a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/t/a.xhtml", '<html><body><h1>One</h1><p>text <img src="../i/x.jpg" alt="pic"/></p></body></html>')
        z.writestr("O/t/b.xhtml", "<html><body><h1>Two</h1><h3>Deep</h3></body></html>")
        z.writestr("O/i/x.jpg", b"\x01\x02")
    book = made.getvalue()
    assert epub_to_markdown(book) == "# My Book\n\n## One\n\ntext ![pic](x.jpg)\n\n---\n\n## Two\n\n#### Deep"
    assert "data:image/jpeg;base64,AQI=" in epub_to_markdown(book, "base64")
    assert levelled("# My Book\n## A", "my book") == "# My Book\n## A" and levelled("intro\n### A\n#### B") == "intro\n# A\n## B" and levelled("x", "T") == "# T\n\nx"
    files = spark.createDataFrame([("a/b.epub", bytearray(book)), ("c.md", bytearray(b"x"))], "path string, content binary")
    assert [(r.path, r.name, bytes(r.content)) for r in epub_images(files).collect()] == [("a/b.epub", "x.jpg", b"\x01\x02")]
    said = {r.path: (r.body, r.error) for r in described(files, lambda b: {1: "one byte"}[len(b)]).collect()}
    assert said["c.md"] == ("one byte", None) and said["a/b.epub"][1].startswith("KeyError")
    m, w = "http://schemas.openxmlformats.org/officeDocument/2006/math", "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    r = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
    formula = f"<m:oMath><m:f><m:num>{r('a')}</m:num><m:den><m:rad><m:deg/><m:e>{r('b')}</m:e></m:rad></m:den></m:f><m:sSup><m:e>{r('x')}</m:e><m:sup>{r('2')}</m:sup></m:sSup><m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr><m:sub>{r('i')}</m:sub><m:sup>{r('n')}</m:sup><m:e>{r('i')}</m:e></m:nary></m:oMath>"
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:m="{m}"><w:body><w:p><w:r><w:t>so </w:t></w:r>{formula}</w:p></w:body></w:document>')
    assert docx_to_markdown(made.getvalue()) == "so $\\frac{a}{\\sqrt{b}}{x}^{2}\\sum_{i}^{n} i$"
    assert ElementTree is not None


def test_scan_by_extensions(spark, tmp_path):
    from lodestone.sources.files import scan, to_markdown

    (tmp_path / "in").mkdir()
    for name in ("a.MD", "b.txt", "c.csv", "in/d.md", "e.bin"):
        (tmp_path / name).write_text("x,y")
    paths = lambda **k: sorted(r.path for r in scan(spark, str(tmp_path), "c", **k).collect())
    assert paths() == ["a.MD", "b.txt", "c.csv", "in/d.md"] and paths(convert_others=False) == ["a.MD", "b.txt", "in/d.md"]
    assert paths(extensions=(".Md", "csv")) == ["a.MD", "c.csv", "in/d.md"] and paths(glob="**/*.txt") == ["b.txt"]
    rows = {r.path: r for r in to_markdown(scan(spark, str(tmp_path), "c")).collect()}
    assert rows["c.csv"].body.startswith("| x | y |") and rows["in/d.md"].title == "D" and rows["b.txt"].error is None
