"""Collections of files as DataFrames, converted to Markdown."""

from __future__ import annotations

import base64
import csv
import io
import posixpath
import re
import zipfile
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import globs
from lodestone.sources.formula import MATH, latex
from lodestone.sources.pdf import pdf_to_markdown

# File types.
TEXT_TYPES = ("md", "markdown", "txt")
OTHER_TYPES = ("csv", "html", "htm", "epub", "docx", "xlsx", "pptx", "pdf")


def is_supported(path: Column, others: bool = True) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*TEXT_TYPES, *(OTHER_TYPES if others else ()))


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def scan(spark: SparkSession, base: str, collection: str, *, glob: str | None = None, extensions: tuple[str, ...] = (), convert_others: bool = True) -> DataFrame:
    """(collection, path, title, hash, content, modified_at) of the supported files below ``base``.

    ``glob`` counts from ``base``: only the folders are listed that can hold a match.
    ``extensions``, with or without a dot and in any case, take its place.
    """
    wanted = globs.compiled(glob) if glob and not extensions else None
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(wanted is None or wanted.deep).lower())
    start = base
    if wanted:
        start = f"{base.rstrip('/')}/{wanted.folder}" if wanted.folder else base
        if wanted.names:
            reader = reader.option("pathGlobFilter", wanted.names)
        if wanted.folder and not _exists(spark, start):
            reader, start = reader.option("pathGlobFilter", "/"), base  # no such folder: no file has this name
    rows = reader.load(start).filter(is_supported(F.col("path"), convert_others))
    if extensions:
        kinds = sorted({e.strip().lstrip(".").lower() for e in extensions})
        rows = rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(kinds))
    inner = F.regexp_replace(F.col("path"), f"^(?:file:)?/*{re.escape(base.removeprefix('file:').strip('/'))}/", "")
    if wanted:
        rows = rows.filter(inner.rlike(wanted.regex))
    stem = F.regexp_replace(F.regexp_extract(inner, r"([^/]+)$", 1), r"\.[^.]+$", "")
    return rows.select(F.lit(collection).alias("collection"), inner.alias("path"), title_of(stem).alias("title"), F.sha2("content", 256).alias("hash"), "content", F.col("modificationTime").alias("modified_at"))


def title_of(stem: Column) -> Column:
    """A file's stem as title; a letter after any other sign is a capital."""
    return F.pandas_udf(lambda s: s.str.replace("_", " ").str.title(), "string")(stem)


def read_text(data: bytes) -> str:
    if b"\0" in data[:8192]:
        raise ValueError("binary file")
    for encoding in ("utf-8", "utf-8-sig"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def matrix_to_markdown(rows: list[list]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    cell = lambda c: re.sub(r"\s+", " ", "" if c is None else str(c)).strip().replace("|", "\\|")
    lines = ["| " + " | ".join([cell(c) for c in r] + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def csv_to_markdown(data: bytes) -> str:
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(read_text(data))) if any(c.strip() for c in r)]
    return matrix_to_markdown(rows)


class _Html(HTMLParser):
    """Headings, paragraphs, lists, tables and preformatted text as Markdown."""

    SKIP = {"script", "style", "head", "title", "meta", "noscript", "svg", "iframe"}
    VOID = {"meta"}

    def __init__(self, image: Callable[[str, str], str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.image = image
        self.out: list[str] = []
        self.text: list[str] = []
        self.skip, self.pre = 0, False
        self.lists: list[list] = []
        self.table: list[list[str]] | None = None
        self.mark = ""

    def flush(self, prefix: str = "") -> None:
        raw = "".join(self.text)
        self.text = []
        text = raw.strip("\n") if self.pre else re.sub(r"\s+", " ", raw).strip()
        if text:
            self.out.append(f"```\n{text}\n```" if self.pre else prefix + text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += tag not in self.VOID
        elif self.skip:
            return
        elif tag == "img" and self.image and dict(attrs).get("src"):
            self.text.append(self.image(dict(attrs)["src"], dict(attrs).get("alt") or ""))
        elif tag == "pre":
            self.flush(self.mark)
            self.pre = True
        elif tag == "table":
            self.flush()
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table:
            self.text = []
            span = dict(attrs).get("colspan") or "1"
            self.span = int(span) if span.isdigit() else 1
        elif tag in ("ul", "ol"):
            self.flush(self.mark)
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush(self.mark)
            if self.lists:
                self.lists[-1][1] += 1
                self.mark = "  " * (len(self.lists) - 1) + ("- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. ")
        elif re.fullmatch("h[1-6]|p|div|section|article|br", tag) and self.table is None:
            self.flush(self.mark)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - (tag not in self.VOID))
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.flush("#" * int(tag[1]) + " ")
        elif tag == "pre":
            self.flush()
            self.pre = False
        elif tag in ("td", "th") and self.table:
            self.table[-1] += ["".join(self.text)] + [""] * (self.span - 1)
            self.text = []
        elif tag == "table" and self.table is not None:
            if rows := [r for r in self.table if r]:
                self.out.append(matrix_to_markdown(rows))
            self.table = None
        elif tag in ("ul", "ol"):
            self.flush(self.mark)
            self.mark = ""
            if self.lists:
                self.lists.pop()
        elif tag in ("p", "div", "li", "section", "article") and self.table is None:
            self.flush(self.mark)
            self.mark = ""

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def html_to_markdown(text: str, image: Callable[[str, str], str] | None = None) -> str:
    """``image`` makes the text of an image from its address and alternative; without it images are left out."""
    p = _Html(image)
    p.feed(text)
    p.close()
    p.flush(p.mark)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(p.out)).strip()


_HEADING = re.compile(r"^(#{1,6})\s+(.*)$", re.M)


def levelled(text: str, title: str | None = None) -> str:
    """One heading of level 1 at most, at the top: the title, or the first heading if it says the same.

    All others are moved together so that the highest has level 2 (1 without a title on top).
    """
    text = text.strip()
    heads = list(_HEADING.finditer(text))
    top = heads[0] if heads and len(heads[0][1]) == 1 else None
    if top and title:
        a, b = top[2].strip().lower(), title.strip().lower()
        top = top if a in b or b in a else None
    elif top and text[: top.start()].strip():
        top = None
    others = [h for h in heads if h is not top]
    least = 2 if top or title else 1
    shift = least - min((len(h[1]) for h in others), default=least)

    def moved(h: re.Match) -> str:
        if top and h.start() == top.start():
            return h[0]
        return f"{'#' * max(least, min(6, len(h[1]) + shift))} {h[2].strip()}"

    out = _HEADING.sub(moved, text)
    if title and not top:
        out = f"# {title}\n\n{out}"
    return re.sub(r"\n{3,}", "\n\n", out).strip()


#: How EPUB images show: by name, or with their data.
IMAGES = ("refer", "base64")


def epub_to_markdown(data: bytes, images: str = "refer") -> str:
    """The spine's documents in order, joined by rules, with headings below the book's title."""
    if images not in IMAGES:
        raise ValueError(f"images are one of {', '.join(IMAGES)}")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item") or e.tag == "item"}
        spine = [items.get(e.get("idref")) for e in package.iter() if e.tag.endswith("itemref")]
        title = next((e.text.strip() for e in package.iter() if e.tag.endswith("}title") and e.text and e.text.strip()), None)
        base = PurePosixPath(opf).parent

        def image(at: str) -> Callable[[str, str], str]:
            def shown(src: str, alt: str) -> str:
                inside = posixpath.normpath(posixpath.join(posixpath.dirname(at), src))
                name = posixpath.basename(inside)
                if images == "base64" and inside in names:
                    kind = name.rsplit(".", 1)[-1].lower().replace("jpg", "jpeg")
                    return f"![{alt}](data:image/{kind};base64,{base64.b64encode(z.read(inside)).decode()})"
                return f"![{alt}]({name})"

            return shown

        parts = [html_to_markdown(read_text(z.read(str(base / h))), image(str(base / h))) for h in spine if h and str(base / h) in names]
    return levelled("\n\n---\n\n".join(p for p in parts if p), title)


def epub_images(files: DataFrame) -> DataFrame:
    """(path, name, content): the images of the EPUB files among ``files`` (path, content), to be written where they are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows += [(path, posixpath.basename(n), z.read(n)) for n in z.namelist() if re.search(r"\.(png|jpe?g|gif|svg|webp)$", n, re.I)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["path", "name", "content"])

    return files.filter(F.lower("path").endswith(".epub")).select("path", "content").mapInArrow(run, "path string, name string, content binary")


def in_window(call: Callable[[bytes], str], items: Iterable[bytes], window: int) -> Iterator[tuple[str | None, str | None]]:
    """(result, error) of each item in order, with at most ``window`` calls at once and as many results waiting."""
    with ThreadPoolExecutor(max(1, window)) as pool:
        waiting: deque = deque()

        def first() -> tuple[str | None, str | None]:
            try:
                return waiting.popleft().result(), None
            except Exception as e:  # noqa: BLE001  one image never fails the job
                return None, f"{type(e).__name__}: {e}"

        for item in items:
            waiting.append(pool.submit(call, item))
            if len(waiting) >= max(1, window):
                yield first()
        while waiting:
            yield first()


def described(images: DataFrame, describe: Callable[[bytes], str], window: int = 4) -> DataFrame:
    """Adds ``body`` to images (…, content): what ``describe`` says of each, or ``error``.

    Partitions work side by side; in each, ``window`` calls are on their way, and rows keep their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = list(in_window(describe, (x.as_py() for x in batch.column("content")), window))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in said], pa.string()) for i in (0, 1))], [*batch.schema.names, "body", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)
    return images.mapInArrow(run, f"{kinds}, body string, error string")


def with_descriptions(documents: DataFrame, images: DataFrame) -> DataFrame:
    """``documents`` (path, body, …) with what ``images`` (path, name, body) say, quoted below where the image stands.

    An image stands where its name ends the address of a Markdown image. Those without a description stay as they are.
    """
    said = images.filter(F.length("body") > 0).groupBy("path").agg(F.collect_list(F.struct("name", F.col("body").alias("text"))).alias("said"))
    rows = documents.join(said, "path", "left").select(*documents.columns, "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for body, own in zip(batch.column("body").to_pylist(), batch.column("said").to_pylist(), strict=True):
                known = {x["name"].rsplit("/", 1)[-1]: " ".join(x["text"].split()) for x in own or ()}
                put = lambda m, known=known: m[0] + (f"\n\n> {known[m[1]]}\n" if m[1] in known else "")
                bodies.append(re.sub(r"!\[[^\]]*\]\((?:[^()]*/)?([^()/]+)\)", put, body) if body and known else body)
            at = batch.schema.get_field_index("body")
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])], batch.schema.names[:-1])

    return rows.mapInArrow(run, documents.schema)


def docx_to_markdown(data: bytes) -> str:
    """Paragraphs with heading and list styles, tables, and formulas between dollar signs."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")

    def text(e: ElementTree.Element) -> str:
        if e.tag == f"{MATH}oMath":
            return f"${latex(e)}$"
        return (e.text or "") if e.tag == f"{w}t" else "".join(map(text, e))

    out = []
    for e in body if body is not None else ():
        if e.tag == f"{w}tbl":
            out.append(matrix_to_markdown([[text(c) for c in r.iter(f"{w}tc")] for r in e.iter(f"{w}tr")]))
        elif e.tag == f"{w}p" and text(e).strip():
            style = next((s.get(f"{w}val", "") for s in e.iter(f"{w}pStyle")), "")
            m = re.search(r"[Hh]eading\s*(\d)", style)
            out.append(("#" * min(int(m[1]), 5) + " " if m else "- " if re.search("List|Bullet", style) else "") + text(e).strip())
    return "\n\n".join(out)


def _parts(z: zipfile.ZipFile, index: str, tag: str) -> list[tuple[ElementTree.Element, str]]:
    """Elements ``tag`` of an Office index part in order, with the names of the parts they point to."""
    base = PurePosixPath(index).parent
    links = ElementTree.fromstring(z.read(f"{base}/_rels/{PurePosixPath(index).name}.rels"))
    where = {e.get("Id"): e.get("Target") for e in links}
    out = []
    for e in ElementTree.fromstring(z.read(index)).iter():
        if e.tag.rsplit("}", 1)[-1] == tag:
            target = where[next(v for k, v in e.attrib.items() if k.startswith("{") and k.endswith("}id"))]
            out.append((e, target.lstrip("/") if target.startswith("/") else f"{base}/{target}"))
    return out


def xlsx_to_markdown(data: bytes) -> str:
    """Each sheet as a heading and a table of its stored values; rows without a value are skipped."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{m}t"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")] if "xl/sharedStrings.xml" in z.namelist() else []

        def value(cell: ElementTree.Element) -> str | None:
            kind, v = cell.get("t", "n"), cell.findtext(f"{m}v")
            if kind == "inlineStr":
                return text(cell)
            if v is None:
                return None
            return {"s": lambda: shared[int(v)], "b": lambda: str(v == "1")}.get(kind, lambda: v)()

        out = []
        for sheet, part in _parts(z, "xl/workbook.xml", "sheet"):
            rows = []
            for row in ElementTree.fromstring(z.read(part)).iter(f"{m}row"):
                cells: dict[int, str | None] = {}
                for c in row.iter(f"{m}c"):
                    at = 0
                    for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(letter) - 64
                    cells[at - 1 if at else len(cells)] = value(c)
                if any(v is not None for v in cells.values()):
                    rows.append([cells.get(i) for i in range(max(cells) + 1)])
            out += [f"## Sheet: {sheet.get('name')}", matrix_to_markdown(rows)]
    return "\n\n".join(x for x in out if x)


def pptx_to_markdown(data: bytes) -> str:
    """Each slide as a heading with its title, its paragraphs as nested bullets, and its tables."""
    a, p = ("{http://schemas.openxmlformats.org/%s/2006/main}" % n for n in ("drawingml", "presentationml"))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{a}t")).strip()
    slides = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i, (_, part) in enumerate(_parts(z, "ppt/presentation.xml", "sldId"), 1):
            title, lines = "", []
            for shape in ElementTree.fromstring(z.read(part)).iter():
                if shape.tag == f"{a}tbl":
                    lines.append(matrix_to_markdown([[text(c) for c in r.iter(f"{a}tc")] for r in shape.iter(f"{a}tr")]))
                elif shape.tag == f"{p}sp":
                    kind = next((e.get("type", "") for e in shape.iter(f"{p}ph")), "")
                    if kind in ("title", "ctrTitle") and not title:
                        title = " ".join(filter(None, map(text, shape.iter(f"{a}p"))))
                        continue
                    for q in shape.iter(f"{a}p"):
                        if text(q):
                            style = q.find(f"{a}pPr")
                            lines.append("  " * int(style.get("lvl", 0) if style is not None else 0) + "- " + text(q))
            slides.append("\n".join([f"## Slide {i}" + (f": {title}" if title else ""), *([""] if lines else []), *lines]))
    return "\n\n".join(slides)


def convert(path: str, data: bytes) -> str:
    kind = path.rsplit(".", 1)[-1].lower()
    made = {"csv": csv_to_markdown, "html": lambda b: html_to_markdown(read_text(b)), "htm": lambda b: html_to_markdown(read_text(b)), "epub": epub_to_markdown, "docx": docx_to_markdown, "xlsx": xlsx_to_markdown, "pptx": pptx_to_markdown, "pdf": pdf_to_markdown}.get(kind, read_text)(data)
    made = made.encode("utf-8", "replace").decode("utf-8")
    return re.sub(r"(?m)^\|.*\|$", lambda m: re.sub(r" {2,}", " ", m[0]), made)


def to_markdown(files: DataFrame, describe: Callable[[bytes], str] | None = None, window: int = 4) -> DataFrame:
    """Adds ``body``, or ``error`` for a file that can't be converted: one file never fails the job.

    With ``describe``, images of EPUB files are described, ``window`` at once in a task, and the descriptions put at their places.
    """

    def one(path: str, data: bytes) -> tuple[str | None, str | None]:
        try:
            return convert(path, data), None
        except Exception as e:  # noqa: BLE001  any broken file ends up in the error column
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(path, data) for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            own = [c for c in batch.schema.names if c != "content"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array([x[i] for x in made], pa.string()) for i in (0, 1))], [*own, "body", "error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content")
    out = files.mapInArrow(run, f"{kept}, body string, error string")
    return with_descriptions(out, described(epub_images(files), describe, window)) if describe else out


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, body) of a table with a column ``html``; null pages are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [html_to_markdown(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(bodies, pa.string())], ["page_id", "body"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, body string")
