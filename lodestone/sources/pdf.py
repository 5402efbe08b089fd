"""Text of PDF files as Markdown, with the standard library only.

Reads compressed and object streams, text operators, and the character maps of fonts.
Lines set clearly larger than the most common size become headings, the largest first.
Encrypted files and scanned pages have no text here and are an error.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: How much larger than the common size a heading is set, and how many levels there are.
LARGER, LEVELS = 1.15, 4


class _File:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF file")
        if b"/Encrypt" in data:
            raise ValueError("encrypted PDF file")
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                inner, first = self.stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
                numbers = list(map(int, inner[:first].split()))
                spots = [*numbers[1::2], len(inner) - first]
                for n, a, b in zip(numbers[::2], spots, spots[1:], strict=False):
                    self.objects.setdefault(n, inner[first + a : first + b])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    def refs(self, body: bytes, name: bytes) -> list[int]:
        """Numbers of the objects that an entry names, one or an array."""
        m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in _REF.findall(m[1])] if m else []

    def pages(self) -> list[bytes]:
        """Pages in the order of the page tree."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out: list[bytes] = []

        def walk(n: int, resources: bytes, depth: int = 0) -> None:
            body = self.objects.get(n, b"")
            own = body if b"/Resources" in body else body + resources
            kids = self.refs(body, b"Kids")
            if kids and depth < 50:
                for k in kids:
                    walk(k, own, depth + 1)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(own)

        for n in self.refs(root, b"Pages"):
            walk(n, b"")
        return out

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str] | None]:
        """Character maps by font name; None for a font of single bytes without one."""
        area = page + b"".join(self.objects.get(n, b"") for n in self.refs(page, b"Resources"))
        area += b"".join(self.objects.get(n, b"") for n in self.refs(area, b"Font"))
        out: dict[bytes, dict[int, str] | None] = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", area):
            font = self.objects.get(int(n), b"")
            if re.search(rb"/Type\s*/Font\b", font):
                maps = self.refs(font, b"ToUnicode")
                out[name] = _character_map(self.stream(self.objects.get(maps[0], b""))) if maps else None
        return out


def _character_map(data: bytes) -> dict[int, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {-1: "2" if re.search(rb"begincodespacerange\s*<[0-9A-Fa-f]{4}>", data) else "1"}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            first = text(c)
            out |= {int(a, 16) + i: first[:-1] + chr(ord(first[-1]) + i) for i in range(int(b, 16) - int(a, 16) + 1)}
    return out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    one = lambda m: b"" if m[1] in (b"\n", b"\r\n") else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _shown(raw: bytes, font: dict[int, str] | None) -> str:
    if font is None:
        return raw.decode("cp1252", "replace")
    width = int(font[-1])
    return "".join(font.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def _lines(content: bytes, fonts: dict[bytes, dict[int, str] | None]) -> list[tuple[float, str]]:
    """(size, text) of the lines of a page, in the order they are set."""
    out: list[list] = []
    font, size, scale, fresh, stack = None, 12.0, 1.0, True, []
    for token in _TOKEN.findall(content):
        if not re.fullmatch(rb"[A-Za-z'\"*]+", token):
            stack.append(token)
            continue
        numbers = [float(x) for x in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", x)]
        if token == b"Tf" and len(stack) >= 2:
            font, size = fonts.get(stack[-2][1:]), numbers[-1] if numbers else size
        elif token == b"Tm" and len(numbers) >= 6:
            scale, fresh = abs(numbers[3]) or 1.0, True
        elif token in (b"Td", b"TD") and len(numbers) >= 2:
            fresh = fresh or abs(numbers[-1]) > 0.1
        elif token in (b"T*", b"BT"):
            fresh = True
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            fresh = fresh or token in (b"'", b'"')
            parts = []
            for x in stack:
                if x[:1] in b"(<":
                    parts.append(_shown(_string(x), font))
                elif token == b"TJ" and re.fullmatch(rb"[-+]?\d*\.?\d+", x) and float(x) < -200:
                    parts.append(" ")
            if fresh or not out:
                out.append([size * scale, ""])
                fresh = False
            out[-1][1] += "".join(parts)
        stack = []
    return [(round(s, 1), re.sub(r"\s+", " ", t).strip()) for s, t in out if t.strip()]


def pdf_to_markdown(data: bytes) -> str:
    """Paragraph lines and headings of all pages."""
    file = _File(data)
    lines: list[tuple[float, str]] = []
    for page in file.pages():
        content = b"\n".join(file.stream(file.objects.get(n, b"")) for n in file.refs(page, b"Contents"))
        lines += _lines(content, file.fonts(page))
    if not lines:
        raise ValueError("the PDF file has no text")
    common = Counter()
    for size, text in lines:
        common[size] += len(text)
    body = common.most_common(1)[0][0]
    larger = sorted({s for s, _ in lines if s > body * LARGER}, reverse=True)
    level = {s: min(i, LEVELS) for i, s in enumerate(larger, 1)}
    out: list[str] = []
    for size, text in lines:
        if size in level:
            out += ["", f"{'#' * level[size]} {text}", ""]
        else:
            out.append(text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
