"""Driver-side parsers of requests: integer ranges, targets, directives, match expressions, command batches."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, replace
from typing import Any

from lodestone.functions.text import STOP_WORDS

SCHEME = "lode://"


def int_ranges(spec: str | int | None) -> list[int] | None:
    """``"22,40, 25-27"`` as a sorted list without repeats; None for anything else."""
    if isinstance(spec, int):
        return [spec]
    parts = [p.strip() for p in (spec or "").split(",") if p.strip()]
    out: set[int] = set()
    for part in parts:
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            return None
        a, b = int(m[1]), int(m[2] or m[1])
        out.update(range(min(a, b), max(a, b) + 1))
    return sorted(out) or None


@dataclass(frozen=True)
class Target:
    collection: str | None = None
    path: str | None = None
    seq: list[int] | None = None
    row_ids: list[int] | None = None


def target(spec: str | int | None, default: str | None = None) -> Target:
    """``scheme://collection/path:seqs``, ``collection:path:seqs``, ``path:seqs`` or row numbers."""
    if isinstance(spec, int):
        return Target(default, row_ids=[spec])
    text = html.unescape((spec or "").strip()).strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        text = html.unescape(text[1:-1]).strip()
    if not text:
        return Target(default)
    if re.fullmatch(r"[0-9,\-\s]+", text) and (rows := int_ranges(text)):
        return Target(default, row_ids=rows)
    seq = None
    scheme = re.match(r"[a-z]{2,}://", text)
    body = text[scheme.end() :] if scheme else text
    if not re.match(r"[A-Za-z]:[\\/]", body) and ":" in body:
        head, _, tail = body.rpartition(":")
        if (seq := int_ranges(tail)) is not None:
            body = head
    collection = default
    if scheme:
        first, slash, rest = body.partition("/")
        if slash:
            collection, body = first or default, rest
    elif not re.match(r"[A-Za-z]:[\\/]", body) and ":" in body:
        first, _, body = body.partition(":")
        collection = first or default
    return Target(collection, body, seq)


_QUOTED = r"""(?:"([^"]+)"|'([^']+)'|(\S+))"""
_SWITCH = {"on": True, "true": True, "exclude": True, "off": False, "false": False}
# Names of directives and of the result's entries, in order of extraction.
_TEXTS = {"title": "title|t", "path": "path|file|p", "collection": "col|in|c", "lex": "lex|fts|l"}
_SWITCHES = {"redact_pii": "pii", "exclude_seen": "seen", "rerank": "rerank|rr", "regex": "regex", "case_sensitive": "case"}
_FLAGS = {"--redact-pii": ("redact_pii", True), "--no-pii": ("redact_pii", False), "--exclude-seen": ("exclude_seen", True)}


def directives(query: str) -> tuple[str, dict[str, Any]]:
    """Takes inline directives out of a query. A directive begins at a word's begin, so ``http://`` is none."""
    found: dict[str, Any] = {}
    text = query or ""

    def take(pattern: str) -> str | None:
        nonlocal text
        m = re.search(rf"(?<!\S){pattern}", text, re.I)
        if not m:
            return None
        text = f"{text[: m.start()]} {text[m.end() :]}"
        return next((g for g in m.groups() if g), m[0])

    for name, keys in _TEXTS.items():
        if (value := take(rf"(?:{keys}):{_QUOTED}")) is not None:
            found[name] = value
    if (value := take(r"(?:limit|n):(\d+)")) is not None:
        found["limit"] = int(value)
    for name, keys in _SWITCHES.items():
        if (value := take(rf"""(?:{keys}):["']?(on|off|true|false|exclude)["']?""")) is not None:
            found[name] = _SWITCH[value.lower()]
    for flag, (name, value) in _FLAGS.items():
        if take(re.escape(flag)) is not None:
            found.setdefault(name, value)
    return re.sub(r"\s+", " ", text).strip(), found


def is_expression(query: str) -> bool:
    return '"' in query or any(f" {op} " in query for op in ("AND", "OR", "NOT"))


def all_terms(query: str) -> list[str]:
    """The words of a plain query without stop words, or all if nothing else is left."""
    found = query.replace('"', "").split()
    return [w for w in found if w.lower() not in STOP_WORDS] or found


def any_terms(query: str) -> list[str]:
    """The words of the relaxed query; none if fewer than two."""
    found = [w for w in re.sub(r"[^\w\s]", " ", query.lower()).split() if w not in STOP_WORDS and len(w) > 1]
    return found if len(found) > 1 else []


# Operators of a compiled expression, in postfix order; other numbers are leaves.
AND, OR, NOT = -1, -2, -3
#: Tokens between the parts of a NEAR group, where the query names no number.
NEAR_TOKENS = 10

_LEXEMES = re.compile(r"""\s*(?:"((?:[^"]|"")*)"|([(){}:^*+,\-])|([^\W]+))""")


def words(text: str) -> list[str]:
    """The tokens of a text as the index has them: lower-case runs of letters and digits."""
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split()


@dataclass(frozen=True)
class Leaf:
    """A phrase: its tokens, whether the last is a word's beginning, in which columns (None: any),
    whether it must begin a column, and the NEAR group (its number and distance) that it is in."""

    tokens: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] | None = None
    first: bool = False
    near: tuple[int, int] | None = None


@dataclass(frozen=True)
class Expression:
    leaves: tuple[Leaf, ...]
    program: tuple[int, ...]


class _Reader:
    """Recursive descent: NOT binds before AND before OR, words side by side before all of them."""

    def __init__(self, query: str):
        self.parts: list[tuple[str, str]] = []
        at, end = 0, len(query.rstrip())
        while at < end:
            m = _LEXEMES.match(query, at)
            if not m:
                raise ValueError(f"unexpected {query[at:].strip()[:1]!r} in the expression")
            quoted, sign, bare = m.groups()
            self.parts.append(("text", quoted.replace('""', '"')) if quoted is not None else ("sign", sign) if sign else ("word", bare))
            at = m.end()
        self.at, self.leaves, self.groups = 0, [], 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.parts[self.at + ahead] if self.at + ahead < len(self.parts) else ("end", "")

    def take(self, *wanted: tuple[str, str]) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(("sign", sign)):
            raise ValueError(f"expected {sign!r} in the expression")

    def whole(self) -> list[int]:
        out = self.chain("OR", OR, lambda: self.chain("AND", AND, lambda: self.chain("NOT", NOT, self.beside)))
        if self.peek()[0] != "end":
            raise ValueError(f"unexpected {self.peek()[1]!r} in the expression")
        return out

    def chain(self, name: str, op: int, below: Any) -> list[int]:
        out = below()
        while self.take(("word", name)):
            out = out + below() + [op]
        return out

    def beside(self) -> list[int]:
        out = self.primary()
        while self.peek()[0] in ("text", "word") and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek() in (("sign", "("), ("sign", "^"), ("sign", "{")):
            out = out + self.primary() + [AND]
        return out

    def primary(self, columns: tuple[str, ...] | None = None) -> list[int]:
        if self.take(("sign", "(")):
            start = len(self.leaves)
            out = self.chain("OR", OR, lambda: self.chain("AND", AND, lambda: self.chain("NOT", NOT, self.beside)))
            self.need(")")
            if columns is not None:
                self.leaves[start:] = [x if x.columns else replace(x, columns=columns) for x in self.leaves[start:]]
            return out
        if self.take(("sign", "{")):
            names = []
            while self.peek()[0] == "word":
                names.append(self.peek()[1])
                self.at += 1
            self.need("}")
            self.need(":")
            return self.primary(tuple(names))
        if self.peek()[0] == "word" and self.peek(1) == ("sign", ":"):
            name = self.peek()[1]
            self.at += 2
            return self.primary((name,))
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            return self.near(columns)
        first = self.take(("sign", "^"))
        return [self.leaf(columns, first)]

    def leaf(self, columns: tuple[str, ...] | None, first: bool = False, near: tuple[int, int] | None = None) -> int:
        kind, value = self.peek()
        if kind not in ("text", "word") or kind == "word" and value in ("AND", "OR", "NOT"):
            raise ValueError("the expression lacks a term")
        self.at += 1
        found = words(value)
        while self.take(("sign", "+")):
            found += words(self.peek()[1]) if self.peek()[0] in ("text", "word") else []
            self.at += 1
        prefix = self.take(("sign", "*"))
        self.leaves.append(Leaf(tuple(found), prefix and bool(found), columns, first, near))
        return len(self.leaves) - 1

    def near(self, columns: tuple[str, ...] | None) -> list[int]:
        self.at += 2
        self.groups += 1
        start, out, distance = len(self.leaves), [], NEAR_TOKENS
        while self.peek()[0] in ("text", "word"):
            out += [self.leaf(columns)] + ([AND] if out else [])
        if self.take(("sign", ",")):
            distance = int(self.peek()[1]) if self.peek()[1].isdigit() else -1
            self.at += 1
        self.need(")")
        if not out or distance < 0:
            raise ValueError("a NEAR group needs terms, and a number after the comma")
        self.leaves[start:] = [replace(x, near=(self.groups, distance)) for x in self.leaves[start:]]
        return out


def expression(query: str) -> Expression:
    """Compiles an expression of phrases, ``*``, ``^``, columns, NEAR, AND, OR, NOT and parentheses.

    Phrases without tokens hold nothing and are left out. Raises ValueError if it can't be read.
    """
    reader = _Reader(query)
    if not reader.parts:
        raise ValueError("the expression has no terms")
    program = reader.whole()
    stack: list[list[int]] = []
    for x in program:
        if x >= 0:
            stack.append([x] if reader.leaves[x].tokens else [])
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a + b + [x] if a and b else (a or b if x != NOT else a))
    return Expression(tuple(reader.leaves), tuple(stack[0]))


def compiled(query: str) -> Expression:
    """What a query asks of the index: an expression as it is, or all of its words but stop words.

    An expression that can't be read is taken as one phrase.
    """
    if not is_expression(query):
        query = " AND ".join(f'"{t}"' for t in all_terms(query))
        return expression(query) if query else Expression((), ())
    try:
        return expression(query)
    except ValueError:
        bare = words(query)
        return Expression((Leaf(tuple(bare)),), (0,)) if bare else Expression((), ())


def relaxed(query: str) -> Expression:
    """Any of the words, for queries that otherwise find too little."""
    return expression(" OR ".join(f'"{t}"' for t in any_terms(query))) if any_terms(query) else Expression((), ())


def tiers(primary: list[str], secondary: list[str], query: str) -> list[str]:
    """Match expressions from strict to loose, for entity and other terms."""
    clean = lambda ts: [f'"{c}"' for t in ts if (c := re.sub(r"[\"':?*^~]", "", t).strip())]
    p, s = clean(primary), clean(secondary)
    if p:
        return [" AND ".join(p + s)] + ([" AND ".join(p)] if s else [])
    if s:
        return [" AND ".join(s)] + ([" OR ".join(s)] if len(s) > 1 else [])
    return [query]


def expansions(answer: str) -> list[tuple[str, str]]:
    """(kind, text) of a model's answer: lines that begin with ``lex:``, ``vec:`` or ``hyde:``, once each, white space made one space."""
    found = re.findall(r"(?m)^\s*(lex|vec|hyde):(.*)$", answer)
    return list(dict.fromkeys((k, " ".join(t.split())) for k, t in found if t.strip()))


def batch_commands(text: str, program: str = "lodestone", most: int = 5) -> list[str]:
    """Commands in free text: think blocks dropped; tags, list marks and back-ticks taken off."""
    text = re.sub(r"(?s)<think>.*?</think>", "", text)
    out = []
    for line in re.sub(r"</?[A-Za-z_]+>", "\n", text).splitlines():
        line = re.sub(r"^\s*(?:[-*]|\d+[.)])\s+", "", line).strip().strip("`").strip()
        if line.startswith(program + " ") and line not in out:
            out.append(line)
    return out[:most]


def lexical_terms(query: str) -> set[str]:
    """What to highlight for a query: its quoted phrases and its words but stop words and single letters."""
    clean = lambda t: t.strip("\"'()[]{}").strip()
    whole = clean(query or "")
    quoted = re.findall(r'"([^"]+)"', whole)
    found = [*([whole] if " " in whole else []), *quoted, *re.findall(r"\b\w+\b", re.sub(r'"[^"]+"', " ", whole))]
    return {c for t in found if len(c := clean(t)) > 1 and c.lower() not in (*STOP_WORDS, "near")}


# Nouns too general to search by.
GENERIC = (
    "feeling", "feelings", "feel", "feels", "felt", "thing", "things", "way", "ways", "reason", "reasons", "idea", "ideas",
    "problem", "problems", "type", "types", "kind", "kinds", "stuff", "part", "parts", "something", "anything", "nothing",
    "everything", "example", "examples", "fact", "facts", "info", "information", "question", "questions", "answer", "answers",
    "detail", "details", "issue", "issues", "item", "items", "result", "results", "case", "cases", "time", "times",
)


@dataclass(frozen=True)
class Word:
    """A word as a language model reads it: its part of speech, whether it is of an entity, and of which noun phrase (None: none)."""

    text: str
    kind: str
    lemma: str = ""
    entity: int | None = None
    phrase: int | None = None
    stop: bool = False


_CONTENT = ("NOUN", "PROPN", "ADJ", "VERB", "NUM")


def tiered_terms(reading: list[Word] | None) -> tuple[list[str], list[str]]:
    """Entities, and noun phrases and content words outside them, of a query that a model has read.

    Without a model there are none. Phrases keep their meaningful words; words that are too
    general count only if nothing else is left.
    """
    reading = reading or []
    general = lambda w: w.text.lower() in GENERIC or w.lemma.lower() in GENERIC
    usable = lambda w: not w.stop and len(w.text.strip()) > 1 and w.kind in _CONTENT
    groups: dict[int, list[Word]] = {}
    for w in reading:
        if w.entity is not None:
            groups.setdefault(w.entity, []).append(w)
    entities = [" ".join(w.text for w in g) for g in groups.values()]
    phrases: dict[int, list[Word]] = {}
    for w in reading:
        if w.phrase is not None:
            phrases.setdefault(w.phrase, []).append(w)
    whole = {p: " ".join(w.text for w in g if usable(w) and not general(w)) for p, g in phrases.items() if all(w.entity is None for w in g)}
    whole = {p: t for p, t in whole.items() if t}
    alone = [w for w in reading if w.entity is None and w.phrase not in whole]
    words_ = [w.text.strip() for w in alone if usable(w) and not general(w)]
    if not whole and not words_:
        words_ = [w.text.strip() for w in alone if usable(w)]
    return list(dict.fromkeys(entities)), list(dict.fromkeys([*whole.values(), *words_]))
