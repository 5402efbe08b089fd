"""Personal data by patterns and a linear-chain conditional random field.

Patterns find the base spans (e-mail and IP addresses, card and phone numbers). The
random field then reads the words around any digit, at sign, 'at' or 'dot', labels them by the
shapes of a word and its neighbours, and adds spans in forms that the patterns miss.
It is trained from a small labelled table, made by rule below; training (maximum
likelihood by forward-backward) and Viterbi decoding run in numpy over padded batches.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import NON_SPACE, slices, split_words, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Words read on each side of a word with a digit, an at sign, or 'at' or 'dot' spelled out.
REACH = 2
#: Words of the longest form of a span.
MOST_WORDS = 7
#: Words up to this length have their scores kept for the next time.
CACHED = 64

#: Words after which 'at' is a plain word: fixed values.
VERBS = ("am", "are", "arrive", "arrived", "be", "been", "is", "look", "looked", "looking", "looks", "meet", "meets", "met", "not", "run", "runs", "see", "start", "started", "starts", "stay", "stop", "was", "were", "work", "works")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: One address, spelled out or not, in any case: a name of one word, an at sign, and a domain of words with dots between.
_ADDRESS = re.compile(r"[\[(]?[A-Z0-9._%+-]*[A-Z0-9](\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+|@)[A-Z0-9-]+((\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)[A-Z0-9-]+)+[\])]?", re.IGNORECASE)
_QUAD = re.compile(r"[0-9]{1,3}([.-])[0-9]{1,3}(\1[0-9]{1,3}){2}")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, an at sign and a dotted domain, in linear time."""
    done = 0
    at = text.find("@")
    while at >= 0:
        low = max(done, at - 256)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start == low > done:  # a longer local part than usual
            start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans in order of kind and start; failing matches are dropped without retry."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def _shape(word: str) -> str:
    s = re.sub("[0-9]", "d", word)
    s = re.sub("[a-zß-\U0010ffff]+", "a", s)
    return re.sub("[A-ZÀ-Þ]+", "A", s)


def features(word: str) -> list[str]:
    """Shape features of one word."""
    core = word.strip(".,;:!?\"'<>[]{}|*#$%&_=")
    digits = sum(c in "0123456789" for c in core)
    shape = _shape(core)
    out = ["bias", f"shape={shape if len(shape) < 24 else 'wide'}", f"digits={min(digits, 17)}", f"short={re.sub('d+', 'D', shape)[:16]}"]
    if "@" in core:
        out.append("at" + (".a" if "." in core.split("@")[-1] else ""))
    if core.lower() in ("at", "dot"):
        out.append(f"word={core.lower()}")
    elif core.lower() in VERBS:
        out.append("verb")
    if core != word:
        out.append("marks")
    if re.search(r"[\[(]at[\])]", core, re.IGNORECASE):
        out.append("bracketed")
    if _QUAD.fullmatch(core):
        out.append("quad")
    return out


@dataclass
class Crf:
    """Weights of emissions by feature and of transitions; features missing here count nothing."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of a chain of words: own features and those of both neighbours."""
        out = np.zeros((len(words), len(LABELS)))
        for i, w in enumerate(words):
            three = self.cache.get(w)
            if three is None:
                f = features(w)
                three = np.zeros((3, len(LABELS)))
                for k, side in enumerate(("", "<", ">")):
                    for x in f:
                        if (j := self.index.get(side + x)) is not None:
                            three[k] += self.emit[j]
                if len(w) <= CACHED and len(self.cache) < 100_000:
                    self.cache[w] = three
            out[i] += three[0]
            if i + 1 < len(words):
                out[i + 1] += three[1]
            if i:
                out[i - 1] += three[2]
        return out

    def decode(self, chains: list[list[str]]) -> list[np.ndarray]:
        """Viterbi over all chains side by side."""
        if not chains:
            return []
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        size = np.array([len(chains[i]) for i in order])
        emit = np.zeros((len(chains), size[0], len(LABELS)))
        for row, i in enumerate(order):
            emit[row, : size[row]] = self.scores(chains[i])
        best = emit[:, 0].copy()
        back = np.zeros(emit.shape, np.int8)
        for t in range(1, size[0]):
            n = np.searchsorted(-size, -t, "left")  # chains longer than t
            way = best[:n, :, None] + self.move
            back[:n, t] = way.argmax(axis=1)
            best[:n] = way.max(axis=1) + emit[:n, t]
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(chains)
        for row, i in enumerate(order):
            path = np.zeros(size[row], np.int8)
            path[-1] = best[row].argmax()
            for t in range(size[row] - 1, 0, -1):
                path[t - 1] = back[row, t, path[t]]
            out[i] = path
        return out


def labelled_table(n: int = 500, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Short labelled chains: personal data in many forms, and numbers that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("aeinrstlo") for _ in range(r.randint(2, 8))) + r.choice(["", "", "", ",", "."])
    name = lambda: w().strip(",.")
    octets = lambda: [str(r.choice((r.randint(0, 9), r.randint(0, 255)))) for _ in range(4)]
    forms = {
        1: [lambda: [f"{name()}.{d(2)}@{name()}{d(1)}.{name()}.com"], lambda: [f"{name()}@{name()}.org"], lambda: [name(), "at", name(), "dot", "com"], lambda: [f"{name()}[at]{name()}.com"], lambda: [f"{name()}(at){name()}.net"]],
        2: [lambda: [".".join(octets())], lambda: ["-".join(octets())], lambda: ["[" + "].[".join(octets()) + "]"]],
        3: [lambda: [d(16)], lambda: [d(4), d(4), d(4), d(4)], lambda: ["-".join(d(4) for _ in range(4))], lambda: [".".join(d(4) for _ in range(4))], lambda: [d(4), d(6), d(5)], lambda: ["/".join(d(4) for _ in range(4))]],
        4: [lambda: ["+1", f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"{d(3)}-{d(3)}-{d(4)}"], lambda: [f"{d(3)}.{d(3)}.{d(4)}"], lambda: [f"+{d(2)}", d(3), d(3), d(4)], lambda: [f"({d(3)}){d(3)}-{d(4)}"], lambda: ["1", f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [d(3), d(3), d(4)]],
    }
    nothing = [lambda: [d(r.randint(1, 7))], lambda: [str(r.randint(1900, 2030))], lambda: [f"{d(4)}-{d(2)}-{d(2)}"], lambda: [f"{d(2)}/{d(2)}/{d(4)}"], lambda: [f"{d(2)}:{d(2)}"], lambda: [f"{d(1)}.{d(1)}.{d(1)}"], lambda: [f"{d(2)}.{d(2)}"], lambda: ["$" + d(3)], lambda: [d(1) + "," + d(3) + "," + d(3)], lambda: ["token", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'], lambda: [f"v{d(1)}.{d(1)}"], lambda: ["@" + name()], lambda: [name() + d(2)], lambda: [d(1), "x", d(2)], lambda: [d(3) + "%"], lambda: [f"{d(2)}-{d(2)}"], lambda: [d(r.randint(8, 30))], lambda: [f"{d(5)}-{d(4)}"], lambda: ["at", d(2)], lambda: [d(3), d(3), d(3)], lambda: [d(4), d(4)], lambda: [name(), "at", name()], lambda: [r.choice(VERBS), "at", name(), "dot", "com"], lambda: [r.choice(VERBS), "at", name() + ".", "dot", "com"], lambda: [f"{d(3)}-{d(2)}-{d(5)}-{d(1)}"], lambda: [f"https://{name()}.com/{d(4)}"]]
    out = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(r.randint(1, 3)):
            before = [w() for _ in range(r.randint(1, 3))]
            words += before
            labels += [0] * len(before)
            kind = r.choice((0, 0, 0, 1, 2, 3, 4))
            part = r.choice(forms[kind] if kind else nothing)()
            while kind and r.random() < 0.3:  # neighbours of one kind
                more = r.choice(forms[kind])()
                if len(part) == len(more) == 1 and r.random() < 0.5:
                    part = [part[0] + r.choice(",;/|") + more[0]]
                else:
                    part = [*part[:-1], part[-1] + r.choice(["", ",", ";"]), *more]
            if r.random() < 0.2:
                part[-1] += r.choice(".,;!")
            words += part
            labels += [kind] * len(part)
        words += [w()]
        labels += [0]
        out.append((words, labels))
    return out


def train(table: list[tuple[list[str], list[int]]], rounds: int = 60, rate: float = 0.2, penalty: float = 2e-4) -> Crf:
    """Maximum likelihood with a quadratic penalty, by Adam on the whole table."""
    index: dict[str, int] = {}
    length = np.array([len(x[0]) for x in table])
    top, n = length.max(), len(table)
    cells: list[tuple[int, int, int]] = []
    gold = np.zeros((n, top), np.int64)
    for row, (words, labels) in enumerate(table):
        gold[row, : len(labels)] = labels
        for i, x in enumerate(words):
            for f in features(x):
                for side, at in (("", i), ("<", i + 1), (">", i - 1)):
                    if 0 <= at < len(words):
                        cells.append((row, at, index.setdefault(side + f, len(index))))
    row, at, which = np.array(cells).T
    spot = row * top + at
    k = len(LABELS)
    inside = np.arange(top) < length[:, None]
    emit, move = np.zeros((len(index), k)), np.zeros((k, k))
    seen_emit = np.zeros_like(emit)
    np.add.at(seen_emit, (which, gold.ravel()[spot]), 1)
    seen_move = np.zeros_like(move)
    both = inside[:, 1:]
    np.add.at(seen_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    state = [np.zeros_like(x) for x in (emit, emit, move, move)]
    for step in range(1, rounds + 1):
        score = np.zeros((n * top, k))
        np.add.at(score, spot, emit[which])
        score = score.reshape(n, top, k)
        lse = lambda x, axis: np.log(np.exp(x - (m := x.max(axis=axis, keepdims=True))).sum(axis=axis)) + m.squeeze(axis)
        fore, aft = np.zeros_like(score), np.zeros_like(score)
        fore[:, 0] = score[:, 0]
        for t in range(1, top):
            fore[:, t] = np.where(inside[:, t, None], lse(fore[:, t - 1, :, None] + move, 1) + score[:, t], fore[:, t - 1])
        for t in range(top - 2, -1, -1):
            aft[:, t] = np.where(inside[:, t + 1, None], lse(move + (score[:, t + 1] + aft[:, t + 1])[:, None, :], 2), 0)
        total = lse(fore[np.arange(n), length - 1], 1)
        node = np.exp(fore + aft - total[:, None, None]) * inside[..., None]
        want_emit = np.zeros_like(emit)
        np.add.at(want_emit, which, node.reshape(-1, k)[spot])
        edge = np.exp(fore[:, :-1, :, None] + move + (score[:, 1:] + aft[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[..., None, None]
        for i, (x, g) in enumerate(((emit, want_emit - seen_emit), (move, edge.sum(axis=(0, 1)) - seen_move))):
            g = g / n + penalty * x
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * g
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * g * g
            x -= rate * (state[2 * i] / (1 - 0.9**step)) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**step)) + 1e-8)
    return Crf(index, emit, move)


@functools.cache
def trained() -> Crf:
    """The random field of the built-in table, trained once in a process."""
    return train(labelled_table())


def _plausible(kind: str, text: str) -> bool:
    """Whether a span that the random field labels has what its kind needs."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and not re.search("[A-Za-z/]", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and not re.search("[A-Za-z]", text) and luhn(digits)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]|\s", text)
    return bool(_ADDRESS.fullmatch(text))


def _trimmed(whole: str, a: int, b: int) -> tuple[int, int]:
    """A span without the marks around it."""
    while a < b and not (whole[a].isalnum() or whole[a] in "+(["):
        a += 1
    while b > a and not (whole[b - 1].isalnum() or whole[b - 1] in "])"):
        b -= 1
    return a, b


def _parts(kind: str, whole: str, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in a run of words of one label: what stands side by side is told apart by what its kind needs.

    Of all ways to cut the run into plausible spans of at most ``MOST_WORDS`` words, and words left
    out, the one that covers most words, then the one with most spans. A word by itself may hold
    several, between commas, semicolons, bars and slashes.
    """
    def single(i: int, j: int) -> list[tuple[int, int]]:
        a, b = _trimmed(whole, edges[i][0], edges[j - 1][1])
        return [(a, b)] if a < b and _plausible(kind, whole[a:b]) else []

    def inside(i: int) -> list[tuple[int, int]]:
        cut = [_trimmed(whole, edges[i][0] + m.start(), edges[i][0] + m.end()) for m in re.finditer(r"[^,;|/]+", whole[edges[i][0] : edges[i][1]])]
        return [(a, b) for a, b in cut if a < b and _plausible(kind, whole[a:b])]

    best: list[tuple[int, int, int, list[tuple[int, int]]]] = [(0, 0, 0, [])]  # of the first k words: covered ones, spans, where the last step began, its spans
    for k in range(1, len(edges) + 1):
        ways = [(*best[k - 1][:2], k - 1, [])]
        ways += [(best[i][0] + k - i, best[i][1] + 1, i, own) for i in range(max(0, k - MOST_WORDS), k) if (own := single(i, k))]
        if own := inside(k - 1):
            ways.append((best[k - 1][0] + 1, best[k - 1][1] + len(own), k - 1, own))
        best.append(max(ways, key=lambda x: x[:2]))
    out, k = [], len(edges)
    while k:
        out += best[k][3]
        k = best[k][2]
    return out


def _spelled(data: np.ndarray) -> np.ndarray:
    """Where 'at' or 'dot' starts, in any case, with no letter, digit or byte of a longer character beside it."""
    low = data | np.uint8(0x20)
    part = (low - np.uint8(0x61) < 26) | (data - np.uint8(0x30) < 10) | (data >= 0x80)
    out = np.zeros(len(data), bool)
    for name in (b"at", b"dot"):
        n = len(data) - len(name) + 1
        if n < 1:
            continue
        hit = np.logical_and.reduce([low[k : n + k] == c for k, c in enumerate(name)])
        out[:n] |= hit & ~np.r_[False, part[: n - 1]] & ~np.r_[part[len(name) :], False]
    return out


def _kernel(part: pa.RecordBatch, crf: Crf, reach: int | None = REACH) -> list[list[tuple[str, int, int, bool]]]:
    """For each text its spans (kind, start, end, base), in order of kind and start.

    Words beyond ``reach`` of a mark aren't decoded, since no form has such words; None decodes all.
    """
    data, offsets = texts_of(part.column("text"))
    out: list[list[tuple[str, int, int, bool]]] = [[] for _ in range(part.num_rows)]
    mark = (data - np.uint8(0x30) < 10) | (data == 0x40) | _spelled(data)
    some = (np.diff(np.r_[0, np.cumsum(mark)][offsets]) > 0) | (reach is None)
    if not some.any():
        return out
    words = split_words(part.column("text"), NON_SPACE)
    sums = np.r_[0, np.cumsum(mark)]
    hot = np.flatnonzero(sums[words.end] > sums[words.start])
    text = words.text
    near = np.full(len(words.start) + 1, reach is None)
    for k in range(-(reach or 0), (reach or 0) + 1):
        at = hot + k
        ok = (at >= 0) & (at < len(text))
        ok[ok] = text[at[ok]] == text[hot[ok]]
        near[at[ok]] = True
    chosen = np.flatnonzero(near[:-1])
    cut = np.flatnonzero(np.r_[True, (np.diff(chosen) > 1) | (np.diff(text[chosen]) > 0), True])
    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    raw = data.tobytes()
    chains, owner = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        chains.append([raw[words.start[i] : words.end[i]].decode() for i in chosen[a:b]])
        owner.append(chosen[a:b])
    found: dict[int, list[tuple[str, list[tuple[int, int]]]]] = {}
    for chain, at, path in zip(chains, owner, crf.decode(chains), strict=True):
        i = 0
        while i < len(path):
            j = i
            while j + 1 < len(path) and path[j + 1] == path[i]:
                j += 1
            if path[i]:
                doc, own = int(text[at[i]]), at[i : j + 1]
                edges = [(int(point[words.start[w]] - point[offsets[doc]]), int(point[words.end[w]] - point[offsets[doc]])) for w in own]
                found.setdefault(doc, []).append((LABELS[path[i]], edges))
            i = j + 1
    for i in np.flatnonzero(some):
        whole = raw[offsets[i] : offsets[i + 1]].decode()
        spans = [(*x, True) for x in base_spans(whole)]
        taken = [(a, b) for _, a, b, _ in spans]
        for kind, edges in found.get(int(i), ()):
            for a, b in _parts(kind, whole, edges):
                if not any(a < y and x < b for x, y in taken):
                    spans.append((kind, a, b, False))
        out[i] = sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return out


def _digest(spans: list[tuple[str, int, int, bool]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def find_personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text", crf: Crf | None = None) -> DataFrame:
    """Spans of personal data in each text, judged whole; one row for each row, no shuffle.

    Counts are those of the base spans. Null and empty texts have none; null keys and
    repeated rows each give their row; an empty table gives none; other columns are not
    read. Spans are in code points, the end exclusive. Returns key, n_email, n_ip,
    n_card, n_phone, base_sha256, spans (all spans as kind:start:end), redacted (the text
    with every span replaced by its kind in angle brackets; overlaps merge).
    """
    model = docs.sparkSession.sparkContext.broadcast(crf or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans = _kernel(part, model.value)
                base = [[s for s in x if s[3]] for x in spans]
                counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
                digest = [hashlib.sha256(_digest(x).encode()).hexdigest() for x in base]
                texts = part.column("text").to_pylist() if any(spans) else None
                redacted = pa.array([_redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string()) if texts else part.column("text").cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("key"), *counts, pa.array(digest), pa.array([_digest(x) for x in spans]), redacted], ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, redacted string")
    return out.withColumnRenamed("key", key)


def _redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
