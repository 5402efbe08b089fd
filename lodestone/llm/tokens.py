"""Token counts by finite-state transducers compiled from a byte-level BPE file.

Two deterministic machines run in cascade:

* The *splitter* reads character classes and writes piece boundaries. It has
  twelve states; every transition is annotated with what it emits (a boundary
  here, or one character back). A long text is cut into chunks; the map of a
  chunk sends each possible entry state to its exit state. These maps compose
  associatively, so a parallel prefix scan (log2 of the number of chunks steps)
  gives the entry state of each chunk, and all chunks emit side by side.
* The *merger* reads the bytes of a piece and writes how the number of tokens
  changes with each byte. Its states hold, for each suffix of what was read
  that can begin a token, the last token before that suffix and the relative
  count; the greedy merges are reproduced because a sequence of tokens is the
  encoding of a text exactly when each neighbouring pair is the encoding of its
  own concatenation. States are made when first reached, and kept in one table.
  A long piece is cut into chunks as well: the map of a chunk sends each state that
  it is likely entered in to its exit state and its count. The likely states are
  those that the bytes before the chunk lead to from a few places; these maps
  compose by the same scan. An entry that a chunk has no map for is added.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import slices, texts_of

#: Characters in a chunk of the splitter.
CHUNK = 1024
#: Text bytes whose pieces run side by side.
STEP_BYTES = 2 << 20
#: States of the merger's table at most; beyond it only those in use are kept.
MAX_STATES = 300_000
#: Bytes in a chunk of the merger, and places before it that likely entry states are found from.
PIECE_CHUNK, STARTS = 1024, 8
#: Rounds in which missing entries of all chunks are added; after them only those in the way are.
ROUNDS = 6

# Character classes of the splitter.
_LETTER, _STMD, _R, _V, _L, _E, _NUMBER, _BLANK, _SPACE, _QUOTE, _OTHER, _SPECIAL = range(12)
# States: between pieces, in letters, numbers, others, a run of one white space (blank or
# not), of several (the last a blank or not), after a quote, after a quote and r, v or l.
_NONE, _LETTERS, _NUMBERS, _OTHERS, _ONE_B, _ONE_S, _RUN_B, _RUN_S, _Q, _QR, _QV, _QL = range(12)
_HERE, _BACK = 1, 2
# In the merger, for a token: none yet, and no token can begin here.
_EMPTY, _CLOSED = -1, -2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission, by state and class, for the pieces of
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    letters = {_LETTER, _STMD, _R, _V, _L, _E}
    fresh = {c: _LETTERS for c in letters} | {_NUMBER: _NUMBERS, _BLANK: _ONE_B, _SPACE: _ONE_S, _QUOTE: _Q, _OTHER: _OTHERS, _SPECIAL: _NONE}
    joined = {c: _LETTERS for c in letters} | {_NUMBER: _NUMBERS, _QUOTE: _OTHERS, _OTHER: _OTHERS}
    go, say = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    for s in range(12):
        for c in range(12):
            to, out = fresh[c], _HERE
            if (s == _LETTERS and c in letters) or (s == _NUMBERS and c == _NUMBER) or (s in (_OTHERS, _Q) and c in (_QUOTE, _OTHER)):
                to, out = joined[c], 0
            elif s in (_ONE_B, _ONE_S, _RUN_B, _RUN_S) and c in (_BLANK, _SPACE):
                to, out = (_RUN_B if c == _BLANK else _RUN_S), 0
            elif s == _ONE_B and c != _SPECIAL:
                to, out = joined[c], 0
            elif s == _RUN_B and c != _SPECIAL:
                to, out = joined[c], _BACK
            elif s == _RUN_S and c != _SPECIAL:
                out = _HERE | _BACK
            elif s == _Q and c == _STMD:
                to, out = _NONE, 0
            elif s == _Q and c in (_R, _V, _L):
                to, out = {_R: _QR, _V: _QV, _L: _QL}[c], 0
            elif (s in (_QR, _QV) and c == _E) or (s == _QL and c == _L):
                to, out = _NONE, 0
            elif s in (_QR, _QV, _QL):
                to, out = (_LETTERS, _BACK) if c in letters else (to, _HERE | _BACK)
            go[s, c], say[s, c] = to, out
    return go, say


_GO, _SAY = _splitter()


def _class_table() -> np.ndarray:
    import regex

    table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for pattern, c in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = c
    for chars, c in (("stmd", _STMD), ("r", _R), ("v", _V), ("l", _L), ("e", _E), (" ", _BLANK), ("'", _QUOTE)):
        table[[ord(x) for x in chars]] = c
    return table


def _byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable
    Latin-1 stands for itself, the rest are numbered from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Counts as the library for this file gives them, without added begin or end tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without prefix space and normaliser can be compiled")
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Tokens by number: the 256 bytes, then one for each merge, in order of rank.
        self.tokens = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joins: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(pairs, 256):
            left, right = raw(a), raw(b)
            if left + right in self.tokens:
                raise ValueError("a token with two merges can't be compiled")
            self.tokens[left + right] = i
            self.halves.append((self.tokens[left], self.tokens[right]))
            self.joins[self.halves[-1]] = i
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.longest = max(map(len, self.tokens))
        self.fits: dict[tuple[int, int], bool] = {}
        self.specials = sorted((t["content"].encode() for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.classes = _class_table()
        self._reset()

    # -- the merger ------------------------------------------------------------------

    def _reset(self) -> None:
        self.slot = np.full(256, -1, np.int32)
        self.width = 128
        self.alphabet = 0
        self.table = np.full(1024 * self.width, -1, np.int32)
        #: For each state: its suffix, and (last token before it, relative count) by position, packed.
        self.info: list[tuple[bytes, bytes]] = [(b"", array("i", [_EMPTY, 0]).tobytes())]
        self.number = {self.info[0]: 0}

    def _compact(self, *states: np.ndarray) -> None:
        """Keeps the states of these arrays only, and renumbers them in place."""
        live = np.unique(np.concatenate([np.zeros(1, np.int32), *states]))
        self.info = [self.info[i] for i in live]
        self.number = {x: i for i, x in enumerate(self.info)}
        self.table = np.full(max(1024, 2 * len(live)) * self.width, -1, np.int32)
        self.fits.clear()
        for x in states:
            x[:] = np.searchsorted(live, x)

    def _may_follow(self, a: int, b: int) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            found = self.fits[a, b] = self._fit(a, b)
        return found

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b may follow token a in an encoding.

        Both are taken apart in the reverse order of their merges; at each stage the
        pair that touches must not have a merge that would have come first.
        """
        limit = 1 << 30
        while True:
            if self.joins.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def _step(self, state: int, byte: int) -> int:
        """Makes the transition: next state * 256 + change of the count + 128.

        A state has the longest suffix that can begin a token, and for each of its
        positions (unless no token can begin there) the last token before it and the
        count there minus the count now.
        """
        suffix, packed = self.info[state]
        places = array("i", packed)
        grown = suffix + bytes([byte])
        n = len(grown)
        last, count = _EMPTY, 0
        for i in range(n):  # longest token first
            before = places[2 * i]
            if before == _CLOSED or (token := self.tokens.get(grown[i:])) is None:
                continue
            if before == _EMPTY or self._may_follow(before, token):
                last, count = token, places[2 * i + 1] + 1
                break
        keep, after = n, array("i")
        for i in range(n):
            if grown[i:] in self.prefixes:
                keep = min(keep, i)
                after.extend((places[2 * i], places[2 * i + 1] - count))
            elif keep < n:
                after.extend((_CLOSED, 0))
        after.extend((last, 0))
        key = (grown[keep:], after.tobytes())
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.info)
            self.info.append(key)
            if (to + 1) * self.width > len(self.table):
                self.table = np.r_[self.table, np.full(len(self.table), -1, np.int32)]
        return (to << 8) + count + 128

    def _learn(self, states: np.ndarray, values: np.ndarray) -> None:
        """Fills the missing transitions of these states on these bytes."""
        for key in np.unique(states.astype(np.int64) * 256 + values):
            s, b = int(key) >> 8, int(key) & 255
            if self.slot[b] < 0:
                if self.alphabet == self.width:
                    self.table = np.c_[self.table.reshape(-1, self.width), np.full((len(self.table) // self.width, self.width), -1, np.int32)].ravel()
                    self.width *= 2
                self.slot[b] = self.alphabet
                self.alphabet += 1
            to = self._step(s, b)
            self.table[s * self.width + self.slot[b]] = to

    def count_pieces(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each byte range, all ranges side by side."""
        out = np.zeros(len(start), np.int64)
        chunk = max(PIECE_CHUNK, 4 * self.longest)
        long = length > 2 * chunk
        out[~long] = self._run(data, start[~long], length[~long], np.zeros((~long).sum(), np.int32))[0]
        if long.any():
            out[long] = self._count_long(data, start[long], length[long], chunk)
        return out

    def _run(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray, *held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each byte range, read from the given states, and the states after it.

        ``held`` are further states that the caller needs afterwards.
        """
        order = np.argsort(-length, kind="stable")
        start, lens, state = start[order], length[order], state[order]
        total = np.zeros(len(start), np.int32)
        active = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), "right")
        for t, n in enumerate(active):
            value = data[start[:n] + t]
            slot = self.slot[value]
            got = np.where(slot < 0, -1, self.table[state[:n] * self.width + slot])
            if (miss := got < 0).any():
                if len(self.info) > MAX_STATES:
                    self._compact(state, *held)
                    miss = np.ones(n, bool)
                self._learn(state[:n][miss], value[miss])
                got = self.table[state[:n] * self.width + self.slot[value]]
            total[:n] += (got & 255) - 128
            state[:n] = got >> 8
        out, after = np.empty_like(total), np.empty_like(state)
        out[order], after[order] = total, state
        return out, after

    def _count_long(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, chunk: int) -> np.ndarray:
        """Tokens of ranges of several chunks: chunk maps of (state, count), composed by a prefix scan."""
        chunks = -(-length // chunk)
        piece = np.repeat(np.arange(len(start)), chunks)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = start[piece] + within * chunk
        size = np.minimum(chunk, start[piece] + length[piece] - begin)
        later, before = np.flatnonzero(within > 0), self.longest + np.arange(STARTS)
        _, found = self._run(data, (begin[later, None] - before).ravel(), np.tile(before, len(later)), np.zeros(len(later) * STARTS, np.int32))
        entry = np.full((len(piece), STARTS), -1, np.int32)  # by chunk, the states that it has a map for; -1 for none
        entry[within == 0, 0] = 0
        found = np.sort(found.reshape(-1, STARTS), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        entry[later] = found
        leave, count = np.full_like(entry, -1), np.zeros_like(entry)
        fresh = entry >= 0
        for turn in range(ROUNDS + len(piece)):
            row, column = np.nonzero(fresh)
            flat = entry[row, column]
            kept = [x[x >= 0] for x in (entry, leave)]
            count[row, column], after = self._run(data, begin[row], size[row], flat, *kept)
            entry[entry >= 0], leave[leave >= 0] = kept
            leave[row, column] = after
            # where each map leads: to which map of the next chunk, or to none (the last number)
            none = entry.shape[1]
            go = np.full((len(piece), none + 1), none)
            same = (leave[:-1, :, None] == entry[1:, None, :]) & (leave[:-1, :, None] >= 0)
            go[:-1, :none] = np.where(same.any(axis=2), same.argmax(axis=2), none)
            scan, step = go.copy(), 1
            while step < chunks.max():  # after each step, twice as many chunks up to here
                ready = np.flatnonzero(within >= step)
                scan[ready] = np.take_along_axis(scan[ready], scan[ready - step], axis=1)
                step *= 2
            at = np.r_[0, scan[:-1, 0]]
            at[within == 0] = 0
            lost = at == none
            if not lost.any():
                return np.bincount(piece, weights=count[np.arange(len(piece)), at], minlength=len(start)).astype(np.int64)
            if turn < ROUNDS:  # every exit that has no map yet
                row, column = np.nonzero((leave[:-1] >= 0) & (go[:-1, :none] == none) & (within[1:] > 0)[:, None])
            else:
                row = np.flatnonzero(lost[1:] & ~lost[:-1])
                column = at[row]
            wanted = np.unique(np.c_[row + 1, leave[row, column]], axis=0)
            place = np.arange(len(wanted)) - np.searchsorted(wanted[:, 0], wanted[:, 0])
            wide = none + int(place.max()) + 1
            entry, leave, count = (np.pad(x, ((0, 0), (0, wide - none)), constant_values=v) for x, v in ((entry, -1), (leave, -1), (count, 0)))
            fresh = np.zeros(entry.shape, bool)
            fresh[wanted[:, 0], none + place] = True
            entry[wanted[:, 0], none + place] = wanted[:, 1]
        raise AssertionError("a chunk is mended in each turn")

    # -- the splitter ----------------------------------------------------------------

    def _chars(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte position and class of each character."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        code = data[at].astype(np.int32)
        more = np.flatnonzero(code >= 0xC0)
        if len(more):
            b = np.r_[data, np.zeros(3, np.uint8)].astype(np.int32)
            c, p = code[more], at[more]
            b1, b2, b3 = b[p + 1] & 63, b[p + 2] & 63, b[p + 3] & 63
            code[more] = np.where(c < 0xE0, (c & 31) << 6 | b1, np.where(c < 0xF0, (c & 15) << 12 | b1 << 6 | b2, (c & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        return at, self.classes[code]

    def _mark_specials(self, data: np.ndarray, offsets: np.ndarray, at: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One character of class special for each added token's string, leftmost and longest first."""
        whole = data.tobytes()
        found = [s for s in self.specials if s in whole]
        if not found:
            return at, cls
        keep = np.ones(len(at), bool)
        cls = cls.copy()
        pattern = re.compile(b"|".join(map(re.escape, found)))
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            for m in pattern.finditer(whole, a, b):
                i, j = np.searchsorted(at, m.span())
                cls[i] = _SPECIAL
                keep[i + 1 : j] = False
        return at[keep], cls[keep]

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, tokens) of each text."""
        data, offsets = texts_of(column)
        sizes, tokens = np.diff(offsets), np.zeros(len(offsets) - 1, np.int64)
        if not len(data):
            return sizes, tokens
        at, cls = self._mark_specials(data, offsets, *self._chars(data))
        first = np.searchsorted(at, offsets)  # characters of each text
        chars = np.diff(first)
        chunks = -(-chars // CHUNK)
        text = np.repeat(np.arange(len(chars)), chunks)
        within = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = first[text] + within * CHUNK
        length = np.minimum(CHUNK, first[text + 1] - begin)
        entry = self._entry_states(cls, begin, length, within, chunks, text)
        marks, final = self._emit(cls, begin, length, entry)
        ends = first[1:][chars > 0]
        last = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
        pending = np.isin(final[last], (_QR, _QV, _QL))
        marks[ends[pending] - 1] = True
        cut = np.flatnonzero(marks)  # first character of each piece
        owner = np.searchsorted(first, cut, "right") - 1
        from_ = at[cut]
        to = np.r_[from_[1:], offsets[-1]]
        to = np.minimum(to, offsets[owner + 1])
        special = cls[cut] == _SPECIAL
        pieces = self.count_pieces(data, from_, np.where(special, 0, to - from_)) + special
        return sizes, np.bincount(owner, weights=pieces, minlength=len(tokens)).astype(np.int64)

    def _entry_states(self, cls: np.ndarray, begin: np.ndarray, length: np.ndarray, within: np.ndarray, chunks: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The state before each chunk: chunk maps composed by a prefix scan within each text."""
        entry = np.zeros(len(begin), np.uint8)
        longer = np.flatnonzero(chunks[text] > 1)
        if not len(longer):
            return entry
        inner = longer[within[longer] < chunks[text[longer]] - 1]  # full chunks with a successor
        maps = np.tile(np.arange(12, dtype=np.uint8), (len(inner), 1))
        open_, one = np.arange(len(inner)), np.zeros(0, np.int64)
        for t in range(CHUNK):
            if t % 64 == 32:  # where all entries have met, one state stands for the twelve
                met = (maps[open_] == maps[open_, :1]).all(axis=1)
                one, open_ = np.r_[one, open_[met]], open_[~met]
            maps[open_] = _GO[maps[open_], cls[begin[inner[open_]] + t][:, None]]
            maps[one, 0] = _GO[maps[one, 0], cls[begin[inner[one]] + t]]
        maps[one] = maps[one, :1]
        # inclusive scan by doubling: after step d, maps[i] covers 2d chunks up to i
        rank, step = within[inner], 1
        while step <= (rank.max() if len(rank) else 0):
            ready = np.flatnonzero(rank >= step)
            maps[ready] = np.take_along_axis(maps[ready], maps[ready - step], axis=1)
            step *= 2
        entry[inner + 1] = maps[:, _NONE]
        return entry

    def _emit(self, cls: np.ndarray, begin: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = np.zeros(len(cls) + 1, bool)
        order = np.argsort(-length, kind="stable")
        at, lens, state = begin[order], length[order], entry[order]
        active = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), "right")
        for t, n in enumerate(active):
            here = at[:n] + t
            c = cls[here]
            out = _SAY[state[:n], c]
            marks[here[(out & _HERE) > 0]] = True
            marks[here[(out & _BACK) > 0] - 1] = True
            state[:n] = _GO[state[:n], c]
        final = np.empty_like(state)
        final[order] = state
        return marks[:-1], final


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The machine for a file, compiled once in each worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer_path: str, *, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """Counts the tokens of every text; one row for each row of ``docs``, no shuffle.

    Null and empty texts have no bytes and no tokens; texts of any length are counted
    whole; repeated rows and null keys each give their row; an empty table gives none;
    other columns are not read. Returns key, n_bytes, n_tokens, over_limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                sizes, tokens = machine.count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
