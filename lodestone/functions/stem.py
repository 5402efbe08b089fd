"""English stems by Porter's algorithm (1980) with its later amendments, and folding of diacritics.

Stems are computed once for each distinct word of a batch.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the algorithm: endings and what takes their place, by step.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _form(word: str) -> str:
    """The word's letters as c (consonant) and v (vowel)."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _form(stem).count("vc")


def _short_end(stem: str) -> bool:
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    for ending, other in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + other if _measure(stem) >= least else word
    return word


@functools.lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and others than ASCII, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending):
                stem = word[: -len(ending)]
                if "v" in _form(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz" and _form(word)[-1] == "c":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short_end(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2, 1), _STEP3, 1)
    for ending in sorted(_STEP4, key=lambda e: -len(e)):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            if _measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def fold(word: str) -> str:
    """The word without diacritics."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def fold_words(words: list[str]) -> list[str]:
    return [porter(fold(w)) for w in words]


def stemmed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the words of ``column`` (arrays of words, or arrays of such) folded and stemmed."""

    def deep(values: pa.Array) -> pa.Array:
        if pa.types.is_list(values.type):
            values = values if not values.offset else pa.concat_arrays([values])
            return pa.ListArray.from_arrays(values.offsets, deep(values.values))
        code = values.dictionary_encode()
        return pa.array(fold_words(code.dictionary.to_pylist()), pa.string()).take(code.indices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            columns = [deep(x) if k == i else x for k, x in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, kinds)


