"""Many headings at once: an automaton over mined keyword files, gone through a page once.

The plan is the same for ten keywords and for a hundred thousand: one Arrow expression a
block of keywords, where a chain of ``contains`` would grow by one each. A block's words
are broadcast; blocks are cut by size, so that is bounded, and each worker makes a block's
automaton once.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from leafmark.workers import find_us

#: Characters of keywords in a block.
BLOCK_CHARS = 4_000_000
_MADE: dict[str, tuple[ahocorasick.Automaton | None, set[str]]] = {}


def blocks_of(keywords: dict[str, list[str]], most: int = BLOCK_CHARS) -> list[list[tuple[str, list[str]]]]:
    """(word, languages) lists, each of at most ``most`` characters (or one word)."""
    languages: dict[str, list[str]] = {}
    for language, words in keywords.items():
        for word in dict.fromkeys(w.lower() for w in words):
            languages.setdefault(word, []).append(language)
    out: list[list[tuple[str, list[str]]]] = [[]]
    size = 0
    for word, of in sorted(languages.items()):
        size += len(word) + sum(map(len, of))
        if size > most and out[-1]:
            out.append([])
            size = len(word) + sum(map(len, of))
        out[-1].append((word, of))
    return out


def automaton(key: str, words: bytes) -> tuple[ahocorasick.Automaton | None, set[str]]:
    """A block's automaton, whose entries are the languages of a word, and the languages that
    the empty word, which stands everywhere, belongs to."""
    if key not in _MADE:
        while len(_MADE) >= 8:
            _MADE.pop(next(iter(_MADE)))
        made, always, some = ahocorasick.Automaton(), set(), False
        for word, languages in json.loads(words):
            if word:
                made.add_word(word, frozenset(languages))
                some = True
            else:
                always |= set(languages)
        if some:
            made.make_automaton()
        _MADE[key] = (made if some else None), always
    return _MADE[key]


def languages_in(opening: str, language: str | None, made: ahocorasick.Automaton | None, always: set[str]) -> tuple[bool, bool]:
    """Whether any keyword stands in the opening, and whether one of the page's language does."""
    any_, same = bool(always), language in always
    if made is not None:
        for _, languages in made.iter(opening):
            any_, same = True, same or language in languages
            if same or language is None:
                break
    return any_, same


@lru_cache(8)
def _packed(told: str) -> tuple[str, bytes]:
    raw = told.encode()
    return hashlib.sha256(raw).hexdigest(), raw


def _hits(shared):
    @F.pandas_udf("struct<any_language:double,same_language:double>")
    def hits(text: pd.Series, of: pd.Series) -> pd.DataFrame:
        made, always = automaton(*shared.value)
        rows = [languages_in(t, None if pd.isna(x) else x, made, always) if isinstance(t, str) else (False, False) for t, x in zip(text, of, strict=True)]
        return pd.DataFrame(rows, columns=["any_language", "same_language"], dtype=float)

    return hits


def keyword_hits(spark: SparkSession, opening: Column, language: Column, keywords: dict[str, list[str]], most: int = BLOCK_CHARS) -> Column:
    """struct of ``any_language`` and ``same_language``: 1.0 if a keyword (of the page's
    language) stands in the opening, also inside a word, else 0.0, as for a null opening."""
    find_us(spark)
    found = []
    for block in blocks_of(keywords, most):
        shared = spark.sparkContext.broadcast(_packed(json.dumps(block)))
        found.append(_hits(shared)(opening, language))
    if len(found) == 1:
        return found[0]
    return F.struct(*[F.greatest(*[h[c] for h in found]).alias(c) for c in ("any_language", "same_language")])
