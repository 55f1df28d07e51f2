"""Column functions over page text: tokens, contents-line shape, page numbers, headings.

Java's ``(?U)`` makes ``\\s`` and ``\\d`` Unicode-aware, as the semantics ask; the
oracles use plain ASCII inputs, where every dialect agrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and headings that decide results.
TOKEN = "[a-zäöüß]{3,}"
TOC_LINE = r"(?U)^(?<title>.{3,120}?)[.\s]{2,}(?<page>\d{1,4}|[ivxlcdm]{1,6}|[IVXLCDM]{1,6})\s*$"
SEPARATOR_RUN = r"(?U)[.\s]{2,}"
URL_OR_DOI = r"(?i)doi\.org|https?://|www\."
IMPRINT = r"(?Ui)^\s*[©@]\s*\d{4}\b|^\s*isbn\b|^\s*gedruckt\b|^\s*printed in\b"
KEYWORDS: dict[str, list[str]] = {
    "en": ["contents", "table of contents"],
    "de": ["inhalt", "inhaltsverzeichnis"],
    "fr": ["sommaire", "table des matières"],
    "it": ["indice", "sommario"],
    "es": ["índice", "tabla de contenidos", "contenido"],
    "nl": ["inhoud", "inhoudsopgave"],
}
ROMAN_MAX = 50
OPENING_LINES = 5

TEXT_FEATURES = ["toc_line_ratio", "digit_density", "monotonic_page_numbers", "keyword_hit_any_language", "keyword_hit_same_language"]


def roman(n: int) -> str:
    """Canonical lower-case numeral of 1 to 50."""
    tens, ones = divmod(n, 10)
    small = {4: "iv", 9: "ix"}.get(ones) or "v" * (ones >= 5) + "i" * (ones % 5)
    return {4: "xl", 5: "l"}.get(tens, "x" * tens) + small


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_text(text: Column) -> Column:
    """Some character that isn't white space; a null text has none."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def token_set(text: Column) -> Column:
    """Distinct lower-case words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def ochiai(a: Column, b: Column) -> Column:
    """Shared tokens over the geometric mean of both sizes; 0.0 if either is empty."""
    size = F.size(a).cast("double") * F.size(b)
    return F.when(size > 0, F.size(F.array_intersect(a, b)) / F.sqrt(size)).otherwise(F.lit(0.0))


def lines(text: Column) -> Column:
    """Non-blank lines of a text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\R|[\x1c-\x1e]"), has_text)


def excluded_line(line: Column) -> Column:
    return ~has_text(line) | line.rlike(URL_OR_DOI) | line.rlike(IMPRINT)


def is_toc_line(line: Column) -> Column:
    return ~excluded_line(line) & strip(line).rlike(TOC_LINE)


def is_toc_candidate(line: Column) -> Column:
    return ~excluded_line(line) & strip(line).rlike(SEPARATOR_RUN)


def toc_title(line: Column) -> Column:
    return F.when(is_toc_line(line), F.regexp_extract(strip(line), TOC_LINE, 1))


def toc_page(line: Column) -> Column:
    """The page token of a contents line, else null."""
    return F.when(is_toc_line(line), F.regexp_extract(strip(line), TOC_LINE, 2))


def page_number(token: Column) -> Column:
    """A decimal number, or a canonical roman numeral up to 50, else null."""
    numerals = F.create_map(*[F.lit(x) for n in range(1, ROMAN_MAX + 1) for x in (roman(n), n)])
    return F.coalesce(F.when(token.rlike(r"^\d+$"), token.try_cast("int")), F.try_element_at(numerals, F.lower(token)))


def toc_line_ratio(line_array: Column) -> Column:
    """Contents lines over lines that have a separator run; 0.0 without any."""
    seen = F.size(F.filter(line_array, is_toc_candidate))
    return F.when(seen > 0, F.size(F.filter(line_array, is_toc_line)) / seen).otherwise(F.lit(0.0))


def page_numbers(line_array: Column) -> Column:
    return F.array_compact(F.transform(line_array, lambda x: page_number(toc_page(x))))


def increasing(numbers: Column) -> Column:
    """1.0 for at least two, strictly increasing numbers, else 0.0."""
    later = F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0)))
    up = F.forall(F.zip_with(F.slice(numbers, 1, F.size(later)), later, lambda a, b: b > a), lambda x: x)
    return F.when(F.size(numbers) >= 2, up.cast("double")).otherwise(F.lit(0.0))


def digit_density(text: Column) -> Column:
    """Digits over all characters; 0.0 for no text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^\p{Nd}]", "")) / n).otherwise(F.lit(0.0))


def opening(line_array: Column) -> Column:
    return F.lower(F.array_join(F.slice(line_array, 1, OPENING_LINES), " "))


def keyword_hit(opening_text: Column, keywords: list[str]) -> Column:
    """1.0 if any keyword stands in the opening, also inside a word."""
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(opening_text, F.lit(word.lower()))
    return F.coalesce(hit.cast("double"), F.lit(0.0))


def same_language_hit(opening_text: Column, language: Column, keywords: dict[str, list[str]]) -> Column:
    out = F.lit(0.0)
    for code, words in keywords.items():
        out = F.when(language == code, keyword_hit(opening_text, words)).otherwise(out)
    return out


def heading_phrase(text: Column, max_words: int = 4) -> Column:
    """The first non-blank line, stripped and lower-cased, if it is short; else null."""
    first = F.lower(strip(F.get(lines(text), F.lit(0))))
    return F.when(F.size(F.split(first, r"(?U)\s+")) <= max_words, first)
