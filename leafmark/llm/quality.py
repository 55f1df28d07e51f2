"""Line-first quality rules, wholly in DataFrame expressions.

Each line is judged by a punctuation, a navigation and a boilerplate rule; failing
lines are removed, and a document that loses too much of its text is rejected.

Defined results: a null text has no words and fails the base rule; an empty or
blank text likewise; very long texts are read whole; a share of just the least one, or
of repeated words of just one half, passes; repeated rows are judged alike, each on its
own; an empty table gives no rows; extra columns are ignored by :func:`judge` and kept
by :func:`clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import FENCE, documents, fenced, words_of

# The rules' patterns, in a dialect that Java and RE2 share.
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
SENTENCE_END = "[.!?…][\"')\\]”’»]*([ \\t\\r]|$)"
SHOUT = r"[!?#*$%&|<>]{2,}"
SEPARATOR = r"[|>»›•·]([ \t\r]|$)"
MENU = r"(?i)(^|[^a-z])(home|menu|log ?in|sign ?in|sign ?up|next page|previous page|back to top|skip to content|click here|read more|share this)([^a-z]|$)"
BOILERPLATE = r"(?i)(all rights reserved|cookie policy|uses cookies|privacy policy|terms of use|terms of service|enable javascript|lorem ipsum|subscribe to our newsletter)"

MIN_WORDS = 50
#: Characters of a line for each doubled mark or separator that it may hold.
MARK_CHARS = 30
MENU_CHARS = 50
BOILERPLATE_CHARS = 120
MIN_KEPT_SHARE = 0.5

#: Positions that fit beside a hash in one long; longer texts sort pairs instead.
_PLACE_BITS = 15


def line_passes(line: Column) -> Column:
    """True for a line that all three rules accept. A line without a word passes."""
    chars = F.length(line)
    punctuation = line.rlike(SENTENCE_END) & (F.regexp_count(line, F.lit(SHOUT)) * MARK_CHARS <= chars)
    navigation = (F.regexp_count(line, F.lit(SEPARATOR)) * MARK_CHARS > chars) | ((chars <= MENU_CHARS) & line.rlike(MENU))
    boilerplate = (chars <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE)
    return (punctuation & ~navigation & ~boilerplate) | ~line.rlike(WORD)


def _same_window(w: Column, i: Column, j: Column) -> Column:
    return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))


def _window_hash(w: Column, i: Column) -> Column:
    return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def _repeats(df: DataFrame) -> DataFrame:
    """Add ``repeat``: words of ``words`` in 3-word windows found twice or more.

    Windows of one document are sorted by hash, with their place in the low bits
    of the same long (a primitive sort), and those of equal hash compared
    word for word. Nothing leaves the row. Each step is a projection of its own:
    inside a lambda Spark would interpret the sort.
    """
    w, n = F.col("words"), F.size("words")
    places = F.sequence(F.lit(0), n - 3)
    low = (1 << _PLACE_BITS) - 1
    fits = (n >= 4) & (n <= low)
    none = F.array().cast("array<bigint>")
    packed = F.when(fits, F.sort_array(F.transform(places, lambda i: F.shiftleft(_window_hash(w, i), _PLACE_BITS).bitwiseOR(i.cast("long"))))).otherwise(none)
    pairs = F.when(n > low, F.array_sort(F.transform(places, lambda i: F.struct(_window_hash(w, i).alias("h"), i.alias("i")))))
    df = df.withColumns({"packed": packed, "pairs": pairs})
    p, s = F.col("packed"), F.col("pairs")

    # Another window of a run of equal hashes is next to it, as a rule; where a neighbour
    # has the hash but not the words, the whole run is looked through.
    def found_in(items: Column, x: Column, k: Column, same_hash, same_words) -> Column:
        beside = [F.get(items, k + 1), F.get(items, k - 1)]
        alike = F.lit(False)
        clash = F.lit(False)
        for y in beside:
            alike = alike | F.coalesce(same_hash(x, y) & same_words(x, y), F.lit(False))
            clash = clash | F.coalesce(same_hash(x, y) & ~same_words(x, y), F.lit(False))
        return alike | (clash & F.exists(items, lambda y: same_hash(x, y) & ~(x == y) & same_words(x, y)))

    at = lambda x: x.bitwiseAND(low).cast("int")
    short = F.transform(
        F.filter(p, lambda x, k: found_in(p, x, k, lambda a, b: F.shiftright(a, _PLACE_BITS) == F.shiftright(b, _PLACE_BITS), lambda a, b: _same_window(w, at(a), at(b)))), at
    )
    long_ = F.transform(F.filter(s, lambda x, k: found_in(s, x, k, lambda a, b: a["h"] == b["h"], lambda a, b: _same_window(w, a["i"], b["i"]))), lambda x: x["i"])
    df = df.withColumn("places", F.sort_array(F.when(s.isNull(), short).otherwise(long_))).drop("packed", "pairs")
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    return df.withColumn("repeat", F.aggregate("places", start, step)["n"]).drop("places")


def _measure(df: DataFrame) -> DataFrame:
    """Add words, lines, the lines that pass, and all counts, to rows with ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumns({"words": words_of(text), "lines": F.split(text, "\n")})
    df = _repeats(df).withColumns({"worded": F.filter("lines", lambda x: x.rlike(WORD)), "passed": F.filter("lines", line_passes)})
    chars = lambda c: F.length(F.array_join(c, ""))
    return df.withColumns(
        {
            "n": F.size("words"),
            "chars": chars("words"),
            "dup": F.size("worded") - F.size(F.array_distinct("worded")),
            "line_chars": chars("worded"),
            "passed_chars": chars(F.filter("passed", lambda x: x.rlike(WORD))),
        }
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """One row per document: base counts, base_failed, share kept and kept."""
    m = _measure(documents(docs, id_col, text_col))
    return m.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.col("chars").cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.col("dup").cast("long").alias("n_dup_lines"),
        F.col("repeat").cast("long").alias("n_repeat_words"),
        _base_failed().alias("base_failed"),
        F.coalesce(F.col("passed_chars") / F.nullif(F.col("line_chars"), F.lit(0)), F.lit(0.0)).alias("kept_share"),
        (~_base_failed() & (F.col("passed_chars") >= F.col("line_chars") * min_kept_share)).alias("kept"),
    )


def _base_failed() -> Column:
    return (F.col("n") < MIN_WORDS) | (F.col("repeat").cast("long") * 100 > F.col("n").cast("long") * 50)


def clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """The documents that pass, failing lines removed; other columns as they were.

    ``chars_col``, where the table has it, is set to the new length.
    """
    names = docs.columns
    m = _measure(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")))
    kept = fenced(m).filter(~_base_failed() & (F.col("passed_chars") >= F.col("line_chars") * min_kept_share) & (F.col(FENCE) >= 0))
    left = F.array_join("passed", "\n")
    fresh = {text_col: left, chars_col: F.length(left).cast("long")}
    return kept.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])
