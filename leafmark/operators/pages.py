"""Page tables: numbering, head and tail scans, runs, blank fill, book context.

A page table has ``book`` and ``page_index`` (from 0). A book is bounded (hundreds
of pages), so windows over one book are too; numbering rows of arbitrary groups
(:func:`number_rows`) makes no such assumption.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.functions.geometry import PAGE_FEATURES
from leafmark.functions.keywords import keyword_hits

CONTEXT_FEATURES = ["line_count_rel", "font_size_max_ratio_book", "edge_distance"]


def number_rows(df: DataFrame, group: str, order: str, name: str, ranges: int = 256, total: str | None = None) -> DataFrame:
    """Add ``name``: 0, 1, ... by ``order`` (a number) within ``group``; and ``total``,
    the rows of the group, if it is named.

    Groups may be of any size: rows are ranked in ranges of ``order`` (quantiles of
    the table), and shifted by the counts of earlier ranges of their group.
    """
    ends = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], ranges * 20)).first()[0]
    ends = sorted(set(ends or []))
    bounds = F.lit(ends).cast("array<bigint>") if ends else F.array().cast("array<bigint>")
    part = F.size(F.filter(bounds, lambda b: b < F.col(order)))
    df = df.withColumn("__part", part)
    sizes = df.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(group)
    earlier = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(earlier, F.lit(0)).alias("__earlier"), F.sum("__n").over(whole).alias("__total"))
    rank = F.row_number().over(Window.partitionBy(group, "__part").orderBy(order)) - 1
    joined = df.withColumn("__rank", rank).join(sizes, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    made = {name: (F.col("__earlier") + F.col("__rank")).cast("int")} | ({total: F.col("__total").cast("int")} if total else {})
    return joined.withColumns(made).drop("__part", "__rank", "__g", "__p", "__earlier", "__total")


def page_counts(pages: DataFrame) -> DataFrame:
    """(book, total_pages)."""
    return pages.groupBy("book").agg((F.max("page_index") + 1).alias("total_pages"))


def books_with_text(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(book, has_text): whether some page has a character that isn't white space."""
    return pages.groupBy("book").agg(F.bool_or(T.has_text(F.col(text_col))).alias("has_text"))


def wanted(total: Column, index: Column, head: int | None, tail: int | None) -> Column:
    """Whether a head and tail scan reads a page. Both None: every page; one None: none of it."""
    if head is None and tail is None:
        return F.lit(True)
    return (index < (head or 0)) | (index >= total - (tail or 0))


def scan_head_tail(pages: DataFrame, head: int | None, tail: int | None) -> DataFrame:
    """Pages of the first ``head`` and last ``tail``; ``pages`` has total_pages."""
    return pages.filter(wanted(F.col("total_pages"), F.col("page_index"), head, tail))


def with_runs(pages: DataFrame) -> DataFrame:
    """Add run_start: the first page of the unbroken run that a page is in."""
    order = Window.partitionBy("book").orderBy("page_index")
    island = F.col("page_index") - F.row_number().over(order)
    return pages.withColumn("__island", island).withColumn("run_start", F.min("page_index").over(Window.partitionBy("book", "__island"))).drop("__island")


def runs(pages: DataFrame) -> DataFrame:
    """(book, run_start, run_end) of each unbroken run."""
    return with_runs(pages).groupBy("book", "run_start").agg(F.max("page_index").alias("run_end"))


def fill_blank(pages: DataFrame, books: DataFrame, head: int | None = None, tail: int | None = None) -> DataFrame:
    """Every wanted page of ``books`` (book, total_pages): those missing have zero
    features and no text."""
    index = F.explode(F.when(F.col("total_pages") > 0, F.sequence(F.lit(0), F.col("total_pages") - 1)).otherwise(F.array().cast("array<int>")))
    every = books.select("book", "total_pages", index.alias("page_index")).filter(wanted(F.col("total_pages"), F.col("page_index"), head, tail))
    joined = every.join(pages.drop("total_pages"), ["book", "page_index"], "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in [*PAGE_FEATURES, "max_font_size", "modal_font_size"] if c in pages.columns}
    return joined.withColumns(zero | ({"text": F.coalesce("text", F.lit(""))} if "text" in pages.columns else {}))


def book_context(pages: DataFrame) -> DataFrame:
    """Add the context features; medians are over the non-empty pages that ``pages`` holds.

    Medians come of counts of equal values, which are combined before the shuffle, and are
    joined back: no task gathers a book's rows.
    """
    full = F.col("line_count") > 0
    medians = pages.groupBy(F.col("book").alias("__book")).agg(
        F.percentile(F.when(full, F.col("line_count")), 0.5).alias("__lines"), F.percentile(F.when(full & (F.col("modal_font_size") > 0), F.col("modal_font_size")), 0.5).alias("__body")
    )
    lines = F.when(F.coalesce("__lines", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("__lines"))
    body = F.coalesce("__body", F.lit(0.0))
    font = F.when((body > 0) & (F.col("max_font_size") > 0), F.col("max_font_size") / body).otherwise(F.lit(1.0))
    edge = F.least(F.col("page_index"), F.col("total_pages") - 1 - F.col("page_index")).cast("double")
    joined = pages.join(medians, F.col("book").eqNullSafe(F.col("__book")))
    return joined.withColumns({"line_count_rel": F.col("line_count") / lines, "font_size_max_ratio_book": font, "edge_distance": edge}).drop("__book", "__lines", "__body")


#: Keywords from which on an automaton looks for all at once.
MANY_KEYWORDS = 64


def text_features(pages: DataFrame, keywords: dict[str, list[str]] | None = T.KEYWORDS, text_col: str = "text", language_col: str | None = "language") -> DataFrame:
    """Add the five text features; ``keywords=None`` turns both keyword hits to 0.0. A few
    keywords are a chain of expressions; many (mined ones) an automaton, so the plan doesn't grow."""
    pages = pages.withColumn("__lines", T.lines(F.col(text_col)))
    ln, words = F.col("__lines"), [w for group in (keywords or {}).values() for w in group]
    head = T.opening(ln)
    language = F.col(language_col) if language_col else F.lit(None).cast("string")
    if len(words) > MANY_KEYWORDS:
        pages = pages.withColumn("__hits", keyword_hits(pages.sparkSession, head, language, keywords))
        hit, same = F.col("__hits.any_language"), F.col("__hits.same_language")
    else:
        hit, same = T.keyword_hit(head, words), T.same_language_hit(head, language, keywords or {})
    return pages.withColumns(
        {
            "toc_line_ratio": T.toc_line_ratio(ln),
            "digit_density": T.digit_density(F.col(text_col)),
            "monotonic_page_numbers": T.increasing(T.page_numbers(ln)),
            "keyword_hit_any_language": hit,
            "keyword_hit_same_language": same,
        }
    ).drop("__lines", "__hits")
