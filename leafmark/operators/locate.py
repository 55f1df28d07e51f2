"""Scoring pages against a reference, and choosing page ranges, as table operators.

Windows are made by sending each page to the windows it is in, and chosen by
aggregates that combine before the shuffle: no task gathers a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.functions.ranges import MAX_WINDOW, MIN_WINDOW, SUM_DIGITS, TOP_K, non_overlapping
from leafmark.storage import hold


def reference_vocabulary(reference_pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(book, vocabulary): distinct tokens of all of a book's reference pages."""
    token = reference_pages.select("book", F.explode(T.token_set(F.col(text_col))).alias("token")).distinct()
    return token.groupBy("book").agg(F.array_sort(F.collect_list("token")).alias("vocabulary"))


def score_pages(pages: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """(book, page_index, score): Ochiai overlap with the book's vocabulary. Books
    without a usable reference are absent."""
    tokens = pages.select("book", "page_index", T.token_set(F.col(text_col)).alias("tokens"))
    return tokens.join(vocabulary, "book").select("book", "page_index", T.ochiai(F.col("tokens"), F.col("vocabulary")).alias("score"))


def fixed_window(scores: DataFrame, size: Column | int) -> DataFrame:
    """(book, start, end, top_score, runner_up_score, margin): the window of ``size``
    pages with the best mean, and the best one apart from it. Books whose scores
    are all zero have no row. ``size`` is clamped to the book's pages; the first of
    equal windows wins. Pages are numbered 0, 1, ... without gaps.

    Means are made once. At most 2w - 2 other windows touch the best one, so each book's
    best 2w hold the runner-up: they are kept by a rank, which for one ``size`` of all
    books is cut before the shuffle.
    """
    most = 2 * size if isinstance(size, int) else 2 * F.col("w")
    size = F.lit(size) if isinstance(size, int) else size
    books = scores.groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.min(size).alias("asked")).filter("best > 0")
    books = books.select("book", "n", F.greatest(F.lit(1), F.least(F.col("asked"), F.col("n"))).cast("int").alias("w"))
    first, last = F.greatest(F.lit(0), F.col("page_index") - F.col("w") + 1), F.least(F.col("page_index"), F.col("n") - F.col("w")).cast("int")
    each = scores.select("book", "page_index", "score").join(books, "book").select("book", "w", "page_index", "score", F.explode(F.sequence(first, last)).alias("start"))
    means = each.groupBy("book", "w", "start").agg(F.round(F.sum("score") / F.col("w"), SUM_DIGITS).alias("mean"))
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("mean"), "start"))
    few = means.withColumn("rank", rank).filter(F.col("rank") <= most)
    ranked = few.groupBy("book", "w").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "mean"))).alias("r"))
    top, w = F.get("r", F.lit(0)), F.col("w")
    apart = F.filter("r", lambda x: (x["start"] + w - 1 < top["start"]) | (x["start"] > top["start"] + w - 1))
    found = ranked.select("book", top["start"].alias("start"), (top["start"] + w - 1).alias("end"), top["mean"].alias("top_score"), F.coalesce(F.get(apart, F.lit(0))["mean"], F.lit(0.0)).alias("runner_up_score"))
    return found.withColumn("margin", F.col("top_score") - F.col("runner_up_score"))


def locate(pages: DataFrame, reference_pages: DataFrame, window: int | None = None) -> DataFrame:
    """Locate each book's reference inside its pages: status, range, score and margin.

    The window is the number of reference pages unless given. Status is
    ``located``, ``reference_has_no_text`` or ``no_candidate``. Scores are held, so texts are
    read once.
    """
    sizes = reference_pages.groupBy("book").agg(F.count(F.lit(1)).alias("n_reference"))
    books = hold(sizes.join(reference_vocabulary(reference_pages), "book", "left"), "references")
    known = books.filter("vocabulary is not null")
    scores = hold(score_pages(pages, known).join(known.select("book", "n_reference"), "book"), "scores")
    found = fixed_window(scores, window or F.col("n_reference"))
    out = books.select("book", F.when(F.col("vocabulary").isNull(), "reference_has_no_text").alias("status")).join(found, "book", "left")
    return out.withColumn("status", F.coalesce("status", F.when(F.col("start").isNull(), "no_candidate").otherwise("located")))


def window_sums(scores: DataFrame, low: int = MIN_WINDOW, high: int = MAX_WINDOW, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """(keys, start, end, score): every window of ``low`` to ``high`` pages, summed.

    Only whole windows: pages follow one another within a key, so a window is whole
    when it got as many pages as it is wide.
    """
    span = F.explode(F.sequence(F.lit(low), F.lit(high)))
    each = scores.select(*keys, "page_index", "score", span.alias("w"))
    each = each.select(*keys, "score", "w", F.explode(F.sequence(F.col("page_index") - F.col("w") + 1, F.col("page_index"))).alias("start"))
    summed = each.groupBy(*keys, "start", "w").agg(F.round(F.sum("score"), SUM_DIGITS).alias("score"), F.count(F.lit(1)).alias("n"))
    return summed.filter("n = w").select(*keys, "start", (F.col("start") + F.col("w") - 1).cast("int").alias("end"), "score")


def topk_ranges(windows: DataFrame, k: int = TOP_K, keys: tuple[str, ...] = ("book",), widest: int = MAX_WINDOW) -> DataFrame:
    """(keys, rank, start, end, score): each key's best windows (largest sum, widest,
    earliest) that don't overlap a better one; at most ``k``, or all of them if ``k`` is 0.

    A window of up to ``widest`` pages touches a bounded number of others, so the first
    ``k`` are among a bounded number of best ones, which a rank keeps that is cut before
    the shuffle. With ``k`` of 0 a key's windows are folded in one row: for books only.
    """
    order = [F.desc("score"), (F.col("end") - F.col("start")).desc(), F.col("start")]
    ranked = windows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if k > 0:
        touched = widest * (widest + 1) // 2 + widest * (widest - 1)
        ranked = ranked.filter(F.col("__rank") <= (k - 1) * touched + 1)
    item = F.struct("__rank", *[F.col(c).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"), ("score", "double"))])
    best = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__w"))
    picked = best.select(*keys, F.posexplode(non_overlapping(F.col("__w"), k)).alias("__at", "__r"))
    return picked.select(*keys, (F.col("__at") + 1).alias("rank"), "__r.start", "__r.end", "__r.score")


def best_range(windows: DataFrame, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """The single best window of each key, over all its runs: one aggregate."""
    key = F.struct("score", (F.col("end") - F.col("start")).alias("width"), (-F.col("start")).alias("s"))
    best = windows.groupBy(*keys).agg(F.max(key).alias("b"))
    return best.select(*keys, (-F.col("b.s")).alias("start"), (F.col("b.width") - F.col("b.s")).alias("end"), F.col("b.score").alias("score"))


def true_page_rank(scores: DataFrame) -> DataFrame:
    """(book, best_true_page_rank): the least rank (score descending, then page) of a
    page with ``label``; counted by comparison with each book's best true page."""
    best = scores.filter("label").groupBy("book").agg(F.max(F.struct("score", (-F.col("page_index")).alias("p"))).alias("t"))
    ahead = (F.col("score") > F.col("t.score")) | ((F.col("score") == F.col("t.score")) & (F.col("page_index") < -F.col("t.p")))
    return scores.join(best, "book").groupBy("book").agg((F.count(F.when(ahead, 1)) + 1).alias("best_true_page_rank"))
