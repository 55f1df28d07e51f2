"""Composed plans: from pages to a range, and from scored pages to an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import geometry as G
from leafmark.operators import locate, pages
from leafmark.operators.boosting import Boosted
from leafmark.operators.ml import Linear
from leafmark.sources import alto
from leafmark.storage import hold

HEAD_PAGES, TAIL_PAGES = 30, 20


def pages_of_lines(lines: DataFrame) -> DataFrame:
    """Texts and layout features of pages given as ALTO text lines.

    ``lines`` has book, page_index, total_pages, height, width and lines
    (array<struct<top,words>>). Text and features come of one pass.
    """
    rows = lines.withColumn("visual", G.visual_lines(F.col("lines")))
    rows = rows.withColumns({"text": F.array_join(F.transform("visual", G.line_text), "\n"), "f": G.page_features("visual", "height", "width")})
    return rows.select("book", "page_index", "total_pages", "text", "f.*")


def feature_table(page_rows: DataFrame, head: int | None = None, tail: int | None = None) -> DataFrame:
    """All 15 features of scanned pages (book context is over the scanned pages only)."""
    scanned = pages.scan_head_tail(page_rows, head, tail)
    return pages.text_features(pages.book_context(scanned), language_col="language" if "language" in page_rows.columns else None)


def locate_pages(page_rows: DataFrame, model: Linear | Boosted, top_k: int = 3, head: int | None = HEAD_PAGES, tail: int | None = TAIL_PAGES) -> DataFrame:
    """(book, pages): the predicted page indices of each book.

    Windows never cross the gap between head and tail. ``top_k`` of 1 or more can't
    change the single best range and is there for the interface.
    """
    scored = model.transform(feature_table(page_rows, head, tail))
    windows = locate.window_sums(pages.with_runs(scored), keys=("book", "run_start"))
    best = locate.best_range(windows)
    return best.select("book", F.sequence("start", "end").alias("pages"), "score")


def locate_files(spark: SparkSession, path: str, model: Linear | Boosted, top_k: int = 3, head: int | None = HEAD_PAGES, tail: int | None = TAIL_PAGES) -> DataFrame:
    """(book, pages, score): from ALTO files to each one's range; ``book`` is the file."""
    lines = alto.read_pages(spark, path).withColumnRenamed("file", "book")
    totals = lines.groupBy("book").agg((F.max("page_index") + 1).alias("total_pages"))
    return locate_pages(pages_of_lines(lines.join(totals, "book")), model, top_k, head, tail)


def positions(scored: DataFrame) -> DataFrame:
    """Pages numbered by their place among a book's rows, as the evaluation compares them."""
    return pages.number_rows(scored.withColumnRenamed("page_index", "__page"), "book", "__page", "page_index").drop("__page")


def evaluate(scored: DataFrame, k: int = 3) -> DataFrame:
    """(book, top1_hit, top3_hit, top1_overlap, top3_overlap, best_true_page_rank) of
    scored, labelled pages; books without a true page are left out."""
    placed = hold(positions(scored.select("book", "page_index", "score", "label")), "placed")
    truth = placed.filter("label").groupBy("book").agg(F.min("page_index").alias("lo"), F.max("page_index").alias("hi"))
    ranges = locate.topk_ranges(locate.window_sums(placed), k)
    true_pages = placed.filter("label").select("book", F.col("page_index").alias("p"))
    inside = (F.col("p") >= F.col("start")) & (F.col("p") <= F.col("end"))
    hits = ranges.join(truth, "book").join(true_pages, "book").groupBy("book", "rank", "start", "end", "lo", "hi").agg(F.bool_or(inside).alias("overlap"))
    hit = (F.col("start") <= F.col("lo")) & (F.col("end") >= F.col("hi"))
    first = F.col("rank") == 1
    per_book = hits.groupBy("book").agg(
        F.bool_or(hit & first).alias("top1_hit"), F.bool_or(hit).alias("top3_hit"), F.bool_or(F.col("overlap") & first).alias("top1_overlap"), F.bool_or("overlap").alias("top3_overlap")
    )
    return per_book.join(locate.true_page_rank(placed), "book")
