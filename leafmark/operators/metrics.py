"""Hit rates by group, rank medians and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS = ["top1_hit", "top3_hit", "top1_overlap", "top3_overlap"]


def hit_rates(per_book: DataFrame, groups: tuple[str, ...] = ("corpus", "extraction_type"), hits: list[str] | None = None) -> DataFrame:
    """Rates over all rows and by each group, in one pass of grouping sets.

    ``by`` names the group, ``value`` is its value (null: all rows, or the null value).
    """
    hits = hits or HITS
    level = F.lit("all")
    for g in groups:
        level = F.when(F.grouping(g) == 0, F.lit(g)).otherwise(level)
    rated = per_book.groupingSets([(), *[(g,) for g in groups]], *groups).agg(
        level.alias("by"), F.coalesce(*groups).alias("value"), F.count(F.lit(1)).alias("n"), *[F.avg(F.col(h).cast("double")).alias(h) for h in hits]
    )
    return rated.select("by", "value", "n", *hits)


def rank_summary(per_book: DataFrame, rank_col: str = "best_true_page_rank", within: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Median rank and the shares within some ranks; nulls for no books."""
    shares = [F.avg((F.col(rank_col) <= k).cast("double")).alias(f"within_{k}") for k in within]
    return per_book.agg(F.median(rank_col).alias("median_rank"), *shares)
