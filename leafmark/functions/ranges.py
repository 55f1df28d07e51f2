"""Column functions over score arrays and page ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Margins and weights of located labels; window lengths.
MARGIN_LOW, MARGIN_HIGH, WEIGHT_LOW, WEIGHT_HIGH = 0.0, 0.5, 0.3, 1.0
MIN_WINDOW, MAX_WINDOW, TOP_K = 1, 6, 3
#: Sums are rounded before ranking, so that equal windows tie whatever the order of adding.
SUM_DIGITS = 9


def margin_weight(margin: Column) -> Column:
    """A label's confidence: the margin clipped to [0, 0.5], laid linearly on [0.3, 1]."""
    clipped = F.greatest(F.least(margin, F.lit(MARGIN_HIGH)), F.lit(MARGIN_LOW))
    return F.lit(WEIGHT_LOW) + (clipped - MARGIN_LOW) / (MARGIN_HIGH - MARGIN_LOW) * (WEIGHT_HIGH - WEIGHT_LOW)


def window_sums(scores: str, low: int = MIN_WINDOW, high: int = MAX_WINDOW) -> Column:
    """array<struct<start,end,score>>: every window of ``low`` to ``high`` scores."""
    total = f"round(aggregate(slice({scores}, s + 1, w), 0D, (a, x) -> a + x), {SUM_DIGITS})"
    each = f"transform(sequence(0, size({scores}) - w), s -> named_struct('start', s, 'end', s + w - 1, 'score', {total}))"
    widths = f"sequence({low}, least({high}, size({scores})))"
    empty = "cast(array() as array<struct<start:int,end:int,score:double>>)"
    return F.expr(f"CASE WHEN size({scores}) >= {low} THEN flatten(transform({widths}, w -> {each})) ELSE {empty} END")


def non_overlapping(ranked: Column, k: int = TOP_K) -> Column:
    """Of windows in order of rank (structs with start, end and score), those that don't
    overlap an earlier choice; at most ``k``, or all of them if ``k`` is 0."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,score:double>>)")

    def pick(chosen: Column, x: Column) -> Column:
        clash = F.exists(chosen, lambda c: ~((x["end"] < c["start"]) | (x["start"] > c["end"])))
        full = F.size(chosen) >= k if k > 0 else F.lit(False)
        one = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
        return F.when(clash | full, chosen).otherwise(F.concat(chosen, one))

    return F.aggregate(ranked, empty, pick)


def topk_ranges(scores: str, k: int = TOP_K, low: int = MIN_WINDOW, high: int = MAX_WINDOW) -> Column:
    """The best non-overlapping windows of one book's score array: largest sum first,
    then widest, then earliest; at most ``k``, or all of them if ``k`` is 0."""
    by_rank = lambda x: F.struct((-x["score"]).alias("a"), (x["start"] - x["end"]).alias("b"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"))
    return non_overlapping(F.array_sort(F.transform(window_sums(scores, low, high), by_rank)), k)


def contains_range(window: Column, pages: Column) -> Column:
    """True if the window (struct start, end) holds all of the sorted page array."""
    return (F.size(pages) > 0) & (window["start"] <= F.array_min(pages)) & (window["end"] >= F.array_max(pages))


def overlaps_range(window: Column, pages: Column) -> Column:
    return F.exists(pages, lambda p: (p >= window["start"]) & (p <= window["end"]))
