"""Optimal length buckets and token-budget batches.

The lengths' global histogram (exact to 65,536 tokens, the default budget; then 4096
bins to each doubling, cut only at their longest) goes to the driver, and dynamic
programming over it chooses the bucket boundaries that minimise padding: each length's
best cut before it is found on the lower hull of straight lines, so the histogram is
gone through once for each bucket. Inside each bucket documents form batches of at most
``budget`` padded tokens.

Defined results: a null or empty text has length 0 and needs no padding; a document
longer than the budget is a batch of its own, however long; of equally good boundaries
the fewest and lowest are taken; repeated rows are packed one by one, each at a place
of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import documents, hold, words_of

BUCKETS, BUDGET = 16, 65_536
#: Rows that a hashed part of a bucket is to have, and the least and most parts.
PART_ROWS, PARTS, MOST_PARTS = 1_000_000, 256, 16_384
#: Bits of lengths that have a bin of their own, and leading bits that bins of longer ones keep.
EXACT_BITS, LEAD_BITS = 16, 13


def tokens(text: Column) -> Column:
    """Default length of a text: its words (``[^\\x20\\x09-\\x0D]+``)."""
    return F.size(words_of(text)).cast("long")


def _bin(n: Column) -> Column:
    """Monotone bin of a length: itself, or its leading bits and size."""
    size = F.length(F.bin(n))
    bits = F.when(size <= EXACT_BITS, F.lit(0)).otherwise(size - LEAD_BITS)
    return F.struct(bits.alias("bits"), F.call_function("shiftright", n, bits).alias("lead"))


def choose_boundaries(longest: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends, among ``longest`` (ascending), of at most ``buckets`` buckets with
    the least total of count times upper end, which is the least padding.

    cost(j) = rows(j) * length(j) + min over i < j of (cost before(i) - rows(i) * length(j)):
    lines that fall steeper with i, asked at places that grow with j.
    """
    top, rows = [0, *map(int, longest)], [0, *np.cumsum(counts, dtype=np.int64).tolist()]
    n, cuts = len(longest), []
    cost: list[int | None] = [0, *[None] * n]
    for _ in range(min(buckets, n)):
        hull: list[int] = []
        best, arg, at = list(cost), list(range(-1, n)), 0
        for j in range(1, n + 1):
            i = j - 1
            if cost[i] is not None:
                # A line is of no use where the next crosses it before it crosses the one before.
                while len(hull) > 1 and (cost[i] - cost[hull[-2]]) * (rows[hull[-1]] - rows[hull[-2]]) <= (cost[hull[-1]] - cost[hull[-2]]) * (rows[i] - rows[hull[-2]]):
                    hull.pop()
                hull.append(i)
            at = min(at, len(hull) - 1)
            value = lambda k: cost[k] - rows[k] * top[j]  # noqa: B023, E731
            while at + 1 < len(hull) and value(hull[at + 1]) < value(hull[at]):
                at += 1
            found = value(hull[at]) + rows[j] * top[j]
            if best[j] is None or found < best[j]:
                best[j], arg[j] = found, hull[at]
            else:
                arg[j] = -1  # a bucket less is as good
        cuts.append(arg)
        cost = best
    ends, j = [], n
    for arg in reversed(cuts):
        if j and arg[j] >= 0:
            ends.append(top[j])
            j = arg[j]
    return ends[::-1]


def boundaries(lengths: DataFrame, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Bucket boundaries over all rows of ``lengths`` (column n_tokens), and their number.
    The driver gets one row for each bin: 65,536 and some 4096 for each doubling at most."""
    bins = lengths.groupBy(_bin(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n"))
    found = sorted((r["top"], r["n"]) for r in bins.select("top", "n").collect())
    return choose_boundaries(np.array([t for t, _ in found], np.int64), np.array([n for _, n in found], np.int64), buckets), sum(n for _, n in found)


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, batch and place of every document.

    Texts are read once; their lengths are held. A bucket may hold most rows, so it is
    numbered in hashed ``parts``, and a batch's number follows from the rows of earlier
    parts: no task orders a bucket. Rows that repeat id and length are one row with a
    count until they are numbered.
    """
    length = tokens(F.col("text")) if length is None else length
    rows = hold(documents(docs, id_col, text_col).select("doc_id", length.cast("long").alias("n_tokens")), "lengths")
    ends, total = boundaries(rows, buckets)
    parts = parts or min(MOST_PARTS, max(PARTS, total // PART_ROWS))
    at = F.lit(len(ends))
    for i, end in reversed(list(enumerate(ends))):
        at = F.when(F.col("n_tokens") <= end, F.lit(i)).otherwise(at)
    padded = F.get(F.lit(ends or [0]).cast("array<bigint>"), F.col("bucket"))
    part = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(parts)).cast("int")
    rows = rows.withColumns({"bucket": at.cast("int"), "part": part}).groupBy("bucket", "part", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("times"))
    # buckets x parts rows at most, whatever the input.
    sizes = rows.groupBy("bucket", "part").agg(F.sum("times").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("bucket", "part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    before = F.sum("times").over(Window.partitionBy("bucket", "part").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("in_part", F.coalesce(before, F.lit(0))).join(F.broadcast(sizes), ["bucket", "part"])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))
    rows = rows.withColumns({"padded_length": padded, "first": F.col("earlier") + F.col("in_part")}).withColumn("repeat", each)
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_length"), F.lit(1)))).cast("long")
    in_bucket = F.col("first") + F.col("repeat")
    return rows.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_length",
        F.floor(in_bucket / per_batch).cast("long").alias("batch"),
        (in_bucket % per_batch).cast("long").alias("place"),
    )
