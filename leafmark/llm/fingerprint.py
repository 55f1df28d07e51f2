"""Document fingerprints: bottom-k sketches of shingle hashes, in expressions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's
shingles (words, A-Z lower-cased, k = 128, five words to a shingle; a shorter
text is one shingle). Sketches merge by keeping the k smallest of both, so parts
may be sketched apart, and estimate resemblance, containment and the number of
distinct shingles; below k shingles every estimate is exact.

Defined results: a null, empty or blank text has the empty sketch, alike (1.0)
to another empty one and unlike (0.0) any other; equal texts have equal
sketches; repeated rows count one by one; a null doc_id sorts as the smallest;
rows that share a doc_id follow one another by text, null first, and are in one
task; very long texts are sketched whole; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import documents, lower_az, words_of

K, SHINGLE = 128, 5
#: Rows that a range of ids is to have, in which neighbours are looked up; the least and
#: most ranges, which bound the driver's array.
RANGE_ROWS, RANGES, MOST_RANGES = 20_000, 2048, 65_536


def with_sketch(df: DataFrame, text: Column, name: str, k: int = K, words: int = SHINGLE) -> DataFrame:
    """Add ``name``: the sketch (array<bigint>) of ``text``.

    Steps are projections of their own, so that the sort of longs is compiled.
    """
    w, h, u = f"{name}_w", f"{name}_h", f"{name}_u"
    df = df.withColumn(w, words_of(lower_az(F.coalesce(text, F.lit("")))))
    df = df.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x))).drop(w)
    a, n = F.col(h), F.size(h)
    shingles = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(words)]))
    whole = F.array(F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
    empty = F.array().cast("array<bigint>")
    df = df.withColumn(u, F.when(n >= words, F.array_distinct(shingles)).when(n > 0, whole).otherwise(empty)).drop(h)
    return df.withColumn(name, F.slice(F.sort_array(u), 1, k)).drop(u)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = SHINGLE) -> DataFrame:
    """doc_id and sketch of every whole text."""
    return with_sketch(documents(docs, id_col, text_col), F.col("text"), "sketch", k, words).select("doc_id", "sketch")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group: its hashes are made distinct within salted parts
    first, so a hot group never sends more than k hashes from each part."""
    part = df.withColumn("__part", F.pmod(F.hash(sketch_col), F.lit(64)))
    least = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("__s")))), 1, k)
    once = part.withColumn("__s", F.col(sketch_col)).groupBy(*keys, "__part", "__s").agg(F.count(F.lit(1)).alias("__n"))
    halves = once.groupBy(*keys, "__part").agg(least.alias("__s"))
    return halves.groupBy(*keys).agg(least.alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of both texts' distinct shingles that they have in common."""
    both = merge(a, b, k)
    share = F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.nullif(F.size(both), F.lit(0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(1.0)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    rank = (F.get(a, F.lit(k - 1)).cast("double") + F.lit(float(2**63))) / F.lit(float(2**64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / rank)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too."""
    r = resemblance(a, b, k)
    union = F.when(F.size(merge(a, b, k)) < k, F.size(F.array_union(a, b)).cast("double")).otherwise(distinct_shingles(merge(a, b, k), k))
    share = r * union / F.nullif(distinct_shingles(a, k), F.lit(0.0))
    return F.least(F.lit(1.0), F.coalesce(share, F.lit(1.0)))


def digest(a: Column) -> Column:
    """The sketch as text: sixteen hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _next_rows(df: DataFrame, keep: list[str], ranges: int) -> DataFrame:
    """Add next_<column> of the row that follows by descending id (the last: the first).

    Rows are dealt to id ranges between ids of the table itself (quantiles, so
    ranges are even). The rows at a range's upper end also go, as guests, to the
    range above, whose last row they follow: no task sees more than one range,
    and only ``ranges`` ids reach the driver.
    """
    df = df.withColumn("__key", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    ends = df.agg(F.percentile_approx("__key", [i / ranges for i in range(1, ranges + 1)], ranges * 10).alias("q"), F.max("__key").alias("top")).first()
    ends = sorted({*(ends["q"] or []), *([] if ends["top"] is None else [ends["top"]])})
    bounds = F.lit(ends).cast("array<bigint>") if ends else F.array().cast("array<bigint>")
    n = len(ends)
    # Binary search over the sorted ends: the number of ends below the id.
    steps = [1 << i for i in range(max(n, 1).bit_length() - 1, -1, -1)]
    at = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda a, s: F.when(F.coalesce(F.get(bounds, a + s - 1) < F.col("__key"), F.lit(False)), a + s).otherwise(a))
    df = df.withColumn("__range", at)
    is_end = F.coalesce(F.get(bounds, F.col("__range")) == F.col("__key"), F.lit(False))
    home = F.struct(F.col("__range").alias("r"), F.lit(0).alias("guest"))
    above = F.struct(F.pmod(F.col("__range") + 1, F.lit(max(n, 1))).alias("r"), F.lit(1).alias("guest"))
    dealt = df.withColumn("__to", F.explode(F.when(is_end, F.array(home, above)).otherwise(F.array(home))))
    order = Window.partitionBy("__to.r").orderBy(F.col("__to.guest"), F.col("__key").desc(), F.col("text").asc_nulls_first())
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in keep}).filter(F.col("__to.guest") == 0)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and likeness to it and to
    the next document. One shuffle, of the texts with their sketches."""
    ranges = ranges or min(MOST_RANGES, max(RANGES, docs.count() // RANGE_ROWS))
    df = with_sketch(documents(docs, id_col, text_col), F.col("text"), "sketch")
    df = _next_rows(df, ["text", "sketch"], ranges)
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr(text, F.lit(1), n - cut), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    df = df.withColumns({"n": n, "edited": edited})
    df = with_sketch(df, F.col("edited"), "edited_sketch")
    return df.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("sketch")).alias("fingerprint"),
        digest(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )
