"""Capped diversity sampling: rows are taken in order, as long as no value of any
dimension would be over its cap. A null value has no cap; a row counts in all its
dimensions or in none."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.storage import held_now, hold, release


def cap(target: int, fraction: float) -> int:
    return max(1, math.ceil(target * fraction))


def admitted(rows: Iterable[tuple], caps: tuple[int, ...], used: Counter, room: int) -> list[bool]:
    """Whether each row (a value for each dimension) is taken. ``used`` counts (dimension,
    value) of what was taken before and is carried on; at most ``room`` rows are taken."""
    out = []
    for values in rows:
        counted = [(i, v) for i, v in enumerate(values) if v is not None]
        fits = room > 0 and not any(used[c] >= caps[c[0]] for c in counted)
        out.append(fits)
        if fits:
            room -= 1
            used.update(counted)
    return out


def sample_one(df: DataFrame, dimension: str, order: str, target: int, fraction: float, parts: int = 64) -> DataFrame:
    """The sample over one dimension: each value's first ``cap`` rows, then the first
    ``target`` of those (null values are uncapped).

    Each value is first cut to its cap inside ``parts`` hashed parts, so a hot value
    never meets in one task in full.
    """
    limit = cap(target, fraction)
    part = F.pmod(F.xxhash64(order), F.lit(parts))
    few = df.withColumn("__part", part).withColumn("__r", F.row_number().over(Window.partitionBy(dimension, "__part").orderBy(order)))
    most = F.when(F.col(dimension).isNull(), F.lit(target)).otherwise(F.lit(limit))
    few = few.filter(F.col("__r") <= most)
    few = few.withColumn("__r", F.row_number().over(Window.partitionBy(dimension).orderBy(order))).filter(F.col("__r") <= most)
    return few.drop("__part", "__r").orderBy(order).limit(target)


def sample_many(df: DataFrame, fractions: dict[str, float], order: str, target: int, ahead: int = 8) -> DataFrame:
    """The sample over several dimensions; ``order`` is a unique number or text, not null.

    A row's fate needs only the rows before it: with ``a`` of them taken and ``u`` undecided
    that have its value, it is taken if ``a + u`` is under the cap in every dimension,
    and dropped if ``a`` reaches the cap in one. Each round decides all rows that this
    tells, the first undecided one among them at least, so the rounds end; as a rule few
    are needed. Which rows were taken in the order without a limit, cut to the first
    ``target``, are those taken with it.

    Rows go through this in stretches of the order of about ``ahead`` x ``target``, without
    those of values at their cap (at most 1 / fraction values of a dimension), until the
    target is reached. All is counted by the tasks: the driver gets numbers of rows, a
    stretch's end, and the values at their caps.
    """
    caps, mark = {n: cap(target, f) for n, f in fractions.items()}, held_now()
    taken, n_taken, rest = df.limit(0), 0, df
    while n_taken < target and (left := rest.count()):
        whole = left <= 2 * ahead * target
        part = rest if whole else rest.filter(F.col(order) <= F.lit(_end(rest, order, left, ahead * target / left)))
        taken = hold(taken.unionByName(_decided(part, taken, caps, order)), "taken")
        release(mark, but=1)
        n_taken = taken.count()
        if whole:
            break
        rest = df.filter(F.col(order) > F.lit(part.agg(F.max(order)).first()[0]))
        for n, most in caps.items():
            over = [r[0] for r in taken.filter(F.col(n).isNotNull()).groupBy(n).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= most).collect()]
            rest = rest.filter(F.col(n).isNull() | ~F.col(n).isin(over)) if over else rest
    return taken.orderBy(order).limit(target) if n_taken > target else taken


def _end(rows: DataFrame, order: str, n: int, share: float) -> object:
    """A value of ``order`` with about ``share`` of the ``n`` rows up to it. Texts: by a
    bounded sample of them, which decides where a stretch ends, and no row's fate."""
    if dict(rows.dtypes)[order] != "string":
        return rows.agg(F.percentile_approx(order, share, 10_000)).first()[0]
    some = sorted(r[0] for r in rows.select(order).sample(min(1.0, 10_000 / n), 7).collect())
    return some[int(len(some) * share)] if some else rows.agg(F.max(order)).first()[0]


def _decided(rows: DataFrame, taken: DataFrame, caps: dict[str, int], order: str) -> DataFrame:
    """Those of ``rows`` that are taken after ``taken``, by rounds."""
    columns, mark = rows.columns, held_now()
    for n in caps:
        used = taken.filter(F.col(n).isNotNull()).groupBy(F.col(n).alias("__v")).agg(F.count(F.lit(1)).alias(f"__used_{n}"))
        rows = rows.join(used, F.col(n) == F.col("__v"), "left").drop("__v").fillna(0, [f"__used_{n}"])
    state = hold(rows.withColumn("__taken", F.lit(False)), "round")
    while True:
        free, never = F.lit(True), F.lit(False)
        for n, most in caps.items():
            # Rows without a value have no cap: they are told apart, so that they don't meet.
            of = Window.partitionBy(n, F.when(F.col(n).isNull(), F.col(order))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            sure = F.coalesce(F.sum(F.col("__taken").cast("long")).over(of), F.lit(0)) + F.col(f"__used_{n}")
            every = F.coalesce(F.count(F.lit(1)).over(of), F.lit(0)) + F.col(f"__used_{n}")
            capped = F.col(n).isNotNull()
            free, never = free & (~capped | (every < most)), never | (capped & (sure >= most))
        judged = state.withColumns({"__free": free, "__never": ~F.col("__taken") & never}).filter("not __never")
        judged = judged.withColumn("__now", F.col("__taken") | F.col("__free"))
        state = hold(judged.drop("__taken", "__free", "__never").withColumnRenamed("__now", "__taken"), "round")
        release(mark, but=1)
        if state.filter("not __taken").isEmpty():
            return state.select(columns)
