"""Shared helpers: Arrow row maps and expression binding; held tables are the library's."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.storage import held_now, hold, release, shared_dir

__all__ = ["held_now", "hold", "release", "shared_dir"]

#: Bytes that separate words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"


def workers_find_us(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver's path has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only the id and the text, under fixed names; other columns are pruned."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterable[dict] | dict]], schema: str, rows: int = 256) -> DataFrame:
    """mapInArrow over slices of ``rows`` rows, so that Python holds few texts at once.

    ``make()`` runs once a task and returns a function from a dict of column
    lists to a dict of column lists.
    """
    spark = df.sparkSession
    workers_find_us(spark)
    target = to_arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = step(batch.slice(at, rows).to_pydict())
                if len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows of one key that a join gives to a task.
KEY_ROWS = 200_000


def hot_keys(rows: DataFrame, key: str, per: int | None = None) -> DataFrame:
    """(key, parts) of the keys with more than ``per`` rows: there can't be more than a
    ``per``-th of the rows, by counting, so they may be broadcast."""
    per = per or KEY_ROWS
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("parts")).filter(F.col("parts") > per).withColumn("parts", F.ceil(F.col("parts") / per))


def dealt(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """Add ``salt``: the part of its hot key that a row is in, else 0."""
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1)))).drop("parts")


def copied(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Rows once for each part of their key, as ``salt``, to be met by the dealt ones."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", each).drop("parts")


FENCE = "__fence"


def fenced(df: DataFrame) -> DataFrame:
    """Add a column that, once a filter reads it, keeps that filter above this
    projection: pushed down, the filter would evaluate costly columns twice."""
    return df.withColumn(FENCE, F.monotonically_increasing_id())


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Words of a text as the contracts cut them; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod
