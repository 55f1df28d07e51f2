"""From raw documents to packed batches, one stage after another.

Each stage reads what its predecessor wrote. All but the last return the columns of
``documents``; the last returns the packing of every document that is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm import langid, linededup, neardup, packing, quality
from leafmark.llm.common import held_now, hold, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject go.

    Null, empty and very short texts are rejected; very long ones are read whole;
    repeated rows are judged alike; an empty table stays empty; all columns stay, and
    of columns like the stage's own working ones the documents' own are returned.
    """
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go; ``lang`` becomes the prediction.

    Texts that are null or have no letter go, as do all where no row has a language;
    ties go to the first in alphabetical order; repeated rows are learned from once;
    very long texts are read whole; an empty table stays empty; all columns stay.
    """
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand at an earlier place go, and documents of which nothing is left.

    Null and empty texts stay, as do rows without an id, which are nobody's first
    occurrence; the smallest doc_id and place are the first; rows that repeat id and text
    keep theirs alike; very long texts are read whole; an empty table stays empty; all
    columns stay.
    """
    return linededup.apply(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, Jaccard 0.8 or more.

    Texts that are null or without words stay; the smallest doc_id is kept, with all rows
    that have it; rows without an id stay; very long texts enter whole; an empty table
    stays empty; all columns stay.
    """
    return neardup.keep_one(docs, size=5, least=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of all that is left.

    Null and empty texts have length 0; a text longer than the budget is a batch of its
    own; ties go to fewer and lower boundaries; repeated rows have a place each; an empty
    table gives no rows; other columns are left out.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("minhash near-dedup", minhash_near_dedup),
    ("packing", pack),
]
#: The language stage's machines have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = held_now()
        docs = hold(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(mark, but=1)  # what the stage held for itself
    return STAGES[-1][1](spark, docs, sf_dir)
