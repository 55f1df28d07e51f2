"""From labelled corpora on disk to a report of left-out books, and to a scorer.

A corpus is a folder of ``<key>.expected.json`` files with each book's layout beside it,
``<key>.xml`` (ALTO). Books located by a reference are label files (JSON) with their
layouts in a folder of their own, and count by their margin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import boosting, metrics, ml
from leafmark.operators import labels as L
from leafmark.plans import inference
from leafmark.sources import alto, files
from leafmark.storage import hold

_KEY = r"([^/]+)\.xml$"


def label_rows(spark: SparkSession, root: str, located: str = "") -> DataFrame:
    """Label rows of all corpora under ``root``, and of the ``located`` labels of other books.
    Of a key that several corpora have, the last corpus by name counts."""
    corpora = files.discover_corpora(spark, root)
    rows = None
    for i, corpus in enumerate(corpora):
        part = files.read_expected(spark, corpus, layouts=True).withColumn("ordinal", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError(f"no expected files under {root}")
    others = L.located_rows(files.read_labels(spark, located)) if located else rows.drop("ordinal").limit(0)
    return L.merge_labels(rows, others)


def feature_rows(spark: SparkSession, labels: DataFrame, folders: list[str]) -> DataFrame:
    """All features of all pages of the labelled books, with label, weight, corpus and type."""
    lines = None
    for folder in folders:
        part = alto.read_pages(spark, f"{folder}/*.xml")
        lines = part if lines is None else lines.unionByName(part)
    lines = lines.withColumn("book", F.regexp_extract("file", _KEY, 1)).drop("file")
    named = labels.select(F.col("key").alias("book"), "language")
    totals = lines.groupBy("book").agg((F.max("page_index") + 1).alias("total_pages"))
    page_rows = inference.pages_of_lines(lines.join(named.select("book"), "book").join(totals, "book"))
    return L.label_pages(inference.feature_table(page_rows.join(named, "book")), labels)


def corpus_features(spark: SparkSession, root: str, located: str = "", layouts: str = "", cache: str = "", rebuild: bool = False) -> DataFrame:
    """:func:`feature_rows` of everything under ``root``, and of the books of ``located`` labels,
    whose layouts are in ``layouts``; kept in ``cache`` as long as the books are the same."""
    labels = hold(label_rows(spark, root, located), "labels")
    folders = [*files.discover_corpora(spark, root), *([layouts] if layouts else [])]
    build = lambda: feature_rows(spark, labels, folders)
    return files.cached_table(build, labels.select("key"), "key", cache, rebuild) if cache else hold(build(), "features")


def report(rows: DataFrame, model: str = ml.MODELS[0], how: boosting.Growth = boosting.Growth()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per_book, rates, ranks): each book scored by a model of all other books; hit rates over
    all and by corpus and extraction type; median rank of the best true page, and shares."""
    scored = ml.leave_one_out(rows, model=model, how=how)
    kinds = rows.groupBy("book").agg(F.first("corpus").alias("corpus"), F.first("extraction_type").alias("extraction_type"))
    per_book = hold(inference.evaluate(scored).join(kinds, "book"), "per-book")
    return per_book, metrics.hit_rates(per_book), metrics.rank_summary(per_book)


def fit(rows: DataFrame, model: str = ml.MODELS[0], how: boosting.Growth = boosting.Growth()) -> ml.Linear | boosting.Boosted:
    """The scorer of all rows."""
    if model not in ml.MODELS:
        raise ValueError(f"model must be one of {ml.MODELS}")
    return ml.fit_linear(rows) if model == ml.MODELS[0] else ml.fit_boosted(rows, how=how)
