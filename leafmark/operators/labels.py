"""Ground-truth labels: weights, merging by priority, labelled pages, heading mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.functions.ranges import margin_weight

COLUMNS = ["key", "pdf_path", "toc_start_index", "toc_end_index", "weight", "language", "corpus", "source", "extraction_type"]


def located_rows(labels: DataFrame, listing: DataFrame | None = None, languages: DataFrame | None = None) -> DataFrame:
    """Label rows of status ``located`` whose full text is in ``listing`` (isbn, path),
    weighted by their margin, with the manifest's language (isbn, language, and the
    ``ordinal`` whose last wins; without it the last in alphabetical order)."""
    rows = labels.filter("status = 'located'")
    rows = rows.withColumn("path", F.lit(None).cast("string")) if listing is None else rows.join(listing.select("isbn", "path"), "isbn")
    rows = rows.withColumn("language", F.lit(None).cast("string")) if languages is None else rows.join(languages.groupBy("isbn").agg((F.max_by("language", "ordinal") if "ordinal" in languages.columns else F.max("language")).alias("language")), "isbn", "left")
    return rows.select(
        F.col("isbn").alias("key"),
        F.col("path").alias("pdf_path"),
        "toc_start_index",
        "toc_end_index",
        margin_weight(F.col("margin")).alias("weight"),
        "language",
        F.lit("dnb_located").alias("corpus"),
        F.lit("dnb_located").alias("source"),
        F.lit(None).cast("string").alias("extraction_type"),
    )


def merge_labels(expected: DataFrame, located: DataFrame) -> DataFrame:
    """Expected rows (the last of equal keys by ``ordinal``, if they have one), and
    located rows whose key, taken as it is, isn't among them."""
    if "ordinal" in expected.columns:
        rest = [c for c in expected.columns if c not in ("key", "ordinal")]
        last = expected.groupBy("key").agg(F.max_by(F.struct(*rest), "ordinal").alias("r"))
        expected = last.select("key", *[F.col(f"r.{c}").alias(c) for c in rest])
    return expected.unionByName(located.join(expected.select("key"), "key", "left_anti"), allowMissingColumns=True)


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages of labelled books with label, weight, corpus and extraction_type. A book
    known to have no range has only false labels."""
    inside = F.col("page_index").between(F.col("toc_start_index"), F.col("toc_end_index"))
    named = labels.select(F.col("key").alias("book"), "toc_start_index", "toc_end_index", "weight", "corpus", "extraction_type")
    return pages.join(named, "book").withColumn("label", F.coalesce(inside, F.lit(False))).drop("toc_start_index", "toc_end_index")


def phrase_counts(pages: DataFrame, min_count: int = 1, text_col: str = "text", language_col: str = "language") -> DataFrame:
    """(language, phrase, n): short headings of first contents pages, counted."""
    phrase = T.heading_phrase(F.col(text_col))
    rows = pages.select(F.col(language_col).alias("language"), phrase.alias("phrase")).filter("language is not null and phrase is not null")
    return rows.groupBy("language", "phrase").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def mine_candidates(pages: DataFrame, labels: DataFrame, min_count: int = 1) -> DataFrame:
    """phrase_counts over the first contents page of every book with a range and a language."""
    named = labels.filter("toc_start_index is not null and language is not null").select(F.col("key").alias("book"), F.col("toc_start_index").alias("page_index"), "language")
    return phrase_counts(pages.join(named, ["book", "page_index"]), min_count)
