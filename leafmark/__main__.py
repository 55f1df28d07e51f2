"""Command line: ``python -m leafmark harvest | fetch | locate | mine | evaluate | train | find``.

``fetch`` and ``locate`` leave a file for each book, so a run that broke off is taken up where
it ended, and ``locate`` and ``mine`` read what the step before left. ``evaluate`` reports on
left-out books of labelled corpora, ``train`` saves a scorer, and ``find`` gives each layout
file's contents pages by it.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import catalogue as C
from leafmark.functions import rounding
from leafmark.operators import labels as L
from leafmark.operators import boosting, locate, matching, ml
from leafmark.plans import inference, training
from leafmark.sources import files, harvest, pdf, sink

# Fixed value: what label files call the way a range was located.
METHOD = "text_token_ochiai_fixed_window"


def harvested(spark: SparkSession, base: str, sets: str, host: str) -> DataFrame:
    """Records of the sets that have an ISBN and a handle."""
    harvest.register(spark)
    rows = spark.read.format("oai").option("base", base).option("sets", sets).load()
    return rows.select(C.parse_oai_record(F.col("record"), host).alias("r")).filter("r is not null").select("r.*")


def fetched(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """Both files of each book, where they aren't there yet; what became of each book of
    this and earlier runs."""
    entries = spark.read.schema(files.MANIFEST_TYPE).json(manifest)
    there = files.list_files(spark, folder, "*.pdf") if files.there(spark, folder) else spark.createDataFrame([], "path string, name string")
    told = f"{folder.rstrip('/')}.statuses"
    sink.save_files(sink.wanted_files(entries, there), folder, publish="each", errors="report", statuses=told)
    return sink.read_statuses(spark, told) if files.there(spark, told) else spark.createDataFrame([], sink.STATUS_TYPE)


def labelled(spark: SparkSession, folder: str, out: str, again: bool = False, parse=pdf.parse_pages) -> None:
    """A label file for each pair of files that has none yet, or for all of them."""
    done = files.list_files(spark, out, "*.json").select(F.regexp_replace("name", r"\.json$", "").alias("isbn")) if not again and files.there(spark, out) else None
    rows = located(spark, folder, parse, done)
    places = {c: rounding.round_half_even(F.col(c), 4) for c in ("top_score", "margin")}
    found = F.col("status") == "located"
    rows = rows.withColumns(places | {"method": F.when(found, METHOD), "verified": F.when(found, False)})
    sink.save_json(rows.select("isbn", "status", "toc_start_index", "toc_end_index", "top_score", "margin", "method", "verified", "error"), "isbn", out)


def located(spark: SparkSession, folder: str, parse=pdf.parse_pages, but: DataFrame | None = None) -> DataFrame:
    """A label for each pair of files, of whatever status; not for the books (isbn) of ``but``."""
    pairs = matching.file_pairs(files.list_files(spark, folder, "*.pdf"))
    pairs = pairs.join(but, "isbn", "left_anti") if but is not None else pairs
    pages = pdf.read_texts(spark, folder, parse=parse)

    def side(name: str) -> DataFrame:
        return pairs.select(F.col("isbn"), F.col(name).alias("at")).join(pages.withColumnRenamed("book", "at"), "at").select(F.col("isbn").alias("book"), "page_index", "text", "status", "error")

    full, reference = side("fulltext"), side("reference")
    bad = full.unionByName(reference).filter("status = 'error'").groupBy("book").agg(F.min("error").alias("error"))
    good = lambda df: df.join(bad, "book", "left_anti").select("book", "page_index", "text")
    found = locate.locate(good(full), good(reference))
    rows = found.select(F.col("book").alias("isbn"), "status", F.col("start").alias("toc_start_index"), F.col("end").alias("toc_end_index"), "top_score", "margin", F.lit(None).cast("string").alias("error"))
    failed = bad.select(F.col("book").alias("isbn"), F.lit("error").alias("status"), *[F.lit(None).cast(t).alias(c) for c, t in (("toc_start_index", "int"), ("toc_end_index", "int"), ("top_score", "double"), ("margin", "double"))], "error")
    return rows.unionByName(failed)


def mined(spark: SparkSession, folder: str, labels: str, languages: str, min_count: int, parse=pdf.parse_pages) -> DataFrame:
    """Headings of located contents pages, counted by language."""
    listing = files.list_files(spark, folder, "*.fulltext.pdf").select(F.regexp_replace("name", r"\.fulltext\.pdf$", "").alias("isbn"), "path")
    books = files.read_books_manifest(spark, languages).select(F.col("key").alias("isbn"), "language")
    named = L.located_rows(files.read_labels(spark, labels), listing, books)
    pages = pdf.read_texts(spark, folder, parse=parse).filter("status = 'ok'").join(named.select(F.col("pdf_path").alias("book"), "key"), "book")
    return L.mine_candidates(pages.drop("book").withColumnRenamed("key", "book"), named, min_count)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="leafmark")
    tasks = parser.add_subparsers(dest="task", required=True)
    for name, options in {
        "harvest": {"base": None, "sets": None, "host": None, "out": None},
        "locate": {"folder": None, "out": None, "again": 0},
        "mine": {"folder": None, "labels": None, "manifest": None, "out": None, "min-count": 2},
        "fetch": {"manifest": None, "folder": None},
        "evaluate": {"corpora": None, "located": "", "layouts": "", "cache": "", "rebuild": 0, "model": ml.MODELS[0], "rounds": 100, "out": ""},
        "train": {"corpora": None, "located": "", "layouts": "", "cache": "", "rebuild": 0, "model": ml.MODELS[0], "rounds": 100, "out": None},
        "find": {"layouts": None, "model": None, "out": None},
    }.items():
        task = tasks.add_parser(name)
        for option, default in options.items():
            task.add_argument(f"--{option}", required=default is None, default=default, type=type(default) if default is not None else str)
    told = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"leafmark-{told.task}").getOrCreate()
    if told.task == "harvest":
        files.write_lines(harvested(spark, told.base, told.sets, told.host), told.out)
    elif told.task == "locate":
        labelled(spark, told.folder, told.out, bool(told.again))
    elif told.task == "mine":
        files.write_headings(mined(spark, told.folder, told.labels, told.manifest, told.min_count), told.out)
    elif told.task in ("evaluate", "train"):
        rows = training.corpus_features(spark, told.corpora, told.located, told.layouts, told.cache, bool(told.rebuild))
        how = boosting.Growth(rounds=told.rounds)
        if told.task == "train":
            training.fit(rows, told.model, how).save(spark, told.out)
        else:
            per_book, rates, ranks = training.report(rows, told.model, how)
            rates.orderBy("by", "value").show(1000, truncate=False)
            ranks.show()
            if told.out:
                files.write_lines(per_book, told.out)
    elif told.task == "find":
        files.write_lines(inference.locate_files(spark, told.layouts, ml.load_model(spark, told.model)), told.out)
    else:
        matching.tally(fetched(spark, told.manifest, told.folder)).show()


if __name__ == "__main__":
    main()
