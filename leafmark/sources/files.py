"""File sources and sinks: labels, corpora, caches, manifests, models' tables."""

from __future__ import annotations

import os
import urllib.parse
import zlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions.catalogue import RECORD_TYPE
from leafmark.functions.rounding import round_half_even

LABEL_TYPE = "isbn string, status string, toc_start_index int, toc_end_index int, top_score double, margin double, method string, verified boolean, correction_note string, error string"
RECORD_LINE = "isbns array<string>, handle string, title string, pdf_urls array<string>"
MANIFEST_TYPE = "isbn string, dnb_title string, dnb_toc_download_url string, language string, volume_type string, domain_bucket string, oa_source string, oa_handle string, oa_title string, oa_pdf_url string, oa_license_code string"
#: Tasks for each core that read small files.
TASKS = 4
_BOOKS = "struct<books:array<struct<filename:string,isbn:string,language:string,extraction_type:string>>>"


def file_name() -> Column:
    return F.col("_metadata.file_name")


def there(spark: SparkSession, pattern: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, name) of files that have a byte at least, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, in any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_keywords(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Headings by language from a JSON object of arrays; a file that people keep, so small."""
    text = spark.read.option("wholetext", "true").text(path)
    rows = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("language", "words")).collect()
    return {r["language"]: list(r["words"]) for r in rows}


def _folder_of_all(root: str) -> str | None:
    """The folder that a plain path or a ``file:`` address names, if there is one."""
    at = urllib.parse.unquote(urllib.parse.urlsplit(root).path) if root.startswith("file:") else root
    return at if os.path.isabs(at) and os.path.isdir(at) else None


def _texts(spark: SparkSession, folder: str, end: str) -> RDD:
    """The text of each file in ``folder`` itself whose name has this end (hidden ones left
    out). Each task goes through the names and reads those of its share: no listing is
    held anywhere, and a file takes no set-up of its own."""
    parts = TASKS * spark.sparkContext.defaultParallelism

    def read(shares: Iterator[int]) -> Iterator[str]:
        for share in shares:
            with os.scandir(folder) as names:
                for f in names:
                    if f.name.endswith(end) and f.name[0] not in "._" and zlib.crc32(os.fsencode(f.name)) % parts == share and f.is_file():
                        with open(f.path, "rb") as opened:
                            text = opened.read().decode("utf-8-sig", "replace")
                        if text.strip():
                            yield text

    return spark.sparkContext.parallelize(range(parts), parts).mapPartitions(read)


def read_labels(spark: SparkSession, root: str, by_line: bool = False) -> DataFrame:
    """Labels of any status: one of each JSON file, or of each line of what
    :func:`write_labels` wrote. Small files of a shared folder are read by tasks that share the
    names out, other places by Spark's reader."""
    if not by_line and (at := _folder_of_all(root)):
        return spark.read.schema(LABEL_TYPE).json(_texts(spark, at, ".json"))
    return spark.read.schema(LABEL_TYPE).option("multiLine", str(not by_line).lower()).option("pathGlobFilter", "*.json").json(root)


def discover_corpora(spark: SparkSession, root: str) -> list[str]:
    """The folder itself if it holds expected files, else its sub-folders that do, sorted."""
    if there(spark, f"{root}/*.expected.json"):
        return [root]
    if not there(spark, f"{root}/*/*.expected.json"):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*.expected.json")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted({x.getPath().getParent().toString() for x in found})


def read_expected(spark: SparkSession, corpus: str, layouts: bool = False) -> DataFrame:
    """Label rows of a folder of ``<key>.expected.json`` files beside ``<key>.pdf`` (or, with
    ``layouts``, beside ``<key>.xml``: pdf_path is then that file).

    A null ``toc`` is kept (a book known to have none); an absent one isn't.
    """
    texts = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.expected.json").text(corpus)
    toc = F.from_json("value", "toc struct<toc_start_index:int,toc_end_index:int>")["toc"]
    rows = texts.select(F.regexp_replace(file_name(), r"\.expected\.json$", "").alias("key"), F.array_contains(F.json_object_keys("value"), "toc").alias("has"), toc.alias("toc"))
    kind = "xml" if layouts else "pdf"
    pdfs = list_files(spark, corpus, f"*.{kind}").select(F.regexp_replace("name", rf"\.{kind}$", "").alias("key"), F.col("path").alias("pdf_path"))
    rows = rows.filter("has").join(pdfs, "key")
    if there(spark, f"{corpus}/manifest.json"):
        text = spark.read.option("wholetext", "true").text(f"{corpus}/manifest.json")
        books = text.select(F.explode(F.from_json("value", _BOOKS)["books"]).alias("b"))
        books = books.select(F.regexp_replace("b.filename", r"\.[^.]*$", "").alias("key"), "b.language", "b.extraction_type")
    else:
        books = spark.createDataFrame([], "key string, language string, extraction_type string")
    return rows.join(books, "key", "left").select(
        "key",
        "pdf_path",
        "toc.toc_start_index",
        "toc.toc_end_index",
        F.lit(1.0).alias("weight"),
        "language",
        F.lit(corpus.rstrip("/").rsplit("/", 1)[-1]).alias("corpus"),
        F.lit("expected_json").alias("source"),
        "extraction_type",
    )


def read_record_lines(spark: SparkSession, path: str) -> DataFrame:
    """Harvested records, one JSON object a line; a missing file is empty."""
    if not there(spark, path):
        return spark.createDataFrame([], RECORD_LINE)
    return spark.read.schema(RECORD_LINE).json(path)


def read_record_cache(spark: SparkSession, root: str) -> DataFrame:
    """(isbn, record) of ``<isbn>.lobid.json`` files; the ISBN is the file's name."""
    texts = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.lobid.json").text(root)
    return texts.select(F.regexp_replace(file_name(), r"\.lobid\.json$", "").alias("isbn"), F.from_json("value", RECORD_TYPE).alias("record"))


def read_books_manifest(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Books of a manifest; the last of equal ISBNs (normalised) wins. ``pdf_path`` is the
    book's file in ``folder``, or beside the manifest."""
    text = spark.read.option("wholetext", "true").text(path)
    book = "struct<books:array<struct<isbn:string,title:string,language:string,toc_download_url:string,volume_type:string,domain_bucket:string,lobid_url:string,template:string>>>"
    rows = text.select(F.posexplode(F.from_json("value", book)["books"]).alias("at", "b"))
    key = F.upper(F.replace("b.isbn", F.lit("-"), F.lit("")))
    beside = (folder or path.rsplit("/", 1)[0]).rstrip("/")
    last = rows.groupBy(key.alias("key")).agg(F.max_by("b", "at").alias("b"))
    return last.select("key", "b.*", F.concat(F.lit(f"{beside}/"), "key", F.lit(".pdf")).alias("pdf_path"))


def write_labels(labels: DataFrame, path: str) -> None:
    """One folder for each status, a line a book; scores have four places."""
    rounded = {c: round_half_even(F.col(c), 4) for c in ("top_score", "margin") if c in labels.columns}
    labels.withColumns(rounded).write.mode("overwrite").partitionBy("status").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON, one object a line: harvests, manifests, mined headings."""
    rows.write.mode("overwrite").json(path)


def write_headings(counts: DataFrame, path: str) -> None:
    """For review: a folder for each language, a line for each phrase, sorted within a file;
    files are parts of one order by language and phrase."""
    counts.repartitionByRange("language", "phrase").sortWithinPartitions("language", "phrase").write.mode("overwrite").partitionBy("language").json(path)


def key_set(df: DataFrame, key: str) -> tuple[int, str]:
    """A fingerprint of a key column: distinct keys, and a sum of their hashes."""
    row = df.select(key).distinct().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return row["n"], row["h"]


def cached_table(build, keys: DataFrame, key: str, path: str, rebuild: bool = False) -> DataFrame:
    """The table at ``path`` if it was built for just these keys, else ``build()``, kept there."""
    spark = keys.sparkSession
    want = key_set(keys, key)
    if not rebuild and there(spark, f"{path}/keys/_SUCCESS"):
        got = spark.read.schema("n long, h string").json(f"{path}/keys").first()
        if (got["n"], got["h"]) == want:
            return spark.read.parquet(f"{path}/table")
    build().write.mode("overwrite").parquet(f"{path}/table")
    spark.createDataFrame([want], "n long, h string").coalesce(1).write.mode("overwrite").json(f"{path}/keys")
    return spark.read.parquet(f"{path}/table")
