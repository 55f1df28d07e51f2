"""Keyed matching of harvested records: keep-last index, keep-first match, anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import catalogue as C


def exploded(records: DataFrame, isbns_col: str = "isbns") -> DataFrame:
    """One row for each record and distinct ISBN; other columns stay."""
    return records.withColumn("isbn", F.explode(F.array_distinct(F.transform(isbns_col, C.normalize_isbn)))).drop(isbns_col)


def keep_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, and ``first_order``: that of its first row.

    One aggregate, combined before the shuffle: a hot key gathers nothing.
    """
    rest = [c for c in df.columns if c != key]
    row = F.struct(F.struct(*order).alias("o"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(rest)])
    found = df.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("r"), F.min(F.struct(*order)).alias("first_order"))
    return found.select(key, *[F.col(f"r.v{i}").alias(c) for i, c in enumerate(rest)], "first_order")


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(rest)])
    found = df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("r"))
    return found.select(key, *[F.col(f"r.v{i}").alias(c) for i, c in enumerate(rest)])


def open_index(records: DataFrame, source_ranks: dict[str, int]) -> DataFrame:
    """ISBN index over (source, rec_no, isbns, ...): the source with the highest rank
    wins, inside a source the later record; first_order keeps the first place."""
    ranks = F.create_map(*[F.lit(x) for pair in source_ranks.items() for x in pair])
    return keep_last(exploded(records).withColumn("source_rank", F.element_at(ranks, F.col("source"))), "isbn", ["source_rank", "rec_no"])


def match_first(records: DataFrame, books: DataFrame, source_ranks: dict[str, int]) -> DataFrame:
    """Inner match of harvested ISBNs with ``books``: the source of the lowest rank,
    inside it the earlier record; one row for each ISBN. Of equal books the least row is taken."""
    ranks = F.create_map(*[F.lit(x) for pair in source_ranks.items() for x in pair])
    first = keep_first(exploded(records).withColumn("source_rank", F.element_at(ranks, F.col("source"))), "isbn", ["source_rank", "rec_no"])
    return first.join(keep_first(books, "isbn", [c for c in books.columns if c != "isbn"]), "isbn")


def unseen(index: DataFrame, seen: DataFrame, seed: int, key: str = "isbn") -> DataFrame:
    """Index rows not in ``seen`` with ``draw``, a seeded order (a hash: not the
    order of any other implementation's shuffle)."""
    return index.join(seen.select(key).distinct(), key, "left_anti").withColumn("draw", F.xxhash64(F.col(key), F.lit(seed)))


def pdf_link(bitstream_url: Column, pdf_urls: Column) -> Column:
    """struct<url,provenance>: the repository's bitstream, else the first harvested link."""
    harvested = F.get(pdf_urls, F.lit(0))
    origin = F.when(bitstream_url.isNotNull(), "bitstream").when(harvested.isNotNull(), "oai")
    return F.struct(F.coalesce(bitstream_url, harvested).alias("url"), origin.alias("provenance"))


def usable_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Features of the records that are books with an ISBN and a contents link."""
    return records.filter(C.record_matches(F.col(record_col))).select(C.record_features(F.col(record_col)).alias("f")).select("f.*")


def manifest_entries(features: DataFrame, index: DataFrame) -> DataFrame:
    """Manifest rows of features whose ISBN is in the open index; ``index`` has source,
    handle, title, pdf_url and license_code. Further columns of features stay."""
    open_ = index.select("isbn", F.col("source").alias("oa_source"), F.col("handle").alias("oa_handle"), F.col("title").alias("oa_title"), F.col("pdf_url").alias("oa_pdf_url"), F.col("license_code").alias("oa_license_code"))
    more = [c for c in features.columns if c not in ("isbn", "title", "toc_download_url", "language", "volume_type", "domain_bucket", "lobid_url")]
    named = features.select("isbn", F.col("title").alias("dnb_title"), F.col("toc_download_url").alias("dnb_toc_download_url"), "language", "volume_type", "domain_bucket", *more)
    return named.join(open_, "isbn")


def file_pairs(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """(isbn, reference, fulltext) for files ``<isbn>.dnb_toc.pdf`` that have a
    ``<isbn>.fulltext.pdf``."""
    name = F.element_at(F.split(path_col, "/"), -1)
    kinds = {"reference": r"^(.+)\.dnb_toc\.pdf$", "fulltext": r"^(.+)\.fulltext\.pdf$"}
    sides = [listing.filter(name.rlike(p)).select(F.regexp_extract(name, p, 1).alias("isbn"), F.col(path_col).alias(k)) for k, p in kinds.items()]
    return sides[0].join(sides[1], "isbn")


def to_fetch(manifest: DataFrame, listing: DataFrame, path_col: str = "path") -> DataFrame:
    """Manifest rows with both links of which not both files are there yet."""
    done = file_pairs(listing, path_col).select("isbn")
    return manifest.filter("dnb_toc_download_url is not null and oa_pdf_url is not null and dnb_toc_download_url <> '' and oa_pdf_url <> ''").join(done, "isbn", "left_anti")


def tally(statuses: DataFrame, status_col: str = "status") -> DataFrame:
    return statuses.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))
