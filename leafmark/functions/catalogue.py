"""Column functions over catalogue and repository records."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD_TYPE = "struct<type:array<string>,isbn:array<string>,title:string,language:array<struct<id:string>>,tableOfContents:array<struct<id:string>>,subject:array<struct<notation:string,source:struct<label:string>>>,id:string>"

# ISO 639-2 to 639-1 codes, and patterns of repository records.
LANGUAGES = {"ger": "de", "eng": "en", "fre": "fr", "fra": "fr", "spa": "es", "ita": "it", "dut": "nl", "nld": "nl", "lat": "la", "rus": "ru"}
ISBN = "<oapen:relationisbn>([0-9Xx-]+)</oapen:relationisbn>"
TITLE = "(?s)<dc:title>(.*?)</dc:title>"
RECORD = "(?s)<record>.*?</record>"
TOKEN = "<resumptionToken[^>]*>([^<]*)</resumptionToken>"
PDF = r"(?i)<dc:identifier>(https?://[^<]+\.pdf)</dc:identifier>"
TITLE_CHARS = 200


def normalize_isbn(raw: Column) -> Column:
    return F.upper(F.replace(raw, F.lit("-"), F.lit("")))


def record_isbn(record: Column) -> Column:
    return normalize_isbn(F.get(record["isbn"], F.lit(0)))


def record_toc_url(record: Column) -> Column:
    urls = F.transform(record["tableOfContents"], lambda x: x["id"])
    return F.get(F.filter(urls, lambda u: u.rlike("(?i)^https?:")), F.lit(0))


def record_matches(record: Column) -> Column:
    book = F.coalesce(F.array_contains(record["type"], "Book"), F.lit(False))
    return book & record_isbn(record).isNotNull() & record_toc_url(record).isNotNull()


def record_language(record: Column) -> Column:
    code = F.nullif(F.element_at(F.split(F.coalesce(F.get(record["language"], F.lit(0))["id"], F.lit("")), "/"), -1), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), code)


def record_volume_type(record: Column) -> Column:
    has = lambda kind: F.coalesce(F.array_contains(record["type"], kind), F.lit(False))
    return F.when(has("EditedVolume"), "edited_volume").when(has("Thesis"), "thesis").otherwise("monograph")


def record_domain_bucket(record: Column) -> Column:
    """Letters of the first RVK notation that has any, else ``unknown``."""
    own = F.filter(record["subject"], lambda s: F.contains(s["source"]["label"], F.lit("RVK")))
    letters = F.transform(own, lambda s: F.regexp_replace(F.get(F.split(s["notation"], " "), F.lit(0)), r"[^\p{L}]", ""))
    return F.coalesce(F.get(F.filter(letters, lambda x: x != ""), F.lit(0)), F.lit("unknown"))


def record_api_url(record: Column) -> Column:
    base = F.nullif(F.regexp_replace(F.coalesce(record["id"], F.lit("")), "[#!]+$", ""), F.lit(""))
    return F.concat(base, F.lit("?format=json"))


def record_features(record: Column) -> Column:
    return F.struct(
        record_isbn(record).alias("isbn"),
        F.coalesce(record["title"], F.lit("")).alias("title"),
        record_language(record).alias("language"),
        record_volume_type(record).alias("volume_type"),
        record_domain_bucket(record).alias("domain_bucket"),
        record_toc_url(record).alias("toc_download_url"),
        record_api_url(record).alias("lobid_url"),
    )


def split_records(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(RECORD), F.lit(0))


def resumption_token(xml: Column) -> Column:
    return F.nullif(F.regexp_extract(xml, TOKEN, 1), F.lit(""))


def parse_oai_record(xml: Column, handle_host: str) -> Column:
    """struct<isbns,handle,title,pdf_urls>; null without an ISBN or a handle of the host."""
    handle_at = rf'<dc:identifier type="URL">https://{re.escape(handle_host)}/handle/([\d.]+/\d+)</dc:identifier>'
    isbns = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(xml, F.lit(ISBN), F.lit(1)), normalize_isbn)))
    title = F.when(xml.rlike(TITLE), F.substring(F.regexp_extract(xml, TITLE, 1), 1, TITLE_CHARS))
    found = F.struct(isbns.alias("isbns"), F.regexp_extract(xml, handle_at, 1).alias("handle"), title.alias("title"), F.regexp_extract_all(xml, F.lit(PDF), F.lit(1)).alias("pdf_urls"))
    return F.when((F.size(isbns) > 0) & xml.rlike(handle_at), found)


def pdf_bitstream(bitstreams: Column, rest_base: Column) -> Column:
    """struct<url,size_bytes,license_code> of the first PDF bitstream, else null."""
    first = F.get(F.filter(bitstreams, lambda b: b["mimeType"] == "application/pdf"), F.lit(0))
    made = F.struct(F.concat(rest_base, first["retrieveLink"]).alias("url"), first["sizeBytes"].alias("size_bytes"), first["code"].alias("license_code"))
    return F.when(first.isNotNull(), made)
