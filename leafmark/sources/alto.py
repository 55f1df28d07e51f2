"""ALTO XML scans: pages of text lines of word boxes, through Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STRING = "array<struct<_CONTENT:string,_HPOS:string,_VPOS:string,_WIDTH:string,_HEIGHT:string,_STYLEREFS:string>>"
_LINE = f"array<struct<_VPOS:string,String:{_STRING}>>"
PAGE = f"_PHYSICAL_IMG_NR string, _HEIGHT string, _WIDTH string, PrintSpace struct<TextBlock:array<struct<TextLine:{_LINE}>>>"
STYLE = "_ID string, _FONTSIZE string"


def _number(text: Column) -> Column:
    """A missing or empty attribute is 0.0."""
    return F.coalesce(F.nullif(text, F.lit("")).cast("double"), F.lit(0.0))


def font_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, fonts): each file's map of style id to size, the last of equal ids; styles
    without an id are dropped."""
    rows = spark.read.format("xml").option("rowTag", "TextStyle").schema(STYLE).load(path)
    # Rows of one block of a file are read in order by one task.
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_ID").alias("id"), _number(F.col("_FONTSIZE")).alias("size"), place.alias("place")).filter("id is not null and id <> ''")
    last = rows.groupBy("file", "id").agg(F.max_by("size", "place").alias("size"))
    return last.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("id", "size"))).alias("fonts"))


def word(s: Column, fonts: Column) -> Column:
    """A word box; its size is that of the first style with one, else its own height."""
    x0, top, height = _number(s["_HPOS"]), _number(s["_VPOS"]), _number(s["_HEIGHT"])
    sizes = F.transform(F.split(F.coalesce(s["_STYLEREFS"], F.lit("")), r"\s+"), lambda r: F.try_element_at(fonts, r))
    size = F.coalesce(F.get(F.filter(sizes, lambda x: x > 0), F.lit(0)), height)
    return F.struct(
        F.coalesce(s["_CONTENT"], F.lit("")).alias("text"), x0.alias("x0"), (x0 + _number(s["_WIDTH"])).alias("x1"), top.alias("top"), (top + height).alias("bottom"), size.alias("size")
    )


def text_lines(blocks: Column, fonts: Column) -> Column:
    """array<struct<top,words>>: lines that have a word with content; a line's place is
    its own VPOS attribute, else its first word's."""
    every = F.flatten(F.transform(F.coalesce(blocks, F.array().cast(f"array<struct<TextLine:{_LINE}>>")), lambda b: F.coalesce(b["TextLine"], F.array().cast(_LINE))))

    def line(x: Column) -> Column:
        words = F.filter(F.transform(F.coalesce(x["String"], F.array().cast(_STRING)), lambda s: word(s, fonts)), lambda w: w["text"] != "")
        top = F.coalesce(F.nullif(x["_VPOS"], F.lit("")).cast("double"), F.get(words, F.lit(0))["top"])
        return F.struct(top.alias("top"), words.alias("words"))

    return F.filter(F.transform(every, line), lambda x: F.size(x["words"]) > 0)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_index, height, width, lines) of every page of the files."""
    rows = spark.read.format("xml").option("rowTag", "Page").schema(PAGE).load(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), "*").join(font_sizes(spark, path), "file", "left")
    fonts = F.coalesce("fonts", F.expr("cast(map() as map<string,double>)"))
    return rows.select(
        "file",
        (F.coalesce(F.nullif("_PHYSICAL_IMG_NR", F.lit("")).cast("int"), F.lit(0)) - 1).alias("page_index"),
        _number(F.col("_HEIGHT")).alias("height"),
        _number(F.col("_WIDTH")).alias("width"),
        text_lines(F.col("PrintSpace.TextBlock"), fonts).alias("lines"),
    )
