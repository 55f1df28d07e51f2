"""Registered queries of the operators that read and write files.

Each writes its files from the driver's tables, in the folder that all executors share,
reads them back with the operator, and is compared with SQL over the tables. Files of
tables that grow are written by Spark; single small files (of the 25 nations) by the driver.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import geometry as G
from leafmark.functions import rounding
from leafmark.operators import labels as L
from leafmark.operators import matching, ml
from leafmark.plans import inference
from leafmark.plans.queries import _BOX, _GAPS, _PER_PAGE, ORACLE_SQL, QUERIES, _parts, _query, _table
from leafmark.sources import alto, files, pdf, sink
from leafmark.storage import scratch

__all__ = ["ORACLE_SQL", "QUERIES"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark, 'files')}/{name}"


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows at every size


# ALTO: 201 parts are a book, nine of them a page; each is a text line of one word. Styles
# are f0 to f4 of 6 to 10 points (f0 stands twice, the last holds), and one that isn't there.
_ALTO_PARTS = 9
_ALTO = _BOX.replace("SELECT book, i, p_partkey, p_type, p_size::DOUBLE AS size,", f"SELECT book, i % {_PER_PAGE} // {_ALTO_PARTS} AS page_index, i, p_partkey, p_type, CASE p_size % 6 WHEN 5 THEN 12 ELSE 6 + p_size % 6 END::DOUBLE AS size,")



def _write_alto(spark: SparkSession, sf_dir: str) -> str:
    place = F.col("i") % _PER_PAGE
    x0, top = (place * 30.0).cast("string"), (F.floor(place / 3) * 20.0 + (F.col("i") % 3) * 1.5).cast("string")
    line = F.format_string(
        '<TextLine VPOS="%s"><String CONTENT="%s" HPOS="%s" VPOS="%s" WIDTH="%s" HEIGHT="12" STYLEREFS="zz f%s"/></TextLine>',
        top, F.col("p_type"), x0, top, (F.col("p_size") * 0.6).cast("string"), (F.col("p_size") % 6).cast("string"),
    )
    lines = _parts(spark, sf_dir).select("book", F.floor(place / _ALTO_PARTS).alias("page"), F.struct("i", line.alias("line")).alias("l"))
    joined = lambda c, f: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x[f]), "")
    page = F.format_string('<Page PHYSICAL_IMG_NR="%s" HEIGHT="800" WIDTH="600"><PrintSpace><TextBlock>%s</TextBlock></PrintSpace></Page>', (F.col("page") + 1).cast("string"), "lines")
    paged = lines.groupBy("book", "page").agg(joined("l", "line").alias("lines")).select("book", F.struct("page", page.alias("xml")).alias("p"))
    styles = '<TextStyle ID="f0" FONTSIZE="99"/><TextStyle FONTSIZE="5"/>' + "".join(f'<TextStyle ID="f{k}" FONTSIZE="{6 + k}"/>' for k in range(5))
    text = F.format_string(f"<alto><Styles>{styles}</Styles><Layout>%s</Layout></alto>", joined("p", "xml"))
    path = _folder(spark, "alto")
    paged.groupBy("book").agg(text.alias("value")).write.partitionBy("book").text(path)
    return path


def _book(file: str = "file"):
    return F.regexp_extract(file, r"/book=(\d+)/", 1).cast("long").alias("book")


@_query("SELECT DISTINCT p_partkey // 201 AS book, k AS style, (6 + k)::DOUBLE AS size FROM part, range(5) t(k)")
def alto_fonts(spark, sf_dir):
    found = alto.font_sizes(spark, _write_alto(spark, sf_dir))
    rows = found.select(_book(), F.explode("fonts").alias("id", "size"))
    return rows.select("book", F.substring("id", 2, 9).cast("long").alias("style"), "size")


@_query(f"WITH {_ALTO} SELECT book, page_index::INT AS page_index, p_type AS text, round(x0, 6) AS x0, round(x1, 6) AS x1, top, top + 12 AS bottom, size FROM w_")
def alto_words(spark, sf_dir):
    pages = alto.read_pages(spark, _write_alto(spark, sf_dir))
    rows = pages.select(_book(), "page_index", F.explode("lines").alias("l")).select("book", "page_index", F.explode("l.words").alias("w"))
    return rows.select("book", "page_index", "w.text", F.round("w.x0", 6).alias("x0"), F.round("w.x1", 6).alias("x1"), "w.top", "w.bottom", "w.size")


_ALTO_LINES = f"""{_ALTO}, g_ AS (SELECT *, (x0 - lag(x1) OVER o) / ((size + lag(size) OVER o) / 2) AS ratio, row_number() OVER o AS n FROM w_ WINDOW o AS (PARTITION BY book, line ORDER BY x0)),
l_ AS (SELECT book, page_index, line, string_agg({_GAPS} || p_type, '' ORDER BY x0) AS text, avg(size) AS size, min(x0) / 600 AS x, min(top) AS top, max(top) + 12 AS bottom FROM g_ GROUP BY book, page_index, line)"""


@_query(f"WITH {_ALTO_LINES} SELECT book, page_index::INT AS page_index, string_agg(text, chr(10) ORDER BY line) AS text FROM l_ GROUP BY book, page_index")
def alto_page_texts(spark, sf_dir):
    """Words of three lines, of which two are one visual line, in reading order."""
    rows = alto.read_pages(spark, _write_alto(spark, sf_dir)).select(_book(), "page_index", F.lit(0).alias("total_pages"), "height", "width", "lines")
    return inference.pages_of_lines(rows).select("book", "page_index", "text")


_ALTO_FEATURES = f"""{_ALTO_LINES}, m_ AS (SELECT book, page_index, round(size, 1) AS modal FROM l_ GROUP BY book, page_index, round(size, 1)
  QUALIFY row_number() OVER (PARTITION BY book, page_index ORDER BY count(*) DESC, min(line)) = 1),
f_ AS (SELECT book, page_index::INT AS page_index, count(*)::DOUBLE AS line_count, max(size) / max(modal) AS ratio, max(size) AS max_size, max(modal) AS modal, avg(x) AS margin, min(top) / 800 AS first, max(bottom) / 800 AS last
  FROM l_ JOIN m_ USING (book, page_index) GROUP BY book, page_index)"""


@_query(f"""WITH {_ALTO_FEATURES} SELECT book, page_index, line_count, round(ratio, 9) AS font_size_max_ratio, round(margin, 6) AS left_margin_mean,
  round(first, 9) AS first_text_vpos_fraction, round(last, 9) AS last_text_vpos_fraction FROM f_""")
def alto_page_features(spark, sf_dir):
    rows = alto.read_pages(spark, _write_alto(spark, sf_dir)).select(_book(), "page_index", F.lit(0).alias("total_pages"), "height", "width", "lines")
    names = {"line_count": 9, "font_size_max_ratio": 9, "left_margin_mean": 6, "first_text_vpos_fraction": 9, "last_text_vpos_fraction": 9}
    return inference.pages_of_lines(rows).select("book", "page_index", *[F.round(c, n).alias(c) for c, n in names.items()])


@_query(f"""WITH {_ALTO_FEATURES}, t_ AS (SELECT book, max(page_index) + 1 AS n FROM f_ GROUP BY book),
k_ AS (SELECT f_.*, n, page_index - row_number() OVER (PARTITION BY book ORDER BY page_index) AS run FROM f_ JOIN t_ USING (book) WHERE page_index < 8 OR page_index >= n - 6),
s_ AS (SELECT book, page_index, run, 1 / (1 + exp(-(-1.0 + (ratio - 1.2) / 0.1 * 0.7 + (least(page_index, n - 1 - page_index) - 3) / 2.0 * 0.4))) AS score FROM k_),
v_ AS (SELECT a.book, a.page_index AS s, b.page_index AS e, round(sum(c.score), 9) AS score FROM s_ a JOIN s_ b ON a.book = b.book AND a.run = b.run AND b.page_index BETWEEN a.page_index AND a.page_index + 5
  JOIN s_ c ON a.book = c.book AND a.run = c.run AND c.page_index BETWEEN a.page_index AND b.page_index GROUP BY ALL)
SELECT book, s::INT AS first, e::INT AS last, round(score, 6) AS score FROM v_ QUALIFY row_number() OVER (PARTITION BY book ORDER BY score DESC, e - s DESC, s) = 1""")
def locate_alto_files(spark, sf_dir):
    """From files to ranges in one plan: scan, text, layout, context, score, windows."""
    model = ml.Linear(["font_size_max_ratio", "edge_distance"], [1.2, 3.0], [0.1, 2.0], [0.7, 0.4], -1.0)
    found = inference.locate_files(spark, _write_alto(spark, sf_dir), model, head=8, tail=6)
    return found.select(_book("book"), F.array_min("pages").alias("first"), F.array_max("pages").alias("last"), F.round("score", 6).alias("score"))


# Labels.
_STATUS = "CASE WHEN c_acctbal > 5000 THEN 'located' WHEN c_acctbal > 0 THEN 'no_candidate' ELSE 'error' END"


def _write_labels(spark: SparkSession, sf_dir: str) -> str:
    rows = _table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) as isbn", f"{_STATUS} as status", "cast(c_custkey % 7 as int) as toc_start_index", "cast(c_custkey % 7 + 2 as int) as toc_end_index", "c_acctbal / 10007.0D as top_score", "c_acctbal / 20011.0D as margin"
    )
    path = _folder(spark, "labels")
    files.write_labels(rows, path)
    return path


@_query(f"""SELECT c_custkey::VARCHAR AS isbn, {_STATUS} AS status, (c_custkey % 7)::INT AS toc_start_index, (c_custkey % 7 + 2)::INT AS toc_end_index,
  round(c_acctbal / 10007.0::DOUBLE, 4) AS top_score, round(c_acctbal / 20011.0::DOUBLE, 4) AS margin FROM customer""")
def label_files(spark, sf_dir):
    """Labels written by status, scores to four places, and scanned again."""
    return files.read_labels(spark, _write_labels(spark, sf_dir), by_line=True).select("isbn", "status", "toc_start_index", "toc_end_index", "top_score", "margin")


@_query("""WITH o AS (SELECT o_custkey::VARCHAR AS isbn, arg_max(substr(o_orderpriority, 1, 1), o_orderkey) AS language FROM orders GROUP BY ALL)
SELECT c_custkey::VARCHAR AS key, '/' || c_custkey AS pdf_path, round(0.3 + least(greatest(round(c_acctbal / 20011.0::DOUBLE, 4), 0), 0.5) / 0.5 * 0.7, 9) AS weight, language
FROM customer LEFT JOIN o ON isbn = c_custkey::VARCHAR WHERE c_acctbal > 5000 AND c_nationkey <> 3""")
def located_labels(spark, sf_dir):
    """Located labels whose full text is listed, with the language of the last manifest row."""
    listing = _table(spark, sf_dir, "customer").filter("c_nationkey <> 3").selectExpr("cast(c_custkey as string) as isbn", "concat('/', c_custkey) as path")
    languages = _table(spark, sf_dir, "orders").selectExpr("cast(o_custkey as string) as isbn", "substr(o_orderpriority, 1, 1) as language", "o_orderkey as ordinal")
    rows = L.located_rows(files.read_labels(spark, _write_labels(spark, sf_dir), by_line=True), listing, languages)
    return rows.select("key", "pdf_path", F.round("weight", 9).alias("weight"), "language")


@_query("""WITH e AS (SELECT o_custkey AS key, o_totalprice AS weight FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT key, weight, 'expected_json' AS source FROM e UNION ALL SELECT c_custkey, c_acctbal, 'dnb_located' FROM customer WHERE c_custkey NOT IN (SELECT key FROM e)""")
def merge_labels_keep_last(spark, sf_dir):
    """Of expected rows with one key the last holds, and hides the located ones."""
    expected = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("weight"), F.lit("expected_json").alias("source"), F.col("o_orderkey").alias("ordinal"))
    located = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("weight"), F.lit("dnb_located").alias("source"))
    return L.merge_labels(expected, located)


def _write_corpora(spark: SparkSession, sf_dir: str) -> str:
    """A folder for each region: a label file and a PDF for each nation, and a manifest."""
    root, books = _folder(spark, "corpora"), {}
    for r in _nations(spark, sf_dir):
        n, at = r["n_nationkey"], f"{root}/region{r['n_regionkey']}"
        toc = {"toc_start_index": n, "toc_end_index": n + 2} if n % 4 else None
        files.put_file(spark, f"{at}/{n}.expected.json", json.dumps({"toc": toc} if n % 7 else {"other": 1}).encode())
        if n % 5:
            files.put_file(spark, f"{at}/{n}.pdf", b"%PDF")
        books.setdefault(at, []).append({"filename": f"{n}.pdf", "isbn": str(n), "language": r["n_name"][:2], "extraction_type": "scan" if n % 2 else "native"})
    for at, found in books.items():
        files.put_file(spark, f"{at}/manifest.json", json.dumps({"books": found}).encode())
    return root


@_query("SELECT DISTINCT 'region' || n_regionkey AS corpus FROM nation")
def corpus_discovery(spark, sf_dir):
    found = files.discover_corpora(spark, _write_corpora(spark, sf_dir))
    return spark.createDataFrame([(x.rstrip("/").rsplit("/", 1)[-1],) for x in found], "corpus string")


@_query("""SELECT n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey END::INT AS toc_start_index, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey + 2 END::INT AS toc_end_index,
  substr(n_name, 1, 2) AS language, 'region' || n_regionkey AS corpus, CASE WHEN n_nationkey % 2 = 1 THEN 'scan' ELSE 'native' END AS extraction_type FROM nation WHERE n_nationkey % 7 <> 0 AND n_nationkey % 5 <> 0""")
def expected_files(spark, sf_dir):
    """Books with a label (a null one counts) and a PDF, over all corpora."""
    rows = None
    for corpus in files.discover_corpora(spark, _write_corpora(spark, sf_dir)):
        found = files.read_expected(spark, corpus)
        rows = found if rows is None else rows.unionByName(found)
    return rows.select("key", "toc_start_index", "toc_end_index", "language", "corpus", "extraction_type")


# Records, manifests, caches.
@_query("SELECT o_custkey::VARCHAR AS isbn, 'h/' || o_orderkey AS handle, o_orderpriority AS title FROM orders")
def record_lines(spark, sf_dir):
    """Harvested records as JSON lines, written and scanned; a missing file adds none."""
    rows = _table(spark, sf_dir, "orders").select(F.array(F.col("o_custkey").cast("string")).alias("isbns"), F.concat(F.lit("h/"), F.col("o_orderkey").cast("string")).alias("handle"), F.col("o_orderpriority").alias("title"))
    path = _folder(spark, "records")
    files.write_lines(rows, path)
    found = files.read_record_lines(spark, path).unionByName(files.read_record_lines(spark, f"{path}-none"))
    return found.select(F.explode("isbns").alias("isbn"), "handle", "title")


@_query("SELECT n_nationkey::VARCHAR AS isbn, n_name AS title, 'http://d.example.org/' || n_regionkey AS toc_download_url FROM nation WHERE n_nationkey % 3 <> 0")
def record_cache(spark, sf_dir):
    """Cached answers, one file each; records that are no books are left out."""
    root = _folder(spark, "cache")
    for r in _nations(spark, sf_dir):
        record = {"type": ["Book"] if r["n_nationkey"] % 3 else ["Serial"], "isbn": [str(r["n_nationkey"])], "title": r["n_name"], "tableOfContents": [{"id": f"http://d.example.org/{r['n_regionkey']}"}]}
        files.put_file(spark, f"{root}/{r['n_nationkey']}.lobid.json", json.dumps(record).encode())
    found = files.read_record_cache(spark, root)
    return matching.usable_records(found).select("isbn", "title", "toc_download_url")


@_query("SELECT n_regionkey || 'X' AS key, max(n_nationkey)::VARCHAR AS title, arg_max(n_name, n_nationkey) AS language, '/books/' || n_regionkey || 'X.pdf' AS pdf_path FROM nation GROUP BY n_regionkey")
def books_manifest(spark, sf_dir):
    """Of a manifest's books with one ISBN, however written, the last."""
    books = [{"isbn": f"{r['n_regionkey']}-{'xX'[r['n_nationkey'] % 2]}", "title": str(r["n_nationkey"]), "language": r["n_name"]} for r in _nations(spark, sf_dir)]
    path = _folder(spark, "manifest") + "/books.json"
    files.put_file(spark, path, json.dumps({"books": books}).encode())
    return files.read_books_manifest(spark, path, "/books/").select("key", "title", "language", "pdf_path")


@_query("""SELECT c_custkey::VARCHAR AS isbn, c_name AS dnb_title, 'https://d.example.org/' || c_custkey AS dnb_toc_download_url, c_mktsegment AS language, max(o_orderkey)::VARCHAR AS oa_handle
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def manifest_rows(spark, sf_dir):
    """Catalogue features joined to the open index, written as lines and read again."""
    index = matching.keep_last(_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("isbn"), "o_orderkey"), "isbn", ["o_orderkey"])
    index = index.select("isbn", F.lit("x").alias("source"), F.col("o_orderkey").cast("string").alias("handle"), F.lit("t").alias("title"), F.lit("u").alias("pdf_url"), F.lit(None).cast("string").alias("license_code"))
    link = F.concat(F.lit("https://d.example.org/"), F.col("c_custkey").cast("string"))
    features = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("isbn"), F.col("c_name").alias("title"), link.alias("toc_download_url"), F.col("c_mktsegment").alias("language"), F.lit("monograph").alias("volume_type"), F.lit("unknown").alias("domain_bucket")
    )
    path = _folder(spark, "entries")
    files.write_lines(matching.manifest_entries(features, index), path)
    return spark.read.schema(files.MANIFEST_TYPE).json(path).select("isbn", "dnb_title", "dnb_toc_download_url", "language", "oa_handle")


@_query("SELECT p_partkey, p_size, 2 AS builds FROM part")
def cached_features(spark, sf_dir):
    """A table built once for its keys, read again for equal keys, built anew for others."""
    parts, path, built = _table(spark, sf_dir, "part").select("p_partkey", "p_size"), _folder(spark, "features"), []

    def build() -> DataFrame:
        built.append(1)
        return parts

    files.cached_table(build, parts.filter("p_size > 10"), "p_partkey", path)
    files.cached_table(build, parts, "p_partkey", path)
    found = files.cached_table(build, parts.select("p_partkey"), "p_partkey", path)
    return found.select("p_partkey", "p_size", F.lit(len(built)).alias("builds"))


@_query("SELECT lower(p_brand) AS language, lower(p_type) AS phrase, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 3")
def headings_file(spark, sf_dir):
    """Mined headings, written by language for review and read again."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_type").alias("text"), F.lower("p_brand").alias("language"))
    path = _folder(spark, "headings")
    files.write_headings(L.phrase_counts(rows, 3), path)
    return spark.read.schema("phrase string, n long, language string").json(path).select("language", "phrase", "n")


@_query("SELECT r_name AS language, lower(n_name) AS word FROM nation JOIN region ON n_regionkey = r_regionkey")
def keyword_file(spark, sf_dir):
    """Headings by language, kept in a file."""
    regions = {r["r_regionkey"]: r["r_name"] for r in _table(spark, sf_dir, "region").collect()}  # five rows at every size
    words: dict[str, list[str]] = {}
    for r in _nations(spark, sf_dir):
        words.setdefault(regions[r["n_regionkey"]], []).append(r["n_name"].lower())
    path = _folder(spark, "keywords") + "/toc.json"
    files.put_file(spark, path, json.dumps(words).encode())
    return spark.createDataFrame([(k, w) for k, some in files.read_keywords(spark, path).items() for w in some], "language string, word string")


@_query("SELECT c_custkey::VARCHAR AS isbn, CASE WHEN c_acctbal > 0 THEN 'located' ELSE 'no_candidate' END AS status, CASE WHEN c_acctbal > 0 THEN c_nationkey END::INT AS toc_start_index, CASE WHEN c_acctbal > 0 THEN format('{:.4f}', c_acctbal / 16384)::DOUBLE END AS top_score FROM customer")
def label_file_each(spark, sf_dir):
    """A label file for each book, of fields that aren't null, published together and read again."""
    some = F.col("c_acctbal") > 0
    rows = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("isbn"), F.when(some, "located").otherwise("no_candidate").alias("status"), F.when(some, F.col("c_nationkey").cast("int")).alias("toc_start_index"),
        F.when(some, rounding.round_half_even(F.col("c_acctbal") / 16384, 4)).alias("top_score"),
    )
    path = _folder(spark, "labels")
    sink.save_json(rows, "isbn", path)
    return files.read_labels(spark, path).select("isbn", "status", "toc_start_index", "top_score")


# PDF: files without pages but with the tables of real ones, and texts behind their end, parted
# by form feeds, that stand for pages. A table of objects, compressed ones, a revision that
# takes pages back, or no table; a nested dictionary before the type.
def _pdf(n_pages: int, kind: int) -> bytes:
    out, places = bytearray(b"%PDF-1.7\n"), {}

    def put(number: int, body: bytes) -> None:
        places[number] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    def tree(n: int) -> bytes:
        return b"<< /Resources << /Font << >> /Count 77 >> /Type /Pages /Kids [] /Count %d >>" % n

    def table(size: int, more: bytes = b"") -> int:
        at = len(out)
        out.extend(b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (k, places[k]) for k in sorted(places)) + b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, more, at))
        return at

    if kind == 1:
        inside = [b"<< /Type /Catalog /Pages 2 0 R >>", tree(n_pages)]
        body = b"1 0 2 %d " % (len(inside[0]) + 1)
        packed = zlib.compress(body + b" ".join(inside))
        put(3, b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(body), len(packed), packed))
        at, fields = len(out), [(0, 0, 255), (2, 3, 0), (2, 3, 1), (1, places[3], 0), (1, len(out), 0)]
        rows, above = b"", bytes(5)
        for a, b, c in fields:
            row = bytes([a]) + b.to_bytes(3, "big") + bytes([c])
            rows, above = rows + b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)), row
        packed = zlib.compress(rows)
        put(4, b"<< /Type /XRef /Size 5 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >> /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed))
        return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % at
    put(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    put(2, tree(n_pages + (9 if kind == 2 else 0)))
    if kind == 3:
        return bytes(out)
    before = table(3)
    if kind == 2:  # a revision with fewer pages
        places.clear()
        put(2, tree(n_pages))
        table(3, b"/Prev %d" % before)
    return bytes(out)


def _write_pdfs(spark: SparkSession, sf_dir: str) -> str:
    root = _folder(spark, "pdfs")
    for r in _nations(spark, sf_dir):
        n = r["n_nationkey"]
        texts = "\f".join(f"{r['n_name']} {k}" for k in range(n % 5 + 1))
        files.put_file(spark, f"{root}/{n}.pdf", b"%broken" if n % 9 == 8 else _pdf(n % 5 + 1, n % 4) + b"%%TEXT\n" + texts.encode())
    return root


def _parse(content: bytes) -> list[str]:
    if content == b"%broken":
        raise ValueError("no pages")
    return content.split(b"%%TEXT\n")[-1].decode().split("\f")


@_query("""SELECT n_nationkey::BIGINT AS book, k::INT AS page_index, n_name || ' ' || k AS text, (n_nationkey % 5 + 1)::INT AS total_pages, 'ok' AS status FROM nation, range(2) t(k) WHERE n_nationkey % 9 <> 8 AND k < n_nationkey % 5 + 1
UNION ALL SELECT n_nationkey, NULL, NULL, 0, 'error' FROM nation WHERE n_nationkey % 9 = 8""")
def pdf_texts(spark, sf_dir):
    """The first two pages of each file, and a row for each file that can't be read."""
    rows = pdf.read_texts(spark, _write_pdfs(spark, sf_dir), 2, _parse)
    return rows.select(F.regexp_extract("book", r"(\d+)\.pdf$", 1).cast("long").alias("book"), "page_index", "text", "total_pages", "status")


def _unread(content: bytes) -> list[str]:
    raise ValueError("pages needn't be read for their number")


@_query("SELECT n_nationkey::BIGINT AS book, CASE WHEN n_nationkey % 9 = 8 THEN 0 ELSE n_nationkey % 5 + 1 END::INT AS total_pages, CASE WHEN n_nationkey % 9 = 8 THEN 'error' ELSE 'ok' END AS status FROM nation")
def pdf_page_counts(spark, sf_dir):
    """Counts by the files' tables, or by their objects; a file that has neither can't be read."""
    rows = pdf.read_page_counts(spark, _write_pdfs(spark, sf_dir), _unread)
    return rows.select(F.regexp_extract("book", r"(\d+)\.pdf$", 1).cast("long").alias("book"), "total_pages", "status")
