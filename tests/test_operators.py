"""Table operators, sources and plans against hand-made vectors and plain Python."""

import ast
import http.server
import inspect
import json
import random
import threading
import urllib.parse
from datetime import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmark import __main__ as cli
from leafmark.functions import geometry as G
from leafmark.operators import labels as L
from leafmark.operators import boosting, locate, matching, metrics, ml, pages, sampling
from leafmark.plans import discovery, file_queries, inference
from leafmark.plans import queries as Q
from leafmark.sources import alto, files, harvest, pdf, sink
from leafmark.streaming import events
from tests.conftest import SF


def test_runs_and_scans(spark):
    """Random page sets and scans against sets in plain Python."""
    rng, rows, want = random.Random(21), [], set()
    for book in "pqrs":
        there = sorted(rng.sample(range(60), rng.randint(1, 40)))
        rows += [(book, i) for i in there]
        starts = [i for i in there if i - 1 not in there]
        want |= {(book, i, next(j for j in range(i, 99) if j + 1 not in there)) for i in starts}
    df = spark.createDataFrame(rows, "book string, page_index int").repartition(3)
    assert {tuple(r) for r in pages.runs(df).collect()} == want
    for _ in range(6):
        n, head, tail = rng.randint(1, 25), rng.choice([None, rng.randint(0, 14)]), rng.choice([None, rng.randint(0, 14)])
        df = spark.range(n).select(F.lit("b").alias("book"), F.col("id").cast("int").alias("page_index"), F.lit(n).alias("total_pages"))
        every = set(range(n))
        kept = every if head is tail is None else set(range(min(n, head or 0))) | set(range(max(0, n - (tail or 0)), n))
        assert {r["page_index"] for r in pages.scan_head_tail(df, head, tail).collect()} == kept


def test_blank_pages(spark):
    some = spark.createDataFrame([("b", 0, 4.0, "x"), ("b", 2, 5.0, "y")], "book string, page_index int, line_count double, text string")
    books = spark.createDataFrame([("b", 3), ("none", 0)], "book string, total_pages int")
    rows = {r["page_index"]: (r["line_count"], r["text"]) for r in pages.fill_blank(some, books).collect()}
    assert rows == {0: (4.0, "x"), 1: (0.0, ""), 2: (5.0, "y")}


def test_book_context(spark):
    rows = [("b", 0, 5, 40.0, 12.0, 10.0), ("b", 1, 5, 20.0, 10.0, 10.0), ("b", 2, 5, 20.0, 10.0, 10.0), ("e", 0, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "book string, page_index int, total_pages int, line_count double, max_font_size double, modal_font_size double")
    got = {(r["book"], r["page_index"]): (r["line_count_rel"], r["font_size_max_ratio_book"], r["edge_distance"]) for r in pages.book_context(df).collect()}
    assert got == {("b", 0): (2.0, 1.2, 0.0), ("b", 1): (1.0, 1.0, 1.0), ("b", 2): (1.0, 1.0, 2.0), ("e", 0): (0.0, 1.0, 0.0)}


def test_number_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), x) for x in rng.sample(range(10**6), 500)]
    got = pages.number_rows(spark.createDataFrame(rows, "g string, o long"), "g", "o", "n", ranges=7).collect()
    for g in "ab":
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"])] == list(range(sum(x == g for x, _ in rows)))


def test_fixed_window(spark):
    """Random scores, with ties and zeros, of books and windows of any length."""
    rng, rows, want = random.Random(22), [], {}
    for n in [1, 2, 3, *(rng.randint(4, 40) for _ in range(25))]:
        book, w, steps = f"b{n}-{len(want)}", rng.randint(1, 9), rng.choice([1, 3, 50])
        values = [rng.randint(0, steps) / steps for _ in range(n)] if rng.random() < 0.9 else [0.0] * n
        rows += [(book, i, v, w) for i, v in enumerate(values)]
        w = min(w, n)
        means = [round(sum(values[i : i + w]) / w, 9) for i in range(n - w + 1)]
        top = means.index(max(means))
        if max(values) > 0:
            second = max((m for i, m in enumerate(means) if abs(i - top) >= w), default=0.0)
            want[book] = (top, top + w - 1, means[top], second)
    df = spark.createDataFrame(rows, "book string, page_index int, score double, w int")
    got = {r["book"]: tuple(r)[1:] for r in locate.fixed_window(df, F.col("w")).collect()}
    assert {b: r[:2] for b, r in got.items()} == {b: r[:2] for b, r in want.items()}
    assert all(np.allclose(got[b][2:], (*want[b][2:], want[b][2] - want[b][3])) for b in want)


def test_locate_statuses(spark):
    rows = [("b", i, t) for i, t in enumerate(["alpha beta", "gamma delta epsilon", "zeta eta", "gamma delta"])] + [("c", 0, "x"), ("d", 0, "other words here")]
    reference = [("b", 0, "gamma delta epsilon"), ("c", 0, " 12 "), ("d", 0, "nothing shared")]
    kind = "book string, page_index int, text string"
    got = {r["book"]: (r["status"], r["start"], r["end"]) for r in locate.locate(spark.createDataFrame(rows, kind), spark.createDataFrame(reference, kind)).collect()}
    assert got == {"b": ("located", 1, 1), "c": ("reference_has_no_text", None, None), "d": ("no_candidate", None, None)}


def test_evaluation_against_model(spark):
    """Hits of chosen ranges by sets of pages; a book without a true page has no row."""
    rng, rows, labels = random.Random(23), [], {}
    for b in range(12):
        n = rng.randint(8, 40)
        lo = rng.randint(0, n - 1)
        labels[f"b{b}"] = set(range(lo, min(n, lo + rng.randint(1, 6)))) if b else set()
        rows += [(f"b{b}", 2 * i + 1, rng.randint(0, 99) / 99, i in labels[f"b{b}"]) for i in range(n)]
    df = spark.createDataFrame(rows, "book string, page_index int, score double, label boolean")
    got = {r["book"]: r for r in inference.evaluate(df).collect()}
    assert set(got) == {b for b, true in labels.items() if true}
    for book, row in got.items():
        values = [v for b, _, v, _ in rows if b == book]
        ranges: list[set[int]] = []
        windows = sorted(((-round(sum(values[i : i + w]), 9), -w, i) for w in range(1, 7) for i in range(len(values) - w + 1)))
        for _, w, i in windows:
            pages_ = set(range(i, i - w))
            if len(ranges) < 3 and not any(pages_ & r for r in ranges):
                ranges.append(pages_)
        true, order = labels[book], sorted(range(len(values)), key=lambda i: (-values[i], i))
        want = (true <= ranges[0], any(true <= r for r in ranges), bool(true & ranges[0]), any(true & r for r in ranges), 1 + min(order.index(i) for i in true))
        assert (row["top1_hit"], row["top3_hit"], row["top1_overlap"], row["top3_overlap"], row["best_true_page_rank"]) == want
    none = inference.evaluate(df.withColumn("label", F.lit(False)))
    assert none.count() == 0 and metrics.rank_summary(none).first()["median_rank"] is None


def test_separate_runs(spark):
    names = ml.FEATURES
    model = ml.Linear(["f"], [0.0], [1.0], [1.0], 0.0)
    logit = lambda p: float(np.log(p / (1 - p)))
    rows = [("b", i, 12, p) for i, p in ((0, 0.1), (1, 0.9), (10, 0.9), (11, 0.1))]
    df = spark.createDataFrame([(b, i, n, logit(p)) for b, i, n, p in rows], "book string, page_index int, total_pages int, f double")
    windows = locate.window_sums(pages.with_runs(model.transform(df)), keys=("book", "run_start"))
    best = locate.best_range(windows).first()
    assert (best["start"], best["end"]) == (0, 1) and len(names) == 15


def test_locate_pages_end_to_end(spark):
    """Pages of word boxes with a contents page, to its index."""

    def line(text, page, top):
        words, x = [], 10.0
        for w in text.split(" "):
            words.append((w, x, x + 5.0 * len(w), top, top + 10.0, 10.0))
            x += 5.0 * len(w) + 3
        if page:
            words.append((str(page), 500.0, 510.0, top, top + 10.0, 10.0))
        return (top, words)

    prose = [line("plain words of a chapter run on here", 0, 20.0 * k) for k in range(12)]
    contents = [line("Contents", 0, 0.0), *[line(f"Chapter number {k}", 10 * k, 20.0 * k) for k in range(1, 9)]]
    rows = [("b", i, 8, 800.0, 600.0, contents if i == 2 else prose) for i in range(8)]
    df = spark.createDataFrame(rows, f"book string, page_index int, total_pages int, height double, width double, lines array<{G.LINE_TYPE}>")
    page_rows = inference.pages_of_lines(df).cache()
    assert "Chapter number 3  30" in {r["page_index"]: r["text"] for r in page_rows.collect()}[2]
    model = ml.Linear(["toc_line_ratio", "keyword_hit_any_language"], [0.5, 0.5], [0.1, 0.5], [2.0, 1.0], 0.0)
    found = inference.locate_pages(page_rows, model).first()
    assert 2 in found["pages"]
    assert inference.locate_pages(page_rows.limit(0), model).count() == 0
    table = inference.feature_table(page_rows)
    assert set(ml.FEATURES) <= set(table.columns)


def taken(rows, caps, target):
    """Plain model of the sampler: indices of the rows taken, each checked against all before."""
    out = []
    for i, row in enumerate(rows):
        if len(out) < target and all(v is None or sum(rows[j][d] == v for j in out) < caps[d] for d, v in enumerate(row)):
            out.append(i)
    return out


@pytest.mark.parametrize("ahead", [1, 8])
def test_samplers_against_model(spark, ahead):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice("xyzw")) for _ in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a string, b string")
    for target, fa, fb in ((60, 0.3, 0.4), (40, 0.01, 0.5), (1, 0.5, 0.5), (390, 0.9, 0.2)):
        want = taken(rows, [sampling.cap(target, fa), sampling.cap(target, fb)], target)
        assert sorted(r["i"] for r in sampling.sample_many(df, {"a": fa, "b": fb}, "i", target, ahead).collect()) == want
        want = taken([r[:1] for r in rows], [sampling.cap(target, fa)], target)
        assert sorted(r["i"] for r in sampling.sample_one(df, "a", "i", target, fa).collect()) == want
    assert sampling.sample_many(df.limit(0), {"a": 0.5}, "i", 5).count() == 0 and sampling.sample_many(df, {}, "i", 3).count() == 3


def test_sampler_takes_thousands(spark):
    """More than a driver's loop would go through at once, with text for an order."""
    rng = random.Random(15)
    rows = [(f"{i:06d}", rng.choice("aab"), rng.choice("uvwxyz") if i % 7 else None, rng.randint(0, 400)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "i string, a string, b string, c int").repartition(4)
    caps, used, want = [sampling.cap(4000, f) for f in (0.5, 0.2, 0.003)], {}, []
    for i, *values in rows:
        counted = [(d, v) for d, v in enumerate(values) if v is not None]
        if len(want) < 4000 and all(used.get(c, 0) < caps[c[0]] for c in counted):
            want.append(i)
            used |= {c: used.get(c, 0) + 1 for c in counted}
    got = sampling.sample_many(df, {"a": 0.5, "b": 0.2, "c": 0.003}, "i", 4000, ahead=2)
    assert sorted(r["i"] for r in got.collect()) == want


def test_keep_first_and_last(spark):
    rows = [("x", 1, ["9-1"], "h1"), ("x", 2, ["9-1", "92"], "h2"), ("y", 1, ["91"], "h3"), ("y", 2, ["93"], "h4")]
    df = spark.createDataFrame(rows, "source string, rec_no long, isbns array<string>, handle string")
    last = {r["isbn"]: r["handle"] for r in matching.open_index(df, {"y": 0, "x": 1}).collect()}
    assert last == {"91": "h2", "92": "h2", "93": "h4"}
    books = spark.createDataFrame([("91", "A"), ("93", "B"), ("99", "C")], "isbn string, name string")
    first = {r["isbn"]: (r["handle"], r["name"]) for r in matching.match_first(df, books, {"x": 0, "y": 1}).collect()}
    assert first == {"91": ("h1", "A"), "93": ("h4", "B")}


def test_fetch_plan(spark):
    listing = spark.createDataFrame([("/p/1.dnb_toc.pdf",), ("/p/1.fulltext.pdf",), ("/p/2.dnb_toc.pdf",)], "path string")
    manifest = spark.createDataFrame([("1", "u", "v"), ("2", "u", "v"), ("3", "u", None), ("4", "", "v")], "isbn string, dnb_toc_download_url string, oa_pdf_url string")
    assert [r["isbn"] for r in matching.to_fetch(manifest, listing).collect()] == ["2"]


def test_label_files(spark, tmp_path):
    tmp_path = tmp_path / "corpus"
    tmp_path.mkdir()
    for name, value in {"a": {"toc": {"toc_start_index": 1, "toc_end_index": 2}}, "b": {"toc": None}, "c": {}, "d": {"toc": None}}.items():
        (tmp_path / f"{name}.expected.json").write_text(json.dumps(value))
        if name != "d":
            (tmp_path / f"{name}.pdf").write_bytes(b"%PDF")
    (tmp_path / "manifest.json").write_text(json.dumps({"books": [{"filename": "a.pdf", "language": "de", "extraction_type": "scan"}]}))
    rows = {r["key"]: r for r in files.read_expected(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"} and rows["b"]["toc_start_index"] is None
    assert (rows["a"]["toc_start_index"], rows["a"]["language"], rows["a"]["corpus"]) == (1, "de", tmp_path.name)
    assert files.discover_corpora(spark, str(tmp_path)) == [str(tmp_path)]
    assert [p.rsplit("/", 1)[-1] for p in files.discover_corpora(spark, str(tmp_path.parent))] == [tmp_path.name]
    assert files.discover_corpora(spark, str(tmp_path / "none")) == []


def test_merge_and_label(spark):
    expected = spark.createDataFrame([("1", 1.0, "expected_json"), ("9", 1.0, "expected_json")], "key string, weight double, source string")
    located = spark.createDataFrame([("1", 0.4, "dnb_located"), ("2", 0.5, "dnb_located")], "key string, weight double, source string")
    assert {r["key"]: r["source"] for r in L.merge_labels(expected, located).collect()} == {"1": "expected_json", "9": "expected_json", "2": "dnb_located"}
    labels = spark.createDataFrame([("i1", "located", 2, 3, 0.25), ("i2", "no_candidate", None, None, None)], "isbn string, status string, toc_start_index int, toc_end_index int, margin double")
    rows = L.located_rows(labels).collect()
    assert len(rows) == 1 and abs(rows[0]["weight"] - 0.65) < 1e-12
    book = spark.createDataFrame([("i1", i, "Inhalt" if i == 2 else "x") for i in range(5)], "book string, page_index int, text string")
    marked = L.label_pages(book, L.located_rows(labels)).collect()
    assert sorted(r["page_index"] for r in marked if r["label"]) == [2, 3]
    named = L.located_rows(labels).withColumn("language", F.lit("de"))
    assert [tuple(r) for r in L.mine_candidates(book, named).collect()] == [("de", "inhalt", 1)]
    assert L.mine_candidates(book, L.located_rows(labels)).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "located", 0.123456, 0.1), ("2", "error", None, None)], "isbn string, status string, top_score double, margin double")
    files.write_labels(df, str(tmp_path / "out"))
    back = {r["isbn"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back["1"]["top_score"] == 0.1235 and back["2"]["status"] == "error"
    assert files.read_record_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    built = []

    def build():
        built.append(1)
        return df

    for keys in (df, df, df.limit(1)):
        files.cached_table(build, keys, "isbn", str(tmp_path / "cache"))
    assert len(built) == 2
    counts = spark.createDataFrame([("de", "inhalt", 2), ("de", "abc", 1)], "language string, phrase string, n long")
    files.write_headings(counts, str(tmp_path / "h"))
    lines = next((tmp_path / "h" / "language=de").glob("part*")).read_text().splitlines()
    assert list(map(json.loads, lines)) == [{"phrase": "abc", "n": 1}, {"phrase": "inhalt", "n": 2}]


ALTO = """<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><Styles><TextStyle ID="f0" FONTSIZE="9.5"/><TextStyle FONTSIZE="7"/></Styles><Layout>
<Page ID="p1" PHYSICAL_IMG_NR="3" WIDTH="600" HEIGHT="800"><PrintSpace>
<TextBlock><TextLine HPOS="1" VPOS="100"><String CONTENT="Foreword" HPOS="10" VPOS="100" WIDTH="40" HEIGHT="8" STYLEREFS="x f0"/></TextLine></TextBlock>
<TextBlock><TextLine VPOS="100.4"><String CONTENT="7" HPOS="300" VPOS="99" WIDTH="5" HEIGHT="8"/></TextLine><TextLine VPOS="120"><String CONTENT="" HPOS="1" VPOS="120"/></TextLine></TextBlock>
<TextBlock><TextLine><String CONTENT="Real" VPOS="0" WIDTH="5" HEIGHT="6"/></TextLine></TextBlock></PrintSpace></Page>
<Page PHYSICAL_IMG_NR="4" WIDTH="600" HEIGHT="800"><PrintSpace/></Page></Layout></alto>"""


def test_alto(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ALTO)
    rows = {r["page_index"]: r for r in alto.read_pages(spark, str(tmp_path)).collect()}
    lines = rows[2]["lines"]
    assert [w["text"] for line in lines for w in line["words"]] == ["Foreword", "7", "Real"]
    assert [line["top"] for line in lines] == [100.0, 100.4, 0.0]
    assert [w["size"] for line in lines for w in line["words"]] == [9.5, 8.0, 6.0]
    assert rows[3]["lines"] == [] and rows[2]["height"] == 800.0
    page = alto.read_pages(spark, str(tmp_path)).select(F.col("file").alias("book"), "page_index", F.lit(5).alias("total_pages"), "height", "width", "lines")
    texts = {r["page_index"]: r["text"] for r in inference.pages_of_lines(page).collect()}
    assert texts[2] == "Real\nForeword  7" and texts[3] == ""


def test_pdf_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two|three")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def parse(content):
        if content == b"bad":
            raise ValueError("no pages")
        return content.decode().split("|")

    rows = pdf.read_texts(spark, str(tmp_path), 2, parse).collect()
    good = [(r["page_index"], r["text"], r["total_pages"]) for r in rows if r["status"] == "ok"]
    assert sorted(good) == [(0, "one", 3), (1, "two", 3)] and [r["error"] for r in rows if r["status"] == "error"] == ["no pages"]


class Repository(http.server.BaseHTTPRequestHandler):
    """Answers of three records each, and a failure before every second one."""

    failed: set = set()

    def do_GET(self):
        asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
        at = int(asked.get("resumptionToken", "s@0").split("@")[1])
        if at % 2 and at not in self.failed:
            self.failed.add(at)
            return self.send_error(503)
        name = asked.get("set") or asked["resumptionToken"].split("@")[0]
        records = "".join(f"<record>{name}{3 * at + k}\n</record>" for k in range(3))
        body = f"<x>{records}<resumptionToken a='1'>{f'{name}@{at + 1}' if at < 3 else ''}</resumptionToken></x>".encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def repository():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Repository)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/oai"
    server.shutdown()


def test_harvest_as_a_source(spark, repository, tmp_path):
    harvest.register(spark)
    options = {"base": repository, "pause": "0"}
    rows = spark.read.format("oai").options(**options, sets="s,t").load().collect()
    want = {(name, n, f"<record>{name}{n}\n</record>") for name in "st" for n in range(12)}
    assert len(rows) == 24 and {tuple(r) for r in rows} == want


def test_harvest_stream_of_many_sets(spark, repository, tmp_path):
    """Three sets side by side; stopped after a batch and started again, and with a lost note:
    every record once, numbered within its set."""
    harvest.register(spark)
    options = {"base": repository, "pause": "0", "sets": "s,t,u", "notes": str(tmp_path / "notes")}

    def run(until: int | None) -> None:
        stream = spark.readStream.format("oai").options(**options).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        while until and query.lastProgress is None or until and query.lastProgress["batchId"] < until:
            query.awaitTermination(0.05)
        if until is None:
            query.processAllAvailable()
        query.stop()

    run(1)
    some = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < some <= 36
    newest = sorted((tmp_path / "notes" / "s").glob("[0-9]*.json"), key=lambda p: int(p.stem))
    if some < 36:
        newest[-1].unlink()
    run(None)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {(name, n, f"<record>{name}{n}\n</record>") for name in "stu" for n in range(12)}
    assert len(rows) == 36 and {tuple(r) for r in rows} == want
    reader = harvest.OaiSource(options).streamReader(None)
    assert reader.latestOffset() == {"s": 4, "t": 4, "u": 4} and reader.partitions(reader.latestOffset(), reader.latestOffset()) == []
    assert {p.of for p in reader.partitions(reader.initialOffset(), {"s": 2, "t": 1, "u": 0})} == {"s", "t"}
    with pytest.raises(ValueError, match="notes"):
        harvest.OaiSource({"base": "b", "sets": "s"}).streamReader(None)


def test_command_line_tasks(spark, repository, tmp_path, monkeypatch):
    """Harvest, locate and mine over small folders, pages parted by form feeds."""
    books = tmp_path / "books"
    books.mkdir()
    pages = ["cover of it", "Inhalt\nrope knots 3\nsails and masts 9", "rope and more rope", "masts"]
    (books / "b1.fulltext.pdf").write_text("\f".join(pages))
    (books / "b1.dnb_toc.pdf").write_text("rope knots 3 sails and masts 9")
    (books / "b2.fulltext.pdf").write_text("\f".join(pages))
    (books / "b2.dnb_toc.pdf").write_text("bad")
    (books / "b3.fulltext.pdf").write_text("alone")
    (books / "books.json").write_text(json.dumps({"books": [{"isbn": "b-1", "language": "de"}, {"isbn": "B1", "language": "de"}]}))

    def parse(content):
        if content == b"bad":
            raise ValueError("no pages")
        return content.decode().split("\f")

    rows = {r["isbn"]: r for r in cli.located(spark, str(books), parse).collect()}
    assert (rows["b1"]["status"], rows["b1"]["toc_start_index"], rows["b1"]["toc_end_index"]) == ("located", 1, 1)
    assert (rows["b2"]["status"], rows["b2"]["error"]) == ("error", "no pages") and set(rows) == {"b1", "b2"}
    labels = cli.located(spark, str(books), parse).withColumn("isbn", F.upper("isbn"))
    sink.save_json(labels, "isbn", str(tmp_path / "labels"))
    for name in ("b1.fulltext.pdf", "b2.fulltext.pdf"):
        (books / name).rename(books / name.replace("b", "B", 1))
    found = cli.mined(spark, str(books), str(tmp_path / "labels"), str(books / "books.json"), 1, parse).collect()
    assert [tuple(r) for r in found] == [("de", "inhalt", 1)]
    assert cli.harvested(spark, repository, "s", "library.example.org").count() == 0
    monkeypatch.setattr(cli.SparkSession.builder, "getOrCreate", lambda: spark)
    cli.main(["harvest", "--base", repository, "--sets", "s", "--host", "x", "--out", str(tmp_path / "out")])
    assert (tmp_path / "out" / "_SUCCESS").exists()


def test_patience():
    waits = []

    def down(request, timeout):
        raise TimeoutError(timeout)

    with pytest.raises(TimeoutError):
        harvest.fetch("http://x.example.org", harvest.Patience((0.5, 1.0, 7.0), 3, waits.append), down)
    assert waits == [0.5, 1.0, 7.0]


def test_lookups(spark):
    def get(url):
        if "bad" in url:
            raise ValueError("down")
        if "search" in url:
            return json.dumps({"member": [{"id": url}] if "9" in url else []}).encode()
        return json.dumps({"bitstreams": [{"mimeType": "text/xml"}, {"mimeType": "application/pdf", "retrieveLink": "/f", "sizeBytes": 3, "code": "CC"}]}).encode()

    rows = {r["isbn"]: r for r in harvest.search_records(spark.createDataFrame([("9",), ("1",), ("bad",)], "isbn string"), "u", get).collect()}
    assert (rows["9"]["status"], rows["1"]["status"], rows["bad"]["error"]) == ("ok", "none", "down")
    row = harvest.resolve_bitstreams(spark.createDataFrame([("1/2",)], "handle string"), "https://r", get).first()
    assert json.loads(row["answer"]) == {"url": "https://r/f", "size_bytes": 3, "license_code": "CC"}


def test_discovery_takes_up_where_it_broke_off(spark):
    def answer(isbn):
        kind = "Book" if int(isbn) % 5 else "Serial"
        return {"type": [kind], "isbn": [isbn], "title": f"T{isbn}", "language": [{"id": f"x/{['ger', 'eng'][int(isbn) % 2]}"}], "tableOfContents": [{"id": "http://d.example.org/1"}]}

    asked = []

    def get(url):
        isbn = url.split("isbn:")[1].split("&")[0]
        if isbn == "7":
            raise ValueError("down")
        return json.dumps({"member": [answer(isbn)]}).encode()

    index = spark.createDataFrame([(str(i), "oapen", f"h{i}", f"t{i}", "u", None) for i in range(1, 40)], "isbn string, source string, handle string, title string, pdf_url string, license_code string")
    empty = spark.createDataFrame([], f"isbn string, record {discovery.C.RECORD_TYPE}")
    found, answers = discovery.discover(index, empty, "http://l.example.org", 8, 3, {"language": 0.5}, get=get)
    first = {r["isbn"]: r for r in found.collect()}
    assert len(first) == 8 and all(int(k) % 5 for k in first) and answers.count() == 32
    assert max(sum(r["language"] == x for r in first.values()) for x in ("de", "en")) == 4
    cache = answers.filter("status = 'ok'").select("isbn", F.from_json("answer", discovery.C.RECORD_TYPE).alias("record"))
    again, rest = discovery.discover(index, cache, "http://l.example.org", 8, 3, {"language": 0.5}, get=get)
    asked = {r["isbn"] for r in rest.collect()}
    assert not asked & {r["isbn"] for r in cache.collect()} and {r["isbn"] for r in again.collect()} == set(first)


def test_scorers(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] * 2 - x[:, 1] + rng.normal(0, 0.3, 300) > 1).astype(int)
    model = ml.Linear.fit(x, y, np.ones(300), ["a", "b"])
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9
    df = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, y, strict=True)], "a double, b double, label int")
    got = model.transform(df).toPandas()
    assert np.allclose(got["score"], model.scores(x))
    model.save(spark, str(tmp_path / "m"))
    assert ml.Linear.load(spark, str(tmp_path / "m")) == model
    z = ml.standardise(df, ["a"]).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9


def plain_boost(bins, y, w, base, how):
    """Boosting on a whole matrix, a split at a time; the raw scores of all rows."""
    raw = np.full(len(y), base)
    for _ in range(how.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = np.rint((p - y) * w * 2**30).astype(int), np.rint(p * (1 - p) * w * 2**30).astype(int)

        def best(rows, g=g, h=h):
            found = (0.0, None)
            for j in range(bins.shape[1]):
                for b in range(how.bins):
                    low, high = rows[bins[rows, j] <= b], rows[bins[rows, j] > b]
                    if min(len(low), len(high)) < how.least_rows or min(h[low].sum(), h[high].sum()) < how.least_curvature * 2**30:
                        continue
                    gain = float(g[low].sum()) ** 2 / h[low].sum() + float(g[high].sum()) ** 2 / h[high].sum() - float(g[rows].sum()) ** 2 / h[rows].sum()
                    if gain > found[0]:
                        found = (gain, (low, high))
            return found

        leaves = [(np.arange(len(y)), best(np.arange(len(y))))]
        while len(leaves) < how.leaves and max(x[1][0] for x in leaves) > 0:
            at = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
            low, high = leaves.pop(at)[1][1]
            leaves += [(low, best(low)), (high, best(high))]
        for rows, _ in leaves:
            raw[rows] += -how.rate * (g[rows].sum() / 2**30) / (h[rows].sum() / 2**30)
    return raw


def test_boosting_against_plain_growth(spark, tmp_path):
    """Of all rows and of all but a book's, however the rows are dealt out."""
    rng, how = np.random.default_rng(5), boosting.Growth(rounds=4, leaves=6, least_rows=5, rate=0.3, bins=12)
    n = 240
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[:, 2] = rng.integers(0, 4, n)
    y = ((x[:, 0] * x[:, 2] - x[:, 1] + rng.normal(0, 0.5, n)) > 0.5).astype(float)
    w, book = rng.uniform(0.3, 1, n), np.array([f"b{i % 7}" for i in range(n)])
    rows = [(book[i], i, *map(float, x[i]), bool(y[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "book string, page_index int, a double, b double, c double, label boolean, weight double")
    held = [None, "b3", "b6"]
    models = boosting.fit(df.repartition(5), ["a", "b", "c"], held, how)
    again = boosting.fit(df.orderBy(F.desc("weight")).coalesce(1), ["a", "b", "c"], held, how)
    for name, model, other in zip(held, models, again, strict=True):
        assert model.trees == other.trees and len(model.trees) == 4
        seen = book != name
        bins = boosting.binned(x, model.ends)
        share = (w * y)[seen].sum() / w[seen].sum()
        assert abs(model.base - np.log(share / (1 - share))) < 1e-12
        assert np.allclose(model.raw(bins)[seen], plain_boost(bins[seen], y[seen], w[seen], model.base, how), atol=1e-9)
    model = models[0]
    assert len(model.ends[2]) == 3 and len(model.ends[0]) <= 11
    got = {r["page_index"]: r["score"] for r in model.transform(df).select("page_index", "score").collect()}
    assert np.allclose([got[i] for i in range(n)], model.scores(x))
    model.save(spark, str(tmp_path / "trees"))
    assert ml.load_model(spark, str(tmp_path / "trees")).trees == model.trees


def test_boosting_holds_sums_and_splits_passes(spark, monkeypatch):
    """Many trees, few cells at once: the same trees."""
    rng, how = random.Random(6), boosting.Growth(rounds=5, leaves=4, least_rows=2)
    rows = [(f"b{i % 3}", rng.random(), rng.random(), rng.random() < 0.3, 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, "book string, a double, b double, label boolean, weight double")
    want = boosting.fit(df, ["a", "b"], [None, "b1"], how)
    monkeypatch.setattr(boosting, "KEEP", 2)
    monkeypatch.setattr(boosting, "CELLS", 600)
    assert [m.trees for m in boosting.fit(df, ["a", "b"], [None, "b1"], how)] == [m.trees for m in want]
    assert boosting.fit(df.limit(0), ["a"], [None], how)[0].trees == []


def test_boosted_left_out_splits_at_every_value(spark, tmp_path):
    """Books of more pages than a feature has bins: splits are those of the SQL."""
    rng, rows = random.Random(3), []
    for book, pages in (("src1", 700), ("src2", 1100), ("src3", 900)):
        rows += [(len(rows) + i, "x" * rng.randrange(20_000), book, "en") for i in range(pages)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["book"], r["page_index"]): r["score"] for r in Q.QUERIES["boosted_left_out"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {(book, page): score for book, page, score in con.execute(Q.ORACLE_SQL["boosted_left_out"]).fetchall()}
    assert len(want) == len(rows) and got == want


def test_leave_one_out_does_not_leak(spark):
    rows = [("a", i, float(i), i == 3, 1.0) for i in range(5)] + [("b", i, float(i), i == 2, 1.0) for i in range(4)] + [("c", 0, 1.0, False, 1.0)]
    df = spark.createDataFrame(rows, "book string, page_index int, f double, label boolean, weight double")
    got = ml.leave_one_out(df, ["f"]).toPandas()
    assert set(got["book"]) == {"a", "b"} and len(got) == 9
    rest = pd.DataFrame([r for r in rows if r[0] != "a"])
    model = ml.Linear.fit(rest[[2]].to_numpy(float), rest[3].to_numpy(), rest[4].to_numpy(), ["f"])
    assert np.allclose(got[got["book"] == "a"].sort_values("page_index")["score"], model.scores(np.arange(5.0)[:, None]))


def test_leave_one_out_with_trees(spark):
    rng = random.Random(4)
    rows = [(b, i, float(i == 3) + rng.uniform(0, 0.2), i == 3, 1.0) for b in "abcd" for i in range(12)] + [("e", 0, 0.5, False, 1.0)]
    df = spark.createDataFrame(rows, "book string, page_index int, f double, label boolean, weight double")
    got = ml.leave_one_out(df, ["f"], "gradient_boosting", boosting.Growth(rounds=5, leaves=3, least_rows=2)).toPandas()
    assert set(got["book"]) == set("abcd") and len(got) == 48
    assert all(part.loc[part["score"].idxmax(), "page_index"] == 3 for _, part in got.groupby("book"))
    with pytest.raises(ValueError):
        ml.leave_one_out(df, ["f"], "forest")


def test_fit_linear_is_the_optimum(spark):
    """The distributed fit equals the one on a whole matrix."""
    rng = np.random.default_rng(7)
    x = rng.normal(3, 2, (200, 2))
    y = x @ [1.0, -0.5] + rng.normal(0, 1, 200) > 1.5
    w = rng.uniform(0.3, 1, 200)
    df = spark.createDataFrame([(f"b{i % 9}", i, *map(float, x[i]), bool(y[i]), float(w[i])) for i in range(200)], "book string, page_index int, a double, b double, label boolean, weight double")
    found, want = ml.fit_linear(df, ["a", "b"]), ml.Linear.fit(x, y, w, ["a", "b"])
    assert np.allclose([*found.weights, found.bias, *found.mean, *found.scale], [*want.weights, want.bias, *want.mean, *want.scale], atol=1e-6)


def test_fit_linear_goes_on_to_large_weights(spark):
    """Few true pages that a narrow gap parts from many: the weights are hundreds, and the
    gradient there is zero."""
    x, y = np.arange(100.0), np.arange(100) < 3
    df = spark.createDataFrame([(f"b{i % 3}", i, float(x[i]), bool(y[i]), 1e6) for i in range(100)], "book string, page_index int, f double, label boolean, weight double")
    found = ml.fit_linear(df, ["f"])
    z = np.stack([(x - x.mean()) / x.std(), np.ones(100)], 1)
    w = np.array([*found.weights, found.bias])
    each = 1e6 * np.where(y, 100 / 2 / 3, 100 / 2 / 97)
    grad = z.T @ (each * (1 / (1 + np.exp(-np.clip(z @ w, -60, 60))) - y)) + np.array([1.0, 1e-9]) * w
    assert np.abs(w).max() > 300 and np.abs(grad).max() < 1e-3


def test_leave_one_book_out_reads_whole_books(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q.ml, "leave_one_out", lambda pages, features, model: seen.append(pages.count()) or pages.withColumn("score", F.lit(0.5)))
    sf = "/root/testdata/sf0.1"
    Q.QUERIES["leave_one_book_out"](spark, sf)
    assert seen == [Q.L.label_pages(Q.book_pages(spark, sf), Q._book_labels(spark)).count()] and seen[0] > 1000


def test_hit_rates(spark):
    rows = [("x", "scan", True), ("x", None, False), ("y", "scan", True)]
    got = {(r["by"], r["value"]): r["h"] for r in metrics.hit_rates(spark.createDataFrame(rows, "corpus string, extraction_type string, h boolean"), hits=["h"]).collect()}
    assert got[("all", None)] == 2 / 3 and got[("corpus", "x")] == 0.5 and got[("extraction_type", "scan")] == 1.0 and got[("extraction_type", None)] == 0.0


def test_no_name_is_defined_twice():
    for module in (Q, file_queries):
        tree = ast.parse(inspect.getsource(module))
        names = [n.name for n in tree.body if isinstance(n, ast.FunctionDef)] + [t.id for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
        assert len(names) == len(set(names))


@pytest.mark.parametrize(("name", "most"), [("locate_fixed_window", 2), ("locate_reference", 3), ("true_page_rank", 2), ("best_range", 1), ("window_sums", 1), ("topk_ranges", 1), ("ochiai_scores", 1)])
def test_scores_are_read_not_made_anew(spark, name, most):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= most and "documents" not in plan


def test_streams(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 5, 30), "ab"[i % 2], 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = events.tumbling_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in events.tumbling_counts(df).collect()}


def test_sample_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Stopped and started from its checkpoint after each file, and without it from the rows
    accepted so far: what one run gives."""
    rng = random.Random(17)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.randint(0, 5)) for i in range(120)]
    kind, fractions = "i long, a string, b int", {"a": 0.4, "b": 0.25}
    want = taken([r[1:] for r in rows], [sampling.cap(30, 0.4), sampling.cap(30, 0.25)], 30)
    source = tmp_path / "in"

    def run(checkpoint: str, accepted=None) -> None:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = events.sample_stream(stream, fractions, "i", 30, accepted).writeStream.format("parquet").option("path", str(tmp_path / checkpoint / "out")).option("checkpointLocation", str(tmp_path / checkpoint / "cp")).start()
        query.processAllAvailable()
        query.stop()

    parts = [spark.createDataFrame(rows[at : at + 40], kind).coalesce(1) for at in (0, 40, 80)]
    for part in parts:
        part.write.mode("append").parquet(str(source))
        run("one")
    assert sorted(r["i"] for r in spark.read.parquet(str(tmp_path / "one" / "out")).collect()) == want
    accepted = spark.createDataFrame([r for r in rows if r[0] in want and r[0] < 40], kind)
    source = tmp_path / "rest"
    for part in parts[1:]:
        part.write.mode("append").parquet(str(source))
    run("two", accepted)
    assert sorted(r["i"] for r in spark.read.parquet(str(tmp_path / "two" / "out")).collect()) == [i for i in want if i >= 40]


@pytest.mark.parametrize("name", sorted(file_queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    want = con.sql(Q.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = ", ".join(f'"{c}"' for c in sorted(got.columns))
    plain = lambda r: tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(plain, got.select(sorted(got.columns)).collect())) == sorted(map(plain, con.sql(f"SELECT {order} FROM want").fetchall()))
