"""One file a row: whole files or none, whatever fails; fetch, locate and mine in a row."""

import http.server
import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmark import __main__ as cli
from leafmark.functions import rounding
from leafmark.sources import files, pdf, sink

TEXTS = {"b1.full": "cover\fInhalt\nrope knots 3\nsails and masts 9\frope and more rope\fmasts", "b1.toc": "rope knots 3 sails and masts 9", "b2.full": "only this", "b2.toc": "nothing", "empty": ""}


class Files(http.server.BaseHTTPRequestHandler):
    asked: Counter = Counter()

    def do_GET(self):
        name = self.path.removeprefix("/")
        self.asked[name] += 1
        if name not in TEXTS:
            return self.send_error(404)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(TEXTS[name].encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def store(monkeypatch):
    from leafmark.sources import harvest

    monkeypatch.setattr(harvest.Patience, "__init__", lambda self, waits=(), limit=5, sleep=None: self.__dict__.update(waits=waits, limit=limit, sleep=sleep))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Files)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Files.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def rows_of(spark, contents):
    rows = [(k, [(n, c, None) for n, c in some]) for k, some in contents.items()]
    return spark.createDataFrame(rows, sink.FILES_TYPE).repartition(3)


def there(folder):
    return {p.name: p.read_bytes() for p in folder.glob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_files_of_rows(spark, tmp_path):
    contents = {str(i): [(f"{i}.a", b"x" * i), (f"{i}.b", b"y")] for i in range(1, 30)}
    want = {n: c for some in contents.values() for n, c in some}
    for publish in ("all", "each"):
        out = tmp_path / publish
        sink.save_files(rows_of(spark, contents), str(out), publish)
        assert there(out) == want
        sink.save_files(rows_of(spark, {"7": [("7.a", b"new")]}), str(out), publish)  # names stay, contents follow
        assert there(out) == want | {"7.a": b"new"} and sorted(p.name for p in out.iterdir()) == sorted(want)


def test_many_label_files_take_few_tasks(spark, tmp_path):
    """Tasks don't grow with the files; odd files give what Spark's reader gives."""
    at = tmp_path / "some labels"
    at.mkdir()
    for i in range(800):
        (at / f"{i}.json").write_text(json.dumps({"isbn": str(i), "status": "located", "toc_start_index": i}, indent=1))
    odd = {"list.json": b'[{"isbn": "l1"}, {"isbn": "l2"}]', "bom.json": b'\xef\xbb\xbf{"isbn": "b"}', "broken.json": b'{"isbn": ', "empty.json": b"", "_hidden.json": b'{"isbn": "h"}', ".dot.json": b'{"isbn": "d"}', "no.txt": b'{"isbn": "t"}'}
    for name, content in odd.items():
        (at / name).write_bytes(content)
    (at / "folder.json").mkdir()
    for root in (str(at), at.as_uri()):
        found = files.read_labels(spark, root)
        assert found.rdd.getNumPartitions() <= files.TASKS * spark.sparkContext.defaultParallelism
        want = spark.read.schema(files.LABEL_TYPE).option("multiLine", "true").json([str(p) for p in at.glob("*.json") if p.is_file() and p.name[0] not in "._"])
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and len(found.collect()) == 804


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    contents = {str(i): [(f"{i}.a", b"x"), ("bad/name" if i == 20 else f"{i}.b", b"y")] for i in range(30)}
    with pytest.raises(Exception, match="not a file's name"):
        sink.save_files(rows_of(spark, contents), str(tmp_path / "all"))
    assert there(tmp_path / "all") == {} and list((tmp_path / "all").iterdir()) == []
    sink.save_files(rows_of(spark, contents), str(tmp_path / "told"), errors="report", statuses=str(tmp_path / "s"))
    assert len(there(tmp_path / "told")) == 58
    told = {r["key"]: r["status"] for r in sink.read_statuses(spark, str(tmp_path / "s")).collect()}
    assert told.pop("20") == "error" and set(told.values()) == {"ok"} and len(told) == 29


def test_an_attempt_that_broke_off_isnt_seen(spark, tmp_path):
    """A task that died in the middle leaves its folder; what it wrote has no name yet."""
    writer = sink._Writer({"path": str(tmp_path / "out")})

    def broken():
        yield from rows_of(spark, {"1": [("1.a", b"whole")], "2": [("2.a", b"whole")]}).collect()
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert there(tmp_path / "out") == {}
    again = writer.write(iter(rows_of(spark, {"1": [("1.a", b"whole")]}).collect()))
    writer.commit([again, None])
    assert there(tmp_path / "out") == {"1.a": b"whole"} and not list((tmp_path / "out").glob("_*"))


def test_fetch_locate_mine(spark, store, tmp_path):
    """Each reads what the one before left; a second fetch asks for nothing that is there."""
    books = [("b1", f"{store}/b1.toc", f"{store}/b1.full"), ("b2", f"{store}/b2.toc", f"{store}/b2.full"), ("b3", f"{store}/gone", f"{store}/b1.full"), ("b4", f"{store}/empty", f"{store}/b1.full"), ("b5", None, f"{store}/b1.full")]
    manifest, folder, labels = tmp_path / "manifest.json", tmp_path / "books", tmp_path / "labels"
    manifest.write_text("".join(json.dumps({"isbn": i, "dnb_toc_download_url": a, "oa_pdf_url": b}) + "\n" for i, a, b in books))
    statuses = {r["key"]: r["status"] for r in cli.fetched(spark, str(manifest), str(folder)).collect()}
    assert statuses == {"b1": "ok", "b2": "ok", "b3": "error", "b4": "error"}
    names = {"b1.dnb_toc.pdf": "b1.toc", "b1.fulltext.pdf": "b1.full", "b2.dnb_toc.pdf": "b2.toc", "b2.fulltext.pdf": "b2.full"}
    assert there(folder) == {n: TEXTS[t].encode() for n, t in names.items()}
    before = dict(Files.asked)
    (folder / "b2.dnb_toc.pdf").unlink()
    cli.fetched(spark, str(manifest), str(folder))
    assert there(folder).keys() == names.keys()
    assert {k: Files.asked[k] - before[k] for k in ("b1.toc", "b2.toc", "b2.full")} == {"b1.toc": 0, "b2.toc": 1, "b2.full": 0}

    parse = lambda content: content.decode().split("\f")
    cli.labelled(spark, str(folder), str(labels), parse=parse)
    told = {n: json.loads(c) for n, c in there(labels).items()}
    assert set(told) == {"b1.json", "b2.json"} and told["b2.json"] == {"isbn": "b2", "status": "no_candidate"}
    assert told["b1.json"] | {"top_score": 0, "margin": 0} == {"isbn": "b1", "status": "located", "toc_start_index": 1, "toc_end_index": 1, "top_score": 0, "margin": 0, "method": cli.METHOD, "verified": False}
    (labels / "b1.json").write_text(json.dumps(told["b1.json"] | {"verified": True}))
    cli.labelled(spark, str(folder), str(labels), parse=parse)  # what people checked stays
    assert json.loads((labels / "b1.json").read_text())["verified"]
    assert files.read_labels(spark, str(labels)).count() == 2
    (tmp_path / "books.json").write_text(json.dumps({"books": [{"isbn": "b1", "language": "de"}]}))
    for p in [*folder.glob("b1*"), *labels.glob("b1*")]:  # mining takes keys in capitals
        p.write_text(p.read_text().replace('"b1"', '"B1"'))
        p.rename(p.with_name(p.name.replace("b1", "B1")))
    mined = cli.mined(spark, str(folder), str(labels), str(tmp_path / "books.json"), 1, parse).collect()
    assert [tuple(r) for r in mined] == [("de", "inhalt", 1)]


def test_rounding_as_python_does(spark):
    import random
    import struct

    rng = random.Random(3)
    some = [0.25, 0.35, 0.45, 2.5, -2.5, -0.04, 0.0, -0.0, 1e300, 5e-324, float("inf"), 0.00005, 2.675, 1.005, 0.5, 1.5, 4503599627370495.5]
    some += [rng.randint(-(10**7), 10**7) / 10 ** rng.randint(0, 7) + rng.choice([0, 0, 5e-5, 0.05]) for _ in range(300_000)]
    some += [(2 * rng.randint(-(10**6), 10**6) + 1) / 2 ** rng.randint(1, 12) for _ in range(200_000)]
    some += [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(200_000)) if x == x and abs(x) < 1e11]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(some)], "i long, x double")
    got = df.select("i", *[rounding.round_half_even(F.col("x"), n).alias(str(n)) for n in (0, 1, 2, 4)]).toPandas().sort_values("i")
    for n in (0, 1, 2, 4):
        want = [x if abs(x) >= 2**52 / 10**n else round(x, n) for x in some]
        assert [struct.pack("d", g) for g in got[str(n)]] == [struct.pack("d", w) for w in want]
    assert spark.sql("select cast(null as double) as x").select(rounding.round_half_even(F.col("x"), 2)).first()[0] is None
