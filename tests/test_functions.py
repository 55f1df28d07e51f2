"""Column functions against hand-made vectors and plain-Python models."""

import random
import time
import statistics

import pytest
from pyspark.sql import functions as F

from leafmark.functions import catalogue as C
from leafmark.functions import geometry as G
from leafmark.functions import keywords as K
from leafmark.functions import ranges as R
from leafmark.functions import text as T


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


def text_features(spark, text, language=None, keywords=T.KEYWORDS):
    from leafmark.operators.pages import text_features as add

    return add(spark.createDataFrame([("b", text, language)], "book string, text string, language string"), keywords).first()


def test_token_set_and_ochiai(spark):
    assert sorted(one(spark, T.token_set(F.col("v")), "Der Titel 1 ist toll")) == ["der", "ist", "titel", "toll"]
    assert one(spark, T.token_set(F.col("v")), None) == []
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert one(spark, T.ochiai(a, a)) == 1.0 and one(spark, T.ochiai(a, b)) == 0.5
    assert one(spark, T.ochiai(a, F.array().cast("array<string>"))) == 0.0


def toc_model(text):
    """Ratio, rise of page numbers, both by hand: a line's tail after dots or blanks is its page."""
    hits, seen, numbers = 0, 0, []
    for line in filter(str.strip, text.split("\n")):
        line = line.strip()
        gaps = [i for i in range(len(line) - 1) if line[i] in ". " and line[i + 1] in ". "]
        seen += bool(gaps)
        tail = line.replace(".", " ").split()[-1]
        if gaps and line.endswith(tail) and tail.isdigit() and len(tail) <= 4 and line[: -len(tail)][-2:].strip(". ") == "" and len(line[: -len(tail)].rstrip(". ")) >= 3:
            hits += 1
            numbers.append(int(tail))
    rises = len(numbers) > 1 and all(b > a for a, b in zip(numbers, numbers[1:], strict=False))
    return hits / seen if seen else 0.0, float(rises)


def test_toc_features_against_model(spark):
    rng = random.Random(3)
    pages = []
    for _ in range(60):
        at, rows = rng.randint(1, 20), []
        for _ in range(rng.randint(0, 6)):
            title = " ".join(rng.choice(["Harbours", "off", "Tides", "and Moons", "Ropes"]) for _ in range(rng.randint(1, 4)))
            at += rng.randint(-1, 9)
            rows.append(title + rng.choice([" ..... ", "    ", " ", " . . "]) + rng.choice([str(max(at, 1)), "q", "12345"]))
        pages.append("\n".join(rows))
    from leafmark.operators.pages import text_features as add

    rows = add(spark.createDataFrame([(str(i), p, None) for i, p in enumerate(pages)], "book string, text string, language string")).collect()
    for r in rows:
        assert (r["toc_line_ratio"], r["monotonic_page_numbers"]) == toc_model(pages[int(r["book"])]), pages[int(r["book"])]


def test_excluded_lines(spark):
    for line in ("© 2019 Some Press  12", "ISBN 978-3-16  148410", "see https://doi.org/10.1  22", "Printed in Germany  3"):
        assert text_features(spark, line)["toc_line_ratio"] == 0.0
    assert one(spark, T.is_toc_line(F.col("v")), "It  7") is False  # three characters of title at least
    assert one(spark, T.is_toc_line(F.col("v")), "Foreword\u00a0\u00a07") is True
    assert one(spark, T.is_toc_line(F.col("v")), "It ended. 12") is True


def test_digits_and_keywords(spark):
    rng = random.Random(4)
    words = {"en": ["harvest", "by the sea"], "nl": ["oogst"], "it": ["raccolto"]}
    rows = []
    for i in range(80):
        lines = [rng.choice(["", "first 12", "The HARVEST 7", "Oogst", "preraccolto", "By The", "by the sea 2024", "٣ and 3"]) for _ in range(rng.randint(0, 8))]
        rows.append((str(i), "\n".join(lines), rng.choice([None, "en", "nl", "it", "pl"])))
    from leafmark.operators.pages import text_features as add

    df = spark.createDataFrame(rows, "book string, text string, language string")
    for keywords in (words, None):
        got = {r["book"]: r for r in add(df, keywords).collect()}
        for book, text, language in rows:
            head = " ".join([x for x in text.split("\n") if x.strip()][:5]).lower()
            hit = lambda some, head=head: float(any(w in head for w in some))
            want = (hit(sum(words.values(), [])), hit(words.get(language, []))) if keywords else (0.0, 0.0)
            assert (got[book]["keyword_hit_any_language"], got[book]["keyword_hit_same_language"]) == want
            assert got[book]["digit_density"] == (sum(c.isdecimal() for c in text) / len(text) if text else 0.0)


def test_page_numbers(spark):
    want = {"7": 7, "0012": 12, "xlix": 49, "L": 50, "li": None, "iiii": None, "civil": None, "iv": 4, "vx": None, "": None}
    rows = spark.createDataFrame([(k,) for k in want], "v string").select("v", T.page_number(F.col("v")).alias("n")).collect()
    assert {r["v"]: r["n"] for r in rows} == want
    values = {"i": 1, "v": 5, "x": 10, "l": 50}
    for n in range(1, 51):
        numeral = [values[c] for c in T.roman(n)]
        assert n == sum(-a if a < b else a for a, b in zip(numeral, [*numeral[1:], 0], strict=True))


def test_increasing(spark):
    for numbers, want in (([1, 2, 3], 1.0), ([1, 1], 0.0), ([3], 0.0), ([], 0.0), ([2, 1, 3], 0.0)):
        assert one(spark, T.increasing(F.col("v")), numbers, "array<int>") == want


def test_heading_phrase(spark):
    assert one(spark, T.heading_phrase(F.col("v")), "\n  INHALT \nx") == "inhalt"
    assert one(spark, T.heading_phrase(F.col("v")), "one two three four five") is None
    assert one(spark, T.heading_phrase(F.col("v")), " \n") is None


def test_margin_weight(spark):
    for margin, want in ((0.0, 0.3), (0.5, 1.0), (10.0, 1.0), (-1.0, 0.3), (0.25, 0.65)):
        assert abs(one(spark, R.margin_weight(F.col("v")), margin, "double") - want) < 1e-12


def ranges(spark, scores, **kw):
    return [tuple(r) for r in one(spark, R.topk_ranges("v", **kw), scores, "array<double>")]


def model(scores, k=3, low=1, high=6):
    every = [(-round(sum(scores[s : s + w]), 9), -w, s) for w in range(low, min(high, len(scores)) + 1) for s in range(len(scores) - w + 1)]
    out = []
    for total, width, start in sorted(every):
        end = start - width - 1
        if all(end < a or start > b for a, b, _ in out):
            out.append((start, end, -total))
            if len(out) == k:
                break
    return out


def test_topk_without_limit_and_without_scores(spark):
    rng = random.Random(9)
    for _ in range(5):
        values = [rng.choice([0.0, 0.25, 0.5]) for _ in range(rng.randint(1, 12))]
        for k in (0, 1, 50):
            got = [r[:2] for r in ranges(spark, values, k=k, high=3)]
            assert got == [w[:2] for w in model(values, k or 99, high=3)]
    assert ranges(spark, [], k=0) == ranges(spark, []) == []


def test_topk_against_model(spark):
    rng = random.Random(1)
    rows = [(i, [round(rng.choice([0.0, 0.1, 0.5, rng.random()]), 2) for _ in range(rng.randint(0, 14))]) for i in range(60)]
    got = spark.createDataFrame(rows, "i int, v array<double>").select("i", R.topk_ranges("v").alias("x")).collect()
    for r in got:
        want = model(dict(rows)[r["i"]])
        assert [tuple(x)[:2] for x in r["x"]] == [w[:2] for w in want]
        assert all(a["end"] < b["start"] or b["end"] < a["start"] for n, a in enumerate(r["x"]) for b in r["x"][:n])


def test_containment(spark):
    window = F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"))
    for pages, inside, over in (([2, 3, 4], True, True), ([4, 5], False, True), ([7], False, False), ([], False, False)):
        assert one(spark, R.contains_range(window, F.col("v")), pages, "array<int>") is inside
        assert one(spark, R.overlaps_range(window, F.col("v")), pages, "array<int>") is over


def word(text, x0, x1, top=0.0, size=10.0):
    return (text, float(x0), float(x1), float(top), float(top) + 8, float(size))


def test_gap_text_against_model(spark):
    """Words apart by a random part of their size: joined, spaced, or widely spaced."""
    rng = random.Random(12)
    rows = []
    for i in range(40):
        words, x, want = [], rng.uniform(0, 9), ""
        for n in range(rng.randint(1, 7)):
            size = rng.choice([0.0, 7.5, 12.0])
            gap = rng.choice([-2.0, 0.04, 0.5, 2.9, 3.1, 9.0])
            if n:
                mean = (words[-1][5] + size) / 2 or 1.0
                x += gap * mean
                want += "  " if gap >= 3 else " " if gap >= 0.1 else ""
            name = rng.choice(["oak", "elm-", "7", "Birch"])
            words.append(word(name, x, x + 5 * len(name), size=size))
            x, want = x + 5 * len(name), want + name
        order = sorted(words, key=lambda w: w[1])
        if order == words:  # a step back past a whole word would change the order
            rng.shuffle(words)
            rows.append((i, words, want))
    got = spark.createDataFrame(rows, f"i int, v array<{G.WORD_TYPE}>, want string").select("want", G.line_text(F.col("v")).alias("x")).collect()
    assert len(rows) > 20 and all(r["x"] == r["want"] for r in got)


def test_visual_lines_against_model(spark):
    """Lines in random order: each joins the group whose first is at most two points above."""
    rng = random.Random(13)
    rows, want = [], {}
    for i in range(30):
        tops = sorted(rng.choice([0.0, 0.5, 1.0, 2.0, 2.5, 4.0, 6.5]) + 10 * rng.randint(0, 2) for _ in range(rng.randint(0, 9)))
        boxes = [(t, [word(f"{n}", 7.0 * n, 7.0 * n + 5, t)]) for n, t in enumerate(tops)]
        groups = []
        for box in boxes:
            if groups and box[0] - groups[-1][0][0] <= 2.0:
                groups[-1].append(box)
            else:
                groups.append([box])
        want[i] = [[w[0] for _, ws in sorted(g, key=lambda b: b[1][0][1]) for w in ws] for g in groups]
        rows.append((i, rng.sample(boxes, len(boxes))))
    got = spark.createDataFrame(rows, f"i int, v array<{G.LINE_TYPE}>").select("i", G.visual_lines(F.col("v")).alias("x")).collect()
    assert {r["i"]: [[w["text"] for w in line] for line in r["x"]] for r in got} == want


def test_dense_pages_take_linear_time(spark):
    """Twenty thousand lines of a page, most of them in long chains of near ones."""
    rng = random.Random(14)
    tops = [round(0.9 * i + rng.random(), 3) for i in range(20_000)]
    boxes = [(t, [word(str(n), 1.0 * n, 1.0 * n + 1, t)]) for n, t in enumerate(tops)]
    df = spark.createDataFrame([(rng.sample(boxes, len(boxes)),)], f"v array<{G.LINE_TYPE}>")
    began = time.perf_counter()
    sizes = [len(x) for x in df.select(F.transform(G.visual_lines(F.col("v")), F.size).alias("n")).select(F.transform("n", lambda n: F.sequence(F.lit(1), n))).first()[0]]
    assert sum(sizes) == 20_000 and time.perf_counter() - began < 60
    ordered, want = sorted(tops), []
    for t in ordered:
        if want and t - want[-1][0] <= 2.0:
            want[-1].append(t)
        else:
            want.append([t])
    assert sizes == list(map(len, want))
    assert G.first_lines([]) == [] and G.first_lines([1.0, 2.0, float("nan"), None]) == [0, 2, 3]


def test_many_keywords_against_contains(spark):
    """Ten thousand keywords: the same as asking for each; the plan has one step for them all."""
    rng = random.Random(16)
    letters = "abcdeäß é"
    made = lambda n: "".join(rng.choice(letters) for _ in range(n))
    keywords = {lang: [made(rng.randint(3, 6)).upper() for _ in range(3000)] for lang in ("de", "en", "fr")} | {"es": [made(4) for _ in range(1000)]}
    rows = [(i, None if i % 50 == 0 else made(rng.randint(0, 9)), rng.choice(["de", "en", "xx", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, o string, lang string")
    low = {lang: [w.lower() for w in words] for lang, words in keywords.items()}
    any_ = lambda o, words: float(o is not None and any(w in o for w in words))
    want = {i: (any_(o, [w for words in low.values() for w in words]), any_(o, low.get(lang, []))) for i, o, lang in rows}
    assert 0.2 < sum(a for a, _ in want.values()) / 2000 < 0.9
    for most in (K.BLOCK_CHARS, 20_000):
        found = df.select("i", K.keyword_hits(spark, F.col("o"), F.col("lang"), keywords, most).alias("h")).select("i", "h.*")
        assert {r["i"]: tuple(r)[1:] for r in found.collect()} == want
    few = df.select("i", K.keyword_hits(spark, F.col("o"), F.col("lang"), {"de": ["abc"]}).alias("h"))
    many = df.select("i", K.keyword_hits(spark, F.col("o"), F.col("lang"), keywords).alias("h"))
    size = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(few) == size(many)
    empty = df.select(K.keyword_hits(spark, F.col("o"), F.col("lang"), {"de": [""]}).alias("h"), "o", "lang").collect()
    assert all(tuple(r["h"]) == (float(r["o"] is not None), float(r["o"] is not None and r["lang"] == "de")) for r in empty)
    assert {tuple(r[0]) for r in df.select(K.keyword_hits(spark, F.col("o"), F.col("lang"), {})).collect()} == {(0.0, 0.0)}


def test_page_features(spark):
    lines = [[word("a", 10, 20, 50, 10)], [word("b", 20, 30, 70, 10), word("c", 40, 50, 70, 14)], [word("d", 10, 20, 90, 12)]]
    row = spark.createDataFrame([(lines, 200.0, 100.0)], f"l array<array<{G.WORD_TYPE}>>, h double, w double").select(G.page_features("l", "h", "w").alias("f")).first()["f"]
    lefts = [0.1, 0.2, 0.1]
    assert row["line_count"] == 3.0 and row["modal_font_size"] == 12.0 and row["max_font_size"] == 12.0
    assert abs(row["left_margin_mean"] - statistics.mean(lefts)) < 1e-12 and abs(row["left_margin_var"] - statistics.variance(lefts)) < 1e-12
    assert row["first_text_vpos_fraction"] == 0.25 and row["last_text_vpos_fraction"] == 0.49
    tie = spark.createDataFrame([([lines[0], lines[2]], 200.0, 100.0)], f"l array<array<{G.WORD_TYPE}>>, h double, w double").select(G.page_features("l", "h", "w").alias("f")).first()["f"]
    assert tie["modal_font_size"] == 10.0 and tie["left_margin_var"] == 0.0
    empty = spark.createDataFrame([([], 200.0, 100.0), (lines, 0.0, 100.0)], f"l array<array<{G.WORD_TYPE}>>, h double, w double").select(G.page_features("l", "h", "w").alias("f")).collect()
    assert all(set(r["f"].asDict().values()) == {0.0} for r in empty)


def test_page_features_of_many_lines(spark):
    """What a page's lines give is made once, not once a line: 3,000 lines in seconds."""
    rng = random.Random(9)
    lines = [[word("a", rng.randint(0, 500), 600, i, rng.choice([8, 9, 10.25, 11]))] for i in range(3000)]
    df = spark.createDataFrame([(lines, 4000.0, 100.0)], f"l array<array<{G.WORD_TYPE}>>, h double, w double")
    began = time.monotonic()
    row = df.select(G.page_features("l", "h", "w").alias("f")).first()["f"]
    assert time.monotonic() - began < 20
    lefts, sizes = [x[0][1] / 100.0 for x in lines], [round(x[0][5], 1) for x in lines]
    assert abs(row["left_margin_mean"] - statistics.mean(lefts)) < 1e-9 and abs(row["left_margin_var"] - statistics.variance(lefts)) < 1e-9
    assert row["modal_font_size"] == statistics.mode(sizes) and row["max_font_size"] == 11.0


BOOK = {"type": ["Book"], "isbn": ["978-3-16-148410-0"], "title": "T", "language": [{"id": "http://id.example.org/ger"}], "tableOfContents": [{"id": "urn:x"}, {"id": "http://d.example.org/1"}], "subject": [{"notation": "CC 3200", "source": {"label": "RVK"}}], "id": "http://l.example.org/1#!"}


def record(spark, column, **changes):
    return one(spark, column(F.col("v")), {**BOOK, **changes}, C.RECORD_TYPE)


def test_records(spark):
    assert record(spark, C.record_matches) is True
    assert [record(spark, C.record_matches, **c) for c in ({"type": ["Journal"]}, {"tableOfContents": []}, {"isbn": []}, {"type": None})] == [False] * 4
    assert record(spark, C.record_isbn) == "9783161484100" and record(spark, C.record_isbn, isbn=["3-16-148410-x"]) == "316148410X"
    assert record(spark, C.record_language) == "de" and record(spark, C.record_language, language=[{"id": "x/que"}]) == "que" and record(spark, C.record_language, language=None) is None
    kinds = [record(spark, C.record_volume_type, type=t) for t in (["Book"], ["Book", "EditedVolume"], ["Book", "Thesis"])]
    assert kinds == ["monograph", "edited_volume", "thesis"]
    assert record(spark, C.record_domain_bucket) == "CC" and record(spark, C.record_domain_bucket, subject=[]) == "unknown"
    later = [{"notation": "12 3", "source": {"label": "RVK"}}, {"notation": "ST 1", "source": {"label": "RVK"}}]
    assert record(spark, C.record_domain_bucket, subject=later) == "ST"
    assert record(spark, C.record_toc_url) == "http://d.example.org/1" and record(spark, C.record_api_url) == "http://l.example.org/1?format=json"
    assert record(spark, C.record_api_url, id=None) is None


OAI = '<record><dc:title>A &amp; B</dc:title><dc:identifier type="URL">https://library.example.org/handle/20.500.12657/1</dc:identifier><oapen:relationisbn>978-3-16-148410-0</oapen:relationisbn><oapen:relationisbn>9783161484100</oapen:relationisbn><dc:identifier>https://x.example.org/f.PDF</dc:identifier></record>'


def test_oai_records(spark):
    found = one(spark, C.parse_oai_record(F.col("v"), "library.example.org"), OAI)
    assert (found["isbns"], found["handle"], found["title"], found["pdf_urls"]) == (["9783161484100"], "20.500.12657/1", "A &amp; B", ["https://x.example.org/f.PDF"])
    assert one(spark, C.parse_oai_record(F.col("v"), "elsewhere.example.org"), OAI) is None
    assert one(spark, C.parse_oai_record(F.col("v"), "library.example.org"), OAI.replace("relationisbn", "other")) is None
    assert one(spark, F.size(C.split_records(F.col("v"))), OAI + "\n" + OAI) == 2
    assert one(spark, C.resumption_token(F.col("v")), "<resumptionToken a='1'>abc</resumptionToken>") == "abc"
    assert one(spark, C.resumption_token(F.col("v")), "<resumptionToken/>") is None


def test_bitstreams(spark):
    kind = "array<struct<mimeType:string,retrieveLink:string,sizeBytes:long,code:string>>"
    value = [("text/xml", "/a", 1, None), ("application/pdf", "/b", 2, "CC")]
    assert tuple(one(spark, C.pdf_bitstream(F.col("v"), F.lit("https://r")), value, kind)) == ("https://r/b", 2, "CC")
    assert one(spark, C.pdf_bitstream(F.col("v"), F.lit("https://r")), value[:1], kind) is None


@pytest.mark.parametrize("text,want", [(None, False), ("", False), (" \n ", False), ("x", True)])
def test_has_text(spark, text, want):
    assert one(spark, T.has_text(F.col("v")), text) is want
