"""Corpora on disk to a report, a saved scorer of either kind, and the pages that it finds."""

import json
import random

import pytest

from leafmark import __main__ as cli
from leafmark.operators import boosting, ml
from leafmark.plans import training


def layout(pages):
    """An ALTO file: each page a list of lines, each line a list of words, the last at the right."""
    out = ['<alto><Styles><TextStyle ID="f" FONTSIZE="10"/></Styles><Layout>']
    for n, lines in enumerate(pages, 1):
        out.append(f'<Page PHYSICAL_IMG_NR="{n}" HEIGHT="800" WIDTH="600"><PrintSpace><TextBlock>')
        for k, words in enumerate(lines):
            boxes = "".join(f'<String CONTENT="{w}" HPOS="{500 if w.isdigit() else 20 + 60 * i}" VPOS="{20 * k}" WIDTH="50" HEIGHT="10" STYLEREFS="f"/>' for i, w in enumerate(words))
            out.append(f'<TextLine VPOS="{20 * k}">{boxes}</TextLine>')
        out.append("</TextBlock></PrintSpace></Page>")
    return "".join([*out, "</Layout></alto>"])


@pytest.fixture(scope="module")
def corpora(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("corpora"), random.Random(4)
    prose = lambda: [[rng.choice(["plain", "words", "of", "text", "here"]) for _ in range(6)] for _ in range(rng.randint(8, 14))]
    contents = lambda: [["Inhalt"], *([f"Kapitel{k}", "von", "etwas", str(10 * k)] for k in range(1, rng.randint(6, 12)))]
    for name, books in (("one", range(5)), ("two", range(5, 9))):
        folder = root / name
        folder.mkdir()
        for b in books:
            n, at = rng.randint(8, 12), rng.randint(1, 3)
            has = b != 8
            (folder / f"b{b}.xml").write_text(layout([contents() if has and i == at else prose() for i in range(n)]))
            toc = {"toc_start_index": at, "toc_end_index": at} if has else None
            (folder / f"b{b}.expected.json").write_text(json.dumps({"toc": toc}))
        books = [{"filename": f"b{b}.xml", "isbn": f"{b}", "language": "de", "extraction_type": "native" if b % 2 else "ocr"} for b in books]
        (folder / "manifest.json").write_text(json.dumps({"books": books}))
    return root


def test_report_by_corpus_and_type(spark, corpora, tmp_path):
    rows = training.corpus_features(spark, str(corpora), cache=str(tmp_path / "cache"))
    assert set(ml.FEATURES) <= set(rows.columns) and rows.select("book").distinct().count() == 9
    assert rows.filter("label").count() == 8
    again = training.corpus_features(spark, str(corpora), cache=str(tmp_path / "cache"))
    assert again.count() == rows.count()
    for model in ml.MODELS:
        per_book, rates, ranks = training.report(rows, model, boosting.Growth(rounds=6, leaves=4, least_rows=4, rate=0.5))
        assert per_book.count() == 8
        by = {(r["by"], r["value"]): (r["n"], r["top3_overlap"]) for r in rates.collect()}
        assert by["all", None][0] == 8 and by["all", None][1] >= 0.9
        assert {k: n for k, (n, _) in by.items()} == {("all", None): 8, ("corpus", "one"): 5, ("corpus", "two"): 3, ("extraction_type", "native"): 4, ("extraction_type", "ocr"): 4}
        assert ranks.first()["median_rank"] == 1
    with pytest.raises(ValueError, match="no expected files"):
        training.label_rows(spark, str(tmp_path))
    with pytest.raises(ValueError, match="model"):
        training.fit(rows, "forest")


@pytest.mark.parametrize("model", ml.MODELS)
def test_train_and_find(spark, corpora, tmp_path, monkeypatch, model):
    """A saved scorer finds the contents pages of the layouts that it is pointed at."""
    monkeypatch.setattr(cli.SparkSession.builder, "getOrCreate", lambda: spark)
    monkeypatch.setattr(boosting, "Growth", lambda rounds: boosting_growth(rounds=rounds, leaves=4, least_rows=4, rate=0.5))
    cli.main(["train", "--corpora", str(corpora), "--model", model, "--rounds", "6", "--out", str(tmp_path / "scorer")])
    cli.main(["find", "--layouts", f"{corpora}/two/*.xml", "--model", str(tmp_path / "scorer"), "--out", str(tmp_path / "found")])
    found = {r["book"].rsplit("/", 1)[-1]: r["pages"] for r in spark.read.json(str(tmp_path / "found")).collect()}
    assert set(found) == {f"b{b}.xml" for b in range(5, 9)}
    for b in range(5, 8):
        at = json.loads((corpora / "two" / f"b{b}.expected.json").read_text())["toc"]["toc_start_index"]
        assert at in found[f"b{b}.xml"]
    cli.main(["evaluate", "--corpora", str(corpora), "--model", model, "--rounds", "3", "--out", str(tmp_path / "books")])
    assert spark.read.json(str(tmp_path / "books")).count() == 8


boosting_growth = boosting.Growth


def test_located_labels_join_in(spark, corpora, tmp_path):
    """Books located by a reference count by their margin, unless a corpus has their key."""
    labels, layouts = tmp_path / "labels", tmp_path / "layouts"
    labels.mkdir()
    layouts.mkdir()
    for key, status in (("z1", "located"), ("b2", "located"), ("z2", "no_candidate")):
        (labels / f"{key}.json").write_text(json.dumps({"isbn": key, "status": status} | ({"toc_start_index": 1, "toc_end_index": 2, "margin": 0.1} if status == "located" else {})))
    (layouts / "z1.xml").write_text((corpora / "one" / "b0.xml").read_text())
    rows = training.corpus_features(spark, str(corpora), str(labels), str(layouts))
    new = rows.filter("book = 'z1'").collect()
    assert {r["page_index"] for r in new if r["label"]} == {1, 2} and {r["corpus"] for r in new} == {"dnb_located"} and 0.3 < new[0]["weight"] < 1
    assert {r["corpus"] for r in rows.filter("book = 'b2'").collect()} == {"one"} and rows.filter("book = 'z2'").count() == 0
