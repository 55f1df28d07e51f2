"""Every operator over odd rows and over an empty table: one row for each row, no crash."""

from collections import Counter

import public_tokenizers
import pytest

from leafmark.llm import bpe, divergence, fingerprint, langid, licenses, linededup, lmscore, manifest, neardup, packing, piecebpe, quality, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
OPERATORS = {
    "quality": quality.judge,
    "langid": langid.predict,
    "bpe": lambda d: bpe.encode(d, PATH, PATTERN, ("ids_sha256", "decoded_sha256")),
    "licenses": licenses.scan,
    "fingerprint": fingerprint.compare_with_next,
    "neardup": lambda d: neardup.groups(d, 4, 80),
    "toxicity": lambda d: toxicity.predict(d, toxicity.fit(d, d.selectExpr("doc_id", "1 as toxic"))),
    "packing": packing.pack,
    "lmscore": lambda d: lmscore.score(d, PATH),
    "linededup": linededup.dedup,
    "manifest": lambda d: manifest.audit(d, outputs=("leaf", "subroot", "root", "verified")),
    "piecebpe": lambda d: piecebpe.encode(d, PIECES, ("ids_sha256", "decoded_sha256", "agrees")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd_docs, name):
    rows = OPERATORS[name](odd_docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.select("doc_id").collect())
    same = [tuple(v for k, v in r.asDict().items() if k not in ("batch", "place", "near_next", "edited_sha256", "edited_fingerprint", "near_edited")) for r in rows if r["doc_id"] == 1]
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(no_docs, name):
    assert OPERATORS[name](no_docs).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, odd_docs, no_docs, stage):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    f = corpus_pipeline.STAGES[stage][1]
    assert f(spark, no_docs, "").collect() == []
    out = f(spark, odd_docs, "")
    if stage < 4:
        assert out.columns == odd_docs.columns
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in odd_docs.collect()}


def test_divergence_of_odd_rows(odd_docs, no_docs):
    """One language and source: no pairs, and no term is in thirty documents."""
    assert divergence.audit(no_docs).collect() == divergence.audit(odd_docs).collect() == []
    assert divergence.audit(odd_docs, least=1).collect() == []  # the group is the language


def test_defined_results(odd_docs):
    q = {r["doc_id"]: r for r in quality.judge(odd_docs).collect()}
    assert q[3]["n_words"] == 0 and q[3]["base_failed"] and not q[3]["kept"]
    assert q[8]["n_repeat_words"] == 40_000 and q[5]["n_words"] == 0
    lang = {r["doc_id"]: r for r in langid.predict(odd_docs).collect()}
    assert lang[3]["lang_pred"] == lang[4]["lang_pred"] == "und" and lang[3]["score"] == 0
    near = {r["doc_id"]: r for r in neardup.groups(odd_docs, 4, 80).collect()}
    assert near[2]["component_id"] == 1 and not near[2]["kept"] and near[1]["kept"]
    assert near[3]["component_id"] == 3 and near[3]["n_shingles"] == 0 and near[6]["n_shingles"] == 1
    lic = {r["doc_id"]: r for r in licenses.scan(odd_docs).collect()}
    assert lic[12]["labels"] == "mit" and lic[3]["n_words"] == 0 and lic[3]["first_word"] is None
    prints = {r["doc_id"]: r for r in fingerprint.compare_with_next(odd_docs).collect()}
    assert prints[3]["fingerprint"] == "" and prints[1]["fingerprint"] == prints[2]["fingerprint"]
    pieces = {r["doc_id"]: r for r in piecebpe.encode(odd_docs, PIECES, ("ids", "decoded", "agrees")).collect()}
    assert all(r["agrees"] for r in pieces.values()) and pieces[3]["ids"] == pieces[4]["ids"] == [1, 2] and pieces[3]["decoded"] == ""
    leaves = {r["doc_id"]: r for r in manifest.audit(odd_docs).collect()}
    assert all(r["verified"] for r in leaves.values()) and leaves[3]["leaf"] != leaves[4]["leaf"]
    lines = {r["doc_id"]: r for r in linededup.dedup(odd_docs).collect()}
    assert lines[2]["text"].strip() == "" and lines[3]["text"] is None and lines[7]["text"] == "two words"
