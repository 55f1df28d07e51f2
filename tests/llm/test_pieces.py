"""Merge-type piece vocabularies against the library: whole tables, made texts, made ids."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import sentencepiece

from leafmark.llm import piecebpe, queries
from tests.conftest import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return piecebpe.Encoder(piecebpe.Vocabulary(piecebpe.model_file(PATH)[1]))


def test_query_gives_the_librarys_digests(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op12_piece_bpe(spark, SF).collect()
    assert len(rows) == len(texts) and all(r["agrees"] for r in rows)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_made_texts(encoder, library):
    rng = random.Random(7)
    signs = [*"abcdefgh  \n\t▁éß漢字\U0001f600 THE.,-0123\0﷽́", "the", "ing", "  ", "   ", "<s>", "</s>", "<0x41>", "▁▁", "ization", " "]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 80)))
        packed, ids = encoder.encode(text), library.encode(text, add_bos=True, add_eos=True)
        assert array("I", ids).tobytes() == packed
        assert encoder.decode(array("I", packed)) == library.decode(ids)


def test_made_ids(encoder, library):
    """Broken bytes, controls and the unknown piece anywhere."""
    rng = random.Random(8)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999), 29871]) for _ in range(rng.randint(0, 9))]
        assert encoder.decode(ids) == library.decode(ids)


def test_long_and_short_agendas_agree(encoder, library):
    rng, order = random.Random(9), encoder.vocabulary.order
    for _ in range(500):
        text = "".join(rng.choice("aeinrst▁▁▁") for _ in range(rng.randint(2, piecebpe.SHORT)))
        heaped = piecebpe.symbols_of(text + "漢" * piecebpe.SHORT, order)  # a sign that joins nothing
        assert [s for s in heaped if s != "漢"] == piecebpe._short(list(text), order)
    text = "".join(rng.choice("abcdefghij") for _ in range(50_000))
    assert encoder.encode(text) == array("I", library.encode(text, add_bos=True, add_eos=True)).tobytes()


def test_round_trip_and_decode(spark):
    texts = ["plain words", " two  leading", "", None, "tail \n\n", "漢字 and é and \U0001f600"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = piecebpe.decode(piecebpe.encode(docs, PATH), PATH)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_other_kinds_of_files_are_refused(encoder):
    from sentencepiece import sentencepiece_model_pb2 as formats

    proto = formats.ModelProto()
    proto.ParseFromString(piecebpe.model_file(PATH)[1])
    proto.trainer_spec.model_type = formats.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError, match="merge type"):
        piecebpe.Vocabulary(proto.SerializeToString())
