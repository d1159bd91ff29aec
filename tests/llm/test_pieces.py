"""Encoding and counting against the public library on the same pieces and scores, and by round trips."""

import random

import pytest
import sentencepiece

from sievework.llm import sentencepiece_viterbi, token_counts
from sievework.llm.pieces import MODEL, PLACEHOLDER

from .conftest import LONG, ODD

model_pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")


@pytest.fixture(scope="module")
def library():
    """The library's own unigram encoder on this vocabulary."""
    proto = model_pb.ModelProto()
    with open(MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    lowest = min(p.score for p in proto.pieces if p.type == 1 and p.score > PLACEHOLDER)
    for piece in proto.pieces:
        if piece.score < PLACEHOLDER:
            piece.score = lowest - 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def samples():
    pick = random.Random(7)
    signs = ["a", "the", "er", "in", "ß", "é", " ", "  ", "\n", ".", ",", "$$$", "日", "▁", "7", "Qx", "\t", "ing", "😀"]
    made = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 40))) for _ in range(400)]
    return [*made, " lead", "trail ", "  ", " ", "a  b   c", "x▁ y", "antidisestablishmentarianism's"]


def test_same_pieces_as_the_library(table, library):
    texts = samples()
    df = table(enumerate(texts))
    ids = {r["doc_id"]: r["ids"] for r in sentencepiece_viterbi.encode(df).collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df).collect()}
    for i, text in enumerate(texts):
        assert ids[i] == library.encode(text), text
        assert counts[i] == len(ids[i])


def test_documents_come_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoded = sentencepiece_viterbi.encode(docs)
    assert encoded.where("NOT round_trip OR round_trip IS NULL").count() == 0
    decoded = sentencepiece_viterbi.decode(encoded).withColumnRenamed("text", "back")
    assert decoded.join(docs, "doc_id").where("back <> text").count() == 0
    counted = token_counts.token_counts(docs)
    assert counted.join(encoded, "doc_id").where("n_tokens <> n_pieces").count() == 0


def test_odd_rows(odd, nothing, spark):
    got = {}
    for r in sentencepiece_viterbi.encode(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(ODD)
    assert (got[1][0]["ids"], got[1][0]["n_pieces"], got[1][0]["round_trip"]) == (None, None, None)
    assert (got[2][0]["ids"], got[2][0]["n_pieces"]) == ([], 0)
    assert got[4][0]["round_trip"] and got[4][0]["n_pieces"] > 60000 and len(LONG) > 200000
    assert got[5][0]["ids"] == got[5][1]["ids"]
    assert got[6][0]["round_trip"] is False  # the mark itself comes back as a space
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(odd).collect()}
    assert counts[1] is None and counts[2] == 0
    assert all(counts[k] == v[0]["n_pieces"] for k, v in got.items())
    assert sentencepiece_viterbi.encode(nothing).count() == token_counts.token_counts(nothing).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [99999999, None, -1])], "doc_id long, ids array<int>")
    back = {r["doc_id"]: r["text"] for r in sentencepiece_viterbi.decode(ids).collect()}
    assert back[1] is None and back[2] == "" and "⁇" in back[3]
