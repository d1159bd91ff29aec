"""Whole requests: access, search, context."""

import pytest
from pyspark.sql import functions as F

from sievework.functions.vectors import embed_with
from sievework.operators import vector_search as vs
from sievework.plans import chat, retrieve

WORDS = ("risk", "audit", "cloud", "wages")


def embed():
    def model(texts):
        words = ("risk", "audit", "cloud", "wages")
        return [[float(t.lower().count(w)) + 0.01 for w in words] for t in texts]

    return embed_with(model)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (i, "advisory" if i % 4 else "ventures", f"f{i % 5}.txt", f"{WORDS[i % 4]} report number {i} by Jane Doe " + "z" * i)
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, "id long, namespace string, filename string, chunk_text string")
    return df.withColumn("embedding", embed()(F.col("chunk_text")))


def test_only_permitted_requests_are_searched(spark, corpus):
    rows = [
        (1, "audit report", "advisory", "advisor", "advisory"),
        (2, "audit report", "ventures", "advisor", "advisory"),
        (3, "  ", "advisory", "advisor", "advisory"),
        (4, "audit report", "advisory", "nobody", "advisory"),
        (5, "risk report", "ventures", "ventures", "ventures"),
    ]
    requests = spark.createDataFrame(rows, "query_id long, query string, namespace string, role string, own_namespace string")
    status, found = retrieve.retrieve_requests(requests, corpus, embed(), key="id")
    assert {r["query_id"]: r["status"] for r in status.collect()} == {
        1: "ok", 2: "namespace mismatch", 3: "query required", 4: "no permission", 5: "ok",
    }
    got = found.select("query_id", "id", "pack_pos", "top_k").collect()
    assert {r["query_id"] for r in got} == {1, 5}
    assert all(r["id"] % 4 == 1 for r in got if r["query_id"] == 1)
    assert all(r["pack_pos"] < r["top_k"] <= 14 for r in got)


def test_contexts_of_messages(spark, corpus):
    rows = [
        (1, "please compare the audit reports we have", "", False),
        (2, "who are you", "", False),
        (3, "tell me something about it all", "my private note", False),
        (4, "my SSN is 123-45-6789 as you know", "", False),
        (5, "compare the audit reports", "only this", True),
        (6, "", "", False),
    ]
    messages = spark.createDataFrame(
        rows, "query_id long, message string, private_context string, private_mode boolean"
    ).withColumns({"role": F.lit("advisor"), "namespace": F.lit("advisory")})
    got = {r["query_id"]: r for r in chat.answer_contexts(messages, corpus, embed(), key="id").collect()}
    assert got[1]["priority"] == "HIGH" and "audit report number" in got[1]["context"]
    assert got[2]["fixed_answer"] == "Evidence assistant." and got[2]["context"] is None
    assert got[3]["priority"] == "NONE" and got[3]["context"].rstrip() == "my private note"
    assert got[4]["status"] == "Sensitive data blocked"
    assert got[5]["context"].rstrip() == "only this"
    assert got[6]["status"] == "Message required"


def test_hot_namespace_is_cut_into_blocks(spark, corpus, monkeypatch):
    """Most vectors in one namespace: more blocks, same rows."""
    monkeypatch.setattr(vs, "VECTOR_BLOCK", 4)
    monkeypatch.setattr(vs, "QUERY_BLOCK", 2)
    queries = corpus.select(F.col("id").alias("query_id"), "namespace", F.col("embedding").alias("query_vector"))
    near = vs.match_vectors(queries, corpus, key="id", top=4)
    cut = vs.match_vectors(queries, corpus, key="id", top=4, broadcast_limit=0)
    assert near.exceptAll(cut).isEmpty() and cut.exceptAll(near).isEmpty() and near.count() == 160
