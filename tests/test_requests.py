"""Uploads, stores, streams and payloads on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from sievework.functions import objects
from sievework.functions.vectors import embed_with, mock_embed
from sievework.operators import sessions
from sievework.operators import vector_search as vs
from sievework.plans import ingest as plan
from sievework.sources import files, tables
from sievework.streaming import ingest as stream
from sievework.streaming import stateful

UPLOAD = "request_id long, role string, own_namespace string, text string, file_name string, filename string"


def at():
    return F.lit("2024-02-01").cast("timestamp")


def uploads(spark, numbers):
    rows = [(i, "advisor" if i % 4 else "guest", "advisory", "" if i % 5 == 0 else f"text {i} " * (i % 3 * 80 + 1), f"f{i}.txt", None) for i in numbers]
    return spark.createDataFrame(rows, UPLOAD)


def tables_of(spark, path):
    return {n: sorted(map(str, stream.stored(spark, path, n).drop("batch").collect())) for n in stream.TABLES}


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path, state, source = str(tmp_path / "t"), str(tmp_path / "s"), str(tmp_path / "in")
    requests = spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", 1).parquet(source + "/*")
    for step in range(2):
        uploads(spark, range(step * 20, step * 20 + 20)).coalesce(1).write.parquet(f"{source}/{step}")
        stream.stream_requests(requests, path, state, created_at=at()).awaitTermination()
    first = tables_of(spark, path)
    assert len(first["responses"]) == 40 and len(first["documents"]) == sum(i % 4 > 0 and i % 5 > 0 for i in range(40))
    counts = {r["request_id"]: r["chunks_stored"] for r in stream.stored(spark, path, "responses").collect()}
    assert sum(c or 0 for c in counts.values()) == len(first["chunks"])
    # the last batch was stored but never noted as done; a failed write has left rows behind
    commits = sorted((f for f in os.listdir(f"{state}/commits") if f.isdigit()), key=int)
    os.remove(f"{state}/commits/{commits[-1]}")
    os.remove(f"{state}/commits/.{commits[-1]}.crc")
    stream.stored(spark, path, "chunks").limit(3).drop("batch").write.mode("append").parquet(f"{path}/chunks/batch={commits[-1]}")
    assert tables_of(spark, path) != first
    stream.stream_requests(requests, path, state, created_at=at()).awaitTermination()
    assert tables_of(spark, path) == first


def test_uploads_are_judged(spark):
    rows = [(1, "advisor", "advisory", "hello", "", "b.txt"), (2, "cyber", "cybersecurity", "x", "a", None), (3, "advisor", "advisory", None, "a", None),
            (4, "advisor", "ventures", "x", "a", None), (5, None, None, "x", "a", None), (6, "super_admin", "any", "y" * 901, None, None)]
    responses, documents, chunks = plan.ingest_requests(spark.createDataFrame(rows, UPLOAD), created_at=at())
    got = {r["request_id"]: r for r in responses.collect()}
    assert [got[i]["status"] for i in range(1, 7)] == [200, 403, 400, 403, 403, 200]
    assert got[1]["file_name"] == "b.txt" and got[6]["file_name"] == tables.DEFAULT_NAME and got[6]["chunks_stored"] == 3
    assert sorted(c for r in got.values() for c in (r["chunk_ids"] or [])) == sorted(r["chunk_id"] for r in chunks.collect())
    assert documents.count() == 2


def test_objects_are_told_from_other_texts(spark):
    cases = {'{"a": 1}': True, " {} ": True, "{not json": False, "[1]": False, "12": False, '"x"': False, "null": False, "": False, '{"a": 1} x': False}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    got = {r["t"]: r["o"] for r in df.select("t", objects.is_object(F.col("t")).alias("o")).collect()}
    assert got == cases | {None: False}


def test_stored_embeddings_are_not_made_again(spark, tmp_path):
    path = str(tmp_path / "e")

    def model(texts):
        return [[float(len(t))] for t in texts]

    def broken(texts):
        raise ValueError("called")

    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "i long, t string")
    first = {r["i"]: r["embedding"] for r in vs.embed_stored(df, "t", embed_with(model), path).collect()}
    assert first == {1: [2.0], 2: [1.0], 3: [2.0], 4: []}
    again = vs.embed_stored(df.where("i < 4"), "t", embed_with(broken), path)
    assert {r["i"]: r["embedding"] for r in again.collect()} == {1: [2.0], 2: [1.0], 3: [2.0]}
    with pytest.raises(Exception):
        vs.embed_stored(df.union(spark.createDataFrame([(9, "new")], df.schema)), "t", embed_with(broken), path).collect()
    more = vs.embed_stored(df.union(spark.createDataFrame([(9, "new")], df.schema)), "t", embed_with(model), path)
    assert more.count() == 5 and spark.read.parquet(path).count() == 4


def test_softmax_of_far_scores(spark):
    df = spark.createDataFrame([("a", 1e4), ("a", 1e4 - 1), ("a", -1e4), ("b", -5000.0), ("b", -5000.0), ("c", 0.0)], "g string, s double")
    got = sorted((r["g"], r["s"], round(r["confidence"], 6)) for r in vs.softmax(df, "s", "g").collect())
    assert got == [("a", -1e4, 0.0), ("a", 9999.0, 0.268941), ("a", 1e4, 0.731059), ("b", -5000.0, 0.5), ("b", -5000.0, 0.5), ("c", 0.0, 1.0)]


def test_writes_count_what_they_write(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    assert tables.write_table(df, str(tmp_path / "a"), "g", large=F.count_if(F.col("id") > 900)) == {"rows": 1000, "large": 99}
    assert tables.write_table(df, str(tmp_path / "b"))["rows"] == 1000
    assert tables.append_new(df, str(tmp_path / "c"), ("id",), "g") == 1000
    assert tables.append_new(spark.range(990, 1010).select("id", F.lit(0).cast("long").alias("g")), str(tmp_path / "c"), ("id",), "g") == 10
    assert tables.append_new(df.limit(0), str(tmp_path / "c"), ("id",), "g") == 0
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1010


def test_session_state_goes_with_event_time(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source)
    schema = "conv_id long, turn long, ts timestamp"
    messages = spark.readStream.schema(schema).parquet(source)
    running = (
        stateful.stream_sessions(messages, gap_seconds=100, late_seconds=10)
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "s")).outputMode("append").start()
    )

    def arrive(*rows):
        df = spark.createDataFrame(rows, "conv_id long, turn long, s long").select("conv_id", "turn", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
        running.processAllAvailable()
        return running.lastProgress["stateOperators"][0]["numRowsTotal"]

    try:
        one = arrive((1, 2, 1000), (1, 1, 999))
        # out of order, within the delay
        assert arrive((1, 0, 995), (1, 3, 1003), (2, 1, 1000)) == 2 * one > 0
        # another session moves the watermark; in the end it is the only one held
        arrive((9, 0, 5000))
        assert arrive((9, 1, 5001)) == one
        # the session begins anew
        arrive((1, 4, 5002))
    finally:
        running.stop()
    got = sorted((r["conv_id"], r["turn"], r["message_count"], r["last_turn"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0, 3, 2), (1, 1, 1, 1), (1, 2, 2, 2), (1, 3, 4, 3), (1, 4, 1, 4), (2, 1, 1, 1), (9, 0, 1, 0), (9, 1, 2, 1)]


def test_files_that_arrive_later_are_read_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for step, name in enumerate(("a.txt", "b.md", "c.bin")):
        (source / name).write_text(f"file {name}\nline two\n")
        writer = files.text_stream(spark, str(source)).writeStream.format("parquet").option("path", out)
        writer.option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["path"].rsplit("/", 1)[-1], r["text"]) for r in spark.read.parquet(out).collect())
    assert got == [("a.txt", "file a.txt\nline two\n"), ("b.md", "file b.md\nline two\n")]


def test_payload_comes_in_parts(spark):
    history = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(7)] + [(2, 0, "user", "x")], "conv_id long, turn long, role string, content string")
    memories = spark.createDataFrame([(1, 0, "fact")], "conv_id long, rank int, text string")
    got = {(r["conv_id"], r["part"]): r for r in sessions.payload_parts(history, memories, block=3).collect()}
    assert [len(got[1, p]["messages"]) for p in range(3)] == [3, 3, 1] and got[1, 1]["messages"][0]["content"] == "m3"
    assert got[1, 2]["message_count"] == 7 and got[1, 0]["memory"] == "• fact" and got[2, 0]["memory"] == "No relevant memory retrieved."


def test_a_file_put_in_twice_changes_nothing(spark):
    docs = spark.createDataFrame([("a", "one two three " * 600), ("b", "  ")], "path string, text string")
    empty = spark.createDataFrame([], "id string, values array<double>, text string, metadata string")
    once = plan.ingest_files(docs, empty, embed=mock_embed)
    twice = plan.ingest_files(docs, once, embed=mock_embed)
    assert sorted(r["id"] for r in once.collect()) == sorted(r["id"] for r in twice.collect()) and once.count() == 3
