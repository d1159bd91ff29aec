"""Operators on small fixtures, against brute force where there is no SQL."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import access, context, documents, evidence, memory, ranking, sessions
from sievework.operators import vector_search as vs
from sievework.plans.ingest import ingest
from sievework.sources import files, tables
from sievework.streaming import rate_limit, stateful


def pack(spark, lengths, budget, files_of=None, texts=None):
    rows = [
        (1, i, f"f{files_of[i] if files_of else i}", texts[i] if texts else chr(97 + i) * n, 1.0 - i / 100, budget)
        for i, n in enumerate(lengths)
    ]
    df = spark.createDataFrame(
        rows, "query_id long, pos int, filename string, content string, final_score double, budget int"
    )
    df = df.withColumn("fingerprint", F.col("content"))
    packed = ranking.budget_pack(ranking.file_scores(ranking.file_cap(df)))
    return [r["pos"] for r in packed.orderBy("pack_pos").collect()]


def test_pack_skips_what_does_not_fit(spark):
    assert pack(spark, [6, 5, 4], 10) == [0, 2]


def test_pack_takes_best_of_each_file_first(spark):
    # file 0 has the highest sum; its second row waits for the first row of file 1
    assert pack(spark, [1, 1, 1, 1], 100, [0, 0, 1, 0]) == [0, 2, 1, 3]


def test_pack_stops_after_a_round_that_adds_nothing(spark):
    # second row of the file is too long: the third is not tried, though it would fit
    assert pack(spark, [5, 50, 1], 10, [0, 0, 0]) == [0]


def test_pack_skips_copies(spark):
    assert pack(spark, [3, 3, 3], 100, texts=["abc", "abc", "abd"]) == [0, 2]


def test_file_cap_and_budget_hold(spark):
    random.seed(5)
    rows = [
        (q, i, f"f{random.randrange(4)}", "x" * random.randrange(1, 400) + str(i), random.random(), 900)
        for q in range(20)
        for i in range(20)
    ]
    df = spark.createDataFrame(
        rows, "query_id long, pos int, filename string, content string, final_score double, budget int"
    ).withColumn("fingerprint", F.col("content"))
    packed = ranking.budget_pack(ranking.file_scores(ranking.file_cap(df)))
    worst = packed.groupBy("query_id").agg(F.sum(F.length("content")).alias("n")).agg(F.max("n")).first()[0]
    most = packed.groupBy("query_id", "filename").count().agg(F.max("count")).first()[0]
    assert worst <= 900 and most <= 3


def vectors_and_queries(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 8)).astype("float32")
    base[200:] = base[:200]  # every vector twice: ties everywhere
    corpus = [(i, "a" if i % 3 else "b", base[i].tolist()) for i in range(400)] + [
        (400, "a", None), (401, "a", [0.0] * 8), (402, "a", [1.0, 2.0]),
    ]
    asked = [(q, "a" if q % 2 else "b", rng.normal(size=8).astype("float32").tolist(), 3 + q % 4) for q in range(30)]
    return (
        spark.createDataFrame(corpus, "id long, namespace string, embedding array<float>").repartition(5),
        spark.createDataFrame(asked, "query_id long, namespace string, query_vector array<float>, k int"),
        corpus,
        asked,
    )


def brute(corpus, asked, floor):
    out = {}
    for q, space, vector, k in asked:
        scored = []
        for i, s, v in corpus:
            if s != space:
                continue
            score = 0.0
            if v is not None and len(v) == 8 and any(v):
                a, b = np.array(vector, dtype=float), np.array(v, dtype=float)
                score = round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9)
            if floor is None or score > floor:
                scored.append((-score, i))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("floor", [None, 0.2])
@pytest.mark.parametrize("broadcast_limit", [None, 4])
def test_search_equals_brute_force(spark, floor, broadcast_limit, monkeypatch):
    monkeypatch.setattr(vs, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vs, "VECTOR_BLOCK", 90)
    corpus, queries, raw, asked = vectors_and_queries(spark)
    found = vs.match_vectors(
        queries, corpus, key="id", top=F.col("k"), largest=6, floor=floor, broadcast_limit=broadcast_limit
    )
    got = {q: [] for q, *_ in asked}
    for r in found.orderBy("query_id", "pos").collect():
        got[r["query_id"]].append(r["id"])
    assert got == brute(raw, asked, floor)


def test_confidence_sums_to_one(spark):
    corpus, queries, raw, _ = vectors_and_queries(spark)
    found = vs.local_search_confidence(queries, corpus, key="id", k=len(raw), weakest=-1)
    for r in found.groupBy("query_id").agg(F.sum("confidence").alias("s")).collect():
        assert r["s"] == pytest.approx(1)
    scores = spark.range(50).select((F.col("id") % 2).alias("g"), (F.col("id") * 100.0).alias("s"))
    for r in vs.softmax(scores, "s", "g").groupBy("g").agg(F.sum("confidence").alias("s")).collect():
        assert r["s"] == pytest.approx(1)


def decisions(times, limit, window):
    held, out = [], []
    for t in times:
        held = [x for x in held if t - x < window]
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out


def limited(spark, rows, **options):
    df = spark.createDataFrame(rows, "user_id long, event_id long, s double").withColumn(
        "ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))
    )
    got = rate_limit.rate_limit(df, **options)
    return {r["event_id"]: r["allowed"] for r in got.collect()}


def test_rate_limit_counts_accepted_only(spark):
    rows = [(1, i, float(t)) for i, t in enumerate([0, 1, 2, 3, 60, 61, 62])]
    got = limited(spark, rows, limit=2, window_seconds=60)
    assert [got[i] for i in range(7)] == [True, True, False, False, True, True, False]


@pytest.mark.parametrize("slice_windows", [1, 2, 7])
def test_rate_limit_across_slices_equals_brute_force(spark, slice_windows):
    """One busy user over many slices; with one round the ordered pass takes over."""
    random.seed(11)
    times = {u: sorted(round(random.uniform(0, 3000 if u else 900), 3) for _ in range(600 if u == 0 else 80)) for u in range(4)}
    rows, want = [], {}
    for u, ts in times.items():
        for i, (t, ok) in enumerate(zip(ts, decisions(ts, 3, 60))):
            rows.append((u, u * 10000 + i, t))
            want[u * 10000 + i] = ok
    random.shuffle(rows)
    got = limited(spark, rows, limit=3, window_seconds=60, slice_windows=slice_windows)
    assert got == want


def test_a_user_without_pause_takes_few_rounds(spark, monkeypatch):
    pick, t, times = random.Random(4), 0.0, []
    while t < 4000 * 60:
        t += pick.choice([3.0, 7.0, 11.5, 17.25])
        times.append(t)
    rounds, real = [], rate_limit._decide

    def counted(*args):
        rounds.append(1)
        return real(*args)

    monkeypatch.setattr(rate_limit, "_decide", counted)
    rows = [(1, i, t) for i, t in enumerate(times)] + [(2, 10**6 + i, 70.0 * i) for i in range(50)]
    want = dict(enumerate(decisions(times, 3, 60))) | {10**6 + i: True for i in range(50)}
    assert limited(spark, rows, limit=3, window_seconds=60, slice_windows=1) == want
    assert len(rounds) <= 2 + rate_limit.ROUNDS


def test_decide_reports_remaining_and_wait():
    held, allowed, remaining, wait = stateful.decide([0], 30_000_000, 2, 60_000_000)
    assert (held, allowed, remaining, wait) == ([0, 30_000_000], True, 0, 30)


def test_running_count_over_blocks(spark):
    rows = [(s, t, "user", str(t)) for s in range(3) for t in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    got = sessions.running_count(df, "conv_id", "turn", block=8).orderBy("conv_id", "turn").collect()
    assert [r["message_count"] for r in got] == list(range(1, 15)) * 3


def test_source_cap_fills_up_when_short(spark):
    rows = [(1, i, f"text {i}", "s") for i in range(10)] + [(2, i, f"t{i}", f"s{i % 5}") for i in range(12)]
    df = spark.createDataFrame(rows, "query_id long, pos int, content string, source string")
    got = evidence.source_cap_with_fallback(df, (F.col("pos"),)).orderBy("query_id", "chosen_pos").collect()
    assert [r["pos"] for r in got if r["query_id"] == 1] == list(range(8))
    assert [r["pos"] for r in got if r["query_id"] == 2] == list(range(8))


def test_two_decimals_follow_the_binary_value(spark):
    df = spark.createDataFrame([(2.675,), (0.125,), (1.0,), (-0.375,), (1234.5,)], "x double")
    assert [r[0] for r in df.select(context.two_decimals(F.col("x"))).collect()] == ["2.67", "0.13", "1.00", "-0.38", "1234.50"]


def test_empty_results_keep_their_query(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    found = spark.createDataFrame([(1, 7, "t", 0.5, 0)], "query_id long, id long, text string, similarity double, pos int")
    got = {r["query_id"]: (r["status"], r["count"]) for r in documents.memory_results(queries, found).collect()}
    assert got == {1: ("success", 1), 2: ("success", 0)}
    off = documents.memory_results(queries, found, store_ready=False).collect()
    assert {(r["status"], r["count"]) for r in off} == {("vector_db_disabled", 0)}
    none = found.limit(0).withColumn("final_score", F.lit(1.0)).withColumn("rank", F.lit(0))
    assert {r["summary"] for r in memory.summary_numbered(none, queries).collect()} == {memory.NO_MEMORY_NUMBERED}


def test_access(spark):
    rows = [
        (1, "super_admin", "x", "x", "delete"), (2, "super_admin", "x", "y", "chat"), (3, "cyber", "cybersecurity", "cybersecurity", "upload"),
        (4, "cyber", "cybersecurity", "cybersecurity", "chat"), (5, "nobody", "x", "x", "chat"),
    ]
    df = spark.createDataFrame(rows, "id long, role string, own_namespace string, namespace string, action string")
    got = {r["id"]: r["reason"] for r in access.authorize(df, access.role_matrix(spark)).collect()}
    assert got == {1: "ok", 2: "namespace mismatch", 3: "no permission", 4: "ok", 5: "no permission"}


def test_upsert_takes_the_latest_change(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, seq long")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, seq long")
    got = {r["id"]: r["v"] for r in tables.upsert_by_id(old, new, "seq").collect()}
    assert got == {1: "a", 2: "d", 3: "e"}


def test_json_sources_forgive(spark, tmp_path):
    assert files.json_memory_source(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "bad.json").write_text("no json")
    assert files.json_memory_source(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "good.json").write_text(json.dumps([{"docId": "1", "text": "x", "embedding": [1.0]}]))
    assert files.json_memory_source(spark, str(tmp_path / "good.json")).first()["docId"] == "1"


def test_binary_source_splits_texts_and_rejects(spark, tmp_path):
    (tmp_path / "a.md").write_text(" mail a@b.co ")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.png").write_bytes(b"x")
    texts, rejects = files.binary_source(spark, str(tmp_path))
    assert [r["text"] for r in texts.collect()] == ["mail [REDACTED_EMAIL]"]
    assert sorted(r["reason"] for r in rejects.collect()) == ["Unsupported file type: png", "needs an extractor"]


def test_ingest_twice_writes_the_same_rows(spark, tmp_path):
    docs = spark.createDataFrame(
        [("Jane Smith cv.pdf", "en", "word " * 300), ("x.txt", "fr", "short"), ("y.txt", "fr", "")],
        "file_name string, namespace string, text string",
    )
    states = []
    for run in ("1", "2"):
        counts = ingest(docs, str(tmp_path / f"d{run}"), str(tmp_path / f"c{run}"), created_at=F.timestamp_millis(F.lit(0)))
        assert counts == {"documents": 2, "chunks": 5}
        chunks = spark.read.parquet(str(tmp_path / f"c{run}"))
        states.append(sorted((r["document_id"], r["chunk_index"], r["chunk_text"]) for r in chunks.collect()))
    assert states[0] == states[1] and len(states[0]) == 5
    assert any(t.startswith("PRIMARY ENTITY: Jane Smith\nSOURCE FILE: Jane Smith cv.pdf\n\n") for _, _, t in states[0])
    assert spark.read.parquet(str(tmp_path / "d1")).count() == 2


def test_probe_asks_fixed_questions(spark):
    from sievework.functions.vectors import mock_embed

    store = spark.range(20).select("id", mock_embed(F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("embedding"))
    found = memory.probe(store, mock_embed, "id", ("one", "two and more", "three or four"))
    assert {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()} == {0: 2, 1: 2, 2: 2}


@pytest.mark.parametrize("broadcast_limit", [None, 0])
def test_null_scopes_agree_with_nothing(spark, broadcast_limit):
    corpus = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, "", [1.0, 0.1]), (4, "a", [0.0, 1.0])],
        "id long, namespace string, embedding array<float>",
    )
    queries = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, "", [1.0, 0.0])],
        "query_id long, namespace string, query_vector array<float>",
    )
    found = vs.match_vectors(queries, corpus, key="id", top=5, broadcast_limit=broadcast_limit).collect()
    assert sorted((r["query_id"], r["id"]) for r in found) == [(1, 1), (1, 4), (3, 3)]
    anywhere = vs.match_vectors(queries, corpus, key="id", scope=None, top=1, broadcast_limit=broadcast_limit).collect()
    assert sorted((r["query_id"], r["id"]) for r in anywhere) == [(1, 1), (2, 1), (3, 1)]


@pytest.mark.parametrize("broadcast_limit", [None, 0])
def test_text_keys(spark, broadcast_limit):
    rows = [("b", "n", [1.0, 0.0]), ("a", "n", [2.0, 0.0]), ("c", "n", [0.0, 1.0]), (None, "n", [1.0, 0.0])]
    corpus = spark.createDataFrame(rows, "id string, namespace string, embedding array<float>")
    queries = spark.createDataFrame(
        [("q", "n", [1.0, 0.0], "b"), ("r", "n", [1.0, 0.0], None)],
        "query_id string, namespace string, query_vector array<float>, own string",
    )
    found = vs.match_vectors(queries, corpus, key="id", top=2, own_key="own", broadcast_limit=broadcast_limit)
    got = [(r["query_id"], r["pos"], r["id"]) for r in found.orderBy("query_id", "pos").collect()]
    assert got == [("q", 0, "a"), ("q", 1, "c"), ("r", 0, "a"), ("r", 1, "b")]


def test_search_reads_named_scopes_and_scans_once(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = [(i, f"s{i % 5}", [float(i % 7) + 1, 1.0]) for i in range(100)]
    spark.createDataFrame(rows, "id long, namespace string, embedding array<float>").write.partitionBy("namespace").parquet(path)
    corpus = spark.read.parquet(path)
    queries = spark.createDataFrame([(1, "s2", [1.0, 0.0])], "query_id long, namespace string, query_vector array<float>")
    found = vs.match_vectors(queries, corpus, key="id", top=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "s2" in plan.split("PartitionFilters", 1)[1][:200]
    assert plan.count("MapInArrow") == 1


def test_equal_sequences_are_decided_alike(spark):
    rows = [(1, 5, f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, seq long, value string")
    picks = {tables.latest_by_id(df.repartition(n), "seq").first()["value"] for n in (1, 3, 7, 11)}
    assert len(picks) == 1


def test_memory_of_tomorrow_has_no_recency(spark):
    day = 86400000
    df = spark.createDataFrame([(1.0, 2.0, 3 * day)], "score double, priority double, written_ms long")
    assert memory.apply_weights(df, F.lit(2 * day)).first()["final_score"] == pytest.approx(0.65 + 0.5)


def test_a_second_ingest_into_the_same_folder_adds_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("a.txt", "n", "word " * 300), ("a.txt", "n", "word " * 300), ("b.txt", "m", "x")], "file_name string, namespace string, text string")
    paths = str(tmp_path / "d"), str(tmp_path / "c")
    at = F.timestamp_millis(F.lit(0))
    assert ingest(docs, *paths, created_at=at) == {"documents": 2, "chunks": 5}
    assert ingest(docs, *paths, created_at=at) == {"documents": 0, "chunks": 0}
    more = docs.unionByName(spark.createDataFrame([("c.txt", "m", "y")], docs.schema))
    assert ingest(more, *paths, created_at=at) == {"documents": 1, "chunks": 1}
    chunks = spark.read.parquet(paths[1])
    assert chunks.count() == 6 and chunks.select("chunk_id").distinct().count() == 6


def test_stream_limits_over_triggers_drop_old_state(spark, tmp_path):
    """Out-of-order requests over several triggers, late ones, and state that goes away behind the watermark."""
    second = 1_000_000
    triggers = [
        [(u, 100 + u, t * second) for u in range(40) for t in (3, 1, 2)],
        [(1, 7, 2 * second), (1, 8, 30 * second)],  # in time though behind the newest
        [(99, 1, 10_000 * second)],  # moves the watermark past all windows
        [(99, 2, 10_000 * second + 1), (1, 9, 5 * second)],  # the second is too late and left out
        [(99, 3, 20_000 * second)],
    ]
    source = tmp_path / "in"
    schema = "user_id long, event_id long, ts timestamp"
    for n, rows in enumerate(triggers):
        df = spark.createDataFrame(rows, "user_id long, event_id long, us long").withColumn("ts", F.timestamp_micros("us"))
        df.drop("us").coalesce(1).write.parquet(str(source / f"t={n}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    limited = stateful.stream_rate_limit(stream, limit=2, window_seconds=60, late_seconds=100)
    query = (
        limited.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    got = {(r["user_id"], r["event_id"], r["ts_us"] // second): r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert all(got[u, 100 + u, t] == (t < 3) for u in range(40) for t in (1, 2, 3))
    assert got[1, 7, 2] is False and got[1, 8, 30] is False
    assert got[99, 1, 10_000] and got[99, 3, 20_000] and (1, 9, 5) not in got
    assert max(states) >= 40 and states[-1] <= 4
