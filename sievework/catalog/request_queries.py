"""Whole requests: uploads, files, memory updates, deletions; and what stores and streams of them hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masking, rx, vectors
from ..operators import sessions
from ..operators import vector_search as vs
from ..plans import ingest as plan
from ..session import new_workspace
from ..sources import files, tables
from ..streaming import ingest as stream
from ..streaming import stateful
from . import fixtures as fx
from .registry import query
from .retrieval_queries import BASE, hits_cte, recalled, session_messages
from .store_queries import DOC_ID, FILES, NAMED, created, matrix_sql
from .stream_queries import run_to_end, stream_table
from .text_queries import ENTITY_SQL, report_sql

# --- uploads --------------------------------------------------------------------------------------------------------


def uploads(files_of):
    number = F.col("doc_id")
    return files_of.select(
        number.alias("request_id"),
        fx.pick(fx.ROLES, number).alias("role"),
        F.when(number % 3 == 0, fx.pick(fx.NAMESPACES, number)).otherwise(fx.pick(fx.NAMESPACES, number + 5)).alias("own_namespace"),
        F.when(number % 13 == 0, F.lit(None)).when(number % 17 == 0, "").otherwise(F.col("text")).alias("text"),
        "file_name",
        F.when(number % 2 == 0, "second.txt").alias("filename"),
    )


UPLOADS = f"""{FILES}, {matrix_sql()}, uploads AS (SELECT doc_id AS request_id, {fx.pick_sql(fx.ROLES, "doc_id")} AS role,
  CASE WHEN doc_id % 3 = 0 THEN {fx.pick_sql(fx.NAMESPACES, "doc_id")} ELSE {fx.pick_sql(fx.NAMESPACES, "doc_id + 5")} END AS own_namespace,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN '' ELSE text END AS text, file_name AS given,
  CASE WHEN doc_id % 2 = 0 THEN 'second.txt' END AS filename FROM files),
 judged AS (SELECT u.*, CASE WHEN NOT coalesce((list_contains(namespaces, '*') OR list_contains(namespaces, own_namespace))
   AND list_contains(actions, 'upload'), false) THEN 403 WHEN coalesce(text, '') = '' THEN 400 ELSE 200 END AS status
  FROM uploads u LEFT JOIN matrix m ON u.role = m.role),
 titled AS (SELECT request_id, status, own_namespace, text,
   coalesce(nullif(given, ''), nullif(filename, ''), 'Uploaded Document') AS file_name FROM judged),
 answered AS (SELECT request_id, status::BIGINT AS status, CASE status WHEN 403 THEN 'Forbidden: No permission to upload'
   WHEN 400 THEN 'Missing required field: text.' END AS error, CASE WHEN status = 200 THEN file_name END AS file_name,
  CASE WHEN status = 200 THEN {ENTITY_SQL} END AS primary_entity, CASE WHEN status = 200 THEN own_namespace END AS namespace,
  CASE WHEN status = 200 THEN CAST(ceil(length(text) / 450.0) AS BIGINT) END AS chunks_stored FROM titled)"""
ANSWERED = ("request_id", "status", "error", "file_name", "primary_entity", "namespace", "chunks_stored")


def answers(responses, documents, chunks):
    """Responses with what the tables hold of each."""
    held = documents.groupBy(F.col("id").alias("document_id")).agg(F.count(F.lit(1)).alias("documents"))
    pieces = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    joined = responses.join(held, "document_id", "left").join(pieces, "document_id", "left")
    longs = {c: F.col(c).cast("long") for c in ("status", "chunks_stored")}
    return joined.withColumns(longs).select(*ANSWERED, F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


UPLOAD_SQL = f"""{UPLOADS} SELECT *, CASE WHEN status = 200 THEN 1 ELSE 0 END::BIGINT AS documents,
 coalesce(chunks_stored, 0) AS chunks FROM answered"""


@query("ingest_requests", UPLOAD_SQL)
def ingest_requests(spark, sf_dir):
    return answers(*plan.ingest_requests(uploads(fx.files(spark, sf_dir)), created_at=created()))


@query("stream_ingest_requests", UPLOAD_SQL)
def stream_ingest_requests(spark, sf_dir):
    """The same as a stream; the tables are read back."""
    path = new_workspace(spark, "uploads")
    documents = stream_table(spark, sf_dir, "documents")
    stream.stream_requests(uploads(fx.files_of(documents)), path, path + "-state", created_at=created()).awaitTermination()
    return answers(*[stream.stored(spark, path, name) for name in ("responses", "documents", "chunks")])


# --- files ----------------------------------------------------------------------------------------------------------


@query(
    "ingest_files",
    r"""WITH w AS (SELECT doc_id, regexp_split_to_array(text, '\s+') AS words FROM documents),
 s AS (SELECT doc_id, words, unnest(range(0, len(words), 650)) AS start FROM w),
 p AS (SELECT doc_id, array_to_string(words[start + 1 : start + 750], ' ') AS text FROM s)
 SELECT text, 'local_file' AS source, length(text)::VARCHAR AS length, 3::BIGINT AS width FROM p WHERE trim(text) <> ''""",
)
def ingest_files(spark, sf_dir):
    """Every document as a file, put into the vector table twice."""
    docs = fx.documents(spark, sf_dir).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    empty = spark.createDataFrame([], "id string, values array<double>, text string, metadata string")
    once = plan.ingest_files(docs, empty)
    return plan.ingest_files(docs, once).select(
        "text",
        F.get_json_object("metadata", "$.source").alias("source"),
        F.get_json_object("metadata", "$.length").alias("length"),
        F.size("values").cast("long").alias("width"),
    )


MARK, CUT = "\x1e", "\x1f"


@query("text_source_stream", "SELECT page_id, html FROM pages")
def text_source_stream(spark, sf_dir):
    """Pages in files of up to 64 that arrive in two steps, read whole by a stream that is started twice."""
    path = new_workspace(spark, "arriving")
    page = F.concat(F.lit(MARK), F.col("page_id").cast("string"), F.lit(CUT), F.col("html"))
    group = F.floor(F.col("page_id") / 64).alias("g")
    grouped = fx.table(spark, sf_dir, "pages").groupBy(group).agg(F.array_join(F.collect_list(page), "").alias("value"))
    for step in range(2):
        tables.write_each(grouped.where(F.col("g") % 2 == step).select("value"), f"{path}/in/{step}")
        writer = files.text_stream(spark, f"{path}/in").writeStream.format("parquet").option("path", f"{path}/out")
        writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    pieces = spark.read.parquet(f"{path}/out").select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), MARK)).alias("page"))
    cut = F.instr("page", CUT)
    return pieces.where("page <> ''").select(
        F.expr(f"substring(page, 1, instr(page, '{CUT}') - 1)").cast("long").alias("page_id"),
        F.substring(F.col("page"), cut + 1, F.length("page")).alias("html"),
    )


# --- memory and objects ---------------------------------------------------------------------------------------------


def memory_updates(spark, sf_dir):
    number = F.col("request_id")
    body = F.concat(
        F.lit('{"namespace": "'), F.col("namespace"), F.lit('", "note": '), number.cast("string"),
        F.when(number % 2 == 0, F.concat(F.lit(', "id": '), (number % 50).cast("string"))).otherwise(""), F.lit("}"),
    )
    return fx.requests(spark, sf_dir).select(
        "request_id", "role", "own_namespace",
        F.when(number % 7 == 4, "oops").when(number % 7 == 5, "[1]").otherwise(body).alias("body"),
        F.when(number % 3 != 0, vectors.mock_embed(body)).alias("embedding"),
    )


@query(
    "update_memory",
    f"""WITH {fx.REQUESTS}, j AS (SELECT request_id, CASE WHEN request_id % 7 IN (4, 5) THEN 400
   WHEN NOT (role = 'super_admin' OR (namespace <> '' AND namespace = own_namespace)) THEN 403 ELSE 200 END AS status,
  CASE WHEN request_id % 2 = 0 THEN request_id % 50 ELSE {fx.AS_OF_MS} + request_id END AS own FROM requests),
 good AS (SELECT own, max(request_id) AS latest FROM j WHERE status = 200 AND request_id % 3 <> 0 GROUP BY own)
 SELECT request_id, status::BIGINT AS status, CASE WHEN status = 200 THEN j.own END AS id,
  CASE WHEN status = 200 THEN CASE WHEN request_id % 3 <> 0 THEN 3 ELSE 0 END END::BIGINT AS embedding_length,
  CASE WHEN status = 200 THEN request_id % 3 <> 0 END AS vectorized, latest IS NOT NULL AS in_table, status = 200 AS appended
 FROM j LEFT JOIN good ON request_id = latest""",
)
def update_memory(spark, sf_dir):
    empty = spark.createDataFrame([], "id string, values array<double>, text string, metadata string")
    path = new_workspace(spark, "memory")
    responses, entries, after = plan.update_memory(memory_updates(spark, sf_dir), empty, F.lit(fx.AS_OF_MS) + F.col("request_id"))
    entries.write.mode("append").json(path)
    note = "get_json_object({}, '$.note')"
    held = after.select(F.expr(note.format("text")).cast("long").alias("request_id"), F.lit(True).alias("in_table"))
    stored = spark.read.schema("raw string").json(path)
    stored = stored.select(F.expr(note.format("raw")).cast("long").alias("request_id"), F.lit(True).alias("appended"))
    rows = responses.join(held, "request_id", "left").join(stored, "request_id", "left")
    return rows.select(
        "request_id", F.col("status").cast("long").alias("status"), "id", F.col("embedding_length").cast("long").alias("embedding_length"),
        "vectorized", F.coalesce("in_table", F.lit(False)).alias("in_table"), F.coalesce("appended", F.lit(False)).alias("appended"),
    )


def object_texts(spark, sf_dir):
    number = F.col("doc_id")
    whole = F.concat(
        F.lit('{"lang": "'), F.col("lang"), F.lit('", "k'), (number % 3).cast("string"), F.lit('": '), F.col("n_chars").cast("string"), F.lit("}")
    )
    odd = F.when(number % 7 == 3, "{broken").when(number % 7 == 5, '[{"lang": "xx"}]').when(number % 7 == 6, "7")
    return fx.documents(spark, sf_dir).select(F.col("source").alias("object_id"), "doc_id", F.coalesce(odd, whole).alias("payload"))


@query(
    "merge_json",
    """WITH good AS (SELECT * FROM documents WHERE doc_id % 7 NOT IN (3, 5, 6)),
 fields AS (SELECT source, doc_id, 'lang' AS key, '"' || lang || '"' AS value FROM good
  UNION ALL SELECT source, doc_id, 'k' || (doc_id % 3), n_chars::VARCHAR FROM good)
 SELECT source AS object_id, key, arg_max(value, doc_id) AS value FROM fields GROUP BY 1, 2""",
)
def merge_json(spark, sf_dir):
    return tables.merge_json(object_texts(spark, sf_dir), "payload", "doc_id")


@query(
    "payload_entries",
    f"""SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id * 3 ELSE {fx.AS_OF_MS} + doc_id END AS id,
 CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE {fx.AS_OF_MS} + doc_id END AS timestamp,
 CASE WHEN doc_id % 5 = 0 THEN '{{"lang":"' || lang || '"}}' ELSE '{{}}' END AS metadata FROM documents WHERE doc_id % 7 <> 3""",
)
def payload_entries(spark, sf_dir):
    number = F.col("doc_id")

    def when(remainder, *parts):
        return F.when(number % remainder == 0, F.concat(*parts)).otherwise("")

    text = F.concat(
        F.lit('{"doc": 1'), when(2, F.lit(', "id": '), (number * 3).cast("string")), when(3, F.lit(', "timestamp": '), number.cast("string")),
        when(5, F.lit(', "metadata": {"lang": "'), F.col("lang"), F.lit('"}')), F.lit("}"),
    )
    payload = F.when(number % 7 == 3, F.concat(F.lit("x"), text)).otherwise(text)
    found = tables.payload_entries(fx.documents(spark, sf_dir), payload, F.lit(fx.AS_OF_MS) + number)
    return found.select("id", "timestamp", "metadata")


@query(
    "delete_answers",
    f"""{FILES}, named AS (SELECT doc_id, {NAMED} AS file_name FROM files)
 SELECT doc_id AS request_id, CASE WHEN doc_id % 2 = 1 THEN 403 WHEN doc_id % 3 = 1 THEN 400 ELSE 200 END::BIGINT AS status,
  CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN file_name END AS deleted FROM named""",
)
def delete_answers(spark, sf_dir):
    number = F.col("doc_id")
    rows = tables.document_rows(fx.files(spark, sf_dir), created(), "doc_id")
    asked = rows.select(
        number.alias("request_id"),
        fx.pick(("super_admin", "admin"), number).alias("role"),
        F.when(number % 3 == 0, F.col("id")).when(number % 3 == 1, "").otherwise(F.concat(F.lit("absent-"), F.col("id"))).alias("document_id"),
        "namespace",
    )
    found = tables.delete_answers(rows.select("id", "file_name", "namespace"), asked)
    return found.select("request_id", F.col("status").cast("long").alias("status"), F.col("deleted_document.file_name").alias("deleted"))


# --- counts, vectors, sessions --------------------------------------------------------------------------------------


@query(
    "write_masked",
    f"""SELECT rule, CAST(sum(hits) AS BIGINT) AS hits FROM ({report_sql(masking.CLINICAL)}) GROUP BY rule
 UNION ALL SELECT 'rows', count(*) FROM documents""",
)
def write_masked(spark, sf_dir):
    """Masked documents written and counted by one job."""
    counts = tables.write_masked(fx.marked(spark, sf_dir), "text", new_workspace(spark, "masked"), masking.CLINICAL)
    return spark.createDataFrame(sorted(counts.items()), "rule string, hits long")


@query(
    "embed_stored",
    f"""WITH {fx.MESSAGES}, e AS (SELECT role, lower({fx.trim_sql("message")}) AS norm FROM messages)
 SELECT role, round(sum(length(norm) % 10 / 10.0), 6) AS s0, round(sum(length(norm) % 7 / 7.0), 6) AS s1, count(*) AS n
 FROM e GROUP BY role""",
)
def embed_stored(spark, sf_dir):
    """The users' messages first, then all; those known by then come from the store."""
    path = new_workspace(spark, "embedded")
    said = fx.messages(spark, sf_dir).select("role", F.lower(rx.trim(F.col("message"))).alias("norm"))
    vs.embed_stored(said.where("role = 'user'"), "norm", vectors.mock_embed, path)
    embedded = vs.embed_stored(said, "norm", vectors.mock_embed, path)
    sums = [F.sum(F.get("embedding", F.lit(i))).alias(f"s{i}") for i in range(2)]
    return embedded.groupBy("role").agg(*sums, F.count(F.lit(1)).alias("n"))


@query(
    "session_payload_messages",
    f"""{BASE}, {hits_cte("hits", "2", scoped=False, floor=None)},
 said AS (SELECT query_id, string_agg('• ' || chunk_text, chr(10) ORDER BY pos) AS memory FROM hits JOIN corpus USING (doc_id)
  GROUP BY query_id),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
 whole AS (SELECT conv_id, count(*) AS message_count, max(turn) AS updated_at FROM conversations GROUP BY conv_id)
 SELECT conv_id, place // 3 AS part, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages,
  any_value(message_count) AS message_count, any_value(updated_at) AS updated_at,
  coalesce(any_value(memory), 'No relevant memory retrieved.') AS memory
 FROM placed JOIN whole USING (conv_id) LEFT JOIN said ON conv_id = query_id GROUP BY conv_id, place // 3""",
)
def session_payload_messages(spark, sf_dir):
    """The whole payload, in parts of three messages."""
    found = recalled(spark, sf_dir, 2).select(F.col("query_id").alias("conv_id"), F.col("pos").alias("rank"), "text")
    parts = sessions.payload_parts(session_messages(spark, sf_dir), found, block=3)
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return parts.withColumn("messages", F.array_join(line, "\n")).withColumn("part", F.col("part").cast("long"))


@query(
    "session_state_event_time",
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_count,
 max(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS last_turn FROM conversations""",
)
def session_state_event_time(spark, sf_dir):
    """A minute between two turns; a session ends after half an hour of silence."""
    messages = stream_table(spark, sf_dir, "conversations").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60))
    return run_to_end(stateful.stream_sessions(messages), "timed-sessions")
