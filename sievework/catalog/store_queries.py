"""Sources, sinks, filters and projections over stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import mock_embed
from ..operators import access, documents, memory
from ..operators.vector_search import match_vectors
from ..plans.ingest import chunk_documents, ingest
from ..session import new_workspace
from ..sources import files, tables
from . import fixtures as fx
from .registry import query
from .text_queries import ENTITY_SQL, HEADER_SQL, fixed_sql, masked_sql, masking, trim_sql

def created():
    return F.timestamp_millis(F.lit(fx.AS_OF_MS))


FILES = f"WITH {fx.FILES}"
NAMED = "coalesce(nullif(file_name, ''), 'Uploaded Document')"
DOC_ID = f"sha256(namespace || '␟' || {NAMED} || '␟' || text || '␟' || CAST(doc_id AS VARCHAR))"

# --- sources --------------------------------------------------------------------------------------------------------


def in_few_tasks(df):
    """Spark reads some thirty small files in a task; here are very many, so each task takes several such groups."""
    return df.coalesce(16 * df.sparkSession.sparkContext.defaultParallelism)


@query("text_source", "SELECT page_id, html || chr(10) AS text FROM pages")
def text_source(spark, sf_dir):
    """Every page written as a file of its own, its number in the first line, and read back whole."""
    path = new_workspace(spark, "pages")
    pages = fx.table(spark, sf_dir, "pages")
    tables.write_each(pages.select(F.concat_ws("\n", F.col("page_id").cast("string"), "html").alias("value")), path)
    found = in_few_tasks(files.text_source(spark, path))
    cut = F.instr("text", "\n")
    return found.select(
        F.expr("substring(text, 1, instr(text, '\n') - 1)").cast("long").alias("page_id"),
        F.substring(F.col("text"), cut + 1, F.length("text")).alias("text"),
    )


@query(
    "route_by_type",
    f"{FILES}, e AS (SELECT doc_id, mime, lower(list_last(string_split(file_name, '.'))) AS ext FROM files)"
    " SELECT doc_id, CASE WHEN ext IN ('txt', 'md') THEN 'text' WHEN ext IN ('pdf', 'docx') THEN 'extract' ELSE 'reject' END"
    " AS route, CASE WHEN mime IN ('application/pdf') THEN 'extract' ELSE 'text' END AS mime_route,"
    " CASE WHEN ext NOT IN ('txt', 'md', 'pdf', 'docx') THEN 'Unsupported file type: ' || ext END AS reason FROM e",
)
def route_by_type(spark, sf_dir):
    name = F.col("file_name")
    route = files.route_by_extension(name)
    return fx.files(spark, sf_dir).select(
        "doc_id",
        route.alias("route"),
        files.route_by_mime(F.col("mime")).alias("mime_route"),
        F.when(route == "reject", files.reject_reason(name)).alias("reason"),
    )


@query("parse_text", f"SELECT doc_id, {trim_sql(masked_sql('text', masking.PII))} AS text FROM documents")
def parse_text(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("doc_id", files.parsed_text(F.col("text")).alias("text"))


def vector_entries(spark, sf_dir):
    b, e = fx.table(spark, sf_dir, "benchmark"), fx.table(spark, sf_dir, "embeddings")
    entry = F.struct(
        F.col("item_id").cast("string").alias("docId"),
        F.concat(F.lit("item"), F.col("item_id").cast("string"), F.lit(".txt")).alias("filename"),
        "text",
        "embedding",
    )
    return b.join(e, b.item_id == e.vec_id).select("item_id", entry.alias("entry"))


ENTRIES_PER_FILE = 1000
JSON_SQL = """SELECT CAST(item_id AS VARCHAR) AS "docId", 'item' || CAST(item_id AS VARCHAR) || '.txt' AS filename, text,
 CAST(len(embedding) AS BIGINT) AS width, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS mass
 FROM benchmark JOIN embeddings ON item_id = vec_id"""


def json_summary(df):
    mass = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + F.abs(x.cast("double")))
    return df.select("docId", "filename", "text", F.size("embedding").alias("width"), mass.alias("mass"))


@query("json_memory_source", JSON_SQL)
def json_memory_source(spark, sf_dir):
    path = new_workspace(spark, "arrays")
    rows = vector_entries(spark, sf_dir)
    # files that each hold an array of many entries, at most about ENTRIES_PER_FILE
    count = max(16, -(-rows.count() // ENTRIES_PER_FILE))
    group = F.pmod(F.xxhash64("item_id"), F.lit(count)).alias("g")
    groups = rows.groupBy(group).agg(F.to_json(F.collect_list("entry")).alias("value"))
    tables.write_each(groups.select("value"), path)
    return json_summary(files.json_memory_source(spark, f"{path}/*"))


@query("json_dir_source", JSON_SQL)
def json_dir_source(spark, sf_dir):
    path = new_workspace(spark, "objects")
    tables.write_each(vector_entries(spark, sf_dir).select("entry.*"), path, "json")
    return json_summary(files.json_dir_source(spark, f"{path}/*"))


@query(
    "file_router",
    f"""WITH said AS (SELECT doc_id, 'id=' || CAST(doc_id AS VARCHAR) || ';' || chr(10) || text
   || CASE WHEN doc_id % 4 = 1 THEN chr(65533) || ' end' ELSE '' END AS text FROM documents WHERE doc_id % 4 < 2)
 SELECT doc_id, {trim_sql(masked_sql("text", masking.PII))} AS text, NULL AS reason, 1 AS files FROM said
 UNION ALL SELECT NULL, NULL, 'Unsupported file type: ' || CASE doc_id % 4 WHEN 2 THEN 'json' ELSE 'csv' END, count(*)
 FROM documents WHERE doc_id % 4 > 1 GROUP BY 3""",
)
def file_router(spark, sf_dir):
    """Every document in a file of its own, a quarter with a malformed byte, half of types that are rejected."""
    path = new_workspace(spark, "routed")
    docs, kind = fx.documents(spark, sf_dir), F.col("doc_id") % 4
    said = F.concat(F.lit("id="), F.col("doc_id").cast("string"), F.lit(";\n"), F.col("text")).cast("binary")
    # a lone byte 0xE9 is no UTF-8
    broken = F.when(kind == 1, F.concat(said, F.lit(bytes([0xE9])), F.lit(" end").cast("binary"))).otherwise(said)
    tables.write_each(docs.where(kind < 2).select(broken.cast("string").alias("value")), f"{path}/text")
    tables.write_each(docs.where(kind == 2).select("doc_id"), f"{path}/json", "json")
    tables.write_each(docs.where(kind == 3).select("doc_id"), f"{path}/csv", "csv")
    texts, rejects = map(in_few_tasks, files.binary_source(spark, path))
    number = F.regexp_extract("text", r"^id=(\d+);", 1).cast("long")
    read = texts.select(number.alias("doc_id"), "text", F.lit(None).cast("string").alias("reason"), F.lit(1).alias("files"))
    counted = rejects.where(~F.col("path").contains("_SUCCESS")).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))
    return read.unionByName(counted.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "reason", "files"))


@query("table_sample", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 1")
def table_sample(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source").orderBy("doc_id").limit(1)


# --- sinks ----------------------------------------------------------------------------------------------------------


@query(
    "write_documents",
    f"{FILES} SELECT {DOC_ID} AS id, {NAMED} AS file_name, namespace, CAST({fx.AS_OF_MS} AS BIGINT) AS created_ms FROM files",
)
def write_documents(spark, sf_dir):
    path = new_workspace(spark, "documents")
    rows = tables.document_rows(fx.files(spark, sf_dir), created(), "doc_id")
    tables.write_table(rows.select("id", "file_name", "namespace", "created_at"), path)
    return spark.read.parquet(path).select(
        "id", "file_name", "namespace", F.unix_millis("created_at").alias("created_ms")
    )


CHUNKED = f"""{FILES}, named AS (SELECT doc_id, {DOC_ID} AS document_id, namespace, {NAMED} AS file_name, text FROM files),
 ent AS (SELECT doc_id, document_id, namespace, file_name, text, {ENTITY_SQL} AS entity FROM named),
 heads AS (SELECT *, {HEADER_SQL} AS header FROM ent),
 pieces AS ({fixed_sql("text", 500, 50, "heads")}),
 chunks AS (SELECT h.document_id, h.namespace, p.chunk_index, h.header || p.chunk_text AS chunk_text
  FROM pieces p JOIN heads h USING (doc_id))"""


def chunk_rows(spark, sf_dir):
    rows = chunk_documents(fx.files(spark, sf_dir), created_at=created(), key=("doc_id",))
    return rows.select("document_id", "namespace", "chunk_index", "chunk_text")


@query("write_chunks", f"{CHUNKED} SELECT document_id, namespace, chunk_index, chunk_text FROM chunks")
def write_chunks(spark, sf_dir):
    path = new_workspace(spark, "chunks")
    tables.write_table(chunk_rows(spark, sf_dir), path, "namespace")
    return spark.read.parquet(path).select("document_id", "namespace", "chunk_index", "chunk_text")


def mock_sql(text: str) -> str:
    numbers = ", ".join(f"(length({text}) % {n}) / {n}.0" for n in (10, 7, 5))
    return f"CAST(CAST([{numbers}] AS FLOAT[]) AS DOUBLE[])"


@query(
    "ingest_then_retrieve",
    f"""{CHUNKED}, {fx.QUERY_TABLE},
 pairs AS (SELECT q.query_id, c.document_id || '#' || CAST(c.chunk_index AS VARCHAR) AS chunk_id,
  round(list_cosine_similarity({mock_sql("q.query")}, {mock_sql("c.chunk_text")}), 9) AS similarity
  FROM query_table q JOIN chunks c ON q.namespace = c.namespace),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) - 1 AS pos FROM pairs
  WHERE NOT isnan(similarity) AND similarity > 0.1)
 SELECT query_id, chunk_id, pos, round(similarity, 6) AS similarity FROM ranked WHERE pos < 5""",
)
def ingest_then_retrieve(spark, sf_dir):
    """The chunk table as written by two runs of the same ingest, searched by its own text keys."""
    documents_path, chunks_path = new_workspace(spark, "documents"), new_workspace(spark, "chunks")
    for _ in range(2):
        ingest(fx.files(spark, sf_dir), documents_path, chunks_path, created_at=created(), key=("doc_id",))
    queries = fx.query_table(spark, sf_dir).withColumn("query_vector", mock_embed(F.col("query")))
    return match_vectors(queries, spark.read.parquet(chunks_path), key="chunk_id", top=5, floor=0.1)


@query(
    "upsert_status",
    """WITH changes AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id END AS id, CASE WHEN doc_id % 5 = 0 THEN ''
   ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 3 END AS width, doc_id FROM documents)
 SELECT doc_id, CASE WHEN id IS NULL THEN 'id required' WHEN text = '' THEN 'text required' WHEN width = 0
  THEN 'vector required' ELSE 'ok' END AS status FROM changes""",
)
def upsert_status(spark, sf_dir):
    docs, number = fx.documents(spark, sf_dir), F.col("doc_id")
    changes = docs.select(
        "doc_id",
        F.when(number % 7 != 0, number).alias("id"),
        F.when(number % 5 == 0, "").otherwise(F.col("text")).alias("text"),
        F.when(number % 3 != 0, mock_embed(F.col("text"))).alias("embedding"),
    )
    return tables.with_status(changes).select("doc_id", "status")


@query(
    "upsert_by_id",
    """WITH old AS (SELECT event_id AS id, value AS score, event_type AS text FROM events),
 latest AS (SELECT user_id AS id, arg_max(value, event_id) AS score, arg_max(event_type, event_id) AS text FROM events
  GROUP BY user_id)
 SELECT id, score, text FROM old WHERE id NOT IN (SELECT id FROM latest) UNION ALL SELECT id, score, text FROM latest""",
)
def upsert_by_id(spark, sf_dir):
    """Events as rows; every user's newest event is a change to the row with the user's number."""
    events = fx.table(spark, sf_dir, "events")
    shape = (F.col("value").alias("score"), F.col("event_type").alias("text"), "event_id")
    old = events.select(F.col("event_id").alias("id"), *shape)
    changes = events.select(F.col("user_id").alias("id"), *shape)
    return tables.upsert_by_id(old, changes, "event_id").drop("event_id")


DOOMED = "SELECT document_id, namespace FROM (SELECT document_id, namespace, chunk_index FROM chunks) WHERE chunk_index = 9"


@query(
    "delete_document",
    f"""{CHUNKED}, doomed AS ({DOOMED})
 SELECT 'document' AS kind, count(*) AS n FROM named WHERE document_id NOT IN (SELECT document_id FROM doomed)
 UNION ALL SELECT 'chunk', count(*) FROM chunks WHERE document_id NOT IN (SELECT document_id FROM doomed)
 UNION ALL SELECT 'deleted', count(*) FROM named WHERE document_id IN (SELECT document_id FROM doomed)""",
)
def delete_document(spark, sf_dir):
    """Delete every document long enough to have a tenth chunk."""
    chunks = chunk_rows(spark, sf_dir)
    docs = tables.document_rows(fx.files(spark, sf_dir), created(), "doc_id")
    doomed = chunks.where(F.col("chunk_index") == 9).select("document_id", "namespace")
    left, pieces, gone = tables.delete_documents(docs, chunks, doomed)

    def counted(df, kind):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")

    return counted(left, "document").unionByName(counted(pieces, "chunk")).unionByName(counted(gone, "deleted"))


@query(
    "append_memory",
    f"""{FILES} SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 ELSE {fx.AS_OF_MS} END AS timestamp,
 file_name, mime FROM files""",
)
def append_memory(spark, sf_dir):
    path = new_workspace(spark, "memory")
    payload = fx.files(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 10).alias("timestamp"),
        "file_name",
        "mime",
    )
    tables.append_memory(payload, path, F.lit(fx.AS_OF_MS))
    stored = spark.read.schema("id long, raw string, timestamp long").json(path)
    return stored.select(
        "id",
        "timestamp",
        F.get_json_object("raw", "$.file_name").alias("file_name"),
        F.get_json_object("raw", "$.mime").alias("mime"),
    )


@query(
    "merge_object",
    "SELECT user_id AS object_id, event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
)
def merge_object(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("object_id"), F.col("event_type").alias("key"), "value", "event_id"
    )
    return tables.merge_object(rows, "event_id")


# --- filters --------------------------------------------------------------------------------------------------------


@query("namespace_filter", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def namespace_filter(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").withColumnRenamed("lang", "namespace")
    return documents.in_namespace(rows, "en").select("doc_id", "source")


def matrix_sql() -> str:
    rows = ", ".join(
        f"('{role}', {list(spaces)}, {list(actions)})" for role, spaces, actions in access.ROLE_MATRIX
    )
    return f"matrix(role, namespaces, actions) AS (VALUES {rows})"


@query(
    "authorize_requests",
    f"""WITH {fx.REQUESTS}, {matrix_sql()},
 j AS (SELECT r.*, coalesce((list_contains(namespaces, '*') OR list_contains(namespaces, own_namespace))
  AND list_contains(actions, action), false) AS permitted FROM requests r LEFT JOIN matrix m ON r.role = m.role),
 k AS (SELECT *, CASE WHEN NOT permitted THEN 'no permission' WHEN namespace <> own_namespace THEN 'namespace mismatch'
  ELSE 'ok' END AS reason FROM j)
 SELECT request_id, reason, CASE WHEN reason = 'ok' THEN 'allow' ELSE 'deny' END AS decision FROM k""",
)
def authorize_requests(spark, sf_dir):
    judged = access.authorize(fx.requests(spark, sf_dir), access.role_matrix(spark))
    return judged.select("request_id", "reason", "decision")


@query(
    "authorize_admin_bypass",
    f"""WITH {fx.REQUESTS} SELECT request_id, role = 'super_admin' OR (namespace <> '' AND namespace = own_namespace) AS allowed
 FROM requests""",
)
def authorize_admin_bypass(spark, sf_dir):
    allowed = access.namespace_gate(F.col("role"), F.col("namespace"), F.col("own_namespace"))
    return fx.requests(spark, sf_dir).select("request_id", allowed.alias("allowed"))


PERMISSION_ROLES = ("super_admin", "admin", "operator", "viewer", "client", "guest")
PERMISSIONS = ("upload_documents", "view_documents", "manage_users", "upload_ephemeral", "delete_documents")


def permission_sql() -> str:
    rows = ", ".join(f"('{role}', {list(names)}::VARCHAR[])" for role, names in access.ROLE_PERMISSIONS)
    return f"held(role, permissions) AS (VALUES {rows})"


@query(
    "authorize_permission",
    f"""WITH {fx.REQUESTS}, {permission_sql()},
 asked AS (SELECT request_id, {fx.pick_sql(PERMISSION_ROLES, "request_id")} AS role, namespace, own_namespace,
  {fx.pick_sql(PERMISSIONS, "request_id // 7")} AS permission FROM requests),
 j AS (SELECT a.*, coalesce(list_contains(permissions, permission), false) AS ok FROM asked a LEFT JOIN held h ON a.role = h.role)
 SELECT request_id, CASE WHEN NOT ok THEN 'insufficient permission'
  WHEN role <> 'super_admin' AND namespace <> '' AND namespace <> own_namespace THEN 'namespace mismatch' ELSE 'ok' END AS reason
 FROM j""",
)
def authorize_permission(spark, sf_dir):
    asked = fx.requests(spark, sf_dir).select(
        "request_id",
        fx.pick(PERMISSION_ROLES, F.col("request_id")).alias("role"),
        "namespace",
        "own_namespace",
        fx.pick(PERMISSIONS, F.floor(F.col("request_id") / 7)).alias("permission"),
    )
    return access.authorize_permission(asked, access.role_permissions(spark)).select("request_id", "reason")


@query(
    "not_null_key",
    "SELECT l.doc_id AS document_id, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
    " WHERE l.doc_id IS NOT NULL",
)
def not_null_key(spark, sf_dir):
    """Documents without a label have no key on the label's side."""
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("document_id"))
    rows = fx.table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("document_id", "source")
    return documents.with_document(rows)


@query(
    "drop_empty_content",
    f"WITH {fx.MESSAGES} SELECT conv_id, turn FROM messages WHERE {trim_sql('message')} <> ''",
)
def drop_empty_content(spark, sf_dir):
    from ..operators.ranking import drop_empty

    return drop_empty(fx.messages(spark, sf_dir), "message").select("conv_id", "turn")


def memory_entries(spark, sf_dir):
    e, d = fx.table(spark, sf_dir, "embeddings"), fx.table(spark, sf_dir, "documents")
    number = F.col("vec_id")
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        F.when(number % 13 != 0, number).alias("id"),
        # plain text, a broken object, an array and a number are no objects
        F.when(number % 7 == 3, "plain").when(number % 7 == 4, "{not json").when(number % 7 == 5, '[{"a": 1}]')
        .when(number % 7 == 6, " 12 ").otherwise(F.to_json(F.struct("source", "lang"))).alias("raw"),
        F.when(number % 11 == 5, F.lit(None)).when(number % 11 == 6, F.array()).otherwise(F.col("embedding")).alias(
            "embedding"
        ),
        "text",
    )


ENTRIES = """entries AS (SELECT CASE WHEN vec_id % 13 <> 0 THEN vec_id END AS id, vec_id % 7 IN (3, 4, 5, 6) AS plain, text,
  CASE WHEN vec_id IS NULL OR vec_id % 11 IN (5, 6) THEN 0 ELSE len(embedding) END AS width
 FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""


@query(
    "clean_memory",
    f"WITH {ENTRIES} SELECT id IS NOT NULL AND NOT coalesce(plain, false) AND width > 0 AS valid, count(*) AS entries"
    " FROM entries GROUP BY 1",
)
def clean_memory(spark, sf_dir):
    return memory.clean_report(memory_entries(spark, sf_dir))


@query(
    "integrity_report",
    f"""WITH {ENTRIES} SELECT count(*) AS entries, count(*) FILTER (id IS NULL) AS without_id,
 count(*) FILTER (text = '') AS without_text, count(*) FILTER (width = 0) AS without_vector,
 count(*) FILTER (width NOT IN (0, 64)) AS other_width, 'error' AS status FROM entries""",
)
def integrity_report(spark, sf_dir):
    return memory.integrity_report(memory_entries(spark, sf_dir), 64)


@query(
    "metadata_filter",
    "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src2'",
)
def metadata_filter(spark, sf_dir):
    metadata = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    wanted = F.create_map(F.lit("source"), F.lit("src2"))
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", metadata.alias("metadata"), wanted.alias("wanted"))
    rows = documents.metadata_filter(rows, {"lang": "en"})
    return rows.where(documents.metadata_contains("metadata", "wanted")).select("doc_id")


# --- projections ----------------------------------------------------------------------------------------------------


def raw_results(spark, sf_dir):
    number = F.col("doc_id")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(number % 10 != 4, F.col("text")).alias("chunk"),
        F.when(number % 10 != 7, number / 1000.0).alias("score"),
    )


RAW = """raw AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 4 THEN text END AS chunk,
 CASE WHEN doc_id % 10 <> 7 THEN CAST(doc_id AS DOUBLE) / 1000.0 END AS score FROM documents)"""
SHAPED = "coalesce(substr(chunk, 1, 300), '') AS snippet, round(coalesce(score, 0.0), 6) AS relevance FROM raw"


@query("normalize_results", f"WITH {RAW} SELECT {SHAPED}")
def normalize_results(spark, sf_dir):
    return documents.normalize_results(raw_results(spark, sf_dir))


@query("normalize_results_doc", f"WITH {RAW} SELECT doc_id, {SHAPED}")
def normalize_results_doc(spark, sf_dir):
    return documents.normalize_results(raw_results(spark, sf_dir), "doc_id")


@query(
    "default_row_shape",
    f"WITH {RAW} SELECT doc_id, coalesce(chunk, '') AS chunk, round(coalesce(score, 0.0), 6) AS score FROM raw",
)
def default_row_shape(spark, sf_dir):
    return documents.default_row_shape(raw_results(spark, sf_dir), "doc_id")


@query(
    "preview",
    f"WITH {RAW} SELECT doc_id, coalesce(substr(chunk, 1, 300), '') AS text, round(score, 6) AS score FROM raw",
)
def preview(spark, sf_dir):
    return documents.previews(raw_results(spark, sf_dir).withColumnRenamed("chunk", "text"), "doc_id")


# --- joins and counts -----------------------------------------------------------------------------------------------


@query(
    "documents_with_counts",
    f"""{CHUNKED}, counts AS (SELECT document_id, count(*) AS n FROM chunks WHERE document_id IS NOT NULL GROUP BY 1),
 docs AS (SELECT document_id, file_name, namespace FROM named UNION ALL SELECT 'empty' || CAST(page_id AS VARCHAR), url, 'en'
  FROM pages)
 SELECT d.document_id, d.file_name, d.namespace, coalesce(c.n, 0) AS chunk_count
 FROM docs d LEFT JOIN counts c ON d.document_id = c.document_id""",
)
def documents_with_counts(spark, sf_dir):
    """All documents with their chunks, and the pages as documents without chunks."""
    docs = tables.document_rows(fx.files(spark, sf_dir), created(), "doc_id").select("id", "file_name", "namespace")
    pages = fx.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("empty"), F.col("page_id").cast("string")).alias("id"),
        F.col("url").alias("file_name"),
        F.lit("en").alias("namespace"),
    )
    return documents.documents_with_counts(docs.unionByName(pages), chunk_rows(spark, sf_dir))


@query(
    "chunk_count",
    f"{CHUNKED} SELECT namespace, document_id, count(*) AS chunk_count FROM chunks GROUP BY namespace, document_id",
)
def chunk_count(spark, sf_dir):
    return documents.chunk_count(chunk_rows(spark, sf_dir))
