"""Documents to chunks: clean, cut, label, embed, write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunking, entities, objects, rx
from ..functions.vectors import mock_embed
from ..operators import access
from ..sources import tables


def chunk_documents(
    df: DataFrame,
    *,
    clean: Callable[[Column], Column] | None = None,
    cut: Callable[[Column], Column] = chunking.fixed,
    created_at: Column,
    key: tuple[str, ...] = (),
) -> DataFrame:
    """Chunk rows with header from (file_name, namespace, text). Narrow: no shuffle, whole texts stay in their task."""
    rows = tables.document_rows(df.where(rx.text_or_empty("text") != ""), created_at, *key)
    if clean is not None:
        rows = rows.withColumn("text", clean(F.col("text")))
    rows = rows.withColumn("primary_entity", entities.primary_entity(F.col("file_name"), F.col("text")))
    pieces = chunking.explode_chunks(rows, cut(F.col("text")))
    return pieces.select(
        F.concat_ws("#", "id", F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("id").alias("document_id"),
        "namespace",
        "file_name",
        "primary_entity",
        "created_at",
        "chunk_index",
        F.concat(chunking.header(F.col("primary_entity"), F.col("file_name")), F.col("chunk_text")).alias("chunk_text"),
    )


def ingest(
    df: DataFrame,
    documents_path: str,
    chunks_path: str,
    *,
    embed: Callable[[Column], Column] = mock_embed,
    created_at: Column,
    key: tuple[str, ...] = (),
    **options,
) -> dict[str, int]:
    """Append documents and embedded chunks that are not there yet; returns how many of each were added.

    Ids depend on the content (and key), so a rerun into the same folders adds nothing. Equal documents without a key
    are one document. The chunk table can be searched as it is: chunk_id, namespace, filename, chunk_text, embedding.
    """
    documents = tables.document_rows(df.where(rx.text_or_empty("text") != ""), created_at, *key)
    documents = documents.select("id", "file_name", "namespace", "created_at")
    added = {"documents": tables.append_new(documents, documents_path, ("id",))}
    chunks = chunk_documents(df, created_at=created_at, key=key, **options)
    rows = chunks.withColumn("embedding", embed(F.col("chunk_text"))).select(
        "chunk_id", "document_id", "chunk_index", F.col("file_name").alias("filename"), "chunk_text", "embedding", "namespace"
    )
    added["chunks"] = tables.append_new(rows, chunks_path, ("namespace", "chunk_id"), "namespace")
    return added


FORBIDDEN, MISSING, CREATED = 403, 400, 200
STEP = 450


def ingest_requests(
    requests: DataFrame,
    *,
    created_at: Column,
    embed: Callable[[Column], Column] = mock_embed,
    key: tuple[str, ...] = ("request_id",),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(responses, documents, chunks) of upload requests.

    requests: request_id, role, own_namespace (the caller's), text, file_name, filename. A caller who may not upload gets
    403, a request without text 400; all others become a document of the caller's namespace, named by the first name given.
    A response has status, error, document_id, file_name, primary_entity, namespace, chunks_stored and chunk_ids. Its ids are
    worked out from the request alone, so responses need no look at the tables.
    """
    judged = access.with_permission(requests, access.role_matrix(requests.sparkSession), "upload")
    status = (
        F.when(~F.col("permitted"), FORBIDDEN).when(rx.text_or_empty("text") == "", MISSING).otherwise(CREATED)
    )
    named = judged.withColumn("status", status).withColumn("namespace", F.col("own_namespace"))
    named = named.withColumn("file_name", entities.first_filled(F.col("file_name"), F.col("filename")))
    accepted = named.where(F.col("status") == CREATED)
    rows = tables.document_rows(accepted, created_at, *key)
    entity = entities.primary_entity(F.col("file_name"), F.col("text"))
    documents = rows.select("id", "file_name", "namespace", "created_at")
    chunks = chunk_documents(accepted, created_at=created_at, key=key).withColumn("embedding", embed(F.col("chunk_text")))
    pieces = F.ceil(F.length("text") / STEP).cast("int")
    ids = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.concat_ws("#", "id", i.cast("string")))
    good = rows.select(
        "request_id", "status", F.lit(None).cast("string").alias("error"), F.col("id").alias("document_id"), "file_name",
        entity.alias("primary_entity"), "namespace", pieces.alias("chunks_stored"), ids.alias("chunk_ids"),
    )
    error = F.when(F.col("status") == FORBIDDEN, "Forbidden: No permission to upload").otherwise("Missing required field: text.")
    refused = named.where(F.col("status") != CREATED).select("request_id", "status", error.alias("error"))
    return good.unionByName(refused, allowMissingColumns=True), documents, chunks


def ingest_files(
    files: DataFrame, stored: DataFrame, *, embed: Callable[[Column], Column] = mock_embed, source: str = "local_file"
) -> DataFrame:
    """Next state of a vector table (id, values, text, metadata) after whole files (path, text) were cut into windows of
    words and put into it. The id depends on path and window, so the same file changes nothing."""
    pieces = chunking.explode_chunks(files.select("path", "text"), chunking.word_window(F.col("text")), "chunk").select(
        F.sha2(F.concat_ws("\u241f", "path", F.col("chunk_index").cast("string"), "chunk"), 256).alias("id"),
        embed(F.col("chunk")).alias("values"),
        F.col("chunk").alias("text"),
        F.to_json(F.struct(F.lit(source).alias("source"), F.length("chunk").alias("length"))).alias("metadata"),
        F.lit(0).alias("_at"),
    )
    return tables.upsert_by_id(stored.withColumn("_at", F.lit(0)), pieces, "_at").drop("_at")


def update_memory(
    requests: DataFrame, stored: DataFrame, written_ms: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(responses, entries to append, next state of the vector table) for memory updates.

    requests: request_id, role, own_namespace, body (JSON text), embedding. A body that is no object gets 400; one of another
    namespace than the caller's 403, unless the caller is the super administrator. The rest is stored; with an embedding it
    also becomes (id, values, text, metadata) in the vector table, the latest request of an id winning.
    """
    space = objects.field(F.col("body"), "namespace", "string")
    judged = requests.withColumn("namespace", space).withColumn(
        "status",
        F.when(~objects.is_object(F.col("body")), MISSING)
        .when(~access.namespace_gate(F.col("role"), F.col("namespace"), F.col("own_namespace")), FORBIDDEN)
        .otherwise(CREATED),
    )
    own = objects.field(F.col("body"), "id", "long")
    width = F.coalesce(F.size("embedding"), F.lit(0))
    judged = judged.withColumn("id", F.when(F.col("status") == CREATED, F.coalesce(own, written_ms)))
    good = judged.where(F.col("status") == CREATED)
    entries = tables.payload_entries(good, F.col("body"), written_ms)
    vectors = good.where(width > 0).select(
        F.col("id").cast("string").alias("id"),
        F.col("embedding").alias("values"),
        F.col("body").alias("text"),
        F.to_json(F.struct(F.coalesce("namespace", "own_namespace").alias("namespace"))).alias("metadata"),
        F.col("request_id").alias("_at"),
    )
    after = tables.upsert_by_id(stored.withColumn("_at", F.lit(-1).cast(requests.schema["request_id"].dataType)), vectors, "_at")
    responses = judged.select(
        "request_id", "status", "id", F.when(F.col("status") == CREATED, width).alias("embedding_length"),
        F.when(F.col("status") == CREATED, F.col("embedding").isNotNull()).alias("vectorized"),
    )
    return responses, entries, after.drop("_at")
