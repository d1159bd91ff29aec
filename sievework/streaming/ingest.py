"""Streams of files and of transport fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import rx, text
from ..functions.vectors import mock_embed
from ..plans.ingest import chunk_documents, ingest_requests


def strip_transport(df: DataFrame, column: str = "text") -> DataFrame:
    """Remove transport prefixes and end marks; stateless, for batch and stream alike."""
    cleaned = rx.sub(text.strip_data_prefix(rx.text_or_empty(column)), r"\[DONE\]", "", "i")
    return df.withColumn(column, cleaned)


def stream_ingest(
    documents: DataFrame,
    chunks_path: str,
    checkpoint: str,
    *,
    created_at: Column,
    clean: Callable[[Column], Column] = text.clean_light,
    embed: Callable[[Column], Column] = mock_embed,
    key: tuple[str, ...] = (),
) -> StreamingQuery:
    """Clean, cut, embed and append every document of a stream of (file_name, namespace, text) exactly once."""
    chunks = chunk_documents(documents, clean=clean, created_at=created_at, key=key)
    rows = chunks.withColumn("embedding", embed(F.col("chunk_text")))
    return (
        rows.writeStream.format("parquet")
        .option("path", chunks_path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("namespace")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


TABLES = ("chunks", "documents", "responses")


def store_batch(path: str, created_at: Column, embed: Callable[[Column], Column], key: tuple[str, ...]):
    """What `foreachBatch` calls. Each batch has a folder of its own in every table, written anew when the batch is
    replayed, so a replay adds nothing and a batch that failed half way leaves nothing behind. Chunks come first: a document
    that is listed has all of them."""

    def store(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            responses, documents, chunks = ingest_requests(held, created_at=created_at, embed=embed, key=key)
            for name, rows in zip(TABLES, (chunks, documents, responses)):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            held.unpersist()

    return store


def stream_requests(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    *,
    created_at: Column,
    embed: Callable[[Column], Column] = mock_embed,
    key: tuple[str, ...] = ("request_id",),
) -> StreamingQuery:
    """Answer and store a stream of upload requests (see `ingest_requests`): the tables chunks, documents and responses."""
    writer = requests.writeStream.foreachBatch(store_batch(path, created_at, embed, key))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that `stream_requests` writes, with the batch of each row."""
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
