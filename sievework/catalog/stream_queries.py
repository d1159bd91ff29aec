"""Streams over the given tables, run until all input is read, and their batch counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import new_workspace
from ..streaming import ingest, rate_limit, stateful
from . import fixtures as fx
from .fixtures import chain_sql, trim_sql
from .registry import query
from .store_queries import created
from .text_queries import ENTITY_SQL, HEADER_SQL, LIGHT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIMIT, WINDOW = 3, 86400


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, one Parquet file or a folder of them, as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a pattern that only the table's own path meets: for a plain path a stream wants a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.[p]arquet")


def run_to_end(df: DataFrame, label: str) -> DataFrame:
    """Write the stream as Parquet until its input is read, and read it back."""
    spark = df.sparkSession
    path = new_workspace(spark, label)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def limit_sql(limit: int, window: int) -> str:
    return f"""WITH RECURSIVE numbered AS (SELECT user_id, event_id, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 walk AS (SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS held, NULL::BIGINT AS event_id, NULL::BIGINT AS t,
   false AS allowed FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n, CASE WHEN len(recent) < {limit} THEN list_append(recent, t) ELSE recent END, event_id, t,
   len(recent) < {limit}
  FROM (SELECT w.user_id, e.n, e.event_id, e.t, list_filter(w.held, lambda x: e.t - x < {window}000000) AS recent
   FROM walk w JOIN numbered e ON e.user_id = w.user_id AND e.n = w.n + 1))
 SELECT user_id, event_id, t AS ts_us, allowed, greatest(0, {limit} - len(held)) AS remaining,
  CAST(ceil(({window}000000 - (t - held[1])) / 1000000.0) AS BIGINT) AS retry_after FROM walk WHERE n > 0"""


LIMIT_SQL = limit_sql(LIMIT, WINDOW)


@query("rate_limit_per_minute", limit_sql(20, 60))
def limit_per_minute(spark, sf_dir):
    """The usual twenty requests a minute."""
    return rate_limit.rate_limit(fx.table(spark, sf_dir, "events"))


@query("rate_limit", LIMIT_SQL)
def limit_table(spark, sf_dir):
    return rate_limit.rate_limit(fx.table(spark, sf_dir, "events"), LIMIT, WINDOW, slice_windows=4)


@query("rate_limit_stream", LIMIT_SQL)
def limit_stream(spark, sf_dir):
    return run_to_end(stateful.stream_rate_limit(stream_table(spark, sf_dir, "events"), LIMIT, WINDOW), "limits")


@query(
    "session_state_stream",
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_count,
 max(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS last_turn FROM conversations""",
)
def session_stream(spark, sf_dir):
    messages = stream_table(spark, sf_dir, "conversations")
    return run_to_end(stateful.stream_session_state(messages), "sessions")


ARTIFACT_TEXT = chain_sql("text", (r"(^|\n)\s*data:\s*", "", "i"), (r"\[DONE\]", "", "i"))


@query("stream_artifacts", f"WITH {fx.MARKED} SELECT doc_id, {ARTIFACT_TEXT} AS text FROM marked")
def stream_artifacts(spark, sf_dir):
    marked = stream_table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws(" ", "text", fx.pick(fx.TEXT_PHRASES, F.col("doc_id"))).alias("text")
    )
    return run_to_end(ingest.strip_transport(marked), "fragments")


CLEANED = trim_sql(chain_sql("text", *LIGHT))


@query(
    "stream_ingest",
    f"""WITH t AS (SELECT doc_id, lang, source AS file_name, {CLEANED} AS text FROM documents),
 e AS (SELECT *, {ENTITY_SQL} AS entity FROM t),
 h AS (SELECT *, {HEADER_SQL} AS header FROM e),
 p AS (SELECT *, unnest(range(0, CAST(ceil(length(text) / 450.0) AS BIGINT))) AS chunk_index FROM h)
 SELECT lang AS namespace, file_name, chunk_index, header || substr(text, chunk_index * 450 + 1, 500) AS chunk_text FROM p""",
)
def stream_ingest(spark, sf_dir):
    path = new_workspace(spark, "ingested")
    documents = stream_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("namespace"), F.col("source").alias("file_name"), "text"
    )
    ingest.stream_ingest(
        documents, path, path + "-state", created_at=created(), clean=text.clean_light, key=("doc_id",)
    ).awaitTermination()
    rows = spark.read.parquet(path)
    return rows.select("namespace", "file_name", "chunk_index", "chunk_text")
