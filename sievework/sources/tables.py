"""Documents, chunks, vectors and memories as Parquet tables.

Plain Parquet has no MERGE or DELETE: changes are expressed as the table's next state, written to a new folder that the
caller publishes by name. A failed job leaves the old state untouched.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import masking, objects, tasks
from ..functions.hashing import document_id

DEFAULT_NAME = "Uploaded Document"


def document_rows(df: DataFrame, created_at: Column, *key: str) -> DataFrame:
    """id, file_name, namespace, created_at from (file_name, namespace, text); key columns keep equal documents apart."""
    name = F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.lit(DEFAULT_NAME))
    return (
        df.withColumn("file_name", name)
        .withColumn("id", document_id(F.col("namespace"), F.col("file_name"), F.col("text"), *[F.col(k) for k in key]))
        .withColumn("created_at", created_at)
    )


def write_table(df: DataFrame, path: str, *partition: str, mode: str = "append", **counts: Column) -> dict[str, int]:
    """Write partitioned; rebalancing lets AQE cut a large namespace into several files of even size.

    Returns `rows`, the number of rows written, and further named aggregates of them, observed by the job that writes.
    """
    dealt = df.hint("rebalance", *[F.col(p) for p in partition]) if partition else df
    seen = Observation()
    # above the shuffle: tasks of the writing stage count, and a task that is run again counts once
    dealt = dealt.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])
    writer = dealt.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return seen.get


def append_new(df: DataFrame, path: str, key: tuple[str, ...], *partition: str) -> int:
    """Append the rows whose key the table doesn't hold yet, once each; returns their number.

    A second run of the same input adds nothing.
    """
    spark, fresh = df.sparkSession, df.dropDuplicates(list(key))
    if exists(spark, path):
        held = spark.read.parquet(path)
        fresh = fresh.join(held.select(*key), list(key), "left_anti").select(*df.columns)
    return write_table(fresh, path, *partition).get("rows", 0)


def write_masked(df: DataFrame, column: str, path: str, rules: tuple[masking.Rule, ...], *partition: str) -> dict[str, int]:
    """Write the rows with the column masked; one job writes and counts the rows and the hits of each rule."""
    counted = masking.count_hits(df, column, rules)
    hits = [f"hits_{rule.name}" for rule in rules]
    seen = Observation()
    sums = [F.coalesce(F.sum(h), F.lit(0)).alias(rule.name) for h, rule in zip(hits, rules)]
    observed = counted.observe(seen, F.count(F.lit(1)).alias("rows"), *sums).drop(*hits)
    writer = observed.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return seen.get


# fixed values: extensions that Spark gives the files of a format
EXTENSIONS = {"text": "txt", "json": "json", "csv": "csv"}


def write_each(df: DataFrame, path: str, kind: str = "text") -> None:
    """Write each row as a file of its own, text, json or csv, into folders below path.

    Hadoop's local file system starts a process for the rights of every file it makes, and Spark's committer renames every
    file on the driver; below a `file:` path the tasks write the files themselves.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    if place.getScheme() != "file":
        df.write.option("maxRecordsPerFile", 1).format(kind).save(path)
        return
    # there even without rows
    os.makedirs(os.path.join(place.getPath(), tasks.FIRST_FOLDER), exist_ok=True)
    if kind == "text":
        line = F.col(*df.columns)
    else:
        line = (F.to_json if kind == "json" else F.to_csv)(F.struct(*df.columns))
    content = F.concat(F.coalesce(line.cast("binary"), F.lit(b"")), F.lit(b"\n"))
    df.select(content).foreachPartition(tasks.write_each(place.getPath(), EXTENSIONS[kind]))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def with_status(changes: DataFrame, vector: str = "embedding", text: str = "text") -> DataFrame:
    """Add status to rows of an upsert: ok, or what is missing; rows that aren't ok must not be written."""
    return changes.withColumn(
        "status",
        F.when(F.col("id").isNull(), "id required")
        .when(F.coalesce(F.col(text), F.lit("")) == "", "text required")
        .when(F.coalesce(F.size(vector), F.lit(0)) <= 0, "vector required")
        .otherwise("ok"),
    )


def latest_by_id(df: DataFrame, sequence: str, key: str = "id") -> DataFrame:
    """The row with the highest sequence per id, reduced inside the tasks before the shuffle."""
    others = [c for c in df.columns if c != key]
    # of equal sequence values the row with the greater hash, so reruns agree
    newest = F.max_by(F.struct(*others), F.struct(F.col(sequence), F.xxhash64(*others)))
    return df.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def upsert_by_id(existing: DataFrame, changes: DataFrame, sequence: str, key: str = "id") -> DataFrame:
    """Next state: changed ids get their latest row, others stay."""
    latest = latest_by_id(changes, sequence, key)
    return existing.join(latest.select(key), key, "left_anti").unionByName(latest)


def delete_documents(
    documents: DataFrame, chunks: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next documents, next chunks, deleted documents. doomed: document_id, namespace; naming a row twice is no error."""
    same_document = (F.col("d.id") == F.col("x.document_id")) & (F.col("d.namespace") == F.col("x.namespace"))
    left = documents.alias("d")
    right = doomed.alias("x")
    return (
        left.join(right, same_document, "left_anti"),
        chunks.join(doomed, ["document_id", "namespace"], "left_anti"),
        left.join(right, same_document, "left_semi"),
    )


def delete_answers(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per delete request (request_id, role, document_id, namespace): status and the document that goes.

    Only the super administrator deletes; a document that isn't there is no error, its answer has no row.
    """
    status = F.when(F.coalesce(F.col("role"), F.lit("")) != "super_admin", 403).when(
        F.coalesce(F.col("document_id"), F.lit("")) == "", 400
    ).otherwise(200)
    asked = requests.withColumn("status", status)
    held = documents.select(F.col("id").alias("document_id"), "namespace", F.struct(*documents.columns).alias("deleted_document"))
    answered = asked.join(held, ["document_id", "namespace"], "left")
    return answered.select(
        "request_id", "status", F.when(F.col("status") == 200, F.col("deleted_document")).alias("deleted_document")
    )


def memory_entries(df: DataFrame, written_ms: Column) -> DataFrame:
    """id, raw JSON, time and metadata of payload rows; a payload's own id or timestamp wins over the given ones.

    The raw JSON is also the text to embed.
    """
    own = {name: F.col(name) if name in df.columns else F.lit(None) for name in ("id", "timestamp")}
    payload = F.to_json(F.struct(*df.columns))
    metadata = F.to_json("metadata") if "metadata" in df.columns else F.lit(None).cast("string")
    return df.select(
        F.coalesce(own["id"].cast("long"), written_ms).alias("id"),
        payload.alias("raw"),
        F.coalesce(own["timestamp"].cast("long"), written_ms).alias("timestamp"),
        F.coalesce(metadata, F.lit("{}")).alias("metadata"),
    )


def payload_entries(df: DataFrame, payload: Column, written_ms: Column) -> DataFrame:
    """id, raw, timestamp and metadata of rows whose payload is the text of a JSON object; all others are left out.

    A payload's own id or timestamp wins over the given ones, as in `memory_entries`.
    """
    rows = df.withColumn("_raw", payload).where(objects.is_object(F.col("_raw")))
    metadata = F.try_variant_get(objects.parsed(F.col("_raw")), "$.metadata", "variant")
    return rows.select(
        F.coalesce(objects.field(F.col("_raw"), "id", "long"), written_ms).alias("id"),
        F.col("_raw").alias("raw"),
        F.coalesce(objects.field(F.col("_raw"), "timestamp", "long"), written_ms).alias("timestamp"),
        F.coalesce(F.to_json(metadata), F.lit("{}")).alias("metadata"),
    )


def append_memory(df: DataFrame, path: str, written_ms: Column) -> None:
    memory_entries(df, written_ms).write.mode("append").json(path)


def merge_object(df: DataFrame, sequence: str, object_key: str = "object_id") -> DataFrame:
    """Rows (object, key, value): the last written value per key, reduced before the shuffle."""
    return df.groupBy(object_key, "key").agg(F.max_by("value", F.struct(F.col(sequence), F.col("value"))).alias("value"))


def merge_json(df: DataFrame, payload: str, sequence: str, object_key: str = "object_id") -> DataFrame:
    """Rows (object, key, value) of objects that were written as JSON texts one over the other: the last value per key, as
    JSON text. Texts that are no object change nothing."""
    fields = df.select(object_key, sequence, F.explode(objects.entries(F.col(payload))).alias("_entry"))
    return merge_object(fields.select(object_key, sequence, "_entry.key", "_entry.value"), sequence, object_key)
