"""Files as DataFrames."""

from __future__ import annotations

import itertools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions import rx, tasks
from ..functions.masking import mask_pii

# fixed values: extensions and MIME types by what is done with them
TEXT_EXTENSIONS = ("txt", "md")
EXTRACTED_EXTENSIONS = ("pdf", "docx")
TEXT_MIME = ("text/plain", "text/markdown", "text/x-markdown")
EXTRACTED_MIME = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")

DOCUMENT_MEMORY = T.StructType(
    [
        T.StructField("docId", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


def text_source(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    """One row per file: path and whole text as UTF-8."""
    return (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        # given here: the argument's default would undo an option of the same name
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def text_stream(spark: SparkSession, path: str, glob: str = "*.{txt,md}", files_per_trigger: int = 1000) -> DataFrame:
    """Whole text files as a stream of (path, text, modified): files that arrive while it runs or between two runs."""
    stream = spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("wholetext", True)
    return stream.option("maxFilesPerTrigger", files_per_trigger).format("text").load(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\.", -1), -1))


def route_by_extension(name: Column) -> Column:
    """text, extract or reject; names that are not known are rejected."""
    ext = extension(name)
    return F.when(ext.isin(*TEXT_EXTENSIONS), "text").when(ext.isin(*EXTRACTED_EXTENSIONS), "extract").otherwise("reject")


def route_by_mime(mime: Column) -> Column:
    """text or extract; types that are not known are read as text."""
    return F.when(mime.isin(*EXTRACTED_MIME), "extract").otherwise("text")


def reject_reason(name: Column) -> Column:
    return F.concat(F.lit("Unsupported file type: "), extension(name))


def utf8(content: Column) -> Column:
    """Bytes as text; malformed sequences become U+FFFD, so no file fails the job."""
    return F.make_valid_utf8(content.cast("string"))


def parsed_text(content: Column) -> Column:
    """Text of a file after masking, trimmed."""
    return rx.trim(mask_pii(F.coalesce(content, F.lit(""))))


# most folders whose names the driver holds at once
FOLDERS = 50_000


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder a path names if it is one of a `file:` path without wildcards."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    folder = place.getPath()
    return folder if place.getScheme() == "file" and not set(folder) & set("{}[]*?\\") and os.path.isdir(folder) else None


def folders_below(top: str, enough: int, most: int = FOLDERS) -> list[tuple[str, bool]]:
    """(folder, deep), which together hold every file below top once; deep folders are `enough` if there are as many.

    Levels of more than `most` folders are left to the tasks that walk the level above.
    """
    apart, level = [], [top]
    while level and len(level) < enough:
        below = list(itertools.islice((path for folder in level for path, _ in tasks.found(folder, files=False)), most + 1))
        if len(below) > most:
            break
        apart += [(folder, False) for folder in level]
        level = below
    return apart + [(folder, True) for folder in level]


def local_paths(spark: SparkSession, folder: str, enough: int) -> DataFrame:
    """(path) of all files below a folder all executors can reach, in tasks; the driver holds names of folders only."""
    folders = folders_below(folder, enough)
    return spark.createDataFrame(folders, "folder string, deep boolean").mapInArrow(tasks.list_files, "path string")


def binary_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects) of all files below path; files that need an extractor are rejects with a reason.

    Spark's reader holds every file's status and its place in a task on the driver; below a `file:` path the tasks list the
    files, anew for every job, and read them themselves.
    """
    route, folder = route_by_extension(F.col("path")), local_folder(spark, path)
    if folder is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("route", route)
        found = files.where(F.col("route") == "text")
    else:
        parts = 16 * spark.sparkContext.defaultParallelism
        files = local_paths(spark, folder, parts).withColumn("route", route)
        # a folder may hold most of the files: their paths are dealt to tasks that read
        dealt = files.where(F.col("route") == "text").select("path").repartition(parts, "path")
        found = dealt.mapInArrow(tasks.read_files, "path string, content binary")
    texts = found.select("path", parsed_text(utf8(F.col("content"))).alias("text"))
    rejects = files.where(F.col("route") != "text").select(
        "path",
        F.when(F.col("route") == "extract", F.lit("needs an extractor"))
        .otherwise(reject_reason(F.col("path")))
        .alias("reason"),
    )
    return texts, rejects


def json_memory_source(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_MEMORY) -> DataFrame:
    """Entries of JSON array files; a missing path or a file that is no JSON gives no entries."""
    tagged = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    reader = (
        spark.read.schema(tagged)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
    )
    try:
        # a broken file gives a row of NULLs; Spark wants a data column read along with the corrupt-record column
        readable = F.col("_corrupt").isNull() | F.col(schema.fieldNames()[0]).isNotNull()
        return reader.json(path).where(readable).drop("_corrupt")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def json_dir_source(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_MEMORY) -> DataFrame:
    """One document per ``*.json`` file of a directory."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
