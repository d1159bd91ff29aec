"""Python run inside Spark tasks, mostly on Arrow batches.

Only what Spark SQL has no linear-time expression for: Unicode NFKC, order-keeping line de-duplication; and many small files,
written, listed and read.
The module is shipped by value, so executors need no copy of the package.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _nfkc(text):
    import unicodedata

    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFKC", text)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(_nfkc)


# fixed values: the members of the ECMAScript white-space class
_WHITE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def _dedupe_lines(text):
    if text is None or "\n" not in text:
        return text
    seen, kept = set(), []
    for line in text.split("\n"):
        key = line.strip(_WHITE).lower()
        if key:
            if key in seen:
                continue
            seen.add(key)
        kept.append(line)
    return "\n".join(kept)


@F.pandas_udf(T.StringType())
def dedupe_lines(texts: pd.Series) -> pd.Series:
    return texts.map(_dedupe_lines)


FIRST_FOLDER = "00000-000000"


def write_each(folder: str, extension: str):
    """What `foreachPartition` calls on rows of one binary column: every row becomes a file of a folder shared by all
    executors. Names depend on the task's place alone, so a task that is run again writes the same files anew."""

    def run(rows):
        import os

        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for n, (content,) in enumerate(rows):
            if n % 1000 == 0:
                # folders of bounded size, which many tasks can list at once
                place = os.path.join(folder, f"{task:05d}-{n // 1000:06d}")
                os.makedirs(place, exist_ok=True)
            with open(os.path.join(place, f"{n % 1000:03d}.{extension}"), "wb") as file:
                file.write(content or b"")

    return run


def found(folder: str, files: bool = True):
    """(path, whether it is a folder) of the folders and, if asked for, files that Spark's file readers find right in a folder:
    no hidden names, no empty files. Links are followed, broken ones are left out, and so are names that are no UTF-8."""
    import os

    with os.scandir(folder) as entries:
        for entry in entries:
            name, deeper = entry.name, entry.is_dir()
            hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
            if hidden and not (deeper and name.startswith(("_metadata", "_common_metadata"))):
                continue
            try:
                name.encode()
                if deeper or files and entry.stat().st_size > 0:
                    yield entry.path, deeper
            except (UnicodeEncodeError, FileNotFoundError):
                continue


def list_files(batches):
    """What `mapInArrow` calls on rows (folder, deep): the path of every file of the folder, if deep of all files below it."""
    import pyarrow as pa

    def batch(paths):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    paths = []
    for rows in batches:
        for row in rows.to_pylist():
            left = [row["folder"]]
            while left:
                for path, deeper in found(left.pop()):
                    if not deeper:
                        paths.append(f"file:{path}")
                    elif row["deep"]:
                        left.append(path)
                    if len(paths) == 10_000:
                        yield batch(paths)
                        paths = []
    if paths:
        yield batch(paths)


def read_files(batches):
    """What `mapInArrow` calls on rows (path): path and content, some MB at a time."""
    import pyarrow as pa

    def batch(paths, contents):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    paths, contents, size = [], [], 0
    for rows in batches:
        for path in rows.column(0).to_pylist():
            with open(path.removeprefix("file:"), "rb") as file:
                content = file.read()
            if paths and (size + len(content) > 1 << 22 or len(paths) == 1000):
                yield batch(paths, contents)
                paths, contents, size = [], [], 0
            paths.append(path)
            contents.append(content)
            size += len(content)
    if paths:
        yield batch(paths, contents)
