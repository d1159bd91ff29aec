"""Tables in many files, and what large tables must not make slow or wide."""

import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from sievework.catalog import load
from sievework.functions import chunking, masking, rx, tasks, text
from sievework.plans.chat import finish
from sievework.sources import files, tables

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def in_folders(spark, tmp_path_factory):
    """A table directory whose tables are folders of several files."""
    top = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, f"Jane Smith wrote line {i}.\n" * (i % 40 + 1), "en" if i % 2 else "de", f"src{i % 3}", 1) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    return top


def test_stream_ingest_reads_tables_in_folders(spark, in_folders):
    got = QUERIES["stream_ingest"](spark, in_folders)
    chunks = [-(-len((f"Jane Smith wrote line {i}.\n" * (i % 40 + 1)).strip()) // 450) for i in range(120)]
    assert got.count() == sum(chunks)
    assert got.where("chunk_index = 0").count() == 120


def test_stream_ingest_requests_reads_tables_in_folders(spark, in_folders):
    streamed, once = (QUERIES[name](spark, in_folders) for name in ("stream_ingest_requests", "ingest_requests"))
    assert streamed.count() == once.count() == 120
    assert streamed.exceptAll(once).count() == 0


def files_below(top):
    return sorted(os.path.join(place, name) for place, _, names in os.walk(top) for name in names)


def test_rows_become_files_written_by_tasks(spark, tmp_path):
    rows = spark.range(2500).selectExpr("id", "concat('row ', id) AS value").repartition(2)
    for kind, ending in (("text", ".txt"), ("json", ".json"), ("csv", ".csv")):
        tables.write_each(rows.select("value") if kind == "text" else rows.select("id"), str(tmp_path / kind), kind)
        found = files_below(tmp_path / kind)
        # neither checksums nor marks of a committer, and no folder that one task must list whole
        assert len(found) == 2500 and all(f.endswith(ending) for f in found)
        assert max(len(names) for _, _, names in os.walk(tmp_path / kind)) <= 1000
    assert sorted(r.text for r in files.text_source(spark, str(tmp_path / "text")).collect()) == sorted(f"row {i}\n" for i in range(2500))
    assert spark.read.json(str(tmp_path / "json" / "*")).distinct().count() == 2500
    texts, rejects = files.binary_source(spark, str(tmp_path))
    assert (texts.count(), rejects.count()) == (2500, 5000)


def test_no_rows_become_no_files(spark, tmp_path):
    tables.write_each(spark.range(0).selectExpr("string(id) AS value"), str(tmp_path / "none"))
    assert files.text_source(spark, str(tmp_path / "none")).count() == 0


ODD_FILES = (
    "a.md", "sub/b.TXT", "sub/deep/er/c.txt", "sub/c.png", "no_ending", "sp ace é%20/q #?.txt", "new\nline.txt", "x=1/_y=2/d.txt", "_e=1.txt",
    "_metadata_folder/f.txt", "_hidden/g.txt", "_hidden.txt", ".hidden/h.txt", ".hidden.txt", "_metadata.txt", "i.txt._COPYING_", "j.pdf",
)


@pytest.fixture
def odd_tree(tmp_path):
    top = tmp_path / "_top"
    for n, name in enumerate(ODD_FILES):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"text %d \xe9" % n)
    (top / "empty.txt").touch()
    (top / "link.txt").symlink_to(top / "a.md")
    (top / "linked").symlink_to(top / "sub")
    (top / "broken.txt").symlink_to(top / "nothing")
    with open(os.fsencode(top) + b"/no\xe9.txt", "w") as file:
        file.write("no UTF-8 name")
    return str(top)


def test_binary_source_leaves_the_files_to_tasks(spark, odd_tree):
    texts, rejects = files.binary_source(spark, odd_tree)
    # the driver knows of no file
    assert list(texts.inputFiles()) == list(rejects.inputFiles()) == []
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(odd_tree)
    want = plain.select("path", files.route_by_extension(F.col("path")).alias("route"), files.parsed_text(files.utf8(F.col("content"))).alias("text"))
    assert want.count() == 15
    assert sorted(texts.collect()) == sorted(want.where("route = 'text'").select("path", "text").collect())
    assert sorted(r.path for r in rejects.collect()) == sorted(r.path for r in want.where("route <> 'text'").collect())


def test_binary_source_reads_other_paths_as_spark_does(spark, odd_tree):
    # one file, wildcards, no file at all
    assert files.binary_source(spark, f"{odd_tree}/a.md")[0].count() == 1
    assert files.binary_source(spark, f"{odd_tree}/su*")[0].count() == 2
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.binary_source(spark, f"{odd_tree}/nothing")


def walked(folder):
    for path, deeper in tasks.found(folder):
        yield path, deeper
        if deeper:
            yield from walked(path)


def test_folders_hold_every_file_once(odd_tree):
    whole = [path for path, deeper in walked(odd_tree) if not deeper]
    assert len(whole) == 15
    for enough, most in ((1, 100), (2, 100), (5, 100), (1000, 100), (1000, 3), (1000, 0)):
        folders = files.folders_below(odd_tree, enough, most)
        batch = pa.RecordBatch.from_pylist([{"folder": folder, "deep": deep} for folder, deep in folders])
        paths = [path.removeprefix("file:") for got in tasks.list_files([batch]) for path in got.column(0).to_pylist()]
        assert sorted(paths) == sorted(whole)
        # a level of too many folders is not held
        assert len(folders) == 1 or most > 3


def test_files_are_read_some_at_a_time(tmp_path):
    sizes = [5 << 20, 3 << 20, 2 << 20, 1, 0, 1 << 20]
    for n, size in enumerate(sizes):
        (tmp_path / str(n)).write_bytes(b"x" * size)
    paths = [f"file:{tmp_path}/{n}" for n in range(len(sizes))]
    got = list(tasks.read_files([pa.RecordBatch.from_pydict({"path": part}) for part in (paths[:2], paths[2:])]))
    assert [len(row["content"]) for batch in got for row in batch.to_pylist()] == sizes
    assert [batch.num_rows for batch in got] == [1, 1, 4]
    many = list(tasks.read_files([pa.RecordBatch.from_pydict({"path": paths[3:4] * 2001})]))
    assert [batch.num_rows for batch in many] == [1000, 1000, 1]


def test_file_router_keeps_no_file_on_the_driver(spark, tmp_path):
    rows = [(i, "" if i == 4 else f"Line {i},\n\u00e9 a@b.co ", "en", "src", 1) for i in range(203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["file_router"](spark, str(tmp_path))
    assert list(got.inputFiles()) == []
    text = lambda i: f"id={i};\n" + ("" if i == 4 else f"Line {i},\n\u00e9 [REDACTED_EMAIL] ") + "\ufffd end" * (i % 4)
    want = [(i, text(i).strip(), None, 1) for i in range(203) if i % 4 < 2]
    assert sorted(got.where("reason IS NULL").collect()) == want
    assert sorted(got.where("doc_id IS NULL").select("reason", "files").collect()) == [("Unsupported file type: csv", 50), ("Unsupported file type: json", 51)]


LONG = "12 elm " * 30_000 + ". 5 Elm Street"


@pytest.fixture(scope="module")
def long_text(spark):
    """A long run of numbers and words without a street word, in a text that has one after it."""
    df = spark.createDataFrame([("a", LONG)], "g string, t string").cache()
    df.count()
    return df


def timed(run):
    start = time.perf_counter()
    run()
    # searching the run again from every character takes minutes
    assert time.perf_counter() - start < 30


def test_leak_report_walks_a_run_once(long_text):
    timed(lambda: masking.masking_report(long_text, "t", "g", masking.LEAK_FIRST_PASS).collect())


def test_clinical_report_walks_a_run_once(long_text):
    timed(lambda: masking.masking_report(long_text, "t", "g", masking.CLINICAL).collect())


def pack_words(words, limit):
    pieces, held, length = [], [], 0
    for word in words:
        if length + len(word) > limit:
            pieces.append(" ".join(held))
            held, length = [], 0
        length += len(word) + (1 if held else 0)
        held.append(word)
    return pieces + [" ".join(held)]


def pack_lines(lines, limit):
    pieces, held, length = [], [], 0
    for line in lines:
        if length + len(line) > limit and (piece := "".join(held).strip(rx.WHITE_CHARACTERS)):
            pieces.append(piece)
            held, length = [], 0
        held.append(line + "\n")
        length += len(line) + 1
    piece = "".join(held).strip(rx.WHITE_CHARACTERS)
    return pieces + ([piece] if piece else [])


PARTS = ["a", "bb", "ccc", "x" * 9, "x" * 10, "x" * 11, "x" * 23, "\U0001f600", "é", " ", " ", "  ", "\u00a0", "\u3000", "\n", "\n", "\n\n", "\n \n", "\t", "\r"]


@pytest.fixture(scope="module")
def odd_texts(spark):
    pick = random.Random(3)
    rows = ["".join(pick.choice(PARTS) for _ in range(pick.randrange(40))) for _ in range(3000)] + ["", " ", "\n", "x" * 11 + " "]
    return spark.createDataFrame([(t,) for t in rows], "t string").repartition(8).cache()


def in_python(df):
    return "Python" in df._jdf.queryExecution().executedPlan().toString() or "ArrowEval" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [0, 1, 5, 10, 11, 20])
def test_words_are_packed_without_python(odd_texts, limit):
    got = odd_texts.select("t", chunking.word_pack(F.col("t"), limit).alias("p"))
    assert not in_python(got)
    assert [(r.t, r.p) for r in got.collect() if r.p != pack_words(r.t.split(" "), limit)] == []


@pytest.mark.parametrize("limit", [1, 5, 10, 11, 20])
def test_lines_are_packed_without_python(odd_texts, limit):
    got = odd_texts.select(text.clean_light(F.col("t")).alias("t"), chunking.line_pack(F.col("t"), limit).alias("p"))
    assert not in_python(got)
    assert [(r.t, r.p) for r in got.collect() if r.p != pack_lines(r.t.split("\n"), limit)] == []


def test_full_cleaning_walks_a_run_once(long_text):
    timed(lambda: long_text.select(F.length(text.clean_full(F.col("t")))).collect())


def test_collapse_equals_the_plain_pattern(odd_texts):
    plain = F.trim(rx.sub(F.col("t"), r"\s+", " "))
    assert odd_texts.where(rx.collapse(F.col("t")) != plain).count() == 0
    # a guard by literals changes no result
    marks = odd_texts.select(F.translate("t", "ab", "“•").alias("t"))
    rules = (("[“”]", '"'), ("•", "- "))
    assert marks.where(rx.chain_where(F.col("t"), ("“", "”", "•"), *rules) != rx.chain(F.col("t"), *rules)).count() == 0


def test_finish_walks_a_run_once(long_text):
    answers = long_text.select(F.col("t").alias("answer"), F.lit("m").alias("message"), F.lit("").alias("context"))
    timed(lambda: finish(answers).select(F.length("answer")).collect())


def test_strip_walks_a_run_once(long_text):
    timed(lambda: long_text.select(F.length(masking.strip_sensitive(F.col("t")))).collect())


PLAIN_TYPOGRAPHY = (
    ("[•*–]", "-"), (r"-\s{0,}", "- "), (r"- -\s+", "- "), (r"([a-zA-Z])\n([a-zA-Z])", "$1 $2"), (r"([.?!])([A-Z])", "$1 $2"),
    (r"```\s*$", "```"), (r"\*\*\s+(.*?)\s+\*\*", "**$1**"), (r"`{3,}", "```"), (r"[\x00-\x1F\x7F]", ""), ("[“”]", '"'), ("[‘’]", "'"),
    (r"\bI(?:'m| am) sorry\b.*?(?=\.)", "", "i"), (r"\bAs an AI\b.*?(?=\.)", "", "i"), (r"\bmaybe\b", "possibly", "i"),
    (r"\bI think\b", "It appears", "i"), (r"\bI guess\b", "It suggests", "i"),
)
SIGNS = PARTS + [
    "•", "*", "–", "-", "- -", ".", "?", "A", "b", "```", "`", "**", "\r\n", "“", "’", "\x7f", "I'm sorry", "i AM SORRY", "as an ai",
    "Maybe", "I think", "i guess", ".", " ",
]


def test_typography_equals_the_plain_chain(spark):
    pick = random.Random(4)
    rows = [("".join(pick.choice(SIGNS) for _ in range(pick.randrange(40))),) for _ in range(6000)]
    df, c = spark.createDataFrame(rows, "t string").repartition(8), F.col("t")
    start = rx.trim(rx.chain(c, (r"\r\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]+", " ")))
    bad = df.select("t", text.normalize_typography(c).alias("a"), rx.trim(rx.chain(start, *PLAIN_TYPOGRAPHY)).alias("b")).where("a <> b")
    assert bad.limit(3).collect() == []
    # most patterns run only where a literal of theirs was found
    assert "contains" in df.select(text.normalize_typography(c))._jdf.queryExecution().analyzed().toString().lower()


def test_noise_and_sentences_equal_the_plain_chains(spark):
    pick = random.Random(6)
    signs = SIGNS + [":.", "/", "-", "---", "1.", "\n1.\n", "!", "? ", ". "]
    df = spark.createDataFrame([("".join(pick.choice(signs) for _ in range(pick.randrange(40))),) for _ in range(6000)], "t string").repartition(8)
    answer = rx.trim(rx.chain(F.col("t"), (r"\r\n", "\n"), (r"\n{3,}", "\n\n")))
    noise = ((r":\.", ":"), (r"-\s*/\s*", "- "), (r"\n\d+\.\s*\n", "\n"), (r"^-+\s*$", "", "m"), (r"\n{3,}", "\n\n"))
    assert df.where(text.clean_structural_noise(F.col("t")) != rx.trim(rx.chain(answer, *noise))).count() == 0
    parts = F.filter(F.split("t", rx.ecma(r"(?<=[.!?])\s+"), -1), lambda s: s != "")
    plain = F.when(F.size(parts) <= 2, F.col("t")).otherwise(rx.trim(F.array_join(F.slice(parts, 1, 2), " ")))
    assert df.where(text.cap_sentences(F.col("t"), 2) != plain).count() == 0


def test_text_source_reads_pages_written_by_tasks(spark, tmp_path):
    pages = [(i, f"u{i}", f"<p>\n{i}</p>" if i % 5 else "") for i in range(300)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["text_source"](spark, str(tmp_path))
    assert sorted(got.collect()) == [(i, html + "\n") for i, _, html in pages]
    assert got.rdd.getNumPartitions() <= 16 * spark.sparkContext.defaultParallelism


def test_clinical_masking_walks_a_run_once(long_text):
    timed(lambda: long_text.select(F.length(masking.mask_clinical(F.col("t")))).collect())


def test_write_masked_walks_a_run_once(long_text, tmp_path):
    timed(lambda: tables.write_masked(long_text, "t", str(tmp_path / "masked"), masking.CLINICAL))
