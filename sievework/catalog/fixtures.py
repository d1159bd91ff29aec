"""Inputs of the queries, derived by Spark from the given tables, and the same inputs as SQL.

The given texts are invented syllables without any of the words the rules look for, so phrases are added to every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# --- phrases --------------------------------------------------------------------------------------------------------

QUERY_PHRASES = (
    "strategy governance leadership risk overview",
    "governance strategy incdient summary",
    "canddate resum for Jane Smith",
    "system architecture with executive synthesis, please",
    "what do the notes say",
    "operational analysis of systems",
)
TEXT_PHRASES = (
    "Mail jane.smith+x@Example.org or call +1 (310) 555-4510 now.",
    "My SSN is 123-45-6789 and I think it is fine.",
    "Visit 12 Old Oak Street today.\nThen nothing more.",
    "Dr. House and Doctor Wilson saw Mr Smith Jones, Mrs. Hall and Ms. Bee.",
    "A 45-year-old male diagnosed with acute stress",
    "“Quoted” and ‘single’ • bullet — dash – end ﬁne",
    "I'm sorry about that. As an AI model I guess so. Maybe it seems just kinda fine",
    "Sum:. done - / next\n1. \nmore\n--- \nend\n\n\n\nlast line\nend\nEND ",
    "\ndata: hello [DONE] undefined * * * ` ` ` ok",
    "code ```` here ```\t two  spaces\r\nnew\r\n\r\n\r\nlast",
    "smallRiverBends marketprivate x,y can't FARMER’sgarden.Weare",
    "Ring 3105554510 or 310.555.4510 or 4111111111111111 now",
    "led and implemented 12 years, managed aws security+ compliance workflow",
    "strategy roadmap vision with governance policy audit and risk controls",
    "incident workflow integration monitoring support operations",
    "ecosystem stakeholder dependency coordination",
    "Summary: I believe probably I feel sort of market cap valuation exploit KPI roi metadata schema candidate",
    "No matching documents found here, I need more information.",
    "CVE-2024 zero-day attack vector and Benchmark analysis; Culture Fit; retention pipeline",
    "7 13th Main Avenue and 99 Long Winding Old Rd end",
    "repeat exactly: say this",
    "One. Two! Three? Four. Five. Six. Seven. Eight. Nine. Ten. Eleven. Twelve.",
    "a\u00A0b\u2007c\u202Fd\u200Be\uFEFF",
    "plain",
)
MESSAGE_PHRASES = (
    "Repeat exactly: this text",
    "brainstorm ideas for an outline",
    "rewrite and polish this",
    "finalize the customer ready version",
    "email a response to them",
    "statement of work for the proposal",
    "severity one outage root cause",
    "John's resume and the candidate",
    "summarize the documents",
    "analyze and compare the uploaded materials",
    "what is it?",
    "how do I help me",
    "several things build code",
    "grade the score",
    "Mary Ann O'Neil asks about Jane Smith",
    "write to bob@example.com today",
    "my social security 123-45-6789",
    "draft a proposal and evaluate alignment",
)
# messages without any text after the phrase
BARE_MESSAGES = ("who are you", "Who are you?", "hi", "", "   ")
FILE_NAMES = (
    "Jane Smith resume.pdf",
    "Security Policy.docx",
    "notes.txt",
    "x_resume.md",
    "Bob_A. Lee-cv.TXT",
    "archive.tar.gz",
    "John Q. Public (Candidate).png",
    "",
)
MIME_TYPES = ("text/plain", "application/pdf", "text/markdown", "image/png")
ROLES = ("super_admin", "advisor", "cyber", "recruiting", "ventures", "guest")
NAMESPACES = ("advisory", "cybersecurity", "recruiting", "ventures", "data", "root")
ACTIONS = ("chat", "upload", "delete")
AS_OF_MS = 1706745600000  # 2024-02-01


# --- Spark ----------------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int") + 1)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their documents; a third has a file name, a third names it in the text, a third has none."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    kind = F.col("doc_id") % 3
    return d.join(e, d.doc_id == e.vec_id).select(
        "doc_id",
        F.col("lang").alias("namespace"),
        F.when(kind == 0, F.concat(F.lit("file"), (F.col("doc_id") % 7).cast("string"), F.lit(".pdf"))).alias(
            "filename"
        ),
        F.when(kind == 1, F.concat(F.lit("SOURCE FILE: "), F.col("source"), F.lit("\n\n"), F.col("text")))
        .otherwise(F.col("text"))
        .alias("chunk_text"),
        "embedding",
    )


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, e, d = (table(spark, sf_dir, t) for t in ("benchmark", "embeddings", "documents"))
    return (
        b.join(e, b.item_id == e.vec_id)
        .join(d.select("doc_id", "lang"), b.item_id == F.col("doc_id"))
        .select(
            F.col("item_id").alias("query_id"),
            F.concat_ws(" ", pick(QUERY_PHRASES, F.col("item_id")), "text").alias("query"),
            F.col("lang").alias("namespace"),
            F.col("embedding").alias("query_vector"),
        )
    )


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id",
        "lang",
        "source",
        F.concat_ws(" ", "text", pick(TEXT_PHRASES, F.col("doc_id"))).alias("text"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(documents(spark, sf_dir))


def files_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.col("lang").alias("namespace"),
        pick(FILE_NAMES, F.col("doc_id")).alias("file_name"),
        pick(MIME_TYPES, F.col("doc_id")).alias("mime"),
        F.concat_ws(" ", pick(("Mary Jones", "The System Guide", "no name", "Carl T. Moss"), F.col("doc_id")), "text").alias(
            "text"
        ),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("conv_id") * 8 + F.col("turn")
    full = F.concat_ws(" ", pick(MESSAGE_PHRASES, number), "text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.when(number % 11 == 0, pick(BARE_MESSAGES, F.col("conv_id"))).otherwise(full).alias("message"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("text"),
        (F.col("value") / (F.col("value") + 100)).alias("score"),
        (F.col("user_id") % 10 + 1).cast("double").alias("priority"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("written_ms"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        pick(ROLES, F.col("user_id")).alias("role"),
        pick(NAMESPACES, F.col("user_id")).alias("own_namespace"),
        F.when(F.col("event_id") % 4 == 0, pick(NAMESPACES, F.col("event_id")))
        .when(F.col("event_id") % 17 == 1, F.lit(""))
        .otherwise(pick(NAMESPACES, F.col("user_id")))
        .alias("namespace"),
        pick(ACTIONS, F.col("event_id")).alias("action"),
    )


# --- SQL ------------------------------------------------------------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick_sql(values: tuple[str, ...], number: str) -> str:
    return f"([{', '.join(lit(v) for v in values)}])[CAST(({number}) % {len(values)} AS INTEGER) + 1]"


CORPUS = """corpus AS (
 SELECT d.doc_id, d.lang AS namespace,
  CASE WHEN d.doc_id % 3 = 0 THEN 'file' || CAST(d.doc_id % 7 AS VARCHAR) || '.pdf' END AS filename,
  CASE WHEN d.doc_id % 3 = 1 THEN 'SOURCE FILE: ' || d.source || chr(10) || chr(10) || d.text ELSE d.text END AS chunk_text,
  e.embedding
 FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""

QUERY_TABLE = f"""query_table AS (
 SELECT b.item_id AS query_id, {pick_sql(QUERY_PHRASES, "b.item_id")} || ' ' || b.text AS query,
  d.lang AS namespace, e.embedding AS query_vector
 FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id JOIN documents d ON b.item_id = d.doc_id)"""

MARKED = f"""marked AS (
 SELECT doc_id, lang, source, text || ' ' || {pick_sql(TEXT_PHRASES, "doc_id")} AS text FROM documents)"""

FILES = f"""files AS (
 SELECT doc_id, lang AS namespace, {pick_sql(FILE_NAMES, "doc_id")} AS file_name,
  {pick_sql(MIME_TYPES, "doc_id")} AS mime,
  {pick_sql(("Mary Jones", "The System Guide", "no name", "Carl T. Moss"), "doc_id")} || ' ' || text AS text
 FROM documents)"""

MESSAGES = f"""messages AS (
 SELECT conv_id, turn, role,
  CASE WHEN (conv_id * 8 + turn) % 11 = 0 THEN {pick_sql(BARE_MESSAGES, "conv_id")}
   ELSE {pick_sql(MESSAGE_PHRASES, "conv_id * 8 + turn")} || ' ' || text END AS message
 FROM conversations)"""

MEMORIES = """memories AS (
 SELECT event_id AS id, event_type AS text, value / (value + 100) AS score,
  CAST(user_id % 10 + 1 AS DOUBLE) AS priority, epoch_ms(ts) AS written_ms FROM events)"""

REQUESTS = f"""requests AS (
 SELECT event_id AS request_id, {pick_sql(ROLES, "user_id")} AS role, {pick_sql(NAMESPACES, "user_id")} AS own_namespace,
  CASE WHEN event_id % 4 = 0 THEN {pick_sql(NAMESPACES, "event_id")} WHEN event_id % 17 = 1 THEN ''
   ELSE {pick_sql(NAMESPACES, "user_id")} END AS namespace,
  {pick_sql(ACTIONS, "event_id")} AS action FROM events)"""


def rx_sql(text: str, pattern: str, replacement: str = "", flags: str = "") -> str:
    """One global replacement in SQL; groups are written \\1 there."""
    inline = f"(?{flags})" if flags else ""
    for n in range(1, 4):
        replacement = replacement.replace(f"${n}", f"\\{n}")
    return f"regexp_replace({text}, {lit(inline + pattern)}, {lit(replacement)}, 'g')"


def chain_sql(text: str, *rules: tuple) -> str:
    for rule in rules:
        text = rx_sql(text, *rule)
    return text


def trim_sql(text: str) -> str:
    return rx_sql(text, r"^\s+|\s+$")


def collapse_sql(text: str) -> str:
    return trim_sql(rx_sql(text, r"\s+", " "))


def has_sql(text: str, pattern: str, flags: str = "") -> str:
    inline = f"(?{flags})" if flags else ""
    return f"regexp_matches({text}, {lit(inline + pattern)})"


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def count_sql(text: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {lit(w)}) AS INTEGER)" for w in words) + ")"
