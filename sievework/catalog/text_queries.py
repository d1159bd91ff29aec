"""Text cleaning, masking, chunking, entities, classes, signals and hashes over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking, classify, entities, hashing, masking, rx, signals, text
from ..functions.vectors import mock_embed
from ..plans.chat import finish, triage
from . import fixtures as fx
from .fixtures import any_sql, chain_sql, collapse_sql, count_sql, has_sql, lit, rx_sql, trim_sql
from .registry import query

MARKED = f"WITH {fx.MARKED} "
MESSAGES = f"WITH {fx.MESSAGES} "


def over_documents(name: str, expression, sql_expression: str | None):
    """A text function over every marked document."""
    sql = None if sql_expression is None else f"{MARKED} SELECT doc_id, {sql_expression} AS text FROM marked"

    @query(name, sql)
    def run(spark, sf_dir):
        return fx.marked(spark, sf_dir).select("doc_id", expression(F.col("text")).alias("text"))


# --- cleaning -------------------------------------------------------------------------------------------------------


def masked_sql(text_sql: str, rules) -> str:
    for rule in rules:
        text_sql = rx_sql(text_sql, rule.pattern, rule.replacement, rule.flags)
    return text_sql


NFKC_OF_DATA = (("\u00A0", " "), ("\u2007", " "), ("\u202F", " "), ("ﬁ", "fi"))


def full_sql(t: str) -> str:
    # the only characters of the data that NFKC changes are these four
    plain = rx_sql(t, r"[\x00-\x09\x0B\x0C\x0E-\x1F]", " ")
    for old, new in NFKC_OF_DATA:
        plain = f"replace({plain}, {lit(old)}, {lit(new)})"
    plain = chain_sql(plain, ("[“”]", '"'), ("[‘’]", "'"), ("•", "- "), ("[—–]", "-"), ("\uFEFF", " "))
    return collapse_sql(masked_sql(plain, masking.CLINICAL))


over_documents("clean_text_full", text.clean_full, full_sql("text"))
LIGHT = ((r"\r", ""), (r"\t", " "), (" +", " "), (r"\n{3,}", "\n\n"))
over_documents("clean_text_light", text.clean_light, trim_sql(rx_sql(chain_sql("text", *LIGHT), "\uFEFF$", "")))
over_documents(
    "sanitize_text",
    text.sanitize,
    collapse_sql(rx_sql(masked_sql("text", masking.PII), r"[^\x00-\x7F]+", " ")),
)
CONTENT = ((r"\r", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))


def content_sql(t: str) -> str:
    return trim_sql(rx_sql(chain_sql(t, *CONTENT), "\uFEFF$", ""))


over_documents("normalize_content", text.normalize_content, content_sql("text"))
WIDE_SPACE = "[\u00A0\u2007\u202F\uFEFF]"
over_documents("collapse_ws", text.collapse_space, collapse_sql(rx_sql("text", WIDE_SPACE, " ")))


def terms_sql(t: str) -> str:
    # RE2's word class is ASCII like the one meant here; wide spaces stay until they are collapsed
    kept = rx_sql(f"lower({t})", r"[^\w\s\x{a0}\x{2007}\x{202f}\x{feff}]", "")
    return collapse_sql(rx_sql(kept, WIDE_SPACE, " "))


over_documents("normalize_terms", text.normalize_terms, terms_sql("text"))
ARTIFACTS = (
    (r"[\x{a0}\x{2007}\x{202f}]", " "),
    (r"[\x{200b}-\x{200d}\x{feff}]", ""),
    (r"(^|\n)\s*data:\s*", "", "i"),
    (r"\[DONE\]", "", "i"),
    (r"\n{3,}", "\n\n"),
    (r"\* \* \*", "***"),
    ("` ` `", "```"),
    ("undefined", ""),
)
over_documents("strip_artifacts", text.strip_artifacts, rx_sql(chain_sql("text", *ARTIFACTS), r"^\s+"))
TYPOGRAPHY = (
    ("[•*–]", "-"),
    (r"-\s*", "- "),
    (r"- -\s+", "- "),
    (r"([a-zA-Z])\n([a-zA-Z])", "$1 $2"),
    (r"([.?!])([A-Z])", "$1 $2"),
    (r"```\s*$", "```"),
    (r"`{3,}", "```"),
    (r"[\x00-\x1F\x7F]", ""),
    ("[“”]", '"'),
    ("[‘’]", "'"),
    # no look-ahead in RE2: the full stop is matched and put back
    (r"\bI(?:'m| am) sorry\b[^.]*(\.)", "$1", "i"),
    (r"\bAs an AI\b[^.]*(\.)", "$1", "i"),
    (r"\bmaybe\b", "possibly", "i"),
    (r"\bI think\b", "It appears", "i"),
    (r"\bI guess\b", "It suggests", "i"),
)
over_documents(
    "normalize_typography",
    text.normalize_typography,
    trim_sql(
        rx_sql(
            chain_sql(
                trim_sql(
                    rx_sql(chain_sql("text", (r"\r\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]+", " ")), "\uFEFF$", "")
                ),
                *TYPOGRAPHY,
            ),
            "\uFEFF$",
            "",
        )
    ),
)
REPAIR = (
    (r"\x{a0}", " "),
    (r"[\x{2000}-\x{200f}]", ""),
    (r"([.!?,;:\-’'])([A-Za-z])", "$1 $2"),
    (r"([A-Za-z])([.!?,;:\-’'])", "$1$2 "),
    (r"([a-z]{5,})([A-Z][a-z]+)", "$1 $2"),
    (r"([a-z]{6,})([a-z]{4,})", "$1 $2"),
    (r"([A-Z][a-z]{3,})([A-Z][a-z]+)", "$1 $2"),
    (r"’s([A-Za-z])", "’s $1"),
    (r"[\s\x{202f}\x{feff}]{2,}", " "),
)
over_documents("repair_tokens", text.repair_tokens, trim_sql(rx_sql(chain_sql("text", *REPAIR), "\uFEFF$", "")))

# --- formatting -----------------------------------------------------------------------------------------------------


def answer_sql(t: str) -> str:
    return trim_sql(rx_sql(chain_sql(t, (r"\r\n", "\n"), (r"\n{3,}", "\n\n")), "\uFEFF$", ""))


def noise_sql(t: str) -> str:
    return trim_sql(
        chain_sql(
            answer_sql(t),
            (r":\.", ":"),
            (r"-\s*/\s*", "- "),
            (r"\n\d+\.\s*\n", "\n"),
            (r"^-+\s*$", "", "m"),
            (r"\n{3,}", "\n\n"),
        )
    )


over_documents("clean_structural_noise", text.clean_structural_noise, noise_sql("text"))


def unique_lines_ctes(source: str, t: str) -> str:
    """CTEs from (doc_id, <t>) of source to unique_lines(doc_id, text)."""
    return f"""lines AS (
  SELECT doc_id, generate_subscripts(string_split({t}, chr(10)), 1) AS n, unnest(string_split({t}, chr(10))) AS line
  FROM {source}),
 keyed AS (SELECT *, lower({trim_sql(rx_sql("line", WIDE_SPACE + "+$"))}) AS key FROM lines),
 first_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY n) AS copy FROM keyed),
 unique_lines AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM first_lines WHERE key = '' OR copy = 1 GROUP BY doc_id)"""


@query("dedupe_lines", f"{MARKED}, {unique_lines_ctes('marked', 'text')} SELECT doc_id, text FROM unique_lines")
def dedupe_lines(spark, sf_dir):
    return fx.marked(spark, sf_dir).select("doc_id", text.unique_lines(F.col("text")).alias("text"))


def sentences_sql(t: str) -> str:
    parts = f"list_filter(string_split({rx_sql(t, r'([.!?])\s+', chr(92) + '1' + chr(1))}, chr(1)), lambda s: s <> '')"
    joined = f"{trim_sql(f'array_to_string(({parts})[1:10], {lit(" ")})')}"
    return f"CASE WHEN len({parts}) <= 10 THEN {t} ELSE {joined} END"


over_documents("cap_sentences", text.cap_sentences, sentences_sql("text"))

FORMAT_SQL = f"""{MARKED},
 asked AS (SELECT doc_id, text AS answer, {fx.pick_sql(fx.MESSAGE_PHRASES, "doc_id")} AS request FROM marked),
 normed AS (SELECT doc_id, request, {answer_sql("answer")} AS norm, {noise_sql("answer")} AS noise FROM asked),
 {unique_lines_ctes("normed", "noise")},
 staged AS (SELECT n.doc_id, n.request, n.norm, u.text AS lines FROM normed n JOIN unique_lines u USING (doc_id))
 SELECT doc_id, CASE WHEN norm = '' THEN {lit(text.EMPTY_ANSWER)}
  WHEN {any_sql("lower(norm)", text.MISSING_ANSWER)} OR {any_sql("lower(request)", text.REWRITE_REQUEST)} THEN norm
  WHEN {any_sql("lower(lines)", [h.lower() for h in text.SECTION_HEADERS])} THEN lines
  ELSE {sentences_sql("lines")} END AS text FROM staged"""


@query("format_output", FORMAT_SQL)
def format_output(spark, sf_dir):
    asked = fx.marked(spark, sf_dir).withColumn("request", fx.pick(fx.MESSAGE_PHRASES, F.col("doc_id")))
    return text.format_output(asked, "text", "request").select("doc_id", F.col("formatted").alias("text"))


def rewrite_sql(t: str) -> str:
    return trim_sql(rx_sql(chain_sql(t, *text.REWRITES), "\uFEFF$", ""))


over_documents("rewrite_rules", text.rewrite, rewrite_sql("text"))
FIXTURE_TONES = ("king", "ceo", "advisory", "cybersecurity", "recruiting", "dataManagement", "ventures", "neutral", "x")


def restore_sql(t: str, words) -> str:
    for word in words:
        found = f"regexp_extract(original, {lit('(?i)' + word)}, 0)"
        t = (
            f"CASE WHEN {found} = '' THEN {t} ELSE regexp_replace({t}, {lit('(?i)' + word)}, {found}, 'g') END"
        )
    return t


def tone_sql() -> str:
    # two rewrites with the tone between, then the protected words of each tone in turn
    toned = "CASE tone WHEN 'king' THEN strict WHEN 'ceo' THEN strict "
    toned += "".join(f"WHEN '{tone}' THEN {lit(prefix)} || base " for tone, prefix in text.TONE_PREFIX.items())
    toned += "ELSE CASE WHEN tone = 'neutral' THEN base ELSE strict END END"
    steps = [
        f"{MARKED}, t0 AS (SELECT doc_id, text AS original, {fx.pick_sql(FIXTURE_TONES, 'doc_id')} AS tone FROM marked)",
        f"t1 AS (SELECT *, {rewrite_sql('original')} AS base FROM t0)",
        f"t2 AS (SELECT *, {trim_sql(chain_sql('base', *text.REWRITES[:3]))} AS strict FROM t1)",
        f"t3 AS (SELECT doc_id, original, tone, {toned} AS toned FROM t2)",
        f"s0 AS (SELECT doc_id, original, tone, {rewrite_sql('toned')} AS txt FROM t3)",
    ]
    n = 0
    for tone, words in text.TONE_PROTECTS.items():
        for word in words:
            steps.append(
                f"s{n + 1} AS (SELECT doc_id, original, tone, CASE WHEN tone = '{tone}' THEN {restore_sql('txt', [word])}"
                f" ELSE txt END AS txt FROM s{n})"
            )
            n += 1
    return ", ".join(steps) + f" SELECT doc_id, txt AS text FROM s{n}"


@query("tone_rewrite", tone_sql())
def tone_rewrite(spark, sf_dir):
    tone = fx.pick(FIXTURE_TONES, F.col("doc_id"))
    return fx.marked(spark, sf_dir).select("doc_id", text.tone_rewrite(F.col("text"), tone).alias("text"))


@query(
    "rewrite_report",
    "WITH RECURSIVE "
    + fx.MARKED
    + ", "
    + "r0 AS (SELECT source, text FROM marked), "
    + ", ".join(
        f"r{n} AS (SELECT source, {', '.join([f'h{m}' for m in range(1, n)] + [''])} "
        f"len(regexp_extract_all(text, {lit(('(?i)' if len(rule) > 2 else '') + rule[0])})) AS h{n}, "
        f"{rx_sql('text', *rule)} AS text FROM r{n - 1})"
        for n, rule in enumerate(text.REWRITES, 1)
    )
    + " SELECT source, "
    + ", ".join(f"CAST(sum(h{n}) AS BIGINT) AS rewrites_{n}" for n in range(1, len(text.REWRITES) + 1))
    + f" FROM r{len(text.REWRITES)} GROUP BY source",
)
def rewrite_report(spark, sf_dir):
    counted = text.count_rewrites(fx.marked(spark, sf_dir).select("source", "text"), "text")
    names = [f"rewrites_{n}" for n in range(1, len(text.REWRITES) + 1)]
    return counted.groupBy("source").agg(*[F.sum(n).alias(n) for n in names])


over_documents(
    "truncate",
    lambda c: text.truncate(c, 5000, "\n...[trimmed]"),
    f"CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || {lit(chr(10) + '...[trimmed]')} ELSE text END",
)


@query(
    "literal_strip",
    f"{MESSAGES} SELECT conv_id, turn, "
    + trim_sql(chain_sql("message", *[("^" + p, "", "i") for p in text.LITERAL_PHRASES]))
    + " AS text FROM messages",
)
def literal_strip(spark, sf_dir):
    return fx.messages(spark, sf_dir).select("conv_id", "turn", text.literal_strip(F.col("message")).alias("text"))


# --- queries --------------------------------------------------------------------------------------------------------


def typo_sql(word: str) -> str:
    return f"CASE {word} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.TYPOS.items()) + f" ELSE {word} END"


def normal_query_sql(t: str) -> str:
    plain = chain_sql(trim_sql(f"lower({t})"), (r"[^\w\s]", " "), (r"\s+", " "))
    return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: {typo_sql('w')}), ' ')"


def query_terms_sql(normalized: str) -> str:
    stops = ", ".join(lit(w) for w in text.STOP_WORDS)
    return f"list_filter(string_split({normalized}, ' '), lambda w: length(w) > 3 AND w NOT IN ({stops}))"


@query(
    "normalize_query",
    f"WITH {fx.QUERY_TABLE} SELECT query_id, {normal_query_sql('query')} AS normalized FROM query_table",
)
def normalize_query(spark, sf_dir):
    return fx.query_table(spark, sf_dir).select("query_id", text.normalize_query(F.col("query")).alias("normalized"))


@query(
    "query_terms",
    f"WITH {fx.QUERY_TABLE} SELECT query_id, array_to_string({query_terms_sql(normal_query_sql('query'))}, ' ') AS terms,"
    f" CAST(len({query_terms_sql(normal_query_sql('query'))}) AS BIGINT) AS n FROM query_table",
)
def query_terms(spark, sf_dir):
    terms = text.query_terms(text.normalize_query(F.col("query")))
    return fx.query_table(spark, sf_dir).select(
        "query_id", F.array_join(terms, " ").alias("terms"), F.size(terms).alias("n")
    )


@query(
    "lookup_typo",
    f"{MESSAGES}, words AS (SELECT unnest(string_split(lower(message || ' resum sumarize'), ' ')) AS word FROM messages)"
    f" SELECT word, {typo_sql('word')} AS corrected, count(*) AS n FROM words GROUP BY word",
)
def lookup_typo(spark, sf_dir):
    words = fx.messages(spark, sf_dir).select(
        F.explode(F.split(F.lower(F.concat("message", F.lit(" resum sumarize"))), " ", -1)).alias("word")
    )
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("word", text.correct_word(F.col("word")).alias("corrected"), "n")


@query(
    "tone_lookup",
    f"WITH {fx.REQUESTS} SELECT request_id, CASE namespace "
    + " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in text.NAMESPACE_TONES.items())
    + " ELSE 'king' END AS tone FROM requests",
)
def tone_lookup(spark, sf_dir):
    return fx.requests(spark, sf_dir).select("request_id", text.tone_for_namespace(F.col("namespace")).alias("tone"))


# --- masking --------------------------------------------------------------------------------------------------------

over_documents("mask_clinical", masking.mask_clinical, masked_sql("text", masking.CLINICAL))
over_documents("mask_pii", masking.mask_pii, masked_sql("text", masking.PII))

SCAN_BLOCK = f"({has_sql('text', masking.SSN)} AND {has_sql('text', masking.SSN_WORDS, 'i')})"


@query(
    "dlp_scan",
    f"{MARKED} SELECT doc_id, CASE WHEN {SCAN_BLOCK} THEN text ELSE "
    + masked_sql("text", (masking.LEAK_EMAIL, masking.LEAK_PHONE))
    + f" END AS sanitized, {SCAN_BLOCK} AS block, CASE WHEN {SCAN_BLOCK} THEN 'SSN detected' ELSE 'redacted' END AS reason"
    " FROM marked",
)
def dlp_scan(spark, sf_dir):
    return (
        fx.marked(spark, sf_dir).select("doc_id", masking.leak_scan(F.col("text")).alias("s")).select("doc_id", "s.*")
    )


STRIPPED = masked_sql(masked_sql("text", masking.LEAK_FIRST_PASS), masking.LEAK_SECOND_PASS)


@query(
    "dlp_strip",
    f"{MARKED}, cleaned AS (SELECT doc_id, {STRIPPED} AS text FROM marked) SELECT doc_id, CASE WHEN "
    f"{has_sql('text', masking.SSN)} THEN {lit(masking.BLOCKED)} ELSE text END AS text FROM cleaned",
)
def dlp_strip(spark, sf_dir):
    return fx.marked(spark, sf_dir).select("doc_id", masking.strip_sensitive(F.col("text")).alias("text"))


def report_sql(rules) -> str:
    ctes, n = [f"{MARKED}, m0 AS (SELECT source, text FROM marked)"], 0
    for rule in rules:
        pattern = lit((f"(?{rule.flags})" if rule.flags else "") + rule.pattern)
        held = "".join(f"h{i}, " for i in range(n))
        ctes.append(
            f"m{n + 1} AS (SELECT source, {held}len(regexp_extract_all(text, {pattern})) AS h{n}, "
            f"{rx_sql('text', rule.pattern, rule.replacement, rule.flags)} AS text FROM m{n})"
        )
        n += 1
    rows = " UNION ALL ".join(
        f"SELECT source, '{rule.name}' AS rule, CAST(sum(h{i}) AS BIGINT) AS hits FROM m{n} GROUP BY source"
        for i, rule in enumerate(rules)
    )
    return ", ".join(ctes) + " " + rows


@query("masking_report", report_sql(masking.CLINICAL))
def masking_report(spark, sf_dir):
    return masking.masking_report(fx.marked(spark, sf_dir), "text", "source", masking.CLINICAL)


@query("masking_report_leak", report_sql(masking.LEAK_FIRST_PASS))
def masking_report_leak(spark, sf_dir):
    return masking.masking_report(fx.marked(spark, sf_dir), "text", "source", masking.LEAK_FIRST_PASS)


FINISH_SQL = FORMAT_SQL.rsplit(" SELECT doc_id, CASE WHEN norm", 1)
FINISH_SQL = f"""{FINISH_SQL[0]},
 formatted AS (SELECT doc_id, request, CASE WHEN norm{FINISH_SQL[1]}),
 cleaned AS (SELECT doc_id, request, {STRIPPED} AS text FROM formatted),
 final AS (SELECT doc_id, request, CASE WHEN {has_sql("text", masking.SSN)} THEN {lit(masking.BLOCKED)} ELSE text END AS answer
  FROM cleaned)
 SELECT doc_id, answer, length(request) AS input_length, length(answer) AS output_length FROM final"""


@query("chat_finish", FINISH_SQL)
def chat_finish(spark, sf_dir):
    answers = fx.marked(spark, sf_dir).select(
        "doc_id",
        F.col("text").alias("answer"),
        fx.pick(fx.MESSAGE_PHRASES, F.col("doc_id")).alias("message"),
        F.lit("").alias("context"),
    )
    return finish(answers).select("doc_id", "answer", "input_length", "output_length")


# --- chunking -------------------------------------------------------------------------------------------------------


def fixed_sql(t: str, size: int, overlap: int, source: str = "documents") -> str:
    step = size - overlap
    return (
        f"SELECT doc_id, chunk_index, substr(t, chunk_index * {step} + 1, {size}) AS chunk_text FROM (SELECT doc_id, t,"
        f" unnest(range(0, CAST(ceil(length(t) / {step}.0) AS BIGINT))) AS chunk_index"
        f" FROM (SELECT doc_id, {t} AS t FROM {source}))"
    )


def chunk_query(name: str, cut, sql: str):
    @query(name, sql)
    def run(spark, sf_dir):
        documents = fx.documents(spark, sf_dir)
        return chunking.explode_chunks(documents, cut(F.col("text"))).select("doc_id", "chunk_index", "chunk_text")


chunk_query("chunk_fixed_overlap", lambda c: chunking.fixed(c, 500, 50), fixed_sql("text", 500, 50))
chunk_query("chunk_fixed_collapsed", chunking.fixed_collapsed, fixed_sql(collapse_sql("text"), 800, 200))
chunk_query("chunk_fixed_plain", lambda c: chunking.fixed(c, 800, 0), fixed_sql("text", 800, 0))
chunk_query(
    "chunk_word_window",
    chunking.word_window,
    r"""WITH w AS (SELECT doc_id, regexp_split_to_array(text, '\s+') AS words FROM documents),
 s AS (SELECT doc_id, words, unnest(range(0, len(words), 650)) AS start FROM w),
 p AS (SELECT doc_id, start, array_to_string(words[start + 1 : start + 750], ' ') AS chunk_text FROM s)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, chunk_text FROM p
 WHERE trim(chunk_text) <> ''""",
)
WORD_PACK_SQL = """WITH RECURSIVE
 words AS (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) AS j, unnest(string_split(text, ' ')) AS w
  FROM documents),
 c AS (SELECT doc_id, j, w, length(w) AS n, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY j) AS upto FROM words),
 starts AS (
  SELECT doc_id, 1::BIGINT AS s, 0::HUGEINT AS before FROM c WHERE j = 1
  UNION ALL
  SELECT p.doc_id, min(c.j), arg_min(c.upto - c.n, c.j)
  FROM starts p JOIN c ON c.doc_id = p.doc_id AND c.j > p.s
   AND (c.upto - c.n - p.before) + (c.j - 1 - p.s) + c.n > 800
  GROUP BY p.doc_id, p.s),
 bounds AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM starts),
 pieces AS (SELECT b.doc_id, b.s, string_agg(c.w, ' ' ORDER BY c.j) AS chunk_text
  FROM bounds b JOIN c ON c.doc_id = b.doc_id AND c.j >= b.s AND (b.e IS NULL OR c.j < b.e) GROUP BY b.doc_id, b.s),
 led AS (SELECT doc_id, s, chunk_text FROM pieces
  UNION ALL SELECT doc_id, 0, '' FROM c WHERE j = 1 AND n > 800)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, chunk_text FROM led"""
chunk_query("chunk_word_pack", chunking.word_pack, WORD_PACK_SQL)


def line_pack_ctes() -> str:
    return f"""t AS (SELECT doc_id, {trim_sql(chain_sql("text", *LIGHT))} AS text FROM documents),
 lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS j,
  unnest(string_split(text, chr(10))) AS w FROM t),
 c AS (SELECT doc_id, j, w, length(w) AS n, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY j) AS upto,
  sum(length({trim_sql("w")})) OVER (PARTITION BY doc_id ORDER BY j) AS inked,
  length({trim_sql("w")}) AS ink FROM lines),
 starts AS (
  SELECT doc_id, 1::BIGINT AS s, 0::HUGEINT AS before, 0::HUGEINT AS inked_before FROM c WHERE j = 1
  UNION ALL
  SELECT p.doc_id, min(c.j), arg_min(c.upto - c.n, c.j), arg_min(c.inked - c.ink, c.j)
  FROM starts p JOIN c ON c.doc_id = p.doc_id AND c.j > p.s
   AND (c.upto - c.n - p.before) + (c.j - p.s) + c.n > 800 AND c.inked - c.ink > p.inked_before
  GROUP BY p.doc_id, p.s),
 bounds AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM starts),
 pieces AS (SELECT b.doc_id, b.s, {trim_sql("string_agg(c.w, chr(10) ORDER BY c.j)")} AS chunk_text
  FROM bounds b JOIN c ON c.doc_id = b.doc_id AND c.j >= b.s AND (b.e IS NULL OR c.j < b.e) GROUP BY b.doc_id, b.s)"""


LINE_PACK_SQL = f"""WITH RECURSIVE {line_pack_ctes()}
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, chunk_text FROM pieces
 WHERE chunk_text <> ''"""
chunk_query("chunk_paragraph_pack", chunking.line_pack, LINE_PACK_SQL)


@query(
    "chunk_ids",
    f"""WITH RECURSIVE {line_pack_ctes()},
 numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n, chunk_text FROM pieces
  WHERE chunk_text <> '')
 SELECT 'doc' || CAST(doc_id AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS id, chunk_text AS content,
  'doc' || CAST(doc_id AS VARCHAR) AS source FROM numbered""",
)
def chunk_ids(spark, sf_dir):
    documents = fx.documents(spark, sf_dir).select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), "text"
    )
    pieces = chunking.explode_chunks(documents, chunking.line_pack(F.col("text")))
    return pieces.select(
        chunking.chunk_id(F.col("source"), F.col("chunk_index")).alias("id"),
        F.col("chunk_text").alias("content"),
        "source",
    )


# --- entities -------------------------------------------------------------------------------------------------------


def person_sql(t: str) -> str:
    name = f"regexp_extract({t}, {lit(entities.PERSON)}, 0)"
    banned = "[" + ", ".join(lit(w) for w in entities.NO_PERSON) + "]"
    return (
        f"CASE WHEN len(string_split({name}, ' ')) BETWEEN 2 AND 3 AND NOT list_has_any(string_split({name}, ' '), {banned})"
        f" THEN {name} END"
    )


ENTITY_SQL = (
    "CASE WHEN file_name <> '' THEN coalesce("
    + person_sql(
        collapse_sql(
            chain_sql("file_name", (r"\.[^/.]+$", ""), (entities.FILE_NAME_WORDS, "", "i"), (r"[-_()]", " "))
        )
    )
    + ", "
    + person_sql("substr(text, 1, 300)")
    + ") END"
)


@query("primary_entity", f"WITH {fx.FILES} SELECT doc_id, {ENTITY_SQL} AS entity FROM files")
def primary_entity(spark, sf_dir):
    return fx.files(spark, sf_dir).select(
        "doc_id", entities.primary_entity(F.col("file_name"), F.col("text")).alias("entity")
    )


HEADER_SQL = (
    "CASE WHEN entity IS NOT NULL THEN 'PRIMARY ENTITY: ' || entity || chr(10) ELSE '' END"
    " || 'SOURCE FILE: ' || file_name || chr(10) || chr(10)"
)


@query(
    "chunk_header",
    f"WITH {fx.FILES}, e AS (SELECT doc_id, file_name, {ENTITY_SQL} AS entity FROM files) SELECT doc_id, {HEADER_SQL}"
    " AS header FROM e",
)
def chunk_header(spark, sf_dir):
    rows = fx.files(spark, sf_dir).withColumn("entity", entities.primary_entity(F.col("file_name"), F.col("text")))
    return rows.select("doc_id", chunking.header(F.col("entity"), F.col("file_name")).alias("header"))


@query(
    "message_entity",
    f"{MESSAGES} SELECT conv_id, turn, nullif(regexp_extract(message, {lit(entities.TWO_WORD_NAME)}, 0), '') AS entity"
    " FROM messages",
)
def message_entity(spark, sf_dir):
    return fx.messages(spark, sf_dir).select(
        "conv_id", "turn", entities.message_entity(F.col("message")).alias("entity")
    )


TOKEN_SQL = f"nullif(regexp_extract(message, {lit('(?i)' + entities.RESUME_OWNER)}, 1), '')"
TOKEN_SQL = f"upper(substr({TOKEN_SQL}, 1, 1)) || lower(substr({TOKEN_SQL}, 2))"


@query("requested_token", f"{MESSAGES} SELECT conv_id, turn, {TOKEN_SQL} AS token FROM messages")
def requested_token(spark, sf_dir):
    return fx.messages(spark, sf_dir).select(
        "conv_id", "turn", entities.requested_token(F.col("message")).alias("token")
    )


NAME_CONTEXT_SQL = f"""WITH {fx.FILES}, t AS (
  SELECT doc_id, text, {fx.pick_sql(("Mary", "carl", "System", "no", "T."), "doc_id")} AS token FROM files),
 m AS (SELECT doc_id, token, regexp_extract(text, '(?i)\\b(' || regexp_escape(token) || '\\s+[A-Z][a-z]+)\\b', 1) AS name
  FROM t)
 SELECT doc_id, CASE WHEN name <> '' THEN trim(array_to_string(list_transform(string_split(name, ' '),
  lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')) END AS name FROM m"""


@query("name_from_context", NAME_CONTEXT_SQL)
def name_from_context(spark, sf_dir):
    token = fx.pick(("Mary", "carl", "System", "no", "T."), F.col("doc_id"))
    return fx.files(spark, sf_dir).select("doc_id", entities.name_from_context(F.col("text"), token).alias("name"))


@query(
    "source_label",
    f"WITH {fx.FILES} SELECT doc_id, coalesce(nullif(file_name, ''), CASE WHEN doc_id % 16 = 7 THEN NULL ELSE mime END,"
    " 'UNKNOWN_SOURCE') AS label FROM files",
)
def source_label(spark, sf_dir):
    mime = F.when(F.col("doc_id") % 16 != 7, F.col("mime"))
    return fx.files(spark, sf_dir).select("doc_id", entities.source_label(F.col("file_name"), mime).alias("label"))


@query(
    "evidence_entity",
    f"WITH {fx.FILES}, l AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' Owner  Name ' END AS owner,"
    " coalesce(nullif(file_name, ''), 'UNKNOWN_SOURCE') AS label FROM files) SELECT doc_id, "
    + content_sql("coalesce(owner, " + chain_sql("label", (r"\.[^/.]+$", ""), ("[_-]+", " ")) + ")")
    + " AS entity FROM l",
)
def evidence_entity(spark, sf_dir):
    owner = F.when(F.col("doc_id") % 5 == 0, F.lit(" Owner  Name "))
    label = entities.source_label(F.col("file_name"))
    return fx.files(spark, sf_dir).select("doc_id", entities.evidence_entity([owner], label).alias("entity"))


# --- classes --------------------------------------------------------------------------------------------------------


def rule_sql(t: str, rules, default: str) -> str:
    case = "CASE "
    for name, anywhere, at_start in rules:
        hits = [f"contains({t}, {lit(w)})" for w in anywhere] + [f"starts_with({t}, {lit(w)})" for w in at_start]
        case += f"WHEN {' OR '.join(hits)} THEN '{name}' "
    return case + f"ELSE '{default}' END"


LITERAL_SQL = "(" + " OR ".join(f"starts_with(m, {lit(p)})" for p in text.LITERAL_PHRASES) + ")"
INTENT_CTE = (
    f"low AS (SELECT conv_id, turn, message, {trim_sql('lower(message)')} AS m FROM messages), "
    f"intents AS (SELECT conv_id, turn, message, CASE WHEN {LITERAL_SQL} THEN 'literal' ELSE "
    f"{rule_sql('m', classify.TYPE_RULES, 'general')} END AS type, CASE WHEN {LITERAL_SQL} THEN 'locked' ELSE "
    f"{rule_sql('m', classify.MATURITY_RULES, 'general')} END AS maturity FROM low)"
)


@query("decode_intent", f"{MESSAGES}, {INTENT_CTE} SELECT conv_id, turn, type, maturity FROM intents")
def decode_intent(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).withColumn("i", classify.decode_intent(F.col("message")))
    return rows.select("conv_id", "turn", "i.type", "i.maturity")


@query(
    "classify_intent_simple",
    f"{MESSAGES} SELECT conv_id, turn, {rule_sql('lower(message)', classify.SIMPLE_RULES, 'general')} AS intent"
    " FROM messages",
)
def classify_intent_simple(spark, sf_dir):
    return fx.messages(spark, sf_dir).select(
        "conv_id", "turn", classify.simple_intent(F.col("message")).alias("intent")
    )


SIGNAL_COUNT = count_sql("lower(query)", classify.PROFILE_SIGNALS)


def profile_sql(position: int, quoted: bool = False) -> str:
    a, b, c = classify.PROFILES
    show = (lambda v: f"'{v}'") if quoted else str
    return (
        f"CASE WHEN {SIGNAL_COUNT} >= {a[1]} THEN {show(a[position])} WHEN {SIGNAL_COUNT} >= {b[1]} THEN "
        f"{show(b[position])} ELSE {show(c[position])} END"
    )


@query(
    "query_profile",
    f"WITH {fx.QUERY_TABLE} SELECT query_id, {profile_sql(0, True)} AS type, CAST({profile_sql(2)} AS BIGINT) AS top_k,"
    f" CAST({profile_sql(3)} AS BIGINT) AS match_count, CAST({profile_sql(4)} AS DOUBLE) AS threshold,"
    f" CAST({profile_sql(5)} AS BIGINT) AS budget FROM query_table",
)
def query_profile(spark, sf_dir):
    rows = fx.query_table(spark, sf_dir).select("query_id", classify.query_profile(F.col("query")).alias("p"))
    return rows.select("query_id", "p.*")


PRIORITY_SQL = (
    f"CASE WHEN private AND {any_sql('lower(message)', classify.EVIDENCE_WORDS)} THEN 'LOW' WHEN private THEN 'NONE'"
    f" WHEN {any_sql('lower(message)', classify.EVIDENCE_WORDS)} AND NOT"
    f" {any_sql('lower(message)', classify.SYNTHESIS_WORDS)} THEN 'HIGH'"
    " WHEN type IN ('analysis', 'lookup', 'question') THEN 'MEDIUM' ELSE 'LOW' END"
)


@query(
    "retrieval_priority",
    f"{MESSAGES}, {INTENT_CTE} SELECT conv_id, turn, {PRIORITY_SQL} AS priority FROM"
    " (SELECT *, conv_id % 3 = 0 AS private FROM intents)",
)
def retrieval_priority(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).withColumn("i", classify.decode_intent(F.col("message")))
    priority = classify.retrieval_priority(F.col("message"), F.col("i.type"), F.col("conv_id") % 3 == 0)
    return rows.select("conv_id", "turn", priority.alias("priority"))


SIMPLE_SQL = (
    f"CASE WHEN {trim_sql('lower(message)')} IN ('who are you', 'who are you?') THEN 'Evidence assistant.' WHEN "
    + has_sql("message", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "i")
    + f" THEN 'Email detected. No context.' WHEN length({trim_sql('lower(message)')}) <= 10 THEN 'No subject.' END"
)


@query("simple_case", f"{MESSAGES} SELECT conv_id, turn, {SIMPLE_SQL} AS answer FROM messages")
def simple_case(spark, sf_dir):
    return fx.messages(spark, sf_dir).select(
        "conv_id", "turn", classify.simple_case(F.col("message"), "Evidence assistant.").alias("answer")
    )


GATE_SQL = (
    f"CASE WHEN NOT (conv_id % 4 = 0 OR (length({trim_sql('message')}) >= 120 AND NOT "
    f"{any_sql('lower(message)', classify.EXTERNAL_EVIDENCE)})) THEN {lit(classify.NO_DOCUMENTS)} END"
)


@query("synthesis_gate", f"{MESSAGES} SELECT conv_id, turn, {GATE_SQL} AS answer FROM messages")
def synthesis_gate(spark, sf_dir):
    context = F.when(F.col("conv_id") % 4 == 0, F.lit("given")).otherwise(F.lit("  "))
    return fx.messages(spark, sf_dir).select(
        "conv_id", "turn", classify.synthesis_gate(F.col("message"), context).alias("answer")
    )


NOTE_SQL = (
    "CASE type "
    + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in classify.INTENT_NOTES.items())
    + f" ELSE {lit(classify.DEFAULT_NOTE)} END || CASE WHEN turn > 0 THEN {lit('|' + classify.EVIDENCE_NOTE)} ELSE '' END"
)


@query("inference_notes", f"{MESSAGES}, {INTENT_CTE} SELECT conv_id, turn, {NOTE_SQL} AS notes FROM intents")
def inference_notes(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).withColumn("i", classify.decode_intent(F.col("message")))
    notes = classify.inference_notes(F.col("i.type"), F.col("turn"))
    return rows.select("conv_id", "turn", F.array_join(notes, "|").alias("notes"))


def bucket_ctes(source: str, key: str, order: str, t: str = "content") -> str:
    """CTEs from source(key, order, t) to bucketed(key, bucket, bucket_pos, content)."""
    tests = [
        f"CASE WHEN {count_sql(f'lower({t})', signals_)} >= {least} THEN '{name}' END"
        for name, least, _, signals_ in classify.BUCKETS
        if signals_
    ]
    return f"""named AS (SELECT {key}, {order} AS ord, {t} AS content,
  list_filter([{", ".join(tests)}], lambda b: b IS NOT NULL) AS names FROM {source}),
 tagged AS (SELECT {key}, ord, content, unnest(CASE WHEN len(names) = 0 THEN ['contextual'] ELSE names END) AS bucket
  FROM named),
 copies AS (SELECT *, row_number() OVER (PARTITION BY {key}, bucket, content ORDER BY ord) AS copy FROM tagged),
 placed AS (SELECT *, row_number() OVER (PARTITION BY {key}, bucket ORDER BY ord) AS bucket_pos FROM copies WHERE copy = 1),
 bucketed AS (SELECT {key}, bucket, bucket_pos, content FROM placed
  WHERE bucket_pos <= CASE WHEN bucket = 'operational' THEN 5 ELSE 4 END)"""


@query(
    "abstraction_labels",
    f"{MARKED}, "
    + bucket_ctes("marked", "doc_id", "doc_id", "text")
    + " SELECT doc_id, bucket FROM tagged",
)
def abstraction_labels(spark, sf_dir):
    return fx.marked(spark, sf_dir).select(
        "doc_id", F.explode(classify.abstraction_buckets(F.col("text"))).alias("bucket")
    )


@query(
    "validate_request",
    f"{MESSAGES} SELECT conv_id, turn, CASE WHEN {trim_sql('message')} = '' THEN 'Message required' WHEN"
    " length(message) > 10000 THEN 'Input too large' ELSE 'ok' END AS status FROM messages",
)
def validate_request(spark, sf_dir):
    return fx.messages(spark, sf_dir).select(
        "conv_id", "turn", classify.request_status(F.col("message")).alias("status")
    )


TRIAGE_SQL = f"""WITH {fx.MESSAGES.replace("messages AS", "raw AS")},
 scanned AS (SELECT conv_id, turn, message AS text FROM raw),
 messages AS (SELECT conv_id, turn, {SCAN_BLOCK} AS block, CASE WHEN {trim_sql("text")} = '' THEN 'Message required'
   WHEN length(text) > 10000 THEN 'Input too large' WHEN {SCAN_BLOCK} THEN 'Sensitive data blocked' ELSE 'ok' END AS status,
  CASE WHEN {SCAN_BLOCK} THEN text ELSE {masked_sql("text", (masking.LEAK_EMAIL, masking.LEAK_PHONE))} END AS message
  FROM scanned),
 {INTENT_CTE}
 SELECT m.conv_id, m.turn, m.status, m.message, {SIMPLE_SQL.replace("message", "m.message")} AS fixed_answer,
  i.type AS intent, i.maturity, {PRIORITY_SQL.replace("message", "m.message").replace("private", "(m.conv_id % 3 = 0)")} AS priority
 FROM messages m JOIN intents i USING (conv_id, turn)"""


@query("chat_triage", TRIAGE_SQL)
def chat_triage(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).withColumns(
        {
            "private_context": F.when(F.col("conv_id") % 3 == 0, F.lit("note")),
            "namespace": F.lit("advisory"),
        }
    )
    return triage(rows).select(
        "conv_id", "turn", "status", "message", "fixed_answer", "intent", "maturity", "priority"
    )


# --- signals --------------------------------------------------------------------------------------------------------


def words_sql(t: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> '')"


def density_sql(t: str) -> str:
    w = words_sql(t)
    return f"CASE WHEN len({w}) = 0 THEN 0.0 ELSE len(list_distinct({w})) / CAST(len({w}) AS DOUBLE) END"


SIGNAL_TERMS = ("strategy", "than", "workflow", "ou", "zzz")
WIDE_AS_SPACE = rx_sql("text", WIDE_SPACE, " ")


@query(
    "term_matches",
    f"{MARKED} SELECT doc_id, CAST({count_sql('lower(text)', SIGNAL_TERMS)} AS BIGINT) AS n FROM marked",
)
def term_matches(spark, sf_dir):
    terms = F.array(*[F.lit(t) for t in SIGNAL_TERMS])
    return fx.marked(spark, sf_dir).select("doc_id", signals.term_matches(F.col("text"), terms).alias("n"))


@query(
    "semantic_density",
    f"{MARKED} SELECT doc_id, round({density_sql(WIDE_AS_SPACE)}, 6) AS density FROM marked",
)
def semantic_density(spark, sf_dir):
    return fx.marked(spark, sf_dir).select("doc_id", signals.semantic_density(F.col("text")).alias("density"))


def overlap_sql(a: str, b: str) -> str:
    stops = ", ".join(lit(w) for w in text.STOP_WORDS)
    return (
        f"len(list_filter(list_intersect({a}, {b}), lambda w: length(w) > 4 AND w NOT IN ({stops})))"
        f" / CAST(greatest(len({a}), len({b}), 1) AS DOUBLE)"
    )


@query(
    "semantic_overlap",
    f"""WITH t AS (SELECT d.doc_id, list_distinct({words_sql("d.text")}) AS a, list_distinct({words_sql("b.text")}) AS b
  FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)
 SELECT doc_id, round({overlap_sql("a", "b")}, 6) AS overlap FROM t""",
)
def semantic_overlap(spark, sf_dir):
    d, b = fx.documents(spark, sf_dir), fx.table(spark, sf_dir, "benchmark")
    paired = d.withColumn("item_id", F.col("doc_id") % b.count()).join(b.withColumnRenamed("text", "other"), "item_id")
    overlap = signals.semantic_overlap(signals.word_set(F.col("text")), signals.word_set(F.col("other")))
    return paired.select("doc_id", overlap.alias("overlap"))


def concepts_sql(t: str) -> str:
    tokens = f"string_split({terms_sql(t)}, ' ')"
    kept = f"list_filter({tokens}, lambda w: length(w) >= 5 AND NOT regexp_matches(w, '^[0-9]+$'))"
    return f"list_distinct({kept})"


@query(
    "concept_terms",
    f"{MARKED} SELECT doc_id, array_to_string(list_sort({concepts_sql('text')}), ' ') AS terms FROM marked",
)
def concept_terms(spark, sf_dir):
    return fx.marked(spark, sf_dir).select(
        "doc_id", F.array_join(F.array_sort(signals.concept_terms(F.col("text"))), " ").alias("terms")
    )


def fingerprint_sql(t: str) -> str:
    low = rx_sql(f"lower({t})", r"\s+", " ")
    return (
        f"substr({low}, 1, 120) || '|' || substr({low}, CAST(floor(length({low}) / 2.0) AS BIGINT) + 1, 120)"
        f" || '|' || right({low}, 120)"
    )


@query("content_fingerprint", f"SELECT doc_id, {fingerprint_sql('text')} AS fingerprint FROM documents")
def content_fingerprint(spark, sf_dir):
    return fx.documents(spark, sf_dir).select(
        "doc_id", signals.fingerprint(F.col("text")).alias("fingerprint")
    )


def synthetic_sql(t: str) -> str:
    return (
        "'ecosystem_' || CAST(list_sum(list_transform(string_split("
        + fingerprint_sql(t)
        + ", ''), lambda ch: unicode(ch))) AS VARCHAR)"
    )


@query("synthetic_id", f"SELECT doc_id, {synthetic_sql('text')} AS id FROM documents")
def synthetic_id(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("doc_id", signals.synthetic_id(F.col("text")).alias("id"))


def clamp_sql(value: str, low: float, high: float) -> str:
    return f"greatest({low}, least({high}, {value}))"


def specificity_sql(t: str) -> str:
    parts = [f"CASE WHEN length({t}) > 250 THEN 0.10::DOUBLE ELSE 0.0 END"] + [
        f"CASE WHEN {has_sql(f'lower({t})', p)} THEN {w}::DOUBLE ELSE 0.0 END" for p, w in signals.SPECIFIC_PATTERNS
    ]
    return clamp_sql(" + ".join(parts), 0.0, 0.40)


def dense_sql(t: str) -> str:
    return clamp_sql(f"{count_sql(f'lower({t})', signals.DENSE_WORDS)} * 0.02::DOUBLE", 0.0, 0.20)


def directness_sql(t: str, intent: str) -> str:
    return clamp_sql(
        f"CASE WHEN {intent} <> '' AND contains(lower({t}), lower({intent})) THEN 0.10::DOUBLE ELSE 0.0 END"
        f" + CASE WHEN length({t}) > 0 AND length({t}) < 400 THEN 0.05::DOUBLE ELSE 0.0 END",
        0.0,
        0.15,
    )


def relationship_sql(strength: str, boost: str, continuity: str, n: str) -> str:
    return clamp_sql(
        f"{strength} * 0.04::DOUBLE + {boost} * 0.60::DOUBLE + {continuity} + least({n} * 0.01::DOUBLE, 0.04::DOUBLE)",
        0.0,
        0.15,
    )


def scored_query(name: str, expression, sql: str):
    @query(name, f"{MARKED} SELECT doc_id, round({sql}, 6) AS score FROM marked")
    def run(spark, sf_dir):
        return fx.marked(spark, sf_dir).select("doc_id", expression.alias("score"))


def lazy(build):
    """Column expressions need a session, so they are made when the query runs."""

    class Later:
        def alias(self, name):
            return build().alias(name)

    return Later()


scored_query("specificity", lazy(lambda: signals.specificity(F.col("text"))), specificity_sql("text"))
scored_query("density_terms", lazy(lambda: signals.density_terms(F.col("text"))), dense_sql("text"))
scored_query(
    "directness",
    lazy(lambda: signals.directness(F.col("text"), F.col("lang"))),
    directness_sql("text", "lang"),
)
scored_query(
    "relationship",
    lazy(
        lambda: signals.relationship(
            F.col("doc_id") % 5 / 2.0, F.col("doc_id") % 7 / 100.0, F.col("doc_id") % 3 / 100.0, F.col("doc_id") % 6
        )
    ),
    relationship_sql("(doc_id % 5 / 2.0)", "(doc_id % 7 / 100.0)", "(doc_id % 3 / 100.0)", "(doc_id % 6)"),
)


@query(
    "mock_embed",
    "SELECT doc_id, round(length(text) % 10 / 10.0, 6) AS e0, round(length(text) % 7 / 7.0, 6) AS e1,"
    " round(length(text) % 5 / 5.0, 6) AS e2 FROM documents",
)
def mock_embedding(spark, sf_dir):
    rows = fx.documents(spark, sf_dir).select("doc_id", mock_embed(F.col("text")).alias("e"))
    return rows.select("doc_id", *[F.get("e", F.lit(i)).alias(f"e{i}") for i in range(3)])


# --- hashes ---------------------------------------------------------------------------------------------------------

PERSONA = "Evidence assistant"


def hash_fields():
    return {
        "finalAnswer": F.col("message"),
        "persona": F.lit(PERSONA),
        "tone": F.lit("king"),
        "namespace": F.concat(F.lit("ns"), (F.col("conv_id") % 4).cast("string")),
        "intent": F.col("role"),
        "timestamp": F.when(F.col("turn") != 3, F.concat(F.lit("2024-01-0"), (F.col("turn") + 1).cast("string"))),
    }


def json_text_sql(t: str) -> str:
    return f"CAST(to_json({t}) AS VARCHAR)"


HASH_SQL = (
    "sha256('{\"finalAnswer\":' || "
    + json_text_sql("message")
    + f" || ',\"persona\":\"{PERSONA}\",\"tone\":\"king\",\"namespace\":\"ns' || CAST(conv_id % 4 AS VARCHAR)"
    + " || '\",\"intent\":\"' || role || '\"' || CASE WHEN turn <> 3 THEN ',\"timestamp\":\"2024-01-0' ||"
    + " CAST(turn + 1 AS VARCHAR) || '\"' ELSE '' END || '}')"
)


@query("integrity_hash", f"{MESSAGES} SELECT conv_id, turn, {HASH_SQL} AS hash FROM messages")
def integrity_hash(spark, sf_dir):
    return fx.messages(spark, sf_dir).select(
        "conv_id", "turn", hashing.integrity_hash(hash_fields()).alias("hash")
    )


@query(
    "verify_integrity",
    f"{MESSAGES} SELECT CASE WHEN message = '' THEN NULL ELSE turn % 3 <> 1 END AS valid, count(*) AS n FROM messages"
    " GROUP BY 1",
)
def verify_integrity(spark, sf_dir):
    fields = hash_fields()
    right = hashing.integrity_hash(fields)
    stored = F.when(F.col("turn") % 3 == 1, F.reverse(right)).otherwise(right)
    rows = fx.messages(spark, sf_dir).select(hashing.verify_integrity(fields, stored).alias("valid"))
    return rows.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))
