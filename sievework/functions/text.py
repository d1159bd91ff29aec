"""Cleaning, normalising, rewriting and formatting of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rx
from .masking import mask_clinical, mask_pii
from .tasks import dedupe_lines, nfkc

# --- cleaning -------------------------------------------------------------------------------------------------------


def clean_full(c: Column) -> Column:
    """Control characters, NFKC, quotes, bullets, dashes, clinical masking, one space between words."""
    plain = rx.sub(rx.text_or_empty(c), r"[\x00-\x09\x0B\x0C\x0E-\x1F]", " ")
    plain = rx.chain_where(
        nfkc(plain),
        ("“", "”", "‘", "’", "\uFFFD", "•", "—", "–"),
        ("[“”]", '"'),
        ("[‘’]", "'"),
        (r"\uFFFD", " "),
        ("•", "- "),
        ("[—–]", "-"),
    )
    return rx.collapse(mask_clinical(plain))


def clean_light(c: Column) -> Column:
    return rx.trim(rx.chain(rx.text_or_empty(c), (r"\r", ""), (r"\t", " "), (" +", " "), (r"\n{3,}", "\n\n")))


def sanitize(c: Column) -> Column:
    return rx.collapse(rx.sub(mask_pii(rx.text_or_empty(c)), r"[^\x00-\x7F]+", " "))


def normalize_content(c: Column) -> Column:
    return rx.trim(rx.chain(rx.text_or_empty(c), (r"\r", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


def collapse_space(c: Column) -> Column:
    return rx.collapse(rx.text_or_empty(c))


def normalize_terms(c: Column) -> Column:
    return rx.collapse(rx.sub(F.lower(rx.text_or_empty(c)), r"[^\w\s]", ""))


# the matches of (^|\n)\s*data:\s* in any case: a run of white space is entered at its start only, and what stands before its
# first line end stays
DATA_PREFIX = (
    rf"(?i)\A[{rx.WHITE}]*+data:[{rx.WHITE}]*+|(?<![{rx.WHITE}])([{rx.WHITE}&&[^\n]]*+)\n[{rx.WHITE}]*+data:[{rx.WHITE}]*+"
)


def strip_data_prefix(c: Column) -> Column:
    """Text without `data:` at the start or after a line end, with the white space around."""
    return F.regexp_replace(c, DATA_PREFIX, "$1")


def strip_artifacts(c: Column) -> Column:
    """Invisible characters, transport prefixes and end marks, surplus lines, broken markdown, leaked literals."""
    visible = rx.chain(
        rx.text_or_empty(c),
        # fixed values: the patterns of this chain and the next
        (r"[\u00A0\u2007\u202F]", " "),
        (r"[\u200B-\u200D\uFEFF]", ""),
    )
    return rx.trim_start(
        rx.chain(
            strip_data_prefix(visible),
            (r"\[DONE\]", "", "i"),
            (r"\n{3,}", "\n\n"),
            (r"\* \* \*", "***"),
            ("` ` `", "```"),
            ("undefined", ""),
        )
    )


def normalize_typography(c: Column) -> Column:
    # fixed values: the patterns of these chains
    text = rx.chain_where(rx.text_or_empty(c), ("\r\n",), (r"\r\n", "\n"))
    text = rx.chain_where(text, ("\n\n\n",), (r"\n{3,}", "\n\n"))
    text = rx.trim_rare(rx.chain_where(text, ("  ", "\t"), (r"[ \t]+", " ")))
    # bullets
    text = rx.chain_where(text, ("•", "*", "–"), ("[•*–]", "-"))
    text = rx.chain_where(text, ("-",), (r"-\s{0,}", "- "))
    text = rx.chain_where(text, ("- -",), (r"- -\s+", "- "))
    # sentence ends
    text = rx.chain_where(text, ("\n",), (r"([a-zA-Z])\n([a-zA-Z])", "$1 $2"))
    text = rx.sub(text, r"([.?!])([A-Z])", "$1 $2")
    # markdown
    text = rx.chain_where(text, ("```",), (r"```\s*$", "```"))
    text = rx.chain_where(text, ("**",), (r"\*\*\s+(.*?)\s+\*\*", "**$1**"))
    text = rx.chain_where(text, ("```",), (r"`{3,}", "```"))
    # characters; this also removes the line breaks left
    text = rx.sub(text, r"[\x00-\x1F\x7F]", "")
    text = rx.chain_where(text, ("“", "”", "‘", "’"), ("[“”]", '"'), ("[‘’]", "'"))
    wording = (
        (r"\bI(?:'m| am) sorry\b.*?(?=\.)", "", "i"),
        (r"\bAs an AI\b.*?(?=\.)", "", "i"),
        (r"\bmaybe\b", "possibly", "i"),
        (r"\bI think\b", "It appears", "i"),
        (r"\bI guess\b", "It suggests", "i"),
    )
    # one pass finds the texts in which a rule of the wording may match
    worded = rx.let(text, lambda t: F.when(rx.found(t, "sorry|as an ai|maybe|i think|i guess", "i"), rx.chain(t, *wording)).otherwise(t))
    return rx.trim_rare(worded)


def repair_tokens(c: Column) -> Column:
    """Space around punctuation inside words and a cut inside long fused words; loses information by design."""
    return rx.trim(
        rx.chain(
            c,
            # fixed values: the patterns of this chain
            (r"\u00A0", " "),
            (r"[\u2000-\u200F]", ""),
            ("([.!?,;:\\-’'])([A-Za-z])", "$1 $2"),
            ("([A-Za-z])([.!?,;:\\-’'])", "$1$2 "),
            (r"([a-z]{5,})([A-Z][a-z]+)", "$1 $2"),
            (r"([a-z]{6,})([a-z]{4,})", "$1 $2"),
            (r"([A-Z][a-z]{3,})([A-Z][a-z]+)", "$1 $2"),
            ("’s([A-Za-z])", "’s $1"),
            (r"\s{2,}", " "),
        )
    )


# --- queries --------------------------------------------------------------------------------------------------------

# fixed values: misspelt words and their corrections
TYPOS = {
    "hosptial": "hospital",
    "sumarize": "summarize",
    "incdidnet": "incident",
    "incdient": "incident",
    "resum": "resume",
    "canddate": "candidate",
}
# fixed values: words that carry no meaning in a query
STOP_WORDS = (
    "the", "and", "all", "from", "with", "uploaded", "supporting", "evidence", "notes", "document", "documents",
    "file", "files", "summarize", "analyze", "provide", "identify", "determine", "available", "materials",
)


def correct_word(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TYPOS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, word), word)


def normalize_query(c: Column) -> Column:
    """Lower case, no punctuation, known misspellings corrected; a space left at the end stays."""
    plain = rx.chain(rx.trim(F.lower(rx.text_or_empty(c))), (r"[^\w\s]", " "), (r"\s+", " "))
    return F.array_join(F.transform(F.split(plain, " ", -1), correct_word), " ")


def query_terms(normalized: Column) -> Column:
    """Words of more than three characters that are no stop words, repeats kept."""
    words = F.split(normalized, " ", -1)
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))


# --- rewriting ------------------------------------------------------------------------------------------------------

# fixed values: ordered phrase replacements
REWRITES = (
    (r"\bi think\b", "I conclude", "i"),
    (r"\bmaybe\b", "with certainty", "i"),
    (r"\bprobably\b", "with precision", "i"),
    (r"\bit seems\b", "I determine", "i"),
    (r"\bI guess\b", "I assert", "i"),
    (r"\bjust\b", "", "i"),
    (r"\bsort of\b", "", "i"),
    (r"\bkinda\b", "", "i"),
    (r"\bI believe\b", "I conclude with certainty", "i"),
    (r"\bI feel\b", "I assess", "i"),
    ("  +", " "),
)
# fixed values: what each tone puts in front, and the words it must not change
TONE_PREFIX = {
    "advisory": "Advisory Insight:\n",
    "cybersecurity": "Cybersecurity Analysis:\n",
    "recruiting": "Recruiting Insight:\n",
    "dataManagement": "Data Management Perspective:\n",
    "ventures": "Ventures Analysis:\n",
}
TONE_PROTECTS = {
    "advisory": ("roi", "kpi", "benchmark", "analysis", "strategy"),
    "cybersecurity": ("attack vector", "exploit", "mitigation", "zero[- ]day", r"cve[- ]\d+"),
    "recruiting": ("culture fit", "candidate", "retention"),
    "dataManagement": ("metadata", "schema", "normalization", "pipeline"),
    "ventures": ("market cap", "valuation", "funding round"),
}
TONES = ("king", "ceo", "advisory", "cybersecurity", "recruiting", "dataManagement", "ventures", "neutral")
DEFAULT_TONE = "king"
TONE_REWRITES = REWRITES[:3]
# fixed values: namespace to tone
NAMESPACE_TONES = {
    "root": "king",
    "admin": "king",
    "advisory": "advisory",
    "cybersecurity": "cybersecurity",
    "recruiting": "recruiting",
    "data": "dataManagement",
    "dataManagement": "dataManagement",
    "ventures": "ventures",
}


def rewrite(c: Column, rules: tuple = REWRITES) -> Column:
    return rx.trim(rx.chain(rx.text_or_empty(c), *rules))


def count_rewrites(df: DataFrame, column: str, rules: tuple = REWRITES) -> DataFrame:
    """Rewrite the column and add rewrites_<n>: replacements made by the n-th rule on the text left by the earlier."""
    for n, rule in enumerate(rules, 1):
        pattern = rx.ecma(rule[0], rule[2] if len(rule) > 2 else "")
        df = df.withColumn(f"rewrites_{n}", F.regexp_count(F.col(column), F.lit(pattern)))
        df = df.withColumn(column, rx.chain(F.col(column), rule))
    return df.withColumn(column, rx.trim(F.col(column)))


def tone_for_namespace(namespace: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NAMESPACE_TONES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, namespace), F.lit(DEFAULT_TONE))


def tone_rewrite(c: Column, tone: Column) -> Column:
    """Rewrite, apply the tone, rewrite again, then restore protected words as the original first spelt them."""
    original = rx.text_or_empty(c)
    tone = F.when(tone.isin(*TONES), tone).otherwise(F.lit(DEFAULT_TONE))
    base = rewrite(original)
    # rewriting twice equals rewriting once where the tone adds nothing in between that a rule matches
    toned = F.when(tone.isin("king", "ceo"), rx.trim(rx.chain(base, *TONE_REWRITES)))
    for name, prefix in TONE_PREFIX.items():
        toned = toned.when(tone == name, F.concat(F.lit(prefix), base))
    result = rewrite(toned.otherwise(base))

    def restore(text: Column, words: tuple[str, ...]) -> Column:
        for word in words:
            spelt = F.regexp_extract(original, rx.ecma(word, "i"), 0)
            # "$0" puts the match itself back where the original lacks the word
            text = F.regexp_replace(
                text, F.lit(rx.ecma(word, "i")), F.when(spelt == "", F.lit("$0")).otherwise(spelt)
            )
        return text

    def by_tone(text: Column) -> Column:
        protected = F.when(tone == "", text)
        for name, words in TONE_PROTECTS.items():
            protected = protected.when(tone == name, restore(text, words))
        return protected.otherwise(text)

    return rx.let(result, by_tone)


# fixed values: phrases in front of a text that must be repeated unchanged
LITERAL_PHRASES = ("repeat exactly:", "repeat this exactly:", "do not change:", "say this verbatim:")


def literal_strip(c: Column) -> Column:
    return rx.trim(rx.chain(rx.text_or_empty(c), *[("^" + p, "", "i") for p in LITERAL_PHRASES]))


# --- formatting -----------------------------------------------------------------------------------------------------

# fixed values: section headers, phrases of a missing answer, words of a rewriting request
SECTION_HEADERS = (
    "Summary", "Recommendation", "Key Strengths", "Watch Areas", "Risks", "Next Steps", "Executive Summary",
    "Operational Analysis", "Root Cause", "Impact", "Remediation",
)
MISSING_ANSWER = (
    "no matching documents found", "i need more information", "not enough information", "insufficient information",
)
REWRITE_REQUEST = ("rewrite", "restructure", "revise", "redraft", "edit this")
EMPTY_ANSWER = "I need more information."


def normalize_answer(c: Column) -> Column:
    text = rx.chain_where(rx.text_or_empty(c), ("\r\n",), (r"\r\n", "\n"))
    return rx.trim_rare(rx.chain_where(text, ("\n\n\n",), (r"\n{3,}", "\n\n")))


def clean_structural_noise(c: Column) -> Column:
    text = rx.chain_where(normalize_answer(c), (":.",), (r":\.", ":"))
    text = rx.chain_where(text, ("/",), (r"-\s*/\s*", "- "))
    text = rx.chain_where(text, ("\n",), (r"\n\d+\.\s*\n", "\n"))
    # per line; the white space after the dashes may reach over line ends
    text = rx.chain_where(text, ("-",), (r"^-+\s*$", "", "m"))
    return rx.trim_rare(rx.chain_where(text, ("\n\n\n",), (r"\n{3,}", "\n\n")))


def unique_lines(c: Column) -> Column:
    """Keep the first of each line, compared trimmed and in lower case, anywhere in the text."""
    return dedupe_lines(c)


def cap_sentences(c: Column, limit: int = 10) -> Column:
    # white space is met less often than the look behind it is tried
    sentences = F.filter(F.split(c, rx.ecma(r"\s(?<=[.!?]\s)\s*+"), -1), lambda s: s != "")
    return rx.let(
        F.struct(c.alias("text"), sentences.alias("parts")),
        lambda x: F.when(F.size(x["parts"]) <= limit, x["text"]).otherwise(
            rx.trim(F.array_join(F.slice(x["parts"], 1, limit), " "))
        ),
    )


def format_output(df: DataFrame, answer: str, request: str, out: str = "formatted") -> DataFrame:
    """Normalise answers; leave missing-data answers, rewrites and structured answers whole, shorten the rest."""
    staged = df.withColumn("_norm", normalize_answer(F.col(answer)))
    low = F.lower(F.col("_norm"))
    keep = rx.contains_any(low, MISSING_ANSWER) | rx.contains_any(
        F.lower(rx.text_or_empty(request)), REWRITE_REQUEST
    )
    staged = staged.withColumn("_keep", keep).withColumn("_lines", unique_lines(clean_structural_noise(F.col("_norm"))))
    structured = rx.contains_any(F.lower(F.col("_lines")), [h.lower() for h in SECTION_HEADERS])
    result = (
        F.when(F.col("_norm") == "", F.lit(EMPTY_ANSWER))
        .when(F.col("_keep"), F.col("_norm"))
        .when(structured, F.col("_lines"))
        .otherwise(cap_sentences(F.col("_lines")))
    )
    return staged.withColumn(out, result).drop("_norm", "_keep", "_lines")


# --- lengths --------------------------------------------------------------------------------------------------------

PRIVATE_CONTEXT_CHARS = 18000
RETRIEVED_CONTEXT_CHARS = 22000


def truncate(c: Column, limit: int, marker: str = "") -> Column:
    text = rx.text_or_empty(c)
    if not marker:
        return F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def preview(c: Column, limit: int = 300) -> Column:
    return F.substring(rx.text_or_empty(c), 1, limit)
