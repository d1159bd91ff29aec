"""Names, labels and files found in texts and rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx
from .text import normalize_content

# fixed values: words dropped from file names, words that rule a person out, the shape of a name
FILE_NAME_WORDS = r"\b(resume|cv|profile|candidate|bio)\b"
NO_PERSON = (
    "Playbook", "Guide", "Report", "Document", "Policy", "Procedure", "Plan", "Workflow", "System", "Strategy",
)
PERSON = r"\b[A-Z][a-z]+(?:\s[A-Z]\.)?\s[A-Z][a-z]+\b"
TWO_WORD_NAME = r"\b[A-Z][a-zA-Z'’-]+ [A-Z][a-zA-Z'’-]+\b"
RESUME_OWNER = r"\b([A-Za-z]+?)(?:['’]s|s)?\s+resume\b"


def _person(c: Column) -> Column:
    """The first name in the text if it can be a person's, else NULL."""
    name = F.regexp_extract(c, rx.ecma(PERSON), 0)
    words = F.split(name, " ", -1)
    banned = F.array(*[F.lit(w) for w in NO_PERSON])
    return F.when(F.size(words).between(2, 3) & ~F.arrays_overlap(words, banned), name)


def primary_entity(file_name: Column, text: Column) -> Column:
    """A person named by the file name, else by the first 300 characters; NULL without a file name."""
    base = rx.sub(file_name, r"\.[^/.]+$", "")
    cleaned = rx.collapse(rx.chain(base, (FILE_NAME_WORDS, "", "i"), (r"[-_()]", " ")))
    head = F.substring(rx.text_or_empty(text), 1, 300)
    return F.when(rx.text_or_empty(file_name) != "", F.coalesce(_person(cleaned), _person(head)))


def message_entity(c: Column) -> Column:
    return rx.first(rx.text_or_empty(c), TWO_WORD_NAME)


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 2147483647)))


def requested_token(c: Column) -> Column:
    """The word in front of "resume", capitalised."""
    word = rx.first(rx.text_or_empty(c), RESUME_OWNER, 1, "i")
    return _capitalised(word)


def name_from_context(context: Column, token: Column) -> Column:
    """The token and the word after it, as found in the context."""
    escaped = F.regexp_replace(token, r"[.*+?^${}()|\[\]\\]", r"\\$0")
    pattern = F.concat(
        F.lit("(?i)" + rx.BOUNDARY + "("), escaped, F.lit(rx.ecma(r"\s+[A-Z][a-z]+") + ")" + rx.BOUNDARY)
    )
    name = F.call_function("regexp_extract", rx.text_or_empty(context), pattern, F.lit(1))
    title = F.array_join(F.transform(F.split(name, " ", -1), _capitalised), " ")
    return F.when((rx.text_or_empty(token) != "") & (name != ""), F.trim(title))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def source_label(*columns: Column) -> Column:
    """Give source, file name, document name, document id and id in this order."""
    return F.coalesce(first_filled(*columns), F.lit("UNKNOWN_SOURCE"))


def evidence_entity(explicit: list[Column], label: Column) -> Column:
    """The first explicit entity field, else the source without extension, underscores and hyphens as spaces."""
    from_source = rx.chain(label, (r"\.[^/.]+$", ""), ("[_-]+", " "))
    return normalize_content(F.coalesce(first_filled(*explicit), from_source) if explicit else from_source)


def source_file(file_name: Column, text: Column, fallback: Column) -> Column:
    """The file name, else the SOURCE FILE line of the text, else the fallback."""
    line = F.trim(rx.trim(F.regexp_extract(rx.text_or_empty(text), rx.ecma(r"SOURCE FILE:\s*([^\n\r]+)", "i"), 1)))
    return F.coalesce(first_filled(file_name, line), fallback)
