"""Scores and fingerprints of contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx
from .text import STOP_WORDS, normalize_terms

# fixed values: words that show dense content, patterns that show specific content and what each adds
DENSE_WORDS = (
    "implemented", "managed", "supported", "led", "designed", "trained", "deployed", "analyzed", "clinical",
    "security", "infrastructure", "operations", "integration", "compliance", "workflow",
)
SPECIFIC_PATTERNS = (
    (r"\b\d+\b", 0.10),
    (r"\b\d+\+?\s*(year|yr)s?\b", 0.15),
    (r"\b(implemented|led|designed|managed|deployed|architected|owned|administered|built)\b", 0.20),
    (r"\b(certified|certification|cissp|security\+|aws|azure|epic|ccna|pmp)\b", 0.10),
)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def term_matches(content: Column, terms: Column) -> Column:
    low = F.lower(rx.text_or_empty(content))
    return rx.let(low, lambda text: F.size(F.filter(terms, lambda t: F.contains(text, t))))


def words(content: Column) -> Column:
    """Words in lower case, in order, with repeats."""
    return F.filter(F.split(F.lower(rx.text_or_empty(content)), rx.ecma(r"\s+"), -1), lambda w: w != "")


def density(word_list: Column) -> Column:
    return F.when(F.size(word_list) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(word_list)) / F.size(word_list))


def semantic_density(content: Column) -> Column:
    """Distinct words over words; 0 for an empty text."""
    return rx.let(words(content), density)


def word_set(content: Column) -> Column:
    return F.array_distinct(words(content))


def telling_words(word_set: Column) -> Column:
    """The words that count as shared: longer than four characters and no stop words."""
    return F.filter(word_set, lambda w: (F.length(w) > 4) & ~w.isin(*STOP_WORDS))


def semantic_overlap(a: Column, b: Column) -> Column:
    """Shared long words over the larger number of distinct words; a and b are word sets."""
    return F.size(telling_words(F.array_intersect(a, b))) / F.greatest(F.size(a), F.size(b), F.lit(1))


def concept_terms(content: Column) -> Column:
    tokens = F.split(normalize_terms(content), " ", -1)
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 5) & ~t.rlike(r"^[0-9]+\z")))


def shared_concept_ratio(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    )


def fingerprint(content: Column) -> Column:
    """The first, middle and last 120 characters in lower case with single spaces."""
    low = rx.sub(F.lower(rx.text_or_empty(content)), r"\s+", " ")
    return rx.let(
        low,
        lambda t: F.concat_ws(
            "|",
            F.substring(t, F.lit(1), F.lit(120)),
            F.substring(t, F.floor(F.length(t) / 2).cast("int") + 1, F.lit(120)),
            F.right(t, F.lit(120)),
        ),
    )


def synthetic_id(content: Column) -> Column:
    """A stand-in file name from the sum of the fingerprint's character codes; collides easily."""
    total = F.aggregate(F.split(fingerprint(content), ""), F.lit(0), lambda acc, ch: acc + F.ascii(ch))
    return F.concat(F.lit("ecosystem_"), total.cast("string"))


def specificity(content: Column) -> Column:
    def score(text: Column) -> Column:
        low = F.lower(text)
        total = F.when(F.length(text) > 250, 0.10).otherwise(0.0)
        for pattern, worth in SPECIFIC_PATTERNS:
            total = total + F.when(rx.found(low, pattern), worth).otherwise(0.0)
        return clamp(total, 0.0, 0.40)

    return rx.let(rx.text_or_empty(content), score)


def density_terms(content: Column) -> Column:
    return clamp(rx.count_present(F.lower(rx.text_or_empty(content)), DENSE_WORDS) * 0.02, 0.0, 0.20)


def directness(content: Column, intent: Column) -> Column:
    text = rx.text_or_empty(content)
    named = F.when((intent != "") & F.contains(F.lower(text), F.lower(intent)), 0.10).otherwise(0.0)
    short = F.when((F.length(text) > 0) & (F.length(text) < 400), 0.05).otherwise(0.0)
    return clamp(named + short, 0.0, 0.15)


def relationship(strength: Column, boost: Column, continuity: Column, count: Column) -> Column:
    zero = F.lit(0.0)
    total = (
        F.coalesce(strength, zero) * 0.04
        + F.coalesce(boost, zero) * 0.60
        + F.coalesce(continuity, zero)
        + F.least(F.coalesce(count, F.lit(0)) * 0.01, F.lit(0.04))
    )
    return clamp(total, 0.0, 0.15)
