"""Masking rules as data, and the expressions that apply and count them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rx


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    replacement: str
    flags: str = ""
    # linear-time conditions without each of which the pattern cannot match; spares its backtracking on other rows
    needs: str | tuple[str, ...] = ()
    # literals one of which every match holds; looked for first, as this takes the least
    words: tuple[str, ...] = ()
    # (pattern, replacement) with the same matches that looks at each run of characters once; pattern stays the definition
    linear: tuple[str, str] | None = None

    def _possible(self, c: Column) -> Column | None:
        """Cheap conditions without which nothing matches, None if the rule has none."""
        tests = [rx.contains_any(c, self.words)] if self.words else []
        needs = (self.needs,) if isinstance(self.needs, str) else self.needs
        tests += [rx.found(c, need, self.flags) for need in needs]
        return reduce(Column.__and__, tests) if tests else None

    def replaced(self, c: Column) -> Column:
        """The text masked; right for any text, meant for those in which the rule matches."""
        return rx.sub(c, *(self.linear or (self.pattern, self.replacement)), self.flags)

    def apply(self, c: Column) -> Column:
        def where_possible(t: Column) -> Column:
            possible = self._possible(t)
            return self.replaced(t) if possible is None else F.when(possible, self.replaced(t)).otherwise(t)

        return rx.let(c, where_possible)

    def occurs(self, c: Column) -> Column:
        found = rx.found(c, self.linear[0] if self.linear else self.pattern, self.flags)
        possible = self._possible(c)
        return found if possible is None else possible & found

    def hits(self, c: Column) -> Column:
        pattern = self.linear[0] if self.linear else self.pattern
        matches = F.regexp_count(c, F.lit(rx.ecma(pattern, self.flags)))
        possible = self._possible(c)
        return matches if possible is None else F.when(possible, matches).otherwise(F.lit(0))


# what the house number of an address begins
NUMBER = r"\d\s"
# the end of every telephone number
PHONE_END = r"\d{3}[\s.-]?\d{4}"


@dataclass(frozen=True)
class StreetRule(Rule):
    """A rule whose match lies in one run of `inside` characters and ends in a street word.

    The text is cut into such runs and the rest. In each run only what stands before the end of its last street word is
    searched: there a house number finds a street word at once, so no number makes the engine walk the rest of the run in
    vain. A neighbouring underscore is lent to the run, as it decides whether a word ends. Runs without a digit before white
    space, which most are, are left alone.
    """

    inside: str = ""
    street: str = ""

    def _possible(self, c: Column) -> Column:
        return rx.found(c, NUMBER) & super()._possible(c)

    def _each(self, c: Column, use, unused) -> Column:
        """use(part, whole, reach) for every part that may match: whole is the part with what it was lent, reach its beginning
        up to the last street word, empty if there is none; unused(part) for the others."""
        parts = F.regexp_extract_all(c, F.lit(rx.ecma(f"[{self.inside}]++|[^{self.inside}]++")), F.lit(0))
        # anchored: where no street word is found, a search would begin anew at every character of the part
        last = rx.ecma(rf"\A.*\s(?:{self.street})(?!\w)", "is")

        def of_part(listed: Column, part: Column, i: Column) -> Column:
            fore = F.when(F.right(F.get(listed, i - 1), F.lit(1)) == "_", "_").otherwise("")
            aft = F.when(F.left(F.get(listed, i + 1), F.lit(1)) == "_", "_").otherwise("")
            whole = F.concat(F.when(i > 0, fore).otherwise(F.lit("")), part, aft)
            used = rx.let(whole, lambda w: rx.let(F.regexp_extract(w, last, 0), lambda reach: use(part, w, reach)))
            return F.when(rx.found(part, NUMBER), used).otherwise(unused(part))

        return rx.let(parts, lambda listed: F.transform(listed, lambda part, i: of_part(listed, part, i)))

    def replaced(self, c: Column) -> Column:
        def one(part: Column, whole: Column, reach: Column) -> Column:
            masked = F.concat(rx.sub(reach, self.pattern, self.replacement, self.flags), F.substring(whole, F.length(reach) + 1, F.length(whole)))
            # the underscores lent stand in no match
            start = F.when(F.left(whole, F.lit(1)) == "_", 1).otherwise(0)
            end = F.when(F.right(whole, F.lit(1)) == "_", 1).otherwise(0)
            kept = rx.let(masked, lambda m: F.substring(m, start + 1, F.length(m) - start - end))
            return F.when(reach == "", part).otherwise(kept)

        return F.array_join(self._each(c, one, lambda part: part), "")

    def hits(self, c: Column) -> Column:
        def one(part: Column, whole: Column, reach: Column) -> Column:
            return F.regexp_count(reach, F.lit(rx.ecma(self.pattern, self.flags)))

        counted = F.aggregate(self._each(c, one, lambda part: F.lit(0)), F.lit(0), lambda total, n: total + n)
        return F.when(self._possible(c), counted).otherwise(F.lit(0))


def _once(local: str, rest: str, mark: str) -> tuple[str, str]:
    """An address begins where no member of its class stands before, or where the last match ended."""
    return rf"(?:(?<!{local})|\G){local}++{rest}", mark


def _once_at_word(local: str, rest: str, mark: str) -> tuple[str, str]:
    """The same, beginning at a word's edge: signs of the class before the first word character stay as they are. Where a
    match ended there is such an edge already."""
    return rf"((?<!{local})[.%+-]*+\b|\G\b){local}++{rest}", "$1" + mark


# fixed values: patterns and marks, three rule sets that differ on purpose
CLINICAL = (
    Rule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL REDACTED]", words=("@",),
         linear=_once("[A-Za-z0-9._%+-]", r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL REDACTED]")),
    Rule("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE REDACTED]", needs=PHONE_END),
    StreetRule(
        "address",
        r"\b\d{1,5}\s+[A-Za-z0-9\s]+\s+(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln)\b",
        "[ADDRESS REDACTED]",
        "i",
        needs=r"\s(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln)\b",
        inside=r"A-Za-z0-9\s",
        street="Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln",
    ),
    Rule("clinician_abbreviated", r"\bDr\.\s+[A-Za-z]+\b", "Clinician", words=("Dr.",)),
    Rule("clinician", r"\bDoctor\s+[A-Za-z]+\b", "Clinician", "i", needs="doctor"),
    Rule("patient", r"\b(Patient|Pt|Mr|Ms|Mrs)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", "[PATIENT]", words=("Patient", "Pt", "Mr", "Ms")),
    Rule(
        "diagnosis",
        r"\b(\d{1,3})-year-old\s+(male|female)\s+diagnosed\s+with\s+[A-Za-z0-9\s-]+\b",
        "[PATIENT DIAGNOSIS REDACTED]",
        "i",
        needs="-year-old",
    ),
)

PII = (
    Rule("email", r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[REDACTED_EMAIL]", "i", words=("@",),
         linear=_once("[A-Z0-9._%+-]", r"@[A-Z0-9.-]+\.[A-Z]{2,}", "[REDACTED_EMAIL]")),
    Rule("phone", r"\b(\+?\d{1,2}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", "[REDACTED_PHONE]", needs=PHONE_END),
    Rule("name", r"\b(Dr\.?\s+[A-Z][a-z]+|Mr\.?\s+[A-Z][a-z]+|Ms\.?\s+[A-Z][a-z]+)\b", "[REDACTED_NAME]", words=("Dr", "Mr", "Ms")),
)

STREET = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Wy|Place|Pl"
LEAK_EMAIL = Rule(
    "email", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]", "i", words=("@",),
    linear=_once_at_word("[A-Z0-9._%+-]", r"@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]"),
)
LEAK_PHONE = Rule(
    "phone", r"\+?1?\s*\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", "[REDACTED_PHONE]", needs=PHONE_END,
    # what fails at the start of a run of white space fails inside it too
    linear=(r"(?!(?<=\s)\s)\+?1?\s*+\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", "[REDACTED_PHONE]"),
)
LEAK_PHONE_TEN = Rule("phone_ten", r"\b\d{10}\b", "[REDACTED_PHONE]", needs=r"\d{10}")
LEAK_ADDRESS = Rule(
    "address_short", rf"\b\d{{1,5}}\s+[A-Za-z]+\s+({STREET})\b", "[REDACTED_ADDRESS]", "i",
    needs=(NUMBER, rf"\s({STREET})\b"),
)
LEAK_FIRST_PASS = (
    LEAK_EMAIL,
    LEAK_PHONE,
    Rule("phone_split", r"\b\d{3}[\s.-]\d{3}[\s.-]\d{4}\b", "[REDACTED_PHONE]", needs=PHONE_END),
    LEAK_PHONE_TEN,
    LEAK_ADDRESS,
    Rule(
        "address_numbered",
        rf"\b\d{{1,5}}\s+\d{{1,3}}(?:st|nd|rd|th)\s+[A-Za-z]+\s+(?:{STREET})\b",
        "[REDACTED_ADDRESS]",
        "i",
        needs=(r"\d(?:st|nd|rd|th)\s", rf"\s({STREET})\b"),
    ),
    StreetRule(
        "address_long",
        rf"\b\d{{1,5}}\s+[A-Za-z0-9.\s]+?\s(?:{STREET})\b",
        "[REDACTED_ADDRESS]",
        "i",
        needs=rf"\s({STREET})\b",
        inside=r"A-Za-z0-9.\s",
        street=STREET,
    ),
    # nothing after the first redacted address is kept
    Rule("after_address", r"\[REDACTED_ADDRESS\].*", "[REDACTED_ADDRESS]", "is", words=("[",)),
)
LEAK_SECOND_PASS = (LEAK_EMAIL, LEAK_PHONE, LEAK_PHONE_TEN, LEAK_ADDRESS)
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
SSN_WORDS = r"(ssn|social security)"
BLOCKED = "[BLOCKED: SENSITIVE CONTENT]"


def mask(c: Column, rules: tuple[Rule, ...]) -> Column:
    for rule in rules:
        c = rule.apply(c)
    return c


def mask_clinical(c: Column) -> Column:
    return mask(c, CLINICAL)


def mask_pii(c: Column) -> Column:
    return mask(c, PII)


def count_hits(df: DataFrame, column: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Mask the column and add hits_<rule>: matches on the text as the earlier rules have left it."""
    for rule in rules:
        hits, text = F.col("hits_" + rule.name), F.col(column)
        df = df.withColumn("hits_" + rule.name, rule.hits(text))
        df = df.withColumn(column, F.when(hits > 0, rule.replaced(text)).otherwise(text))
    return df


def masking_report(df: DataFrame, column: str, group: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (group, rule, hits), summed before the shuffle."""
    counted = count_hits(df.select(group, column), column, rules)
    sums = counted.groupBy(group).agg(*[F.sum("hits_" + r.name).alias(r.name) for r in rules])
    return sums.unpivot([group], [r.name for r in rules], "rule", "hits")


def leak_scan(c: Column) -> Column:
    """Struct (sanitized, block, reason): a number with its word blocks and leaves the text as it is."""
    block = rx.found(c, SSN, "i") & rx.found(c, SSN_WORDS, "i")
    light = mask(c, (LEAK_EMAIL, LEAK_PHONE))
    return F.struct(
        F.when(block, c).otherwise(light).alias("sanitized"),
        block.alias("block"),
        F.when(block, F.lit("SSN detected")).otherwise(F.lit("redacted")).alias("reason"),
    )


def strip_sensitive(c: Column) -> Column:
    cleaned = mask(mask(c, LEAK_FIRST_PASS), LEAK_SECOND_PASS)
    return rx.let(cleaned, lambda t: F.when(rx.found(t, SSN), F.lit(BLOCKED)).otherwise(t))
