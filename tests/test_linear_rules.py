"""Rules that never walk a text twice: the same matches as their plain patterns, and no quadratic time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sievework.functions import masking, rx, text

PLAIN_DATA = (r"(^|\n)\s*data:\s*", "", "i")
RULES = {f"{group}_{r.name}": r for group, rules in (("clinical", masking.CLINICAL), ("pii", masking.PII), ("leak", masking.LEAK_FIRST_PASS)) for r in rules}
PIECES = [
    "12", "7", "123456", "St", "Street", "street", "Ave.", "Dr", "Main", "5th", "_", ".", ",", "-", " ", " ", " ", "  ", "\n", "\t", " ",
    "(555)", "555", "1234", "5551234567", "+1", "1", "data:", "Data:", "a", "x@y.com", "Mr", "Jane", "[DONE]",
]


def random_texts(seed, n, longest=30):
    pick = random.Random(seed)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randrange(longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = random_texts(1, 6000) + ["", "12 Main St_", "_12 Main St", "1 a Street 2 Street", "12 Main St 5 St", "data:", "\n\ndata: data: x", " \n\n data:\n"]
    return spark.createDataFrame(list(enumerate(rows)), "i long, t string").repartition(8).cache()


@pytest.mark.parametrize("name", sorted(RULES))
def test_matches_equal_the_plain_pattern(texts, name):
    rule, c = RULES[name], F.col("t")
    pattern = rx.ecma(rule.pattern, rule.flags)
    found = texts.select("t", rule.apply(c).alias("a"), F.regexp_replace(c, pattern, rule.replacement).alias("b"),
                         rule.hits(c).alias("n"), F.regexp_count(c, F.lit(pattern)).alias("m"))
    bad = found.where("a <> b OR n <> m").limit(3).collect()
    assert not bad, bad


def test_data_prefix_equals_the_plain_pattern(texts):
    found = texts.select("t", text.strip_data_prefix(F.col("t")).alias("a"), rx.sub(F.col("t"), *PLAIN_DATA).alias("b"))
    bad = found.where("a <> b").limit(3).collect()
    assert not bad, bad


WORST = {
    "spaces": " " * 200_000,
    "lines": "\n" * 200_000,
    "numbers": "Elm Street " + "12 " * 60_000,
    "numbers and words": "12 Elm Street " + "12 elm " * 30_000,
    "dots": "Elm Street " + "1 a. " * 40_000,
    "signs and spaces": "1234 " + "+1 " + " " * 200_000,
    "digits": "1234" * 50_000,
    "local parts": "a." * 100_000 + "@",
}


@pytest.mark.parametrize("kind", sorted(WORST))
def test_worst_texts_take_little_time(spark, kind):
    df = spark.createDataFrame([(WORST[kind],)], "t string")
    df.select(F.length("t")).collect()
    clinical = tuple(r for r in masking.CLINICAL if r.name != "diagnosis")
    start = time.perf_counter()
    masked = df.select(
        F.length(masking.mask(F.col("t"), clinical)), F.length(masking.strip_sensitive(F.col("t"))), F.length(masking.mask_pii(F.col("t"))),
        F.length(text.strip_data_prefix(F.col("t"))), *[r.hits(F.col("t")) for r in (*clinical, *masking.LEAK_FIRST_PASS)],
    )
    masked.collect()
    # a quadratic rule takes minutes at this length
    assert time.perf_counter() - start < 20
