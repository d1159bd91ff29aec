import pytest
from pyspark.sql import functions as F

# names the operators use inside, and some of the tables' own in other spelling
CLASHES = "k v fp own node root rep n found ids masked gone repeated count component_id least bucket tile grade t l key"


@pytest.fixture(scope="session")
def table(spark):
    """DataFrame of (doc_id, text) pairs with further columns of clashing names."""

    def make(pairs, clashes=True):
        df = spark.createDataFrame(list(pairs), "doc_id long, text string")
        return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES.split())]) if clashes else df

    return make


LONG = "word " * 60000 + "end"
ODD = [
    (1, None), (2, ""), (3, "   "), (4, LONG), (5, "same text here now"), (5, "same text here now"),
    (None, "no key at all"), (6, "\u0000 日本語 ▁ á 😀"), (7, "x"), (8, "\n\n"),
]


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD)


@pytest.fixture(scope="session")
def nothing(table):
    return table([])
