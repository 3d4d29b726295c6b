import random

import pytest

WORDS = "the of and river stone bridge under over light house mountain valley song winter summer paper market".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty, blank and long texts, repeated rows and ids, copies, and lines many share."""
    rng = random.Random(5)
    shared = "This very line stands in a great many documents."
    base = [(i, sentence(rng, rng.randint(3, 80)) + ("\n" + shared if i % 3 == 0 else ""), rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", None])) for i in range(60)]
    base += [(100 + i, base[4][1], "en", "b") for i in range(5)]
    base += [(110, base[4][1].upper(), "en", "a"), (111, "  \t" + shared.upper() + "\r\n\n" + shared, "de", "a")]
    base += [(200, None, None, None), (201, "", "en", "a"), (202, " \n\t", "en", "a"), (203, "123 456", "de", "a"), (None, shared, "en", "a"), (None, None, None, None)]
    base += [(300, sentence(rng, 30_000), "en", "a"), base[7], base[7], (9, "another text with the id nine", "en", "b"), (301, "ñandú É straße ａ " + shared, "de", "b")]
    return base


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with outputs and helpers."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({n: F.lit("mine") for n in ("score", "N_LINES", "fp", "component", "key", "n", "_row", "token", "feature", "spans", "id", "slot")})


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
