import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with the names operators use."""
    rows = [
        (1, "Plain text, with words.", "en"), (2, None, "en"), (3, "", None), (None, "no id here", None), (4, " \t\n ", "en"), (5, "12345 67", "de"),
        (6, "long " * 30_000, "en"), (7, "Plain text, with words.", "en"), (7, "Plain text, with words.", "en"), (8, "É日本語 ñandú", None), (None, None, None),
    ]
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], "doc_id long, text string, lang string, fp string, id int, spans int, key string, n int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


def by_id(df, id_col="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[id_col], []).append(r)
    return out
