import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="session")
def spark():
    from tempest.session import local_session

    return local_session(cpus="8", shuffle_partitions=4, app="tempest-llm-tests")


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and white-space texts, ties, repeated rows, a long text."""
    rng = random.Random(3)
    base = words(rng, 60)
    near = " ".join(base.split()[:-1] + ["other"])
    shared = "This line is shared by many documents of the table"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"),
        (4, None, None, None), (5, "", "en", "a"), (6, " \n\t ", "de", "a"), (None, base, "en", "b"), (None, None, None, "b"),
        (7, shared + "\nown line of seven", "en", "c"), (8, "own\n  " + shared.upper() + " \n", "en", "c"),
        (9, shared + "\n" + shared + "\nend", "en", "c"), (10, words(rng, 4), "fr", None), (11, words(rng, 4000), "fr", "a"),
        (12, "x" * 20000, "fr", "a"), (13, "été çà 日本語 😀 \x00 %%% <|endoftext|>", "fr", "d"), (14, words(rng, 30), "en", "d"),
        (14, words(rng, 30), "en", "d"),
    ] + [(100 + i, words(rng, 40), "en", rng.choice("abcd")) for i in range(40)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def clashing(spark, odd_docs):
    """The odd documents with further columns named like columns that operators make."""
    from pyspark.sql import functions as F

    names = ["key", "size", "mark", "id", "doc", "payload", "terms", "u", "score", "token_ids", "mix_copies", "class_id", "runs", "pos"]
    return odd_docs.select("*", *[F.lit(f"mine-{n}").alias(n) for n in names])
