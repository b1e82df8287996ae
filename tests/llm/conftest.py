"""Fixtures for the corpus operators: a small odd table, and brute force over the driver's sf0.01 tables."""

import random

import pytest

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    words = "alpha beta gamma delta the of and to in is plum stone river cloud seven nine green table".split()
    long = " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(9000))
    rows = [(0, None, "en", "s", 0), (1, "", "en", "s", 0), (2, " \t\n ", None, None, 3), (3, "x", "fr", "s", 1),
            (4, "1234 !!", None, "s", 7), (5, long, "en", "s", len(long)), (6, "a" * 40000, "en", "s", 40000),
            (7, "é ü 𝄞𝄞 ß\x85z\x1cq İ", "de", "s", 9), (8, "é ü 𝄞𝄞 ß\x85z\x1cq İ", "de", "s", 9), (8, "é ü 𝄞𝄞 ß\x85z\x1cq İ", "de", "s", 9),
            (9, " " * 30000 + "end", "en", "s", 30003), (10, "<|endoftext|> it's we'll 'S 12 345", "en", "s", 30), (None, "a row without an id here", None, None, 5)]
    for i in range(20, 60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        rows.append((i, text, rng.choice(["en", "fr", None]), "s", len(text)))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    # extra columns whose names clash with the operators' own
    return spark.createDataFrame(odd_rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("score", "ids", "key", "id", "_id", "word", "block", "found", "held_out", "_text", "_keep")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
