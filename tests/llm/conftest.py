from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int, kinds: int = 200) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.randrange(kinds) // 20}" for _ in range(n))


#: Nulls, empty and blank texts, one word, other scripts, a long text, exact copies, copies in another case, repeated rows.
ROWS: list[tuple] = [
    (1, "The cat sat on the mat.", "en", "a", 23),
    (2, "the CAT sat on the mat.", "en", "a", 23),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", None, "b", 4),
    (6, "word", "en", None, 4),
    (7, "ÀÉ straße 北京 мир — “quotes” 😀 it's I'll we've", "fr", "c", None),
    (8, "The cat sat on the mat.", "en", "c", 23),
    (8, "The cat sat on the mat.", "en", "c", 23),
    (9, words(1, 6000), "en", "hot", 0),
    (10, words(1, 6000) + " changed end", "en", "hot", 0),
    (11, "line one is here\nline two is there\n\nline one is here", "en", "hot", 0),
    (12, "line one is here!\nline 2wo is there\nnothing alike 12345", "en", "hot", 0),
    (None, "no id at all", "en", "a", 12),
    *((100 + k, words(2, 80), "en", "hot", 0) for k in range(60)),
    *((200 + k, words(3, 60) + f" {words(50 + k, 3)}", "de", "hot", 0) for k in range(40)),
]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return ROWS


@pytest.fixture(scope="session")
def docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(docs: DataFrame) -> DataFrame:
    """Extra columns with the names that the operators use inside or give their results."""
    from pyspark.sql import functions as F

    names = ["size", "source_size", "target", "copies", "copy", "fp", "component_id", "lang_pred", "score", "id", "body", "digest", "salt", "keep_id", "block", "bucket", "leaf", "rep", "node", "component", "line", "Score", "data"]
    kept = [n for n in names if n.lower() not in {c.lower() for c in docs.columns}]
    out, seen = docs, set()
    for n in kept:
        if n.lower() not in seen:
            seen.add(n.lower())
            out = out.withColumn(n, F.lit(f"extra {n}"))
    return out


@pytest.fixture(scope="session")
def all_null(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None)], SCHEMA)
