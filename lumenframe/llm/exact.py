"""Exact duplicates by skew-safe combining, with DataFrame functions alone.

Three combines, each comparing whole contents and not digests alone: within each input partition (the partial step of a
grouped aggregation), among the partitions that share a salt, and among the salt winners. A content held by a third of all
rows costs a partition one row after the first combine, and each salt one row after the second.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that the partitions are dealt into before the last combine.
SALTS = 16


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts without other bytes take the faster way to the same result."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(digest, mark, keep_id, group_size), one row for each distinct normalised text."""
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    rows = rows.select("id", "body", (F.spark_partition_id() % salts).alias("salt"), F.unhex(F.sha2("body", 256)).alias("digest"))
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole.select("digest", F.xxhash64("body").alias("mark"), "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row; texts are equal if identical after lower-casing A-Z.

    Of equal texts the row with the largest id stays. A null text counts as empty; rows with a null id lose to all others
    and stay only among themselves. Rows repeated with one id stay or go together, as they are one document. Only the two
    named columns are read; an empty table gives no rows.

    The rows find their group by two independent hashes of the content (256 and 64 bits), as the contents themselves were
    compared while combining; only then is a join, split by adaptive execution where one group is large.
    """
    body = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).select("doc_id", F.unhex(F.sha2("body", 256)).alias("digest"), F.xxhash64("body").alias("mark"))
    found = rows.join(winners(docs, id_col, text_col, salts), ["digest", "mark"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of `docs` that stay, all columns as they are."""
    ids = winners(docs, id_col, text_col, salts).select(F.col("keep_id").alias("__keep_id")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(F.col("__keep_id")), "left_semi")


ORACLE = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256 FROM d"""
