"""Mixing sources to target weights: repetition rates from tokens per source, then whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.runtime import checkpoint, fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Words to share, as a multiple of all words there are.
SHARE = 1.5
#: A target is at most so many times its source's words.
CAP = 2.0
SEED = "mix-1"
#: Sources that are broadcast to the documents, at most (some 10 MB); beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered(df: DataFrame, column: str) -> DataFrame:
    """`df` with __rank, 0 for the first by ascending `column`, null last; no task sees more than its range of rows."""
    ordered = checkpoint(df.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("__part", F.spark_partition_id()))
    before = ordered.groupBy("__part").count().withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(column).asc_nulls_last())) - 1
    return ordered.withColumn("__within", within).join(F.broadcast(before.drop("count")), "__part").withColumn("__rank", F.col("__within") + F.col("__before")).drop("__part", "__within", "__before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: one aggregated row for each source, null being one.

    Sources by code point, null last, have the weights in turn. Words are shared by weight; what a capped source can't take
    goes to the others by weight. The level of a unit of weight is found by repeating one aggregate until it stands still.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    sources = checkpoint(numbered(sources, "source").withColumn("weight", turn))
    level = 0.0
    while True:
        capped = F.col("source_size") * F.lit(cap) < F.col("weight") * F.lit(level)
        words, taken, weight = sources.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not words or not weight:
            break
        now = (share * words - cap * (taken or 0)) / weight
        if now <= level:
            break
        level = now
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(cap)).alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: 48 bits of a digest."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with size, source_size, target and copies, and the names that these four have there (other than any of docs).

    copies = floor(rate) + 1 with probability rate - floor(rate), rate = target / source_size. A null text has size 0; null
    sources are one source, the last; a source without words has rate 0. Rows with equal ids draw alike, so reruns agree and
    a repeated row is repeated as often. The sources are broadcast where they are few, else joined by a shuffle that
    adaptive execution splits where a source is hot.
    """
    named = {n: fresh(docs.columns, n) for n in ("size", "source_size", "target", "copies")}
    sized = docs.withColumn(named["size"], word_count(F.col(text_col)))
    shares = targets(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    shares = shares.select(F.col("source").alias("__source"), F.col("source_size").alias(named["source_size"]), F.col("target").alias(named["target"]))
    if shares.count() <= BROADCAST_SOURCES:
        shares = F.broadcast(shares)
    joined = sized.join(shares, sized[source_col].eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col(named["source_size"]) > 0, F.least(F.col(named["target"]) / F.col(named["source_size"]), F.lit(CAP))).otherwise(0.0)
    copies = (F.floor(rate) + (draw(F.col(id_col), seed) < rate - F.floor(rate)).cast("bigint")).cast("bigint")
    return joined.withColumn(named["copies"], copies), named


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix: each row of `docs`, with its columns as they are, as many times as it is taken."""
    counted, named = with_copies(docs, id_col, text_col, source_col, seed)
    once = fresh(counted.columns, "copy")
    return counted.withColumn(once, F.explode(F.array_repeat(F.lit(0), F.col(named["copies"]).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, sum(source_size) OVER w - source_size AS before, sum(weight) OVER w - weight AS weight_before, sum(weight) OVER () AS weights, sum(source_size) OVER () AS words
FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max((1.5::DOUBLE * words - 2.0::DOUBLE * before) / (weights - weight_before)) AS level FROM c),
t AS (SELECT source, source_size, least(weight * level, source_size * 2.0::DOUBLE) AS target FROM s, l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r"""
