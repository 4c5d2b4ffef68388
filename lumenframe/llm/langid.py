"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lumenframe.llm import spans
from lumenframe.llm.runtime import fresh, small_batches

ORDERS = (1, 2, 3)
#: Buckets of the hashed n-grams; fewer where there are so many languages that the matrix would pass MATRIX_CELLS.
BUCKETS = 1 << 16
#: Cells (four bytes each) of the matrix that is broadcast, at most: 64 MB.
MATRIX_CELLS = 1 << 24
SMOOTHING = 0.5
UNKNOWN = "und"
#: A prediction below this is a rejection in a filter.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Model:
    """languages, and weights[bucket, language] = log P(bucket | language); priors are logs too."""

    languages: tuple[str, ...]
    weights: np.ndarray
    priors: np.ndarray


def _grams(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed n-grams of the lower-cased texts, and the number of the text each is from, ascending."""
    low = [t.lower() for t in texts]
    doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(code) < n:
            return
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            x = h * np.uint64(0x9E3779B97F4A7C15)
            of = doc[: len(h)]
            whole = np.flatnonzero(of == doc[n - 1 :])
            yield ((x ^ (x >> np.uint64(32))) >> np.uint64(16)).astype(np.uint32)[whole] & np.uint32(buckets - 1), of[whole]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over every whole text that has a label; what reaches the driver is the names of the languages and at most
    languages x buckets sums. Any number of languages is learned, the more of them the fewer buckets: 65,536 up to 256
    languages, 1024 at 16,384; with many more the n-grams tell little apart, and the names must fit the driver.

    Rows with a null text or label teach nothing. With no labelled row the model knows no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    share = sorted(rows.groupBy("lang").count().collect())
    languages = tuple(r[0] for r in share)
    buckets = BUCKETS
    while buckets > 1 and buckets * len(languages) > MATRIX_CELLS:
        buckets //= 2
    number = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of this partition, as sparse rows at its end."""
        sums = np.zeros(len(languages) * buckets, np.int64)
        for batch in batches:
            langs = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for i, j, _, _ in spans.text_chunks(batch):
                own = langs[i:j] * buckets
                for h, of in _grams(batch.column(0).slice(i, j - i).to_pylist(), buckets):
                    sums += np.bincount(own[of] + h, minlength=len(sums))
        for i in range(0, len(sums), 1 << 16):
            at = np.flatnonzero(sums[i : i + (1 << 16)]) + i
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["cell", "n"])

    counts = np.zeros(len(languages) * buckets)
    table = rows.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    counts = counts.reshape(len(languages), buckets) + SMOOTHING
    weights = np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32) if languages else np.zeros((buckets, 0), np.float32)
    priors = np.log(np.array([r[1] for r in share], np.float64) / max(1, sum(r[1] for r in share)))
    return Model(languages, np.ascontiguousarray(weights), priors)


def score(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best language and its score for each text: the posterior with the evidence scaled by one over its root.

    Scaling keeps the order of the languages and leaves the score short of certainty where a text is short or mixed.
    """
    width = len(model.languages)
    total, grams = np.zeros((len(texts), width)), np.zeros(len(texts))
    step = max(1024, (1 << 22) // max(1, width))
    for h, of in _grams(texts, len(model.weights)):
        grams += np.bincount(of, minlength=len(texts))
        for i in range(0, len(h), step):
            own = of[i : i + step]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[first]] += np.add.reduceat(model.weights[h[i : i + step]], first, axis=0, dtype=np.float64)
    total = (total + model.priors) / np.sqrt(np.maximum(grams, 1))[:, None]
    total -= total.max(1, keepdims=True)
    total = np.exp(total)
    best = total.argmax(1)
    return best, total[np.arange(len(texts)), best] / total.sum(1)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (or, where docs has such names, with underscores before them).

    `und` with score 0 where the text is null, empty or has no letter, or where the model knows no language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    pred, value = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            raw, offsets = spans.flat(batch.column(at))
            for i, j in spans.chunks(offsets):
                part = batch.slice(i, j - i)
                texts = [t or "" for t in part.column(at).to_pylist()]
                able = np.array([bool(known.languages) and any(map(str.isalpha, t)) for t in texts])
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if able.any():
                    best, share = score([t for t, a in zip(texts, able) if a], known)
                    scores[able] = share
                    for k, b in zip(np.flatnonzero(able), best):
                        names[k] = known.languages[b]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], [*part.schema.names, pred, value])

    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(value, DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of documents that no model of op7 learns from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def accepted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs`, columns as they are, whose language is identified with a score of LEAST_SCORE or more."""
    found = identify(docs, train(docs, text_col, lang_col), text_col)
    pred, value = found.columns[-2:]
    return found.filter((F.col(pred) != UNKNOWN) & (F.col(value) >= LEAST_SCORE)).drop(pred, value)
