"""Quality by weak supervision: overlapping heuristics vote, EM estimates how far each can be trusted, and the posterior labels
train a hashed linear scorer.

A document's votes are one number, its pattern; there are at most 3^9 patterns, so EM needs one grouped count of the whole
corpus and runs on that bounded table. The scorer is fitted on a bounded sample of documents; it scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import spans
from lumenframe.llm.runtime import small_batches

#: Documents that the scorer is fitted on, at most (chosen by a digest of the id).
SAMPLE = 6000
FEATURES = 1 << 16
EPOCHS, RATE, DECAY, SCALE = 40, 0.3, 1e-6, 20.0
EM_ROUNDS = 200
#: Documents scored below this are not kept.
KEEP = 0.4
LABELLERS = ("symbols", "capitals", "digits", "repeated_lines", "repeated_words", "word_length", "stutter", "sentence_ends", "length")
#: A value up to the first bound (or, for those with `False`, from it) is fine; from (up to) the second it is a bad vote.
BOUNDS = {
    "symbols": (0.01, 0.04, True),
    "capitals": (0.1, 0.25, True),
    "digits": (0.05, 0.2, True),
    "repeated_lines": (0.05, 0.25, True),
    "repeated_words": (0.09, 0.14, True),
    "word_length": (6.5, 9.0, True),
    "stutter": (0.03, 0.08, True),
    "sentence_ends": (0.95, 0.7, False),
    "length": (20.0, 4.0, False),
}
#: Labellers whose good votes say something; the others only name a defect.
SPEAK_FOR = ("sentence_ends", "length")
_POWERS = 3 ** np.arange(len(LABELLERS))


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of a value at each byte, the sum in each text."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return np.diff(total[offsets])


def measures(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What each labeller looks at, one row for each text; all are shares but for lengths. A text without words has zeros."""
    n = len(offsets) - 1
    letter = ((raw | 32) - np.uint8(97) < 26) | (raw >= 128)
    upper = raw - np.uint8(65) < 26
    digit = raw - np.uint8(48) < 10
    blank = spans.space_bytes(raw)
    symbol = ~(letter | digit | blank | np.isin(raw, np.frombuffer(b".,;:'\"()-", np.uint8)))
    seen = np.maximum(1, np.diff(offsets) - _sums(blank, offsets))
    start, end, doc = spans.words(raw, offsets)
    words = np.bincount(doc, minlength=n)
    rolling = spans.Rolling(raw)
    word_hash = rolling.spans(start, end)
    starts_line = np.zeros(len(raw) + 1, bool)
    starts_line[offsets] = True
    starts_line[np.flatnonzero(raw == 10) + 1] = True
    a = np.flatnonzero(starts_line)
    a, b = a[:-1], a[1:]
    of = np.searchsorted(offsets, a, side="right") - 1
    b = b - ((b > a) & (raw[np.maximum(b - 1, 0)] == 10))
    full = b > a
    a, b, of = a[full], b[full], of[full]
    lines = np.bincount(of, minlength=n)
    ends = np.bincount(of[np.isin(raw[b - 1], np.frombuffer(b".!?:;\"')", np.uint8))], minlength=n)

    def distinct(group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each text, the number of distinct values and the count of the commonest."""
        order = np.lexsort((h, group))
        g, x = group[order], h[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        at = np.flatnonzero(new)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, g[at], np.diff(np.append(at, len(g))))
        return np.bincount(g[at], minlength=n), most

    line_kinds, _ = distinct(of, rolling.spans(a, b))
    _, top = distinct(doc, word_hash)
    size = np.bincount(doc, (end - start), minlength=n)
    again = np.bincount(doc[1:][(word_hash[1:] == word_hash[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    some, rows = np.maximum(words, 1), np.maximum(lines, 1)
    return np.stack(
        [_sums(symbol, offsets) / seen, _sums(upper, offsets) / np.maximum(1, _sums(letter, offsets)), _sums(digit, offsets) / seen, 1 - line_kinds / rows, np.where(words >= 20, top / some, 0), size / some, again / some, ends / rows, words], 1
    )


def votes(values: np.ndarray) -> np.ndarray:
    """0 no vote, 1 bad, 2 good, for each text and labeller."""
    out = np.zeros(values.shape, np.int64)
    for k, name in enumerate(LABELLERS):
        good, bad, low = BOUNDS[name]
        x = values[:, k]
        wrong = x >= bad if low else x <= bad
        right = (x <= good if low else x >= good) & (name in SPEAK_FOR)
        out[:, k] = np.where(wrong, 1, np.where(right, 2, 0))
    return out


@dataclass(frozen=True)
class Trust:
    """prior of a good document; rate[labeller, class, vote] with class 0 bad, 1 good; posterior of each pattern."""

    prior: float
    rate: np.ndarray
    posterior: np.ndarray

    def accuracy(self) -> np.ndarray:
        """For each labeller how often its bad votes and its good votes are right, as estimated."""
        share = np.array([1 - self.prior, self.prior])[None, :, None] * self.rate
        return np.stack((share[:, 0, 1] / share[:, :, 1].sum(1), share[:, 1, 2] / share[:, :, 2].sum(1)), 1)


#: Rates of (no, bad, good) votes in bad and good documents to begin with, of labellers that speak for documents and of the
#: others, and how many documents they weigh.
FIRST = np.array([[[0.2, 0.3, 0.5], [0.18, 0.02, 0.8]] if name in SPEAK_FOR else [[0.7, 0.3, 0.0], [0.98, 0.02, 0.0]] for name in LABELLERS])
FIRST_WEIGHT = 20


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> Trust:
    """How the labellers vote on good and bad documents, from their agreement alone; FIRST names the two classes.

    A labeller that stays silent is evidence too, weak where it speaks of a rare defect.
    """
    cast = (patterns[:, None] // _POWERS) % 3
    prior, rate = 0.8, np.maximum(FIRST, 1e-4)
    for _ in range(rounds):
        p = _posterior(cast, prior, rate)
        weight = np.stack(((1 - p) * counts, p * counts), 1)
        said = np.stack([(weight[:, None, :] * (cast == v)[:, :, None]).sum(0) for v in range(3)], 2) + FIRST_WEIGHT * FIRST
        new = np.maximum(said / said.sum(2, keepdims=True), 1e-4)
        now = float(np.clip((weight[:, 1].sum() + 8) / (weight.sum() + 10), 0.05, 0.95))
        done = abs(now - prior) < 1e-9 and np.abs(new - rate).max() < 1e-9
        prior, rate = now, new
        if done:
            break
    every = np.arange(3 ** len(LABELLERS))
    return Trust(prior, rate, _posterior((every[:, None] // _POWERS) % 3, prior, rate))


def _posterior(cast: np.ndarray, prior: float, rate: np.ndarray) -> np.ndarray:
    """Probability that a document is good, given its votes."""
    odds = np.log(rate[:, 1] / rate[:, 0])
    return 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + odds[np.arange(cast.shape[1]), cast].sum(1))))


def features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features and the text of each: words (lower case; one that repeats the word before it is feature 0) and three-byte
    grams, in two halves of the space. A feature's value is SCALE times its share of the text's words or grams.
    """
    low = spans.lower_ascii(raw)
    start, end, doc = spans.words(low, offsets)
    half = FEATURES // 2
    whole_hash = spans.Rolling(low).spans(start, end)
    words = (whole_hash % np.uint64(half)).astype(np.int32)
    words[1:][(whole_hash[1:] == whole_hash[:-1]) & (doc[1:] == doc[:-1])] = 0
    if len(raw) < 3:
        return [(words, doc)]
    three = raw[:-2].astype(np.uint32) << 16 | raw[1:-1].astype(np.uint32) << 8 | raw[2:]
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = np.flatnonzero(of[:-2] == of[2:])
    grams = ((three[whole] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32) % half + half
    return [(words, doc), (grams, of[whole])]


def _margins(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """bias + for each half of the features the mean weight over the text."""
    n = len(offsets) - 1
    out = np.full(n, weights[-1])
    for h, of in features(raw, offsets):
        out += SCALE * np.bincount(of, weights[h], minlength=n) / np.maximum(1, np.bincount(of, minlength=n))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Logistic regression with soft targets by AdaGrad; a row is (features, values). The last weight is the bias."""
    weights, seen = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-6)
    if not rows:
        return weights
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            at = np.concatenate([rows[k][0] for k in batch])
            value = np.concatenate([rows[k][1] for k in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[k][0]) for k in batch])
            miss = 1 / (1 + np.exp(-(np.bincount(of, weights[at] * value, minlength=len(batch)) + weights[-1]))) - target[batch]
            grad = np.bincount(at, miss[of] * value, minlength=FEATURES + 1)
            grad[-1] = miss.sum()
            grad = grad / len(batch) + DECAY * weights
            seen += grad * grad
            weights -= RATE * grad / np.sqrt(seen)
    return weights


@dataclass(frozen=True)
class Model:
    trust: Trust
    weights: np.ndarray


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """EM over the votes on every document, then the scorer on at most `sample` documents. An empty table gives the priors."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, raw, at in spans.text_chunks(batch):
                sums += np.bincount(votes(measures(raw, at)) @ _POWERS, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["pattern", "n"])

    table = rows.select("text").mapInArrow(pattern, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    counts = table.column("n").to_numpy().astype(np.float64)
    trust = expectation_maximisation(table.column("pattern").to_numpy().astype(np.int64), counts)
    posterior = trust.posterior

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in spans.text_chunks(batch):
                label = posterior[votes(measures(raw, at)) @ _POWERS]
                n = len(at) - 1
                keys, values = [], []
                for h, of in features(raw, at):
                    cell, many = np.unique(of.astype(np.int64) * FEATURES + h, return_counts=True)
                    keys.append(cell)
                    values.append(SCALE * many / np.bincount(of, minlength=n)[cell // FEATURES])
                key, value = np.concatenate(keys), np.concatenate(values).astype(np.float32)
                order = np.argsort(key, kind="stable")
                cut = pa.array(np.searchsorted(key[order] // FEATURES, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label), pa.ListArray.from_arrays(cut, pa.array((key[order] % FEATURES).astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value[order]))], ["label", "at", "value"]
                )

    n = int(counts.sum())
    pick = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 0.9 * sample / max(1, n)))
    taken = rows.filter(pick if n > sample else F.lit(True)).select("text").mapInArrow(sparse, "label double, at array<int>, value array<float>").limit(sample).toArrow()
    at, value = taken.column("at").combine_chunks(), taken.column("value").combine_chunks()
    given = [(at[k].values.to_numpy(), value[k].values.to_numpy()) for k in range(len(at))]
    return Model(trust, fit(given, taken.column("label").to_numpy()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, votes_good, votes_bad, posterior, score, keep) of each row, repeated ones too.

    posterior is what the votes alone say, score what the scorer says; a text is kept if the mean of the two is at least
    KEEP. A null, empty or wordless text has what the votes on an empty text say, and is not kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for i, j, raw, at in spans.text_chunks(batch, "text"):
                values = measures(raw, at)
                cast = votes(values)
                p = known.trust.posterior[cast @ _POWERS]
                s = 1 / (1 + np.exp(-_margins(raw, at, known.weights)))
                keep = ((p + s) / 2 >= KEEP) & (values[:, -1] > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array((cast == 2).sum(1)), pa.array((cast == 1).sum(1)), pa.array(p), pa.array(s), pa.array(keep)], ["doc_id", "votes_good", "votes_bad", "posterior", "score", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, votes_good bigint, votes_bad bigint, posterior double, score double, keep boolean")
