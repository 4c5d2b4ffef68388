"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of each text.

A paragraph ends with a line feed. Inside a paragraph, pieces end at words chosen by their own hash (one in eight), and
paragraphs are gathered into sections that end at a paragraph chosen by its hash (one in four); so an edit moves no
boundary but its own. Every byte is in exactly one piece. Equal roots mean equal texts; where roots differ, equal branches
are skipped and the differing pieces locate the edit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import spans
from lumenframe.llm.runtime import small_batches

#: One word in so many ends a piece.
PIECE_WORDS = 8
#: Documents of a bucket of neighbours, about, and buckets at most (their bounds are held by the driver).
BUCKET_DOCS, MOST_BUCKETS = 2000, 20_000


@dataclass(frozen=True)
class Tree:
    """root; sections of (hash, paragraphs of (hash, pieces of (hash, start, end))), hashes 16 bytes, places in UTF-8 bytes."""

    root: bytes
    sections: tuple

    def leaves(self) -> Iterator[tuple[bytes, int, int]]:
        for _, paragraphs in self.sections:
            for _, pieces in paragraphs:
                yield from pieces

    def fingerprint(self) -> str:
        """Root in full; then each section as hash[paragraphs], each paragraph as hash:pieces; hashes below the root are cut to 8 digits."""
        return self.root.hex() + "".join(f" {s.hex()[:8]}[" + ",".join(f"{p.hex()[:8]}:" + "".join(x[0].hex()[:8] for x in pieces) for p, pieces in paragraphs) + "]" for s, paragraphs in self.sections)


def _node(kind: bytes, parts: list[bytes]) -> bytes:
    return blake2b(kind + b"".join(parts), digest_size=16).digest()


def trees(texts: list[str]) -> list[Tree]:
    """The tree of each text; the cuts of all texts are found in one numpy pass."""
    bodies = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in bodies]))).astype(np.int64)
    data = b"".join(bodies)
    raw = np.frombuffer(data, np.uint8)
    start, end, _ = spans.words(raw, offsets)
    chosen = end[spans.Rolling(raw).spans(start, end) % np.uint64(PIECE_WORDS) == 0] if len(raw) else end
    lines = np.flatnonzero(raw == 10) + 1
    cuts = np.unique(np.concatenate((offsets, chosen, lines)))
    ends_line = np.isin(cuts, np.concatenate((lines, offsets)), assume_unique=False)
    at = np.searchsorted(cuts, offsets).tolist()
    places, closes = cuts.tolist(), ends_line.tolist()
    found = []
    for k in range(len(bodies)):
        base = places[at[k]]
        sections, paragraphs, pieces = [], [], []
        for c in range(at[k], at[k + 1]):
            a, b = places[c], places[c + 1]
            pieces.append((blake2b(data[a:b], digest_size=16, person=b"piece").digest(), a - base, b - base))
            if closes[c + 1]:
                mark = _node(b"paragraph", [x[0] for x in pieces])
                paragraphs.append((mark, tuple(pieces)))
                pieces = []
                if mark[0] % 4 == 0:
                    sections.append((_node(b"section", [x[0] for x in paragraphs]), tuple(paragraphs)))
                    paragraphs = []
        if paragraphs:
            sections.append((_node(b"section", [x[0] for x in paragraphs]), tuple(paragraphs)))
        found.append(Tree(_node(b"root", [x[0] for x in sections]), tuple(sections)))
    return found


def likeness(a: Tree, b: Tree) -> float:
    """Share of pieces that the two have in common (twice the common ones over all); 1 if and only if the roots are equal.

    It follows from the two fingerprints alone (see likeness_of): pieces are known by the 8 digits that these show. Pieces
    count as often as they occur. Different trees with the same pieces in another order come out just below 1. Two
    empty texts are equal; an empty and another text have 0.
    """
    if a.root == b.root:
        return 1.0
    return _share(Counter(x[0][:4] for x in a.leaves()), Counter(x[0][:4] for x in b.leaves()))


def likeness_of(a: str, b: str) -> float:
    """The likeness of two fingerprints, read from them."""
    if a.split(" ", 1)[0] == b.split(" ", 1)[0]:
        return 1.0
    cut = lambda x: Counter(p[i : i + 8] for p in re.findall(r":([0-9a-f]*)", x) for i in range(0, len(p), 8))
    return _share(cut(a), cut(b))


def _share(ones: Counter, twos: Counter) -> float:
    total = ones.total() + twos.total()
    common = sum(min(n, twos[k]) for k, n in ones.items() if k in twos)
    return min(2 * common / total, math.nextafter(1.0, 0.0)) if total else 1.0


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Byte ranges of `a` whose pieces `b` hasn't, found by going down differing branches only; neighbours are joined."""
    if a.root == b.root:
        return []
    sections = Counter(s for s, _ in b.sections)
    rest_a = []
    for s, paragraphs in a.sections:
        if sections[s] > 0:
            sections[s] -= 1
        else:
            rest_a += paragraphs
    rest_b = []
    for s, paragraphs in b.sections:
        if sections[s] > 0:
            sections[s] -= 1
            rest_b += paragraphs
    marks = Counter(p for p, _ in rest_b)
    pieces = Counter()
    left = []
    for p, own in rest_a:
        if marks[p] > 0:
            marks[p] -= 1
        else:
            left += own
    for p, own in rest_b:
        if marks[p] > 0:
            marks[p] -= 1
            pieces.update(x[0] for x in own)
    out: list[tuple[int, int]] = []
    for h, start, end in left:
        if pieces[h] > 0:
            pieces[h] -= 1
        elif out and out[-1][1] == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, root, fingerprint) of each row, in any order; a null text is empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                found = trees([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.root.hex() for t in found]), pa.array([t.fingerprint() for t in found])], ["doc_id", "root", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, root string, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, guest, doc_id, text), each partition sorted by them: walking a bucket meets each document, then the next.

    doc_id is numeric; null comes before all. Buckets are ranges of ids from approximate quantiles. The first document of a
    bucket is also a guest at the end of the bucket before it, that of the first at the end of the last. Texts are shuffled
    once. Rows with one id follow each other by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.select("doc_id").count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_DOCS))
    bounds = rows.select("doc_id").approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    bounds = np.unique(np.array(bounds, np.float64))

    @F.pandas_udf("int")  # type: ignore[call-overload]
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(-np.inf).to_numpy(np.float64), side="right").astype(np.int32))

    number = F.lit(0) if not len(bounds) else bucket("doc_id")
    first = sorted(rows.select("doc_id", number.alias("bucket")).groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("first")).collect())
    guests = spark.createDataFrame([(f.first.doc_id, first[k - 1].bucket) for k, f in enumerate(first)], "first_id bigint, host int")
    home = rows.withColumn("bucket", number).join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    seats = F.when(F.col("host").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")), F.struct(F.col("host").alias("b"), F.lit(True).alias("g")))
    )
    seated = home.select(F.explode(seats).alias("seat"), "doc_id", "text").select(F.col("seat.b").alias("bucket"), F.col("seat.g").alias("guest"), "doc_id", "text")
    return seated.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text")


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, its edited text and the next document compared by their trees (columns of the contract of op10).

    The next document is that of the next greater id, after the last the first; of rows with one id, the next by text. A
    null text is empty; a lone document is its own next.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Runs of a bucket's rows, each overlapping the next by one row."""
        run, size, last, done = [], 0, None, False
        for batch in batches:
            for b, guest, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b != last:
                    run, size, last, done = [], 0, b, False
                if done:
                    continue
                run.append((i, text))
                size += len(text)
                if guest or (size > spans.CHUNK_BYTES and len(run) > 1):
                    yield run
                    run, size, done = [(i, text)], len(text), guest

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in walk(batches):
            texts = [t for _, t in run]
            new = [edited(a, b) for a, b in zip(texts, texts[1:])]
            own, other = trees(texts), trees(new)
            out = [(i, len(t), sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), a.fingerprint(), x.fingerprint(), likeness(a, x), likeness(a, b)) for (i, t), e, a, x, b in zip(run, new, own, other, own[1:])]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return neighbours(docs, id_col, text_col).mapInArrow(compare, schema)
