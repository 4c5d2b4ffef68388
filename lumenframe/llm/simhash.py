"""SimHash near-duplicates: fingerprints by numpy, neighbours by a vantage-point tree over Hamming distance.

Every text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints (one row each, however many copies) go
down a vantage-point tree that is built on the driver from a bounded sample; the tree only decides where work happens,
never which fingerprints are compared. A fingerprint is at home in one leaf. Where it lies within the radius of a node's
boundary it is also sent, as a visitor, to the other side, and a visitor goes on to every side that its ball touches. So by
the triangle inequality each pair within the radius meets in a leaf exactly where one of the two is at home. A leaf is
searched by a local vantage-point tree, and only a spanning forest of its links leaves it.

Cost: a level replicates the fingerprints that lie within the radius of its boundary, so total work grows a little faster
than the number of distinct fingerprints, by a factor of some 1.2 to 1.35 at each doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import spans
from lumenframe.llm.components import components, local_labels
from lumenframe.llm.runtime import checkpoint, small_batches

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Distinct fingerprints that the tree is built from, at most; they are the only ones the driver ever holds.
SAMPLE = 200_000
#: Distinct fingerprints that a leaf should have at home.
LEAF = 4_000
#: Sample points a leaf must have, so that its size is known well enough.
LEAST_POINTS = 10
#: Distinct fingerprints at home in one task, about; a leaf that no node divides has its tasks of so many, each with all others as visitors.
TILE = 16 * LEAF
#: Hashes unpacked to bits at once.
SLICE = 1 << 18
#: Near texts: words of a shingle; bits in which SimHashes of single words, and of shingles, may differ.
NEAR_SHINGLE, WORD_RADIUS, SHINGLE_BITS = 5, 8, 20
#: Near texts: tenths that the similarity of shingles must have, which is the least ratio of lengths too; bins of the sketch that estimates it.
TENTHS, BINS = 8, 256
RATIO = TENTHS / 10


def _shingle_hashes(raw: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, text after text, and the number of shingles of each text."""
    n = len(offsets) - 1
    start, end, doc = spans.words(raw, offsets)
    out, start, end = spans.spaced(spans.lower_ascii(raw), start, end)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    many = np.maximum(count - shingle + 1, (count > 0).astype(count.dtype))
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    of = np.repeat(np.arange(n), many)
    last = np.minimum(at + shingle, (first + count)[of]) - 1
    return spans.xxh64(out, start[at], end[last], seed), many


def _majority(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each text the bits that are 1 in over half of its hashes; hashes are unpacked a slice at a time, however long a text."""
    end = np.cumsum(many)
    start = end - many
    ones = np.zeros((len(many), 64), np.int32)
    for i in range(0, len(h), SLICE):
        part = h[i : i + SLICE]
        of = np.arange(np.searchsorted(end, i, "right"), np.searchsorted(start, i + len(part), "left"))
        of = of[many[of] > 0]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[of] += np.add.reduceat(bits, np.maximum(start[of] - i, 0), axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > many[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _least(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A row of BINS bytes for each text: from the least hash of its shingles in each bin, never 0; 0 where no shingle falls."""
    out = np.zeros((len(many), BINS), np.uint8)
    chunk = max(1, SLICE // BINS)
    edge = np.concatenate(([0], np.cumsum(many)))
    for i in range(0, len(many), chunk):
        part = h[edge[i] : edge[min(i + chunk, len(many))]]
        of = np.repeat(np.arange(len(many[i : i + chunk])), many[i : i + chunk])
        least = np.full(len(many[i : i + chunk]) * BINS, np.iinfo(np.uint64).max, np.uint64)
        cell = of * BINS + (part % np.uint64(BINS)).astype(np.int64)
        np.minimum.at(least, cell, part >> np.uint64(8))
        code = (least % np.uint64(255)).astype(np.uint8) + np.uint8(1)
        out[i : i + chunk] = np.where(least == np.iinfo(np.uint64).max, np.uint8(0), code).reshape(-1, BINS)
    return out


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints (uint64) of the texts of one flat array."""
    return _majority(*_shingle_hashes(raw, offsets, shingle, seed))


def sketches_of(raw: np.ndarray, offsets: np.ndarray, shingle: int = NEAR_SHINGLE, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(fp, hi, n, sig): SimHashes of single words and of shingles, the number of shingles, and the sketch of their set."""
    h, many = _shingle_hashes(raw, offsets, shingle, seed)
    return fingerprints_of(raw, offsets, 1, seed), _majority(h, many), many, _least(h, many)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text as a signed 64-bit number.

    A text with fewer words than a shingle is one shingle; a null, empty or wordless text has fingerprint 0. A repeated row
    gives a row again; an empty table gives none. Only the two named columns are read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, raw, at in spans.text_chunks(batch, "text"):
                fp = fingerprints_of(raw, at, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


class Node(NamedTuple):
    """A division of the tree by Hamming distance to `vantage`, or, where that is None, by size; a child < 0 is leaf -child - 1."""

    vantage: int | None
    mu: int
    inside: int
    outside: int


class Rule(NamedTuple):
    """When two distinct texts are linked: fingerprints within `radius` bits and, if `bits` is given, SimHashes of shingles within
    that many bits, the smaller size at least RATIO of the larger, and sketches alike by TENTHS."""

    radius: int = RADIUS
    bits: int | None = None

    @property
    def columns(self) -> list[str]:
        return ["fp"] if self.bits is None else ["fp", "hi", "n", "sig"]


def build_tree(fp: np.ndarray, size: np.ndarray | None, leaf_points: int, radius: int, seed: int = 7) -> tuple[list[Node], list[int]]:
    """Nodes, and the sample points of each leaf. A single leaf: no nodes. Of a dozen vantages and three sizes the narrowest boundary is taken."""
    rng = np.random.default_rng(seed)
    nodes: list[Node] = []
    leaves: list[int] = []

    def narrowest(points: np.ndarray) -> tuple | None:
        some = points if len(points) <= 4000 else rng.choice(points, 4000, replace=False)
        found = []
        for v in fp[rng.choice(some, min(12, len(some)), replace=False)]:
            seen = np.cumsum(np.bincount(np.bitwise_count(fp[some] ^ v), minlength=65)) / len(some)
            for mu in np.flatnonzero((seen >= 0.3) & (seen <= 0.7)):
                band = seen[min(64, mu + radius)] - (seen[mu - radius] if mu >= radius else 0)
                found.append((band, abs(seen[mu] - 0.5), int(v), int(mu)))
        for mu in [] if size is None else np.quantile(size[some], (0.4, 0.5, 0.6)).astype(np.int64):
            inside = (size[some] <= mu).mean()
            if 0.3 <= inside <= 0.7:
                band = ((size[some] >= RATIO * mu) & (size[some] * RATIO <= mu)).mean()
                found.append((band, abs(inside - 0.5), None, int(mu)))
        return min((x for x in found if x[0] < 0.8), key=lambda x: x[:2], default=None)

    def grow(points: np.ndarray) -> int:
        best = narrowest(points) if len(points) > leaf_points else None
        if best is None:
            leaves.append(len(points))
            return -len(leaves)
        here, (_, _, v, mu) = len(nodes), best
        nodes.append(Node(v, mu, 0, 0))
        inside = size[points] <= mu if v is None else np.bitwise_count(fp[points] ^ np.uint64(v)) <= mu
        left = grow(points[inside])
        nodes[here] = Node(v, mu, left, grow(points[~inside]))
        return here

    grow(np.arange(len(fp)))
    return nodes, leaves


def _descend(tree: list[Node], fp: np.ndarray, size: np.ndarray | None, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, numbers of fingerprints, at home) for all leaves that any fingerprint must be sent to."""
    todo = [(0 if tree else -1, np.arange(len(fp)), np.zeros(0, np.int64))]
    while todo:
        at, home, visit = todo.pop()
        if not len(home) and not len(visit):
            continue
        if at < 0:
            for rows, is_home in ((home, True), (visit, False)):
                if len(rows):
                    yield -at - 1, rows, is_home
            continue
        v, mu, inside, outside = tree[at]
        if v is None:
            d, e = size[home], size[visit]
            far, in_, out = d >= RATIO * mu, e * RATIO <= mu, e >= RATIO * mu
        else:
            d, e = (np.bitwise_count(fp[x] ^ np.uint64(v)).astype(np.int16) for x in (home, visit))
            far, in_, out = d > mu - radius, e <= mu + radius, e > mu - radius
        todo.append((inside, home[d <= mu], visit[in_]))
        todo.append((outside, home[d > mu], np.concatenate((home[(d <= mu) & far], visit[out]))))


def _tiled(found: Iterator[tuple[int, np.ndarray, bool]], key: np.ndarray, tiles: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Leaves cut into tiles: a fingerprint is at home in the tile of its key and visits those before it; a leaf's visitors visit all."""
    first = np.cumsum(tiles) - tiles
    for leaf, rows, home in found:
        of = key[rows] % tiles[leaf]
        for k in range(tiles[leaf]):
            if home and (of == k).any():
                yield int(first[leaf]) + k, rows[of == k], True
            others = rows[of > k] if home else rows
            if len(others):
                yield int(first[leaf]) + k, others, False


def leaf_links(home: np.ndarray, visit: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within the radius between two at home or one at home and a visitor, as positions in home + visit.

    A local tree prunes by the same bounds; where it no longer saves work, as inside a dense group, blocks are compared.
    """
    fp = np.concatenate((home, visit))
    todo = [(np.arange(len(home)), np.arange(len(home), len(fp)))]
    while todo:
        h, g = todo.pop()
        if not len(h) or len(h) + len(g) < 2:
            continue
        if len(h) > 256:
            v = fp[h[len(h) // 2]]
            d, e = (np.bitwise_count(fp[x] ^ v).astype(np.int16) for x in (h, g))
            mu = int(np.partition(d, len(d) // 2)[len(d) // 2])
            if (d <= mu).all():
                mu -= 1
            parts = [
                (h[d <= mu], g[e <= mu + radius]),
                (h[d > mu], np.concatenate((h[(d <= mu) & (d > mu - radius)], g[e > mu - radius]))),
            ]
            if sum(len(a) * (len(a) + len(b)) for a, b in parts) < 0.9 * len(h) * (len(h) + len(g)):
                todo += parts
                continue
        both = np.concatenate((h, g))
        step = max(1, (1 << 21) // len(both))
        for i in range(0, len(h), step):
            near = np.bitwise_count(fp[h[i : i + step], None] ^ fp[both][None, :]) <= radius
            a, b = np.nonzero(near)
            a, b = h[i + a], both[b]
            yield a[a != b], b[a != b]


def _alike(found: Iterator[tuple[np.ndarray, np.ndarray]], hi: np.ndarray, n: np.ndarray, sig: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of links by fingerprint those whose SimHashes of shingles, sizes and sketches agree too, the cheapest test first."""
    for a, b in found:
        good = np.bitwise_count(hi[a] ^ hi[b]) <= bits
        a, b = a[good], b[good]
        good = np.minimum(n[a], n[b]) >= RATIO * np.maximum(n[a], n[b])
        a, b = a[good], b[good]
        for i in range(0, len(a), SLICE // BINS * 16):
            x, y = a[i : i + SLICE // BINS * 16], b[i : i + SLICE // BINS * 16]
            s, t = sig[x], sig[y]
            some = (s | t) != 0
            good = ((s == t) & some).sum(1) * 10 >= TENTHS * some.sum(1)
            yield x[good], y[good]


def links(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF, bits: int | None = None, tile: int = TILE) -> DataFrame:
    """Edges (u, v) between the representatives of distinct fingerprints (fp, rep): enough to connect all within the radius.

    With `bits`, rows are (fp, hi, n, sig, rep) and links are those of Rule(radius, bits).
    """
    rule = Rule(radius, bits)
    sized = bits is not None
    total = distinct.count()
    share = min(1.0, 1.1 * sample / max(total, 1))
    points = distinct.select("fp", *(["n"] if sized else []))
    points = (points.sample(share, 11) if share < 1 else points).limit(sample).collect() if total > leaf else []
    points = np.array(sorted(tuple(r) for r in points), np.int64).reshape(len(points), 1 + sized)
    least = max(LEAST_POINTS, len(points) * leaf // max(total, 1))
    tree, held = build_tree(points[:, 0].copy().view(np.uint64), points[:, 1] if sized else None, least, radius)
    tiles = np.maximum(1, np.array(held) * (total / max(len(points), 1)) // tile).astype(np.int64)
    columns = rule.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            size = batch.column("n").to_numpy(zero_copy_only=False) if sized else None
            key = batch.column("rep").to_numpy(zero_copy_only=False)
            for at, rows, home in _tiled(_descend(tree, fp, size, radius), key, tiles):
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), at, np.int32)), *taken.columns, pa.array(np.full(len(rows), home))], ["leaf", *columns, "rep", "home"])

    def search(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        order = np.argsort(~home, kind="stable")
        fp = table.column("fp").to_numpy().view(np.uint64)[order]
        rep = table.column("rep").to_numpy()[order]
        cut = int(home.sum())
        found = leaf_links(fp[:cut], fp[cut:], radius)
        if sized:
            hi, n = table.column("hi").to_numpy().view(np.uint64)[order], table.column("n").to_numpy()[order]
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, BINS)[order]
            found = _alike(found, hi, n, sig, bits)
        label = local_labels(len(fp), found)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"u": rep[linked], "v": rep[label[linked]]})

    kinds = "".join(f", {c} {'binary' if c == 'sig' else 'bigint'}" for c in columns)
    sent = distinct.select(*columns, "rep").mapInArrow(assign, f"leaf int{kinds}, rep bigint, home boolean")
    return sent.groupBy("leaf").applyInArrow(search, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the least doc_id reachable over links of at most `radius` bits.

    doc_id must be an integer. Copies share a fingerprint and meet in a grouped minimum before any comparison, so a group of
    copies of any size is one point of the tree. Rows with a null doc_id get the component of their fingerprint where a row
    with an id shares it, else null, and link nothing by themselves. Repeated rows all return.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle).withColumn("doc_id", F.col("doc_id").cast("bigint")))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = components(links(distinct.filter("rep is not null"), radius))
    named = distinct.join(parts, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs`, columns as they are, without those that a component of near duplicates has beside its least doc_id.

    Rows with a null doc_id stay; rows repeated with one doc_id stay or go together.
    """
    return _without(docs, near_duplicates(docs, id_col, text_col, shingle, radius), id_col)


def _without(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, hi, n, sig) of each whole text: see sketches_of. A null, empty or wordless text has zeros; repeated rows all return."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, raw, at in spans.text_chunks(batch, "text"):
                fp, hi, n, sig = sketches_of(raw, at)
                found = [pa.array(fp.view(np.int64)), pa.array(hi.view(np.int64)), pa.array(n.astype(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *found], ["doc_id", "fp", "hi", "n", "sig"])

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, fp bigint, hi bigint, n bigint, sig binary")


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for each row: near texts by five-word shingles at a similarity of 0.8 or more.

    Two texts are linked when all of these agree: the 64-bit SimHashes of their words within WORD_RADIUS bits, which the
    vantage-point tree searches; the SimHashes of their five-word shingles within SHINGLE_BITS; the smaller number of
    shingles, repeats included, at least RATIO of the larger; and the Jaccard similarity of their sets of shingles at least
    TENTHS tenths, as estimated from the least shingle in each of BINS bins (nearly exact for texts of fewer shingles than
    bins, a deviation of 0.025 for long ones). SimHashes of single words move little when few words change, and lie apart
    unevenly, and sizes divide the tree too, so it prunes where it could not at the radius that longer shingles need.
    component_id is the least doc_id reachable. Rows with a null doc_id take the component of an equal row that has one, else
    null, and link nothing; texts without words are one component; repeated rows all return.
    """
    keys = ["fp", "hi", "n", "same"]
    prints = checkpoint(sketches(docs, id_col, text_col).withColumn("same", F.xxhash64("sig")))
    distinct = checkpoint(prints.groupBy(*keys, "sig").agg(F.min("doc_id").alias("rep")))
    parts = components(links(distinct.filter("rep is not null"), WORD_RADIUS, bits=SHINGLE_BITS))
    named = distinct.join(parts, F.col("rep") == F.col("node"), "left").select(*keys, F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", *keys).join(named, keys).select("doc_id", "component_id")


def without_near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, columns as they are, without those that a component of near texts has beside its least doc_id.

    Rows with a null doc_id stay; rows repeated with one doc_id stay or go together.
    """
    return _without(docs, near_texts(docs, id_col, text_col), id_col)


def hex16(fp: Column) -> Column:
    """A 64-bit number as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
