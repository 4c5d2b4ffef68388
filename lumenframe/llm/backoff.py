"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to the n-grams of the documents, summed per document.

The relations are columnar, for a row of its own costs an n-gram three times its bytes: one row holds the sorted hashes and
counts of a slice, a range of hashes, in packed form (some six bytes for an n-gram). Documents are dealt into blocks by hash,
compressed. A block's distinct n-grams of all orders are its exploded side, one row for each slice; a slice adds up its rows,
which is the count table's part there, and gives each row the totals of its n-grams; joined back to their block they score
its documents. All counts cover the whole corpus.

Rows stay long at any size. A corpus that needs more than FAN slices gets them in levels: a block knows FAN slices only, FAN
blocks at a time meet in a slice, are added up there, and go on as one to the FAN slices inside it; totals come back the same
way. So rows are at most FAN for a block and level, in proportion to the input, and the levels follow its logarithm. An
n-gram costs each row at most one entry, however many texts hold it, so no word and no phrase is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import spans
from lumenframe.llm.runtime import FAN, MOST_TASKS, fanned, small_batches

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a block, about; what a worker holds at once follows it.
BLOCK_BYTES = 12 << 20
#: Bytes of text that a task gathers before it deals them to the blocks.
DEAL_BYTES = 32 << 20
#: N-grams of all blocks that a slice should have, about.
SLICE_GRAMS = 1_000_000
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each n up to `order` the hash of the n-gram that ends at each word (0 where the text has too few words before it),
    the text of each word, and the place of each word in its text. Words are those of the word rule, A-Z in lower case."""
    raw, offsets = spans.flat(texts)
    first, doc = [], []
    for i, j in spans.chunks(offsets):
        part = spans.lower_ascii(raw[offsets[i] : offsets[j]])
        start, end, of = spans.words(part, offsets[i : j + 1] - offsets[i])
        first.append(spans.xxh64(part, start, end, 42))
        doc.append((of + i).astype(np.int32))
    word, of = np.concatenate(first or [np.zeros(0, np.uint64)]), np.concatenate(doc or [np.zeros(0, np.int32)])
    place = np.arange(len(of)) - np.searchsorted(of, of)
    if not len(word):
        return [np.zeros(0, np.uint64)] * order, of, place.astype(np.int32)
    out, run = [], np.zeros(len(word), np.uint64)
    for n in range(order):
        if n:
            run[1:] = out_raw[:-1]
            run[0] = 0
        out_raw = spans.mix(run * _SEEDS[0] + word + np.uint64(int(_SEEDS[min(n, 4)]) * (n + 1) % 2**64))
        out.append(np.where(place >= n, out_raw | np.uint64(1), np.uint64(0)))
    return out, of, place.astype(np.int32)


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct hashes as differences, byte planes with the skewed high ones compressed, then the counts likewise."""
    step = np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    low, high = np.ascontiguousarray(step[:, :5].T).tobytes(), np.ascontiguousarray(step[:, 5:].T).tobytes()
    tail = high + pack_counts(counts)
    small = pa.compress(tail, "zstd", asbytes=True)
    return np.array([len(hashes), len(tail)], np.int64).tobytes() + low + small


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = (int(x) for x in np.frombuffer(data, np.int64, 2))
    step = np.zeros((n, 8), np.uint8)
    step[:, :5] = np.frombuffer(data, np.uint8, 5 * n, 16).reshape(5, n).T
    tail = pa.decompress(data[16 + 5 * n :], size, "zstd", asbytes=True)
    step[:, 5:] = np.frombuffer(tail, np.uint8, 3 * n).reshape(3, n).T
    return np.cumsum(step.view(np.uint64).ravel()), unpack_counts(tail[3 * n :], n)


def pack_counts(counts: np.ndarray) -> bytes:
    """Planes of eight bytes, lowest first; leading zero planes are left out."""
    planes = np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    used = int(np.flatnonzero(planes.any(1)).max(initial=0)) + 1
    return bytes([used]) + planes[:used].tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    planes[: data[0]] = np.frombuffer(data, np.uint8, data[0] * n, 1).reshape(data[0], n)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _own(of: np.ndarray, rank: np.ndarray, kinds: int) -> np.ndarray:
    """For each word how often its text has its n-gram."""
    key = of.astype(np.int64) * (kinds + 1) + rank
    _, back, many = np.unique(key, return_inverse=True, return_counts=True)
    return many[back]


def scores(total: list[np.ndarray], own: list[np.ndarray], place: np.ndarray, words: np.ndarray, factor: float = BACKOFF) -> np.ndarray:
    """log S of each word: total[n], own[n] are counts of the (n + 1)-gram ending there, in the corpus and in its own text.

    A text's own n-grams are taken off all counts, so each text is scored by the others. words: the words of the corpus
    outside the text, for each word. A word that no other text has counts as a half.
    """
    rest = [np.maximum(t - o, 0) for t, o in zip(total, own)]
    out = np.log(np.maximum(rest[0], 0.5) / np.maximum(words, 1))
    context = [np.concatenate(([0], r[:-1])) for r in rest]
    for n in range(1, len(total)):
        seen = (place >= n) & (rest[n] > 0)
        out = np.where(place >= n, np.where(seen, np.log(np.maximum(rest[n], 1) / np.maximum(context[n - 1], 1)), math.log(factor) + out), out)
    return out


def dealt_rows(rows: DataFrame, deal_bytes: int = DEAL_BYTES) -> DataFrame:
    """(block, ids, sizes, data) out of (block, doc_id, text): the documents that a task has for a block, their texts compressed."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            block = table.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            table = table.take(pa.array(order))
            block = block[order]
            cut = np.append(np.flatnonzero(np.diff(block, prepend=block[0] - 1)), len(block))
            ids = table.column("doc_id").combine_chunks()
            raw, at = spans.flat(table.column("text").combine_chunks())
            lists = pa.array(cut, pa.int32())
            data = [np.array([at[j] - at[i]], np.int64).tobytes() + (pa.compress(raw[at[i] : at[j]].tobytes(), "zstd", asbytes=True) if at[j] > at[i] else b"") for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), pa.ListArray.from_arrays(lists, ids), pa.ListArray.from_arrays(lists, pa.array(np.diff(at))), pa.array(data, pa.binary())], ["block", "ids", "sizes", "data"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > deal_bytes:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("block", "doc_id", "text").mapInArrow(deal, f"block bigint, ids array<{kind}>, sizes array<bigint>, data binary")


def gathered(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Ids and texts of a block's dealt rows."""
    ids = pa.concat_arrays([x.flatten() for x in table.column("ids").chunks])
    sizes = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table.column("sizes").chunks])
    texts = b"".join(pa.decompress(x[8:], int(np.frombuffer(x, np.int64, 1)[0]), "zstd", asbytes=True) if len(x) > 8 else b"" for x in table.column("data").to_pylist())
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return ids, pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at.tobytes()), pa.py_buffer(texts))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, factor: float = BACKOFF, block_bytes: int = BLOCK_BYTES, slice_grams: int = SLICE_GRAMS, most: int = FAN) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, n_full) of each row: the sum and mean of log S over its words, and how
    many words found their whole n-gram in other texts.

    S is the stupid-backoff score: the share of the context's occurrences that go on with the word, else `factor` times the
    score with a shorter context, at last the word's share of all words. The text's own occurrences are not counted. A null,
    empty or wordless text has 0 words, sum 0 and a null mean; repeated rows are two texts that see each other. Only the id
    and the text are read, so other columns clash with nothing. N-grams are known by 63-bit digests: of 10^12 different ones
    some 5 x 10^4 pairs share a count.

    The input must give the same rows whenever it is read, as tables and checkpoints do; where a block's n-grams differ between
    two reads the job ends with an error instead of wrong counts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, words = rows.agg(F.sum(F.octet_length("text").cast("bigint")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"))).first()
    blocks = max(1, -(-(size or 0) // block_bytes))
    levels, fan = fanned(order * (words or 0) // slice_grams, most)
    kind = docs.schema[id_col].dataType.simpleString()
    block = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.spark_partition_id()), F.lit(blocks))
    dealt = dealt_rows(rows.withColumn("block", block)).repartition(min(blocks, MOST_TASKS), "block")

    def ask(table: pa.Table) -> pa.Table:
        every, _, _ = grams(gathered(table)[1], order)
        out = Rows()
        for n, h in enumerate(every):
            kinds, count = np.unique(h[n:], return_counts=True)
            if len(kinds) and kinds[0] == 0:
                kinds, count = kinds[1:], count[1:]
            out.cut(kinds, count, 0, fan, fan, table.column("block")[0].as_py(), n)
        return out.table()

    def tell(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, body = gathered(texts)
        rows = len(ids)
        every, of, place = grams(body, order)
        told = in_order(answers, order)
        total, own = [], []
        for n, h in enumerate(every):
            kinds, rank = np.unique(h, return_inverse=True)
            counts = np.concatenate([np.zeros(int(len(kinds) > 0 and kinds[0] == 0), np.int64), *map(unpack_answer, told[n])])
            if len(counts) != len(kinds):
                raise RuntimeError("a block's rows changed between two reads of the documents: the input gives other rows each time it is read; checkpoint it")
            total.append(counts[rank])
            own.append(_own(of, rank, len(kinds)))
        lengths = np.bincount(of, minlength=rows)
        each = scores(total, own, place, (words or 0) - lengths[of], factor)
        sums = np.bincount(of, each, minlength=rows).astype(np.float64)
        full = np.bincount(of, (total[-1] - own[-1] > 0) & (place >= order - 1), minlength=rows).astype(np.int64)
        mean = pa.array(sums / np.maximum(lengths, 1), mask=lengths == 0)
        return pa.table({"doc_id": ids, "n_words": lengths, "log_score": sums, "mean_log_score": mean, "n_full": full})

    asked = dealt.groupBy("block").applyInArrow(ask, ROWS)
    answers = counted(asked, order, fan, levels, blocks).withColumnRenamed("source", "block").repartition(min(blocks, MOST_TASKS), "block")
    schema = f"doc_id {kind}, n_words bigint, log_score double, mean_log_score double, n_full bigint"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tell, schema)


ROWS = "slice bigint, source bigint, n int, data binary"


class Rows:
    """Rows of the count relations, as they are gathered."""

    def __init__(self) -> None:
        self.slice, self.source, self.n, self.data = [], [], [], []

    def put(self, number: int, source: int, n: int, data: bytes) -> None:
        self.slice.append(number)
        self.source.append(source)
        self.n.append(n)
        self.data.append(data)

    def cut(self, kinds: np.ndarray, count: np.ndarray, first: int, parts: int, of: int, source: int, n: int) -> None:
        """One row for each of `parts` slices from `first` on, of `of` in all, that has some of the sorted hashes."""
        bound = np.array([k * 2**64 // of for k in range(first + 1, first + parts)], np.uint64)
        at = np.concatenate(([0], np.searchsorted(kinds, bound), [len(kinds)]))
        for k in np.flatnonzero(np.diff(at)):
            self.put(first + int(k), source, n, pack(kinds[at[k] : at[k + 1]], count[at[k] : at[k + 1]]))

    def table(self) -> pa.Table:
        return pa.table({"slice": pa.array(self.slice, pa.int64()), "source": pa.array(self.source, pa.int64()), "n": pa.array(self.n, pa.int32()), "data": pa.array(self.data, pa.binary())})


def pack_answer(counts: np.ndarray) -> bytes:
    plain = pack_counts(counts)
    return np.array([len(counts), len(plain)], np.int64).tobytes() + pa.compress(plain, "zstd", asbytes=True)


def unpack_answer(data: bytes) -> np.ndarray:
    n, size = (int(x) for x in np.frombuffer(data, np.int64, 2))
    return unpack_counts(pa.decompress(data[16:], size, "zstd", asbytes=True), n)


def in_order(answers: pa.Table, order: int) -> list[list[bytes]]:
    """The answers of each n by slice."""
    told: list[list[tuple[int, bytes]]] = [[] for _ in range(order)]
    for s, n, data in zip(*(answers.column(c).to_pylist() for c in ("slice", "n", "data"))):
        told[n].append((s, data))
    return [[data for _, data in sorted(x)] for x in told]


def merged(table: pa.Table, order: int) -> list[tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """For each n the distinct hashes of the rows, their summed counts, and (row, place of each of its hashes among them)."""
    number = table.column("n").to_pylist()
    given = table.column("data").to_pylist()
    out = []
    for n in range(order):
        mine = [k for k, x in enumerate(number) if x == n]
        parts = [unpack(given[k]) for k in mine]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)])
        kinds, back = np.unique(hashes, return_inverse=True)
        sums = np.bincount(back, np.concatenate([np.zeros(0), *(c for _, c in parts)]), minlength=len(kinds)).astype(np.int64)
        ends = np.cumsum([len(h) for h, _ in parts]).tolist()
        out.append((kinds, sums, [(k, back[e - len(h) : e]) for k, e, (h, _) in zip(mine, ends, parts)]))
    return out


def counted(asked: DataFrame, order: int, fan: int, levels: int, sources: int, level: int = 1) -> DataFrame:
    """ROWS that answer the rows of `asked`, whose data are the total counts in the order of the hashes."""

    def answer(table: pa.Table) -> pa.Table:
        out = Rows()
        place = list(zip(table.column("slice").to_pylist(), table.column("source").to_pylist()))
        for n, (_, sums, back) in enumerate(merged(table, order)):
            for k, at in back:
                out.put(*place[k], n, pack_answer(sums[at]))
        return out.table()

    def onward(table: pa.Table) -> pa.Table:
        out = Rows()
        number, source = table.column("slice")[0].as_py(), table.column("source")[0].as_py() // fan
        for n, (kinds, sums, _) in enumerate(merged(table, order)):
            out.cut(kinds, sums, number * fan, fan, fan ** (level + 1), source, n)
        return out.table()

    def back(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = Rows()
        place = list(zip(table.column("slice").to_pylist(), table.column("source").to_pylist()))
        told = in_order(answers, order)
        for n, (_, _, rows) in enumerate(merged(table, order)):
            total = np.concatenate([np.zeros(0, np.int64), *map(unpack_answer, told[n])])
            for k, at in rows:
                out.put(*place[k], n, pack_answer(total[at]))
        return out.table()

    if level == levels:
        return asked.repartition(min(fan**levels, MOST_TASKS), "slice").groupBy("slice").applyInArrow(answer, ROWS)
    groups = -(-sources // fan)
    tasks = min(fan**level * groups, MOST_TASKS)
    parted = asked.withColumn("group", F.expr(f"source div {fan}")).repartition(tasks, "slice", "group")
    told = counted(parted.groupBy("slice", "group").applyInArrow(onward, ROWS), order, fan, levels, groups, level + 1)
    above = told.withColumn("parent", F.expr(f"slice div {fan}")).repartition(tasks, "parent", "source")
    return parted.groupBy("slice", "group").cogroup(above.groupBy("parent", "source")).applyInArrow(back, ROWS)


#: DuckDB SQL of score() over documents, its sums rounded to four digits.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
total AS (SELECT sum(len(w)) AS n FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT r, i, len(w) AS n, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM p),
k AS (
  SELECT r, i, n,
    count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY r, c) AS one,
    count(*) OVER (PARTITION BY i > 1, b, c) - count(*) OVER (PARTITION BY r, i > 1, b, c) AS two,
    count(*) OVER (PARTITION BY i > 2, a, b, c) - count(*) OVER (PARTITION BY r, i > 2, a, b, c) AS three
  FROM t),
x AS (SELECT *, lag(one) OVER (PARTITION BY r ORDER BY i) AS before_one, lag(two) OVER (PARTITION BY r ORDER BY i) AS before_two FROM k),
s1 AS (SELECT x.*, ln(greatest(one, 0.5) / greatest(total.n - x.n, 1)) AS s FROM x, total),
s2 AS (SELECT r, i, three, before_two, CASE WHEN i = 1 THEN s WHEN two > 0 THEN ln(two / greatest(before_one, 1)) ELSE ln(0.4) + s END AS s FROM s1),
s3 AS (SELECT r, CASE WHEN i <= 2 THEN s WHEN three > 0 THEN ln(three / greatest(before_two, 1)) ELSE ln(0.4) + s END AS s, i > 2 AND three > 0 AS whole FROM s2),
e AS (SELECT r, sum(s) AS s, sum(whole::BIGINT)::BIGINT AS whole FROM s3 GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / len(w), 4) AS mean_log_score, coalesce(whole, 0)::BIGINT AS n_full FROM d LEFT JOIN e USING (r)
"""
