"""Line dedup by a segment-partition edit join.

Two different lines are linked if at most EDITS insertions, deletions and replacements of characters turn one into the other,
and at most a fifth of the longer one's length. The shorter line of such a pair, cut into one segment more than edits are
allowed, has a segment that the longer one holds unchanged near its place; so each line is indexed by its segments and
probes with the few substrings that can meet a segment of a line of each possible length. Keys are dealt by hash in packed
form, so that a key held by many copies of a line costs each sender one entry. An entry carries a signature, how often its
line has the characters of each of 16 kinds: an edit moves two of these counts by one at most, so pairs whose signatures lie
further apart go where they meet. What is left is verified exactly by a banded bit-parallel edit distance. Classes are the
connected components of the links; of a class the first line stays.

A sender knows FAN buckets at most; more are reached in levels, so the rows sent grow with the input and not with its square.
A segment that very many different lines share is no task of its own: its lines are cut into blocks of TILE, and each block of
indexed lines meets each block of probing ones in a task that has the lines themselves, compares four signatures of each pair
and verifies the rest at once, so that only links leave it.

Long lines that differ by more than EDITS are not linked, though they may be alike by the share of their length; README gives
how many that are.

Cost: lines of like length that share a segment are compared by their signatures, each with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import spans
from lumenframe.llm.components import components
from lumenframe.llm.runtime import FAN, MOST_TASKS, checkpoint, fanned, small_batches

EDITS = 2
#: A pair may differ by one edit for each so many characters of the longer line.
CHARS_PER_EDIT = 5
#: Entries that a task gathers before it sends them on, and entries a bucket should have, about.
FLUSH, BUCKET_ENTRIES = 1_500_000, 1_500_000
#: Lines in a block of a segment that many share: a key goes to tiles where it asks for more than TILE x TILE comparisons.
TILE = 4096
_END = 0xFFFFFFFF
#: Multipliers by which characters are put into 16 kinds; entries carry the first signature.
_KINDS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]


def allowed(length: np.ndarray | int, edits: int = EDITS):
    """Edits that a pair may differ by whose longer line has this many characters."""
    return np.minimum(edits, length // CHARS_PER_EDIT)


def entries(code: np.ndarray, start: np.ndarray, length: np.ndarray, edits: int = EDITS) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, numbers of lines, probing) of the lines code[start : start + length]: index segments, and substrings that probe."""
    rolling = spans.Rolling(code)
    every = np.arange(len(start))

    def segments(size: np.ndarray) -> np.ndarray:
        """Segments of an indexed line of `size`: one more than the edits of its longest partner; 0 if it has no partner but itself."""
        most = allowed(size + edits, edits)
        return np.where((most > 0) & (size > most), most + 1, 0)

    def place(size: np.ndarray, parts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of segment k of lines of `size` in `parts` even segments, the longer ones last."""
        base, longer = size // parts, size % parts
        short = parts - longer
        return k * base + np.maximum(0, k - short), base + (k >= short)

    def key(at: np.ndarray, upto: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
        return spans.mix(rolling.spans(at, upto, 0) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0x632BE59BD9B4E019 % 2**64))

    parts = segments(length)
    for k in range(edits + 1):
        own = every[parts > k]
        if len(own):
            p, n = place(length[own], parts[own], k)
            yield key(start[own] + p, start[own] + p + n, length[own], k), own, False
    for shorter in range(edits + 1):
        size = length - shorter
        parts = np.where((shorter <= allowed(length, edits)) & (allowed(length, edits) > 0) & (size > 0), segments(np.maximum(size, 0)), 0)
        for k in range(edits + 1):
            own = every[parts > k]
            if not len(own):
                continue
            tau = parts[own] - 1
            p, n = place(size[own], parts[own], k)
            low = np.maximum(0, np.maximum(p - k, p + shorter - (tau - k)))
            high = np.minimum(length[own] - n, np.minimum(p + k, p + shorter + (tau - k)))
            for step in range(int((high - low).max(initial=-1)) + 1):
                fit = low + step <= high
                at = start[own[fit]] + low[fit] + step
                yield key(at, at + n[fit], size[own[fit]], k), own[fit], True


def signatures(code: np.ndarray, start: np.ndarray, length: np.ndarray, by: np.uint32 = _KINDS[0]) -> np.ndarray:
    """Counts, modulo 4, of the characters of 16 kinds in each line, two bits for each kind."""
    n = len(start)
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    kind = (code[at] * by) >> np.uint32(28)
    count = np.bincount(np.repeat(np.arange(n), length) * 16 + kind, minlength=16 * n).reshape(n, 16) & 3
    return (count.astype(np.uint32) << np.arange(0, 32, 2, dtype=np.uint32)).sum(1, dtype=np.uint32)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the kinds of how far two signatures' counts are apart; at most twice the edits between the lines."""
    high, low = np.uint32(0xAAAAAAAA), np.uint32(0x55555555)
    gap = ((a | high) - (b & low)) ^ ((a ^ ~b) & high)
    odd, two = gap & low, (gap >> np.uint32(1)) & low
    return np.bitwise_count(odd) + 2 * np.bitwise_count(two & ~odd)


def distances(pairs: list[tuple[str, str]], most: int = EDITS) -> np.ndarray:
    """Edit distance of each pair, exact up to `most`, greater than `most` where it is greater.

    What both have at their ends is cut off; the rest goes through Hyyrö's banded form of the bit-parallel column step, all
    pairs side by side, the longest first so that those that are done drop off.
    """
    out = np.zeros(len(pairs), np.int64)
    left: list[tuple[int, np.ndarray, np.ndarray]] = []
    for k, (a, b) in enumerate(pairs):
        x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
        if len(x) < len(y):
            x, y = y, x
        if len(x) - len(y) > most:
            out[k] = most + 1
            continue
        apart = np.flatnonzero(x[: len(y)] != y)
        head = int(apart[0]) if len(apart) else len(y)
        x, y = x[head:], y[head:]
        if len(y):
            apart = np.flatnonzero(x[len(x) - len(y) :] != y)
            tail = len(y) - 1 - int(apart[-1]) if len(apart) else len(y)
            x, y = x[: len(x) - tail], y[: len(y) - tail]
        if not len(y):
            out[k] = len(x)
        elif len(x) <= most:
            row = list(range(len(y) + 1))
            for i, c in enumerate(x.tolist(), 1):
                row, old = [i], row
                for j, d in enumerate(y.tolist(), 1):
                    row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
            out[k] = row[-1]
        else:
            left.append((k, x, y))
    left.sort(key=lambda r: -len(r[2]))
    for i in range(0, len(left), 4096):
        part = left[i : i + 4096]
        out[[r[0] for r in part]] = _banded([r[1] for r in part], [r[2] for r in part], most)
    return out


def _banded(xs: list[np.ndarray], ys: list[np.ndarray], k: int) -> np.ndarray:
    """Distances of xs[i] (not shorter, longer than k) to ys[i]; ys by falling length. Bit b of column i is xs[i - k + b]."""
    width = 2 * k + 1
    m, n = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    pattern = np.concatenate([np.concatenate((np.full(k, _END, np.uint32), x, np.full(width, _END, np.uint32))) for x in xs])
    text = np.concatenate(ys)
    at_x, at_y = np.cumsum(m + k + width) - (m + k + width), np.cumsum(n) - n
    full = np.int64((1 << width) - 1)
    vp, vn = np.full(len(xs), full ^ ((1 << k) - 1)), np.zeros(len(xs), np.int64)
    dist = np.full(len(xs), k, np.int64)
    for i in range(int(n[0])):
        live = int(np.searchsorted(-n, -i, side="left"))
        p, v, c = vp[:live], vn[:live], text[at_y[:live] + i]
        match = np.zeros(live, np.int64)
        for b in range(width):
            match |= (pattern[at_x[:live] + np.minimum(i + b, m[:live] + k + width - 1)] == c).astype(np.int64) << b
        d0 = ((((match & p) + p) ^ p) | match | v) & full
        hp = (v | ~(d0 | p)) & full
        hn = d0 & p
        bit = np.maximum(0, width - 1 - (i + k - (m[:live] - 1)))
        dist[:live] += np.where(i < m[:live] - k, 1 - ((d0 >> (width - 1)) & 1), ((hp >> bit) & 1) - ((hn >> bit) & 1))
        d0 >>= 1
        vp[:live] = (hn | ~(d0 | hp)) & full
        vn[:live] = d0 & hp
    return dist


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_id, line_no, line): the lines that are not blank, numbered from 0 in the whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = rows.select("doc_id", _text_id(F.col("text")).alias("text_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _text_id(text: Column) -> Column:
    """Tells texts of one doc_id apart; nulls and empty texts are one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _line_id(line: Column) -> Column:
    return F.xxhash64(line)


def _second_id(line: Column) -> Column:
    """A digest that is independent of the first, so that both are 128 bits."""
    return F.xxhash64(F.lit(1), line)


def chunk_lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and ends of the different lines of a chunk of texts; blank ones are left out."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    edge[np.flatnonzero(raw == 10) + 1] = True
    start = np.flatnonzero(edge)
    start, end = start[:-1], start[1:]
    end = end - ((end > start) & (raw[np.maximum(end - 1, 0)] == 10)) if len(raw) else end
    solid = np.concatenate(([0], np.cumsum(~spans.space_bytes(raw))))
    full = solid[end] > solid[start]
    start, end = start[full], end[full]
    line, first = np.unique(spans.xxh64(raw, start, end, 42), return_index=True)
    return line, start[first], end[first]


def line_bodies(texts: DataFrame) -> DataFrame:
    """(id, line): the different lines of each chunk of texts, so that a line held by a third of all texts is one row a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in spans.text_chunks(batch):
                line, start, end = chunk_lines(raw, offsets)
                if len(line):
                    body = raw.tobytes()
                    made = pa.array([body[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(line.view(np.int64)), made], ["id", "line"])

    return texts.select("text").mapInArrow(run, "id bigint, line string")


def cut(key: np.ndarray, line: np.ndarray, sign: np.ndarray, first: int, parts: int, of: int) -> pa.RecordBatch:
    """The entries, sorted by key, as one packed row for each of `parts` buckets from `first` on, of `of` in all, that has some."""
    order = np.argsort(key)
    key, line, sign = key[order], line[order], sign[order]
    at = np.searchsorted(key, np.array([k * 2**64 // of for k in range(first + 1, first + parts)], np.uint64))
    at = np.concatenate(([0], at, [len(key)]))
    some = np.flatnonzero(np.diff(at))
    data = [b"".join(x[at[k] : at[k + 1]].tobytes() for x in (key, line, sign)) for k in some]
    return pa.RecordBatch.from_arrays([pa.array(some + first, pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, lines and signatures of packed rows."""
    parts = [(x, len(x) // 20) for x in rows]
    return (
        np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64, n) for x, n in parts)]),
        np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64, n, 8 * n) for x, n in parts)]),
        np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32, n, 16 * n) for x, n in parts)]),
    )


def onward(rows: DataFrame, fan: int, of: int, entries: int) -> DataFrame:
    """(bucket, data) of the next level: each bucket's rows are gathered up to FLUSH entries and cut into its `fan` buckets."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last, size = None, 0
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (bucket != last or size > FLUSH):
                    yield cut(*unpacked(held), last * fan, fan, of)
                    held, size = [], 0
                last = bucket
                held.append(data)
                size += len(data) // 20
        if held:
            yield cut(*unpacked(held), last * fan, fan, of)

    salts = max(1, entries * fan // of // FLUSH)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(salts)))
    dealt = salted.repartition(min(MOST_TASKS, max(1, entries // FLUSH)), "bucket", "salt").sortWithinPartitions("bucket")
    return dealt.select("bucket", "data").mapInArrow(split, "bucket bigint, data binary")


def meeting(rows: list[bytes], edits: int, tile: int) -> tuple[np.ndarray, list[tuple[int, int, int, int, list[int]]]]:
    """Pairs of lines (n, 2) of a bucket that share a key and have signatures near enough; and of keys that ask for more
    than tile x tile comparisons the blocks of lines: (key, side, number, blocks of the other side, lines)."""
    key, line, sign = unpacked(rows)
    order = np.argsort(key, kind="stable")
    key, line, sign = key[order], line[order], sign[order]
    group = key >> np.uint64(1)
    new = np.ones(len(key), bool)
    new[1:] = group[1:] != group[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(key)))
    both = ((key[at] & np.uint64(1)) == 0) & ((key[at + size - 1] & np.uint64(1)) == 1) & (size > 1)
    keep = np.repeat(both, size)
    key, line, sign = key[keep], line[keep], sign[keep]
    order = np.lexsort((line, key))
    key, line, sign = key[order], line[order], sign[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line, sign = key[fresh], line[fresh], sign[fresh]
    probe = (key & np.uint64(1)) == 1
    held, asked = key[~probe] >> np.uint64(1), key[probe] >> np.uint64(1)
    index_line, probe_line, index_sign, probe_sign = line[~probe], line[probe], sign[~probe], sign[probe]
    low, high = np.searchsorted(held, asked), np.searchsorted(held, asked, side="right")
    first, last = np.searchsorted(asked, asked), np.searchsorted(asked, asked, side="right")
    many = high - low
    hot = many * (last - first) > tile * tile
    blocks = []
    for k in np.flatnonzero(hot & (first == np.arange(len(asked)))):
        sides = index_line[low[k] : high[k]], probe_line[first[k] : last[k]]
        parts = [-(-len(x) // tile) for x in sides]
        for side, own in enumerate(sides):
            blocks += [(int(asked[k]), side, n, parts[1 - side], own[n * tile : (n + 1) * tile].view(np.int64).tolist()) for n in range(parts[side])]
    cold = ~hot
    low, many, probe_line, probe_sign = low[cold], many[cold], probe_line[cold], probe_sign[cold]
    pairs = np.zeros((0, 2), np.int64)
    total = np.concatenate(([0], np.cumsum(many)))
    i = 0
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(total, total[i] + 2_000_000, side="right")) - 1)
        k = np.repeat(low[i:j] - (total[i:j] - total[i]), many[i:j]) + np.arange(total[j] - total[i])
        near = apart(index_sign[k], np.repeat(probe_sign[i:j], many[i:j])) <= 2 * edits
        a, b = index_line[k[near]].view(np.int64), np.repeat(probe_line[i:j], many[i:j])[near].view(np.int64)
        other = a != b
        got = np.stack((np.minimum(a, b)[other], np.maximum(a, b)[other]), 1)
        pairs = np.unique(np.concatenate((pairs, got)), axis=0) if len(got) else pairs
        i = j
    return pairs, blocks


def near_pairs(left: list[str], right: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of the lines left[i], right[j] that are linked, all pairs compared: signatures first, then distances."""
    signs = []
    for own in (left, right):
        size = np.array([len(x) for x in own], np.int64)
        code = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        signs.append([signatures(code, np.cumsum(size) - size, size, by) for by in _KINDS])
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, (1 << 18) // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = np.nonzero(apart(signs[0][0][at : at + step, None], signs[1][0][None, :]) <= 2 * edits)
        i += at
        for a, b in zip(signs[0][1:], signs[1][1:]):
            near = apart(a[i], b[j]) <= 2 * edits
            i, j = i[near], j[near]
        if len(i):
            far = distances([(left[x], right[y]) for x, y in zip(i.tolist(), j.tolist())], edits)
            near = far <= allowed(np.array([max(len(left[x]), len(right[y])) for x, y in zip(i.tolist(), j.tolist())], np.int64), edits)
            found.append((i[near], j[near]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, bucket_entries: int = BUCKET_ENTRIES, fan_most: int = FAN, tile: int = TILE) -> DataFrame:
    """(a, b), a < b, the ids (64-bit digests) of each two different lines that are linked.

    Of two lines with one digest the lesser speaks for both; the distance of a link is that of the lines themselves.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    number = texts.agg(F.sum((F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1).cast("bigint"))).first()[0] or 0
    total = number * (edits + 1) * (edits + 3)
    levels, fan = fanned(total // bucket_entries, fan_most)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        signs: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            out = cut(np.concatenate(keys), np.concatenate(ids), np.concatenate(signs), 0, fan, fan)
            keys.clear()
            ids.clear()
            signs.clear()
            return out

        for batch in batches:
            for _, _, raw, offsets in spans.text_chunks(batch):
                line, start, end = chunk_lines(raw, offsets)
                if not len(line):
                    continue
                lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                code = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
                sign = signatures(code, lead[start], lead[end] - lead[start])
                for key, own, probing in entries(code, lead[start], lead[end] - lead[start], edits):
                    keys.append(key & ~np.uint64(1) | np.uint64(probing))
                    ids.append(line[own])
                    signs.append(sign[own])
                if sum(map(len, keys)) > FLUSH:
                    yield flush()
        if keys:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        pairs, blocks = meeting(table.column("data").to_pylist(), edits, tile)
        few, many = len(blocks), len(pairs)
        nothing = lambda n, kind: pa.nulls(n, kind)
        return pa.table(
            {
                "a": pa.chunked_array([pa.array(pairs[:, 0]), nothing(few, pa.int64())]),
                "b": pa.chunked_array([pa.array(pairs[:, 1]), nothing(few, pa.int64())]),
                **{c: pa.chunked_array([nothing(many, kind), pa.array([x[k] for x in blocks], kind)]) for k, (c, kind) in enumerate((("key", pa.int64()), ("side", pa.int32()), ("number", pa.int32()), ("others", pa.int32()), ("lines", pa.list_(pa.int64()))))},
            }
        )

    sent = texts.mapInArrow(send, "bucket bigint, data binary")
    for level in range(1, levels):
        sent = onward(sent, fan, fan ** (level + 1), total)
    schema = "a bigint, b bigint, key bigint, side int, number int, others int, lines array<bigint>"
    met = checkpoint(sent.repartition(min(MOST_TASKS, fan**levels), "bucket").groupBy("bucket").applyInArrow(meet, schema))
    candidates = met.filter("a is not null").select("a", "b").distinct()
    members = met.filter("key is not null").select("key", "side", "number", "others", F.explode("lines").alias("id"))
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.select("id")).distinct()
    bodies = checkpoint(line_bodies(texts).join(wanted, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line")))
    pairs = candidates.join(bodies.select(F.col("id").alias("a"), F.col("line").alias("left")), "a").join(bodies.select(F.col("id").alias("b"), F.col("line").alias("right")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            far = distances(list(zip(left, right)), edits)
            longer = np.array([max(len(x), len(y)) for x, y in zip(left, right)], np.int64)
            near = pa.array(far <= allowed(longer, edits))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    def compare(table: pa.Table) -> pa.Table:
        sides: tuple[dict[int, str], dict[int, str]] = {}, {}
        for side, ids, own in zip(*(table.column(c).to_pylist() for c in ("side", "ids", "own"))):
            sides[side].update(zip(ids, own))
        ids = [np.array(list(x), np.int64) for x in sides]
        i, j = near_pairs(list(sides[0].values()), list(sides[1].values()), edits)
        a, b = ids[0][i], ids[1][j]
        some = a != b
        return pa.table({"a": np.minimum(a, b)[some], "b": np.maximum(a, b)[some]})

    verified = pairs.select("a", "b", "left", "right").mapInArrow(verify, "a bigint, b bigint")
    block = members.join(bodies, "id").groupBy("key", "side", "number", "others").agg(F.collect_list("id").alias("ids"), F.collect_list("line").alias("own"))
    across = F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other")
    seat = lambda side: F.when(F.col("side") == side, F.col("number")).otherwise(F.col("other"))
    tiles = block.select("key", "side", "number", "ids", "own", across).select("key", seat(0).alias("i"), seat(1).alias("j"), "side", "ids", "own")
    compared = tiles.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")
    return verified.unionByName(compared).distinct()


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """(doc_id, text_id, line_no, class_id, n_links, class_lines, first_doc, first_text, first_line, kept), one row for each line that is not blank.

    class_id is 32 hex digits: the least 64-bit digest of the lines in the class and, where its lines are linked to no other,
    a second one. n_links is the number of different lines linked to this one, class_lines how many lines the class has,
    first_doc, first_text and first_line its first line by (doc_id, text_id, line_no), and kept whether this is that line.
    text_id is a digest of the text that tells rows of one doc_id apart; rows that are repeated whole are one document, whose
    first line is kept in all of them. A null text has no lines; a null doc_id comes before all.

    Lines are of one class only if 128 bits of digests agree or their own texts have been compared: of lines that share the
    64-bit digest of a linked line, those with another second digest stand alone. The classes' first lines are checkpointed
    before they are joined back, so that adaptive execution can split a hot class.
    """
    edges = checkpoint(links(docs, id_col, text_col, edits))
    parts = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    known = parts.join(degree, "node")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    second = line_bodies(texts).join(known.select(F.col("node").alias("id")), "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))
    known = checkpoint(known.join(second.select(F.col("id").alias("node"), _second_id(F.col("line")).alias("other")), "node"))
    lines = _lines(docs, id_col, text_col).select("doc_id", "text_id", "line_no", _line_id(F.col("line")).alias("id"), _second_id(F.col("line")).alias("second"))
    joined = lines.join(known, (F.col("id") == F.col("node")) & (F.col("second") == F.col("other")), "left")
    linked = F.col("node").isNotNull()
    classed = joined.select("doc_id", "text_id", "line_no", F.coalesce("component", "id").alias("c1"), F.when(linked, F.lit(0)).otherwise(F.col("second")).alias("c2"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))
    first = checkpoint(classed.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "text_id", "line_no")).alias("first"), F.count("*").alias("class_lines")))
    found = classed.join(first, ["c1", "c2"])
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id")) & (F.col("line_no") == F.col("first.line_no"))
    name = F.lower(F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0")))
    return found.select(
        "doc_id", "text_id", "line_no", name.alias("class_id"), "n_links", "class_lines", F.col("first.doc_id").alias("first_doc"), F.col("first.text_id").alias("first_text"), F.col("first.line_no").alias("first_line"), kept.alias("kept")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """`docs`, columns as they are, with every line taken out of the text that its class has earlier; blank lines stay.

    Texts without such lines, null ones too, stay as they are. Rows of one doc_id with different texts are different documents,
    in the order of their text_id; rows that are repeated whole lose the same lines.
    """
    out = duplicate_lines(docs, id_col, text_col, edits).filter(~F.col("kept"))
    gone = out.groupBy("doc_id", "text_id").agg(F.collect_set("line_no").alias("__gone")).select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text"), "__gone")
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col("__id")) & (_text_id(docs[text_col]) == F.col("__text")), "left")
    left = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda _, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("__gone").isNotNull(), left).otherwise(F.col(f"`{text_col}`"))).select(*[F.col(f"`{c}`") for c in docs.columns])
