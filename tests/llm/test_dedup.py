"""op8, op5 and op1 against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenframe.llm import components, exact, lines, queries, simhash, spans
from compare import connect, differences


def low(text: str | None) -> str:
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def key(i: int | None) -> float:
    return -1 if i is None else i


def test_exact_duplicates(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max(ids, key=key)
        for i in ids:
            want[(i, keep, len(ids), i == keep, sha256(text.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in exact.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_exact_deduplicated(docs, wide, empty, all_null, rows):
    kept = exact.deduplicated(wide)
    assert kept.columns == wide.columns
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    keep = {max(ids, key=key) for ids in groups.values()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] in keep and r[0] == max(groups[low(r[1])], key=key))
    assert exact.exact_duplicates(empty).count() == 0 and exact.deduplicated(empty).count() == 0
    assert exact.exact_duplicates(all_null).select("group_size").distinct().collect()[0][0] == 2


def test_exact_sql(spark, sf):
    assert differences(queries.op8_exact_dedup(spark, sf), connect(sf), exact.ORACLE) == ""


def test_exact_plan_is_native(docs):
    text = exact.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    found = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not found:
        return 0
    parts = [" ".join(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def connected(prints: dict, radius: int = 2) -> dict:
    """Least id reachable, by comparing each fingerprint with each."""
    ids = sorted(prints)
    label = {i: i for i in ids}

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints(docs, rows):
    got = Counter((r[0], r[1]) for r in simhash.fingerprints(docs).select("doc_id", simhash.hex16(F.col("fp"))).collect())
    assert got == Counter((r[0], f"{fingerprint(r[1]):016x}") for r in rows)


def test_near_duplicates(docs, rows):
    prints = {r[0]: fingerprint(r[1]) for r in rows if r[0] is not None}
    want = connected(prints)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).filter("doc_id is not null").collect()}
    assert got == want


def test_near_duplicates_of_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    out = queries.op5_simhash_near_dedup(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in out} == connected(prints)


def test_vantage_tree_loses_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, np.uint64)
    flips = [b ^ np.uint64(1 << int(rng.integers(64))) for b in base for _ in range(3)]
    dense = [np.uint64(12345) ^ np.uint64(int(rng.integers(2**12))) for _ in range(600)]
    values = sorted({int(x) for x in [*base, *flips, *dense]})
    table = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), i) for i, v in enumerate(values)], "fp bigint, rep bigint")
    edges = simhash.links(table, leaf=100)
    got = {r.node: r.component for r in components.components(edges).collect()}
    want = connected(dict(enumerate(values)))
    assert {i: got.get(i, i) for i in range(len(values))} == want


def test_simhash_edges(empty, all_null, wide, rows):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0
    assert {tuple(r) for r in simhash.near_duplicates(all_null).collect()} == {(None, 0, None)}
    kept = simhash.deduplicated(wide)
    assert kept.columns == wide.columns
    want = connected({r[0]: fingerprint(r[1]) for r in rows if r[0] is not None})
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] is None or want[r[0]] == r[0])


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + k) for k in range(1, 300)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + k: 1000 for k in range(300)}}


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


def solid_lines(text: str | None) -> list[tuple[int, str]]:
    return [(k, x) for k, x in enumerate((text or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]


def brute_links(texts: list[str]) -> dict[str, set[str]]:
    kinds = sorted(set(texts))
    out = defaultdict(set)
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            most = min(2, max(len(a), len(b)) // 5)
            if abs(len(a) - len(b)) <= most and edit_distance(a, b) <= most:
                out[a].add(b)
                out[b].add(a)
    return out


def line_docs() -> list[tuple]:
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé 北") for _ in range(n)) for n in (5, 9, 10, 11, 14, 25, 40, 90) for _ in range(3)]
    out = []
    for k in range(260):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(2)] = rng.choice(["", "z", "q"])
        out.append("".join(x))
    return [(i, "\n".join(out[i * 4 : i * 4 + 4])) for i in range(65)] + [(900, None), (901, ""), (902, " \n\t"), (903, out[0]), (903, out[0])]


@pytest.mark.parametrize("sizes", [{}, {"tile": 3}, {"bucket_entries": 100, "fan_most": 4, "tile": 10}])
def test_duplicate_lines(spark, monkeypatch, sizes):
    """By pairs, by tiles of segments that many share, and with the buckets in several levels."""
    import functools

    monkeypatch.setattr(lines, "links", functools.partial(lines.links, **sizes))
    rows = line_docs()
    texts = [(i, k, x) for i, t in rows for k, x in solid_lines(t)]
    links = brute_links([x for _, _, x in texts])
    got = lines.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.line_no, r.n_links) for r in got) == Counter((i, k, len(links[x])) for i, k, x in texts)
    body = {(i, k): x for i, k, x in texts}
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(body[(r.doc_id, r.line_no)])
    label: dict[str, int] = {}
    for n, x in enumerate(sorted({x for _, _, x in texts})):
        if x not in label:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in label:
                    label[y] = n
                    todo += links[y]
    want = defaultdict(set)
    for x, n in label.items():
        want[n].add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))
    for r in got:
        first = min((i, k) for i, k, x in texts if label[x] == label[body[(r.doc_id, r.line_no)]])
        assert (r.first_doc, r.first_line) == first and r.kept == ((r.doc_id, r.line_no) == first)


def test_lines_deduplicated(spark, wide, empty, all_null):
    out = {r.doc_id: r.text for r in lines.deduplicated(spark.createDataFrame([(1, "a long line here\n\nb"), (2, "a long line hexe\nc is not b"), (3, None), (4, "a long line here")], "doc_id bigint, text string")).collect()}
    assert out == {1: "a long line here\n\nb", 2: "c is not b", 3: None, 4: ""}
    assert lines.duplicate_lines(empty).count() == 0 and lines.duplicate_lines(all_null).count() == 0
    assert lines.deduplicated(wide).columns == wide.columns


def test_lines_of_repeated_ids(spark):
    """Texts of one doc_id are numbered each by itself; rows repeated whole lose the same lines."""
    rows = [(1, "a first long line\na shared long line"), (1, "a shared long line\nan own long line"), (None, "x y z\nx y z"), (None, "x y z\nx y z"), (2, "an own long line\na last one of them")]
    out = sorted((r.doc_id or 0, r.text) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert out[:2] == [(0, "x y z")] * 2 and out[4] == (2, "a last one of them")
    assert out[2:4] in ([(1, "a first long line"), (1, "a shared long line\nan own long line")], [(1, "a first long line\na shared long line"), (1, "an own long line")])


def test_query_on_the_tables(spark, sf):
    """All pairs of the given lines, compared one by one where their lengths and character counts allow a link."""
    texts = [(r.doc_id, k, x) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for k, x in solid_lines(r.text)]
    every = sorted({x for _, _, x in texts}, key=len)
    count = [Counter(x) for x in every]
    linked: Counter = Counter()
    for i, a in enumerate(every):
        for j in range(i):
            if len(a) - len(every[j]) <= 2 and (count[i] - count[j]).total() <= 2 and edit_distance(a, every[j]) <= min(2, len(a) // 5):
                linked[a] += 1
                linked[every[j]] += 1
    got = queries.op1_line_dedup(spark, sf).collect()
    assert Counter((r.doc_id, r.line_no, r.n_links) for r in got) == Counter((i, k, linked[x]) for i, k, x in texts)


def test_ten_thousand_lines_of_one_segment(spark):
    """Every line shares two segments with every other; they are compared in tiles, and only links leave a task."""
    rng = np.random.default_rng(4)
    names = [f"{x:09x}" for x in rng.integers(0, 16**9, 10_000)]
    names[-1] = names[0][:4] + "z" + names[0][5:]
    text = "\n".join(f"{n} is the number of an entry in the long ledger of the house" for n in names)
    got = {(r.a, r.b) for r in lines.links(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()}
    ids = {n: xxhash.xxh64_intdigest(f"{n} is the number of an entry in the long ledger of the house".encode(), 42) for n in names}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    at: defaultdict[tuple, list] = defaultdict(list)
    want = set()
    for n in set(names):
        for k in range(9):
            at[k, n[:k] + n[k + 1 :]].append(n)
    for same in at.values():
        want |= {tuple(sorted((signed(ids[a]), signed(ids[b])))) for a in same for b in same if a != b}
    assert want <= got and tuple(sorted((signed(ids[names[0]]), signed(ids[names[-1]])))) in got


def test_hot_line_group_stays_small(spark):
    """Lines that share a long part but differ in a word each are no candidates of one another."""
    rows = [(i, "x" * 60 + f" word{i * 7919:08d}{i * 104729:09d} " + "y" * 60) for i in range(150)]
    assert lines.links(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == len([1 for a in range(150) for b in range(a) if edit_distance(rows[a][1][60:90], rows[b][1][60:90]) <= 2])


def test_signatures_bound_edits():
    import random

    rng = random.Random(8)
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 40)))
        b = list(a)
        for _ in range(2):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "z", "k"])
        b = "".join(b)
        code = np.array([ord(c) for c in a + b], np.uint32)
        sign = lines.signatures(code, np.array([0, len(a)]), np.array([len(a), len(b)]))
        assert lines.apart(sign[:1], sign[1:])[0] <= 2 * edit_distance(a, b)


def test_banded_distances():
    import random

    rng = random.Random(1)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "c"])
        pairs.append((a, "".join(b)))
    got = lines.distances(pairs)
    for (a, b), d in zip(pairs, got.tolist()):
        want = edit_distance(a, b)
        assert d == want if want <= 2 else d > 2


@pytest.mark.parametrize("n", [0, 1, 3, 4, 7, 8, 31, 32, 33, 64, 100])
def test_xxh64(n):
    raw = np.frombuffer(bytes(range(7, 7 + n)) * 1 + b"tail", np.uint8)
    got = spans.xxh64(raw, np.array([0]), np.array([n]), 42)[0]
    assert int(got) == xxhash.xxh64_intdigest(raw[:n].tobytes(), 42)
