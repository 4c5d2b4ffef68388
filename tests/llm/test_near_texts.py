"""Near texts (two fingerprints and lengths) against brute force and against exact similarities of five-word shingles."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from lumenframe.llm import components, simhash

def made(rng: random.Random, n: int) -> str:
    """Words drawn evenly, which is harder than prose, whose frequent words hold the bits of a fingerprint."""
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.randrange(100)}" for _ in range(n))


def found_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text: str | None, k: int) -> list[str]:
    w = found_words(text)
    return [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def majority(h: list[int]) -> int:
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least(h: list[int]) -> bytes:
    out = bytearray(256)
    for k in range(256):
        inside = [x >> 8 for x in h if x % 256 == k]
        out[k] = min(inside) % 255 + 1 if inside else 0
    return bytes(out)


def sketch(text: str | None) -> tuple[int, int, int, bytes]:
    """SimHashes of words and of five-word shingles, number of shingles, least shingles by bins."""
    one, five = ([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, k)] for k in (1, 5))
    return majority(one), majority(five), len(five), least(five)


def linked(a: tuple, b: tuple) -> bool:
    if (a[0] ^ b[0]).bit_count() > 8 or (a[1] ^ b[1]).bit_count() > 20 or min(a[2], b[2]) < 0.8 * max(a[2], b[2]):
        return False
    some = [(x, y) for x, y in zip(a[3], b[3], strict=True) if x or y]
    return 10 * sum(x == y for x, y in some) >= 8 * len(some)


def connected(sketches: dict) -> dict:
    label = {i: i for i in sketches}

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sketches)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(sketches[a], sketches[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def test_against_brute_force(docs, rows):
    want = connected({r[0]: sketch(r[1]) for r in rows if r[0] is not None})
    got = simhash.near_texts(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want


def test_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = connected({r.doc_id: sketch(r.text) for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in simhash.near_texts(docs).collect()} == want
    assert {r.doc_id for r in simhash.without_near_texts(docs).collect()} == {i for i, c in want.items() if i == c}


@pytest.mark.parametrize("tile", [simhash.TILE, 70])
def test_tree_and_tiles_lose_no_link(spark, tile):
    rng = random.Random(4)
    rows, value = [], {}
    flip = lambda x, most: x ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(most))})
    for k in range(1500):
        fp, hi, n, sig = rng.getrandbits(64) if k % 3 else 99, rng.getrandbits(64), rng.randrange(1, 900), rng.randbytes(256)
        for j in range(2):
            cut = rng.randrange(70)
            value[2 * k + j] = v = (flip(fp, 10), flip(hi, 22), max(1, int(n * rng.uniform(0.8, 1.2))), rng.randbytes(cut) + sig[cut:])
            rows.append((*(int(np.uint64(x).view(np.int64)) for x in v[:2]), *v[2:], 2 * k + j))
    table = spark.createDataFrame(rows, "fp bigint, hi bigint, n bigint, sig binary, rep bigint")
    edges = simhash.links(table, simhash.WORD_RADIUS, leaf=150, bits=simhash.SHINGLE_BITS, tile=tile)
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert {i: got.get(i, i) for i in value} == connected(value)


def test_size_nodes_divide_where_fingerprints_do_not():
    fp, size = np.full(4000, 7, np.uint64), np.arange(4000)
    tree, held = simhash.build_tree(fp, size, 500, 5)
    assert all(x.vantage is None for x in tree) and max(held) < 1500 and sum(held) == 4000
    assert simhash.build_tree(fp, None, 500, 5) == ([], [4000])


def test_planted_copies_are_caught_and_others_left(spark):
    rng = random.Random(9)
    rows, near = [], 0
    for k in range(300):
        text = made(rng, rng.randrange(60, 500)).split()
        copy = list(text)
        for _ in range(max(1, len(text) // 80)):
            copy[rng.randrange(len(copy))] = "changed"
        a, b = set(shingles(" ".join(text), 5)), set(shingles(" ".join(copy), 5))
        if len(a & b) >= 0.8 * len(a | b):
            near += 1
            rows += [(k, " ".join(text)), (1000 + k, " ".join(copy))]
        else:
            rows.append((k, " ".join(text)))
    found = {r.doc_id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(c == i % 1000 or c == i for i, c in found.items())
    assert sum(c == i - 1000 for i, c in found.items()) >= 0.9 * near > 200


def test_edges(empty, all_null, wide):
    assert simhash.near_texts(empty).count() == 0 and simhash.without_near_texts(empty).count() == 0
    assert [tuple(r) for r in simhash.near_texts(all_null).collect()] == [(None, None)] * 2
    assert simhash.without_near_texts(wide).columns == wide.columns
