"""op6 against SQL and brute force, and the pipeline against its stages done by hand."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from compare import connect, differences
from test_near_texts import connected, sketch

import corpus_pipeline
from lumenframe.llm import bpe, exact, langid, mixing, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows: list[tuple]) -> Counter:
    """(doc_id, size, source_size, target, taken), the targets by sharing again and again."""
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    total: dict = defaultdict(int)
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    target: dict = dict.fromkeys(names, 0.0)
    left, free = 1.5 * sum(size), set(names)
    while free and left > 1e-9:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if target[s] + unit * weight[s] > 2 * total[s]}
        if not full:
            for s in free:
                target[s] += unit * weight[s]
            break
        for s in full:
            target[s] = 2.0 * total[s]
        free -= full
        left = 1.5 * sum(size) - sum(target[s] for s in names if s not in free)
        target.update(dict.fromkeys(free, 0.0))
    out: Counter = Counter()
    for r, n in zip(rows, size, strict=True):
        rate = min(target[r[3]] / total[r[3]], 2.0) if total[r[3]] else 0.0
        key = "" if r[0] is None else str(r[0])
        u = int(md5(f"{key}:{mixing.SEED}".encode()).hexdigest()[:12], 16) / (1 << 48)
        out[(r[0], n, total[r[3]], round(target[r[3]], 6), n * (int(rate) + (u < rate - int(rate))))] += 1
    return out


def test_mixing(docs, rows):
    counted, named = mixing.with_copies(docs)
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.size * r.copies) for r in counted.collect())
    assert got == brute(rows)


def test_mixing_sql(spark, sf):
    assert differences(queries.op6_source_mixing(spark, sf), connect(sf), mixing.ORACLE) == ""


def test_taken_words_come_near_their_targets(spark, sf):
    taken, target = defaultdict(int), {}
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_source_mixing(spark, sf).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.25 * t, 2500)


def test_mixture(wide, empty, all_null, rows):
    out = mixing.mixture(wide)
    assert out.columns == wide.columns
    counted, named = mixing.with_copies(wide)
    want = Counter()
    for r in counted.collect():
        want[r["doc_id"]] += r[named["copies"]]
    assert Counter(r.doc_id for r in out.collect()) == +want
    assert mixing.mixture(empty).count() == 0 and mixing.mixture(all_null).count() == 0


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_chain(spark, docs, tables):
    """run() is what the stages give one after another, each over a written table; all but the last keep the columns."""
    now = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mixing", "byte_bpe"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, tables)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tables}/stage{k}")
        now = spark.read.parquet(f"{tables}/stage{k}")
    want = Counter((r.doc_id, r.n_tokens) for r in now.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, tables).collect()) == want


def test_stages_by_hand(spark, docs, rows, tables):
    model = langid.train(docs)
    accepted = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    best, share = langid.score([r[1] for r in accepted], model)
    kept = [r for r, s in zip(accepted, share, strict=True) if s >= langid.LEAST_SCORE]
    low = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    top = {}
    for r in kept:
        if low(r[1]) not in top or (top[low(r[1])] is None or (r[0] is not None and r[0] > top[low(r[1])])):
            top[low(r[1])] = r[0]
    kept = [r for r in kept if top[low(r[1])] == r[0]]
    label = connected({r[0]: sketch(r[1]) for r in kept if r[0] is not None})
    kept = [r for r in kept if r[0] is None or label[r[0]] == r[0]]
    mixed = Counter()
    for (i, n, _, _, taken), times in brute(kept).items():
        mixed[i] += times * (taken // n if n else 0)
    out = corpus_pipeline.run(spark, tables).collect()
    assert Counter(r.doc_id for r in out) == +mixed and all(r.lossless for r in out)
    ids, count = bpe.Vocabulary(bpe.default_path()).encode([r[1] for r in kept])
    tokens = dict(zip([r[0] for r in kept], count.tolist(), strict=True))
    assert all(r.n_tokens == tokens[r.doc_id] for r in out)


def test_pipeline_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_stage_takes_odd_tables(spark, wide, all_null):
    for stage in (langid.accepted, exact.deduplicated, simhash.without_near_texts, mixing.mixture):
        assert stage(wide).columns == wide.columns
        assert stage(all_null).count() <= 2
