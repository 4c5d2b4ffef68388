"""Every operator over texts longer than the chunks that they work in, beside short ones."""

from __future__ import annotations

import random

import pytest

from lumenframe.llm import backoff, bpe, exact, html, langid, lines, merkle, mixing, quality, simhash, spans


def long_text(seed: int) -> str:
    rng = random.Random(seed)
    kinds = ["".join(rng.choice("abcdefghiklmnoprstuü") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    lines_ = (" ".join(rng.choice(kinds) for _ in range(12)) for _ in range(22_000))
    return "\n".join(lines_)


@pytest.fixture(scope="module")
def long_docs(spark):
    a, b = long_text(1), long_text(2)
    assert len(a.encode()) > spans.CHUNK_BYTES
    rows = [(1, a, "en", "x"), (2, b, "de", "x"), (3, a, "en", "y"), (4, "a short text", "en", "y"), (5, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(2).cache()


def test_copies_of_long_texts(spark, long_docs):
    assert {r.doc_id: r.keep_id for r in exact.exact_duplicates(long_docs).collect()} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(long_docs).collect()}
    assert found[1] == found[3] == 1 and found[2] == 2
    near = long_docs.union(spark.createDataFrame([(6, long_text(1).replace("\n", " new\n", 900), "en", "x")], long_docs.schema))
    assert {r.doc_id: r.component_id for r in simhash.near_texts(near).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 1}
    prints = {r.doc_id: (r.root, r.fingerprint) for r in merkle.fingerprints(long_docs).collect()}
    assert prints[1] == prints[3] != prints[2]


def test_lines_of_long_texts(long_docs):
    kept = {r.doc_id: r.text for r in lines.deduplicated(long_docs).select("doc_id", "text").collect()}
    assert len(kept[1]) > 1_000_000 and set(kept[3].split("\n")) == {""} and kept[4] == "a short text" and kept[5] is None


def test_models_over_long_texts(long_docs):
    out = {r.doc_id: r for r in backoff.score(long_docs).collect()}
    assert out[1].n_words == out[3].n_words == 264_000 and out[1].n_full == 264_000 - 2 and out[5].n_words == 0
    assert {r.doc_id for r in langid.identify(long_docs, langid.train(long_docs)).select("doc_id").collect()} == {1, 2, 3, 4, 5}
    assert quality.score(long_docs.select("doc_id", "text"), quality.train(long_docs.select("doc_id", "text"))).count() == 5
    assert mixing.with_copies(long_docs)[0].count() == 5


def test_tokens_of_long_texts(long_docs):
    from hashlib import sha256

    got = {r.doc_id: r.decoded_sha256 for r in bpe.digests(long_docs).collect()}
    assert got == {r.doc_id: sha256((r.text or "").encode()).hexdigest() for r in long_docs.collect()}


def test_a_long_page():
    text = long_text(3)
    page = "<html><body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>{x}.</p>" for x in text.split("\n")) + "</article></body></html>"
    assert html.main_text(page) == "\n\n".join(f"{x}." for x in text.split("\n"))


def test_the_pattern_is_the_one_that_the_splitter_was_made_for():
    import public_tokenizers

    assert bpe.PATTERN == public_tokenizers.PATTERN
