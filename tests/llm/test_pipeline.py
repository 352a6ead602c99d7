"""The pipeline's stages against plain versions, each on its own input."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline as p
from inkframe.llm import bpe
from tests.llm.test_jaccard import plain as jaccard_plain
from tests.llm.test_suffix import plain as suffix_plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in p.STAGES:
        before = docs.collect()
        docs = p.save(stage(spark, docs, sf), name)
        out.append((before, docs.collect(), docs.columns))
    return out


def test_columns(stages):
    for _, _, columns in stages[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_keeps_clean_documents(stages):
    before, after, _ = stages[0]
    assert len(after) >= 0.97 * len(before)
    assert set(after) <= set(before)


def test_one_document_of_a_group_stays(stages):
    before, after, _ = stages[1]
    want = {i for i, _, c in jaccard_plain([(r.doc_id, r.text) for r in before]) if i == c}
    assert {r.doc_id for r in after} == want < {r.doc_id for r in before}


def test_repeated_passages_go(stages):
    before, after, _ = stages[2]
    got = {r.doc_id: r.text for r in after}
    for i, _, removed, _, kept in suffix_plain([(r.doc_id, r.text) for r in before], p.PASSAGE):
        if i in got:
            assert len(kept) <= len(got[i].encode()) <= len(kept) + 8 * removed // p.PASSAGE
            assert not removed or len(got[i].encode()) < len(kept) + removed
        else:
            assert not kept.strip()
    assert all(r.n_chars == len(r.text) for r in after)


def test_benchmark_items_go(stages, spark, sf):
    before, after, _ = stages[3]
    items = [r.text.lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(x in r.text.lower() for r in after for x in items)
    assert len(after) >= 0.8 * len(before)


def test_tokens_decode_to_the_text(stages):
    before, after, _ = stages[4]
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, sf):
    text = "the quick brown fox jumps over the lazy dog and runs away " * 3
    rows = [(1, text, None, None, 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "42 !!", "en", "s", 5), (5, text, "en", None, 1), (None, text + " x", "en", "s", 9), (6, "é" * 300, "fr", "s", 300), (7, "a b " + "é" * 299, "fr", "s", 300), (None, "nothing here was said before by the others", "en", "s", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in p.STAGES:
        docs = p.save(stage(spark, docs, sf), "odd")
    got = docs.collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "6", "7", "None"]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in p.STAGES:
        empty = p.save(stage(spark, empty, sf), "none")
    assert empty.count() == 0
