"""Token counts against the library, on whole texts."""

from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import heartwood.llm.tokencount as tokencount
import heartwood.llm.transducer as transducer
from heartwood.llm.queries import queries
from heartwood.llm.tokencount import token_counts
from heartwood.llm.transducer import Transducer

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["a", "b", " ", "  ", "th", "e", "ing", " the", "er", "▁", "\n", "\t", "\x00", "日", "本", "é", "е", "ا", "𝔘", "<s>", "</s>", "<0x41>", "7", "."]

texts = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)


def want(some):
    return [len(ids) for ids in LIBRARY.encode(some)]


@given(st.lists(texts, max_size=8))
@settings(max_examples=200, deadline=None)
def test_counts_equal_the_library(some):
    assert tokencount._counts(Transducer.of(PATH), some).tolist() == want(some)


@given(st.lists(texts, min_size=1, max_size=8), st.integers(1, 9), st.sampled_from([0, 1000]), st.integers(5, 40))
@settings(max_examples=100, deadline=None)
def test_any_cut_into_chunks_gives_the_same(some, chunk, few, together):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(transducer, "CHUNK", chunk)
        patch.setattr(transducer, "FEW", few)
        patch.setattr(tokencount, "TOGETHER", together)
        assert tokencount._counts(Transducer.of(PATH), some).tolist() == want(some)


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_characters(text):
    assert tokencount._counts(Transducer.of(PATH), [text]).tolist() == want([text])


def test_stretches_without_a_break():
    some = ["a" * 5000, " " * 5000, "ab" * 3000, "日本" * 2000, "\n" * 500, "x" + " " * 999 + "the", "", "inging" * 3000]
    assert tokencount._counts(Transducer.of(PATH), some).tolist() == want(some)


def test_forgotten_states_are_built_again(monkeypatch):
    monkeypatch.setattr(tokencount, "MOST_STATES", 50)
    fresh = Transducer(PATH)
    for some in (["the internation of things " * 30], ["another thinger"], ["the internation of things " * 30]):
        assert tokencount._counts(fresh, some).tolist() == want(some)


def test_awkward_rows(awkward, nothing, spark):
    for docs in (awkward, awkward.withColumnRenamed("bucket", "n_tokens")):
        found = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect())
        rows = docs.select("doc_id", "text").collect()
        sizes = [(str(r.doc_id), len((r.text or "").encode()), len(LIBRARY.encode(r.text or ""))) for r in rows]
        assert found == sorted((i, b, n, n > 4096) for i, b, n in sizes)
        assert any(r[3] for r in found)
    assert token_counts(nothing, PATH).collect() == []


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        Transducer(str(tmp_path / "none.model"))


def test_the_query_counts_every_document(spark, sf_dir):
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries()["op12_token_counts"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text or "" for r in rows]
    assert found == {r.doc_id: (len(t.encode()), n, n > 4096) for r, t, n in zip(rows, texts, want(texts), strict=True)}
