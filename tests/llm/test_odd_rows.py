"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, through every query."""

import hashlib
import zlib
from collections import Counter

import pytest
from conftest_llm import odd_documents

from meshframe.llm import registry

DOCUMENT_QUERIES = [q for q in registry.queries() if q not in ("op9_merkle", "op12_phrases", "pipeline")]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_every_row_once(spark, odd, name):
    got = Counter(r["doc_id"] for r in registry.queries()[name](spark, odd).collect())
    assert got == Counter(d[0] for d in odd_documents())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_empty_tables(spark, nothing, name):
    found = registry.queries()[name](spark, nothing)
    assert found.columns and found.collect() == []


def test_pages(spark, odd):
    rows = registry.queries()["op9_merkle"](spark, odd).collect()
    assert Counter(r["page_id"] for r in rows) == Counter([1, 1, 2, None, None, 700, 3])


def test_empty_texts(spark, odd):
    q = registry.queries()
    empty = {3, 4}
    by = lambda name: {r["doc_id"]: r for r in q[name](spark, odd).collect()}
    pieces, tokens, ids, words, sets, scores, pll = (by(n) for n in ("op2_pieces", "op1_token_counts", "op10_repair", "op5_suffix_arrays", "op6_minhash", "op8_quality", "op7_pseudo_likelihood"))
    for i in empty:
        assert (pieces[i]["n_tokens"], pieces[i]["ids_sha256"]) == (1, hashlib.sha256(b"2").hexdigest())
        assert pieces[i]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
        assert tokens[i]["n_tokens"] == 0
        assert (ids[i]["n_tokens"], ids[i]["ids_crc32"]) == (1, zlib.crc32(b"\x02\0\0\0"))
        assert (words[i]["n_words"], words[i]["contaminated"]) == (0, False)
        assert (sets[i]["n_shingles"], sets[i]["component_id"], sets[i]["kept"]) == (0, i, True)
        assert scores[i]["score"] == scores[3]["score"]
        assert (pll[i]["n_words"], pll[i]["log_likelihood"], pll[i]["per_word"]) == (0, 0.0, None)
