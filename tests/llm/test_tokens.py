"""Encodings against the libraries, separator scans against a loop, files against a round trip."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest_llm import odd_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshframe.llm import bytebpe, pieces, repair, separators

PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", " ", "a", "b", "the", "\n", "\t", "▁", "é", "　", "<s>", "</s>", "<|endoftext|>", "'s", "'LL", "🙂", "\x00", "\r", "\x1c", "\x85", " ", "12", "!", "_", "١"]


def noise(n):
    r = random.Random(5)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_pieces_equal_the_library():
    sp, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.ChunkEncoder(pieces.model_bytes(PIECES))
    for x in [*noise(20_000), *(t or "" for _, t, *_ in odd_documents())]:
        assert own.encode(x) == sp.encode(x)


def test_a_full_table_makes_room(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 5)
    sp, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.ChunkEncoder(pieces.model_bytes(PIECES))
    for x in noise(500):
        assert own.encode(x) == sp.encode(x)
        assert len(own.table) <= 5 and len(own.old) <= 20
    texts = noise(300)
    assert [x.tolist() for x in own.encode_all(pa.array([*texts, None]))] == [*sp.encode(texts), []]


def test_encode_and_decode_keep_other_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    assert set(out.columns) == set(docs.columns) and out.count() == docs.count()
    for r in out.select("text", "decoded", "ids", "slot").collect():
        assert r["decoded"] == (r["text"] or "").replace("▁", " ") and r["ids"][-1] == 2 and r["slot"] == "6"


def test_bytes_equal_the_library():
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    own = bytebpe.ByteBpe(bytebpe.definition(BPE))
    for x in [*noise(20_000), *(t or "" for _, t, *_ in odd_documents())]:
        assert own.encode(x).tolist() == library.encode(x, add_special_tokens=False).ids
    for cp in range(0, 0x110000, 7):
        if not 0xD800 <= cp < 0xE000:
            x = f"a{chr(cp)}b 1{chr(cp)} {chr(cp)}"
            assert own.encode(x).tolist() == library.encode(x, add_special_tokens=False).ids
    assert own.by_library("a b").tolist() == own.encode("a b").tolist()


def test_special_strings_equal_the_plain_library(spark, odd):
    library = Tokenizer.from_file(BPE)
    own = bytebpe.ByteBpe(bytebpe.definition(BPE), special=True)
    for x in [*noise(20_000), *(t or "" for _, t, *_ in odd_documents())]:
        assert own.encode(x).tolist() == library.encode(x, add_special_tokens=False).ids
    assert own.by_library("a<|endoftext|>").tolist() == own.encode("a<|endoftext|>").tolist()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in repair.op10_repair(spark, odd).collect()}
    ids = np.array([*library.encode(dict((i, t) for i, t, *_ in odd_documents())[12], add_special_tokens=False).ids, 2], "<u4")
    assert 50256 in ids and got[12] == (len(ids), zlib.crc32(ids.tobytes()))


def brute(ids, sep):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == sep:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block", [1, 3, 64])
def test_scan(spark, block):
    r = np.random.default_rng(block)
    streams = {0: r.integers(0, 4, 200), 1: np.zeros(20, int), 2: np.full(30, 3), 3: np.zeros(0, int), 4: r.integers(0, 2, 50)}
    rows = [(s, n, ids[i : i + block].astype("<u2").tobytes()) for s, ids in streams.items() for n, i in enumerate(range(0, len(ids), block))]
    got = separators.scan(spark.createDataFrame(rows, separators.STREAM_SCHEMA), 0).collect()
    for s, ids in streams.items():
        own = sorted((g["ordinal"], g["start"], g["n_tokens"], g["terminated"]) for g in got if g["stream"] == s)
        assert own == [(n, *x) for n, x in enumerate(brute(ids.tolist(), 0))]


@pytest.mark.parametrize("block", [1, 8, 1 << 19])
def test_flat_files(spark, tmp_path, block):
    ids = np.array([5, 6, 0, 7, 0, 0, 8] * 50, "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "c.bin").write_bytes(ids[:3].tobytes())
    got = separators.scan(separators.flat_file_blocks(spark, str(tmp_path), 2, block), 0).orderBy("stream", "ordinal").collect()
    assert [(g["start"], g["n_tokens"], g["terminated"]) for g in got if g["stream"] == 0] == brute(ids.tolist(), 0)
    assert [(g["stream"], g["start"], g["n_tokens"]) for g in got if g["stream"]] == [(2, 0, 2)]
    one = separators.flat_file_blocks(spark, f"file://{tmp_path}/c.bin", 2, block)
    assert separators.scan(one, 0).select("n_tokens").collect() == [(2,)]
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError, match="odd.bin"):
        separators.flat_file_blocks(spark, str(tmp_path))


def test_digests_of_pieces_equal_the_library(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t, *_ in odd_documents():
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = pieces.op2_pieces(spark, odd).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_counts_equal_the_library(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    blocks, listed = separators.write_streams(docs, BPE, block_ids=100)
    got = separators.scan(blocks, 50256).join(listed, ["stream", "ordinal"]).select("doc_id", "n_tokens").collect()
    wanted = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in odd_documents()]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip(seed):
    r = np.random.default_rng(seed)
    phrase = r.integers(0, 50, 40)
    ids = np.concatenate([[phrase, r.integers(0, 50, 7), np.full(9, 3)][r.integers(0, 3)] for _ in range(300)]).astype(np.int32)
    rules, seq = repair.compress(ids, 50, least=4, share=2 + seed)
    assert len(rules) and len(seq) < len(ids)
    g = repair.Grammar(rules, repair.lengths(rules, 50), seq, 50)
    assert (g.all() == ids).all()
    for _ in range(200):
        a, n = r.integers(0, len(ids)), r.integers(0, 60)
        assert (g.range(int(a), int(n)) == ids[a : a + n]).all()


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(1)
    passage = r.integers(0, 5000, 700)
    ids = np.concatenate([x for _ in range(60) for x in (passage, r.integers(0, 5000, 50))]).astype(np.int32)
    rules, seq = repair.compress(ids, 5000)
    assert (repair.Grammar(rules, repair.lengths(rules, 5000), seq, 5000).all() == ids).all()
    assert np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)[1].max() < repair.LEAST
    assert repair.lengths(rules, 5000).max() > 500 and len(seq) < 5000


def test_grammars_of_small_alphabets(monkeypatch):
    monkeypatch.setattr(repair, "BIN_BITS", 3)  # bins that all pairs share drop nothing they should not
    r = np.random.default_rng(2)
    for n, kinds in itertools.product((0, 1, 2, 3, 5, 40, 3000), (1, 2, 3, 200)):
        ids = r.integers(0, kinds, n).astype(np.int32)
        rules, seq = repair.compress(ids, kinds, least=4)
        assert all(max(a, b) < kinds + i for i, (a, b) in enumerate(rules.tolist()))
        assert (repair.Grammar(rules, repair.lengths(rules, kinds), seq, kinds).all() == ids).all()
        assert max(Counter(itertools.pairwise(seq.tolist())).values(), default=0) < 4
        expanded = {i: [i] for i in range(kinds)}
        for i, (a, b) in enumerate(rules.tolist()):
            expanded[kinds + i] = expanded[a] + expanded[b]
        assert [x for y in seq.tolist() for x in expanded[y]] == ids.tolist()
        assert repair.lengths(rules, kinds).tolist() == [len(expanded[kinds + i]) for i in range(len(rules))]


@pytest.mark.parametrize("top", [0, 255, 65535, 65536, 70000, (1 << 20) - 1])
def test_narrow_numbers(top):
    r = np.random.default_rng(top)
    for n in (0, 1, 7, 8, 1000):
        x = r.integers(0, top + 1, n).astype(np.int32)
        data = repair.narrow(x, top)
        assert (repair.widen(data, n, top) == x).all() and len(data) <= n * (2 + max(0, top.bit_length() - 16) / 8) + 4


def test_files_equal_the_library(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    files = repair.write(docs, BPE, 2, shard_ids=500)
    got = sorted(repair.read(files).collect(), key=lambda r: r["start"])
    names = [r["doc_id"] for r in got]
    assert names == sorted(names, key=lambda x: (x is not None, x or 0))
    at = 0
    wanted = {}
    for i, t, *_ in odd_documents():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        wanted[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(wanted.values())
    assert files.where(F.size("doc_ids") > 0).count() > 3
