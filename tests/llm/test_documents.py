"""Searches, groups, shards, fingerprints and scores against brute-force versions."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from conftest_llm import DOCUMENTS, odd_documents, prose
from pyspark.sql import functions as F

from meshframe.llm import fixity, hilbert, neardup, pseudolik, quality, registry, suffixes, syncmers

TABLES = ["documents", "benchmark", "labels", "pages"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    wanted, found = con.sql(registry.oracle_sql()[name]), registry.queries()[name](spark, sf)
    names = sorted(wanted.columns)
    assert sorted(found.columns) == names
    pick = lambda cols, rows: sorted((tuple(r[cols.index(n)] for n in names) for r in rows), key=repr)
    assert pick(found.columns, found.collect()) == pick(wanted.columns, wanted.fetchall())


# ---- decontamination


def brute_hits(text, items, window):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hit, found = set(), set()
    for name, item in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate({c: c + 32 for c in range(65, 91)}))
        n = min(window, len(iw))
        for a in range(len(iw) - n + 1 if n else 0):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == iw[a : a + n]:
                    hit |= set(range(p, p + n))
                    found.add(name)
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize(("shard_words", "slice_bytes"), [(1 << 20, 1 << 24), (40, 60), (7, 1)])
def test_matches(spark, shard_words, slice_bytes):
    r = random.Random(shard_words)
    word = lambda: r.choice("a b c B é 1 x-y".split())
    items = [(str(n), " ".join(word() for _ in range(r.choice([0, 1, 3, 4, 6, 12])))) for n in range(12)]
    docs = [(n, " ".join(word() for _ in range(r.choice([0, 2, 5, 30, 90])))) for n in range(40)]
    bench = spark.createDataFrame([(int(n), t) for n, t in items], "item_id bigint, text string")
    got = suffixes.find(documents(spark, docs), bench, 4, shard_words, slice_bytes).select("doc_id", "matches").collect()
    for row in got:
        m = row["matches"]
        n, hit, found = brute_hits(dict(docs)[row["doc_id"]], items, 4)
        assert (m["n_words"], sum(h["to"] - h["from"] for h in m["hits"]), m["items"]) == (n, hit, sorted(found))
        assert m["n_items"] == len(found)


@pytest.mark.parametrize(("shard_words", "slice_bytes"), [(1 << 20, 1 << 24), (60, 40), (9, 1)])
def test_longest_match_of_every_copy(spark, shard_words, slice_bytes):
    items = [prose(1, 9), prose(2, 6) + " " + prose(1, 4), prose(3, 2)]
    texts = ["x " + prose(1, 9) + " y"] * 4 + [prose(1, 7), prose(1, 7), "z " + prose(3, 2), prose(9, 8), ""] + [prose(1, 4) + " q " + prose(2, 6)] * 3
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = suffixes.find(documents(spark, list(enumerate(texts))).coalesce(1), bench, 4, shard_words, slice_bytes).select("doc_id", "matches").collect()

    def brute(text):
        w, found = text.split(), [(0, 0)]
        for i in map(str.split, items):
            found += [(n, -p) for p in range(len(w)) for a in range(len(i)) for n in range(1, len(i) - a + 1) if w[p : p + n] == i[a : a + n]]
        return max(found)

    for r in got:
        n, p = brute(texts[r["doc_id"]])
        assert (r["matches"]["longest"], r["matches"]["longest_from"]) == (n, -p if n else None)


def test_many_rows_of_a_window_and_many_items(spark):
    items = [(i, "the") for i in range(50)] + [(100 + i, prose(1, 12)) for i in range(30)]
    texts = ["the " * 200 + prose(1, 12)] * 40 + ["other words", "THE end"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = suffixes.find(documents(spark, list(enumerate(texts))), bench).select("doc_id", "matches").collect()
    for r in got:
        m, t = r["matches"], texts[r["doc_id"]]
        want = ([(0, 212)], 80) if "end" not in t and "other" not in t else ([(0, 1)], 50) if "end" in t else ([], 0)
        assert ([(h["from"], h["to"]) for h in m["hits"]], m["n_items"]) == want


def test_longest_match_and_order():
    x = np.array([3, 1, 2, 1, 2, 4, 1, 2, 1, 5])
    order = suffixes.suffix_array(x, 10, np.arange(len(x)))
    assert [x[i:].tolist() for i in order] == sorted(x[i:].tolist() for i in range(len(x)))
    bench = suffixes.Benchmark([(0, [b"p", b"q", b"p", b"q", b"p"])], 3)
    seq = np.array([2, 0, 1, 0, 2, 0, 1, 2])
    longest, place, lo, hi = bench.search(seq, suffixes.suffix_array(seq, 5, np.flatnonzero(seq != 2)))
    assert longest.tolist() == [3, 2, 3, 2, 1] and place[0] == 1 and (hi - lo)[0] == 1


def test_clean_documents_stay(spark):
    docs = documents(spark, [(1, prose(1, 50)), (2, "x " + prose(2, 50)), (3, None), (4, "")])
    bench = spark.createDataFrame([(7, prose(2, 50))], "item_id bigint, text string")
    kept = suffixes.remove(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


# ---- near duplicates


def brute_groups(rows, k):
    sets = []
    for _, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if sets[i] and ids else (rows[i][0] if not sets[i] else None)))
    return out


def clustered(seed):
    """Clouds of edited copies around a few texts, near the threshold, and others."""
    r = random.Random(seed)
    rows = []
    for c in range(4):
        base = prose(100 * seed + c, 90).split()
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(["new", "words", "here"])
            rows.append(" ".join(w))
        rows += [rows[-1]] * 3
    rows += [prose(seed + n, 40) for n in range(20)] + [None, "", "a b"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups(spark, seed):
    rows = clustered(seed)
    got = neardup.groups(documents(spark, rows), 4).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_groups(rows, 4))


def test_groups_with_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in odd_documents()]
    got = neardup.groups(documents(spark, rows), 5).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_groups(rows, 5), key=str)


def test_one_of_each_group_stays(spark):
    rows = clustered(5)
    docs = documents(spark, rows + [rows[0], rows[0]])
    kept = neardup.remove(docs, 5)
    assert kept.columns == docs.columns
    firsts = {c for _, n, c in brute_groups(rows, 5)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(firsts)


def test_rows_that_repeat_thousands_of_times(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 50)
    monkeypatch.setattr(neardup, "CELL_ROWS", 30)
    made = {}
    monkeypatch.setattr(neardup, "store", lambda df, what, **_: made.setdefault(what, []).append(x := fixity.store(df, what)) or x)
    monkeypatch.setattr(neardup, "release", lambda *_: None)
    one = prose(1, 60).split()
    near = [" ".join([*one[:59], "x"]), " ".join(["y", *one[1:]])]
    rows = [(7, " ".join(one))] * 5000 + [(8, near[0])] * 5000 + [(None, near[1])] * 100 + clustered(6)[:60]
    got = neardup.groups(documents(spark, rows), 4).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    once = list(dict.fromkeys(rows))
    n = {r: rows.count(r) for r in once}
    want = {}
    for r, b in zip(once, brute_groups(once, 4), strict=True):
        want[b] = want.get(b, 0) + n[r]
    assert {tuple(r)[:3]: r["count"] for r in got} == want
    n_classes = made["classes"][0].count()
    assert n_classes <= len(once) and made["buckets"][0].count() <= 42 * n_classes
    assert all(x.count() <= n_classes**2 for x in made["verified"]) and made["sets"][0].groupBy("cid").count().where("count > 1").isEmpty()
    kept = neardup.remove(documents(spark, rows), 4).collect()
    assert len(kept) == len({b[2] if b[1] else b for b in want}) and len([r for r in kept if r["doc_id"] == 7]) == 1


@pytest.mark.parametrize("percent", [80, 82, 85])
def test_recall_of_planted_pairs(spark, percent):
    """Pairs of sets at a known similarity just over the threshold share a bucket, all of them here."""
    r = np.random.default_rng(percent)
    met = 0
    for _ in range(400):
        pool = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64))
        own = len(pool) * (100 - percent) // 200
        a, b = np.sort(pool[own:]), np.sort(pool[: len(pool) - own])
        met += bool(set(neardup.bands(neardup.sketch(a)).tolist()) & set(neardup.bands(neardup.sketch(b)).tolist()))
        assert np.bitwise_count((neardup.one_bits(a) ^ neardup.one_bits(b)).view(np.uint64)).sum() <= neardup.APART
    assert met == 400


def test_kept_rows_without_ids(spark, write, tmp_path):
    text = prose(1, 30)
    rows = [(None, text), (4, text), (None, prose(2, 30)), (None, None), (9, "")]
    path = write(tmp_path / "t", [(i, t, None, None, None) for i, t in rows])
    got = registry.queries()["op6_minhash"](spark, path).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 4, False), (4, 4, True), (None, None, True), (None, None, True), (9, 9, True)], key=str)


@pytest.mark.parametrize("n_bins", [256, 2048])
def test_sketches_estimate_similarity(n_bins):
    r = np.random.default_rng(1)
    for n in (1, 2, 9, 300, 5000):
        pool = np.unique(r.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        a, b = np.sort(pool[: max(1, n * 9 // 10)]), np.sort(pool[:n])
        same = (neardup.sketch(a, n_bins) == neardup.sketch(b, n_bins)).mean()
        j = len(a) / len(b)
        assert abs(same - j) <= 5 * np.sqrt(j * (1 - j) / n_bins) + 1e-9


# ---- shards


@pytest.mark.parametrize(("bits", "n"), [(1, 2), (3, 1), (2, 2), (3, 3), (2, 4)])
def test_curve(spark, bits, n):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    names = [f"c{i}" for i in range(n)]
    df = spark.createDataFrame(cells, names).withColumn("h", hilbert.hilbert_index([F.col(c) for c in names], bits))
    walk = sorted((r["h"], tuple(r)[:n]) for r in df.collect())
    assert [h for h, _ in walk] == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in itertools.pairwise(walk))


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_law_of_rows(spark, request, which):
    path = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    got = registry.queries()["op3_hilbert"](spark, path).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d["doc_id"]), 8 + len((d["text"] or "").encode()), zlib.crc32((d["text"] or "").encode())) for d in docs)
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == len(docs)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    walk = [r["hilbert"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert walk == sorted(walk)


def test_cuts_of_whole_strings(spark):
    names = [None] * 9 + ["https://example.org/" + x for x in "a" * 50 + "bcdefgh" * 3 + "z" * 30] + ["", "ü"]
    df = spark.createDataFrame([(x,) for x in names], "s string").repartition(5)
    known = sorted((x for x in names if x is not None), key=str.encode)
    want = sorted({known[-(-len(known) * i // 8) - 1] for i in range(1, 8)}, key=str.encode)
    assert hilbert.string_cuts(df, F.col("s"), 3) == want
    assert hilbert.string_cuts(df.where("false"), F.col("s"), 3) == []


def test_shards_can_be_skipped(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("https://one.prefix/"), F.col("source")).alias("source"), F.octet_length("text").alias("size"), F.lit("x").alias("rank"), F.lit("y").alias("_salt"))
    placed = hilbert.shard(docs, {"source": F.col("source"), "size": F.col("size")}, ["doc_id"], 12)
    assert placed.columns == [*docs.columns, "hilbert", "shard", "slot"] and placed.count() == docs.count()
    stats = hilbert.statistics(placed, ["source", "size"]).collect()
    one = docs.groupBy("source").count().orderBy("count", "source").first()["source"]
    small = docs.approxQuantile("size", [0.1], 0)[0]
    for keeps in (lambda r: r["least_source"] <= one <= r["greatest_source"], lambda r: r["least_size"] <= small):
        kept = {r["shard"] for r in stats if keeps(r)}
        assert len(stats) == 12 and 0 < len(kept) <= 8
    assert {r["shard"] for r in placed.where(F.col("source") == one).collect()} <= {r["shard"] for r in stats if r["least_source"] <= one <= r["greatest_source"]}


# ---- fingerprints


def test_edited_texts(spark, odd):
    rows = [(i, t or "") for i, t, *_ in odd_documents()]
    got = registry.queries()["op4_syncmers"](spark, odd).collect()
    by_text: dict[str, set] = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    # distinct ids alone have one next document
    once = [i for i, _ in rows if i is not None and [x for x, _ in rows].count(i) == 1]
    order = sorted({i for i, _ in rows if i is not None}, reverse=True)
    texts = dict(rows)
    for r in got:
        i = r["doc_id"]
        if i in once and (n := order.index(i) + 1) < len(order) and order[n] in once:
            half = len(texts[i]) // 2
            edited = texts[i][: len(texts[i]) - half] + texts[order[n]][:half]
            assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
            by_text.setdefault(texts[i], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_next_wraps_and_crosses_ranges(spark):
    docs = spark.range(0, 100, 3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = {r["doc_id"]: r["next_text"] for r in syncmers.with_next(docs, ["text"], rows_per_range=4).collect()}
    ids = sorted(got, reverse=True)
    assert got == {a: str(b) for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}


def spark_hash(values, seed=42):
    """Spark's xxhash64 of strings or 64-bit numbers, signed."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_anchors(text):
    t = []
    for w in re.findall(r"\S+", text, re.ASCII):
        t += [w] if len(w) <= 8 else [w[:8], w[8:]] if len(w) <= 16 else list(w)
    inner = [spark_hash(p) for p in itertools.pairwise(t)] + ([spark_hash(t[-1:])] if t else [])
    low = lambda h, at: (h & 0x3FFFFFFF) << 2 | at
    out, last = [], -1
    for i in range(len(t) - 4):
        m = inner[i : i + 4]
        if min(m) in (m[0], m[3]):
            out.append(low(spark_hash([inner[i], inner[i + 2], inner[i + 3]]), i - last))
            last = i
    return out or ([low(spark_hash(t), 0)] if t else [])


def signed(x):
    return x - (1 << 32) if x >> 31 else x


def test_anchors_equal_brute_force(spark):
    r = random.Random(3)
    texts = ["", " ", "a", "a b c d", "a b c d e", "same same same same same same same"] + [prose(i, r.randint(3, 40)) for i in range(60)] + ["x" * 20 + " " + prose(3, 10), "y" * 12 + " z " + "é" * 17]
    got = {r["doc_id"]: r for r in syncmers.with_anchors(documents(spark, list(enumerate(texts))), "text", "a").withColumn("p", syncmers.positions(F.col("a"))).select("doc_id", "a", "p").collect()}
    for i, t in enumerate(texts):
        want = brute_anchors(t)
        assert got[i]["a"] == [signed(x) for x in want], t
        gaps = [x & 3 for x in want]
        assert all(1 <= g <= 3 for g in gaps) or len(gaps) == 1
        assert [p["position"] for p in got[i]["p"]] == [max(0, x - 1) for x in itertools.accumulate(gaps)]


def test_fingerprints_equal_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(docs, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))

    def near(a, b):
        a, b = ({x >> 2 for x in y} for y in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for r in registry.queries()["op4_syncmers"](spark, sf).collect():
        text, other = docs[r["doc_id"]], docs[after[r["doc_id"]]]
        half = len(text) // 2
        own, edited, following = map(brute_anchors, (text, text[: len(text) - half] + other[:half], other))
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{x:08x}" for x in y) for y in (own, edited))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((near(own, edited), near(own, following)))


def test_anchors_do_not_depend_on_what_surrounds_them(spark):
    middle = prose(8, 60)
    rows = [(0, middle, prose(9, 30) + " " + middle + " " + prose(10, 30))]
    df = spark.createDataFrame(rows, "id int, one string, two string")
    both = syncmers.with_anchors(syncmers.with_anchors(df, "one", "a"), "two", "b")
    found = syncmers.passages(both, ["id"], "a", "b").collect()
    assert [(r["from_b"] - r["from_a"]) for r in found] == [30] and found[0]["tokens"] > 50


def test_many_rows_of_one_id(spark):
    rows = [(i, f"t{i}") for i in range(300)] + [(7, f"seven{i}") for i in range(400)] + [(None, f"none{i}") for i in range(400)] + [(-(10**17), "low"), (10**18, "high")]
    got = syncmers.with_next(documents(spark, rows).select("doc_id", "text"), ["doc_id", "text"], rows_per_range=20).collect()
    after = {r["text"]: (r["next_doc_id"], r["next_text"]) for r in got}
    assert len(got) == len(rows) and sorted(t for _, t in after.values()) == sorted(t for _, t in rows)
    walk, at = [], "high"
    for _ in rows:
        walk.append(dict((t, i) for i, t in rows)[at])
        at = after[at][1]
    assert at == "high" and walk == sorted([i for i, _ in rows if i is not None], reverse=True) + [None] * 400


def test_likeness(spark, sf):
    got = registry.queries()["op4_syncmers"](spark, sf).where("n_chars > 1000").agg(F.avg("near_edited"), F.max("near_next"), F.expr("avg(cast(near_edited > near_next as int))")).first()
    assert got[0] > 0.2 and got[1] < 0.2 and got[2] == 1


def test_short_texts_have_fingerprints_of_their_own(spark):
    texts = {i: prose(i, 5 + i % 6, 10**6) for i in range(300)} | {300: ""}
    got = {r["doc_id"]: r["s"] for r in syncmers.with_anchors(documents(spark, list(texts.items())), "text", "s").select("doc_id", "s").collect()}
    assert got.pop(300) == [] and all(got.values())
    assert len({tuple(s) for s in got.values()}) == len(set(texts.values())) - 1


def test_passages_without_white_space_keep_their_anchors(spark):
    r = random.Random(4)
    passage = "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(400))
    rows = [(0, passage)] + [(n, "x" * n + passage) for n in range(1, 8)] + [(8, passage[:200] + "x" + passage[200:])]
    got = {r["doc_id"]: {x >> 2 for x in r["s"]} for r in syncmers.with_anchors(documents(spark, rows), "text", "s").select("doc_id", "s").collect()}
    assert all(len(got[0] & s) / len(got[0] | s) > 0.85 for s in got.values())
    words = "short " + "a" * 8 + " " + "b" * 8 + "c" * 8 + " " + "d" * 8 + "e " + "🙂" * 17
    cut = spark.createDataFrame([(words,)], "t string").select(syncmers.tokens(F.col("t"))).first()[0]
    assert cut == ["short", "a" * 8, "b" * 8, "c" * 8, "d" * 8, "e", *["🙂"] * 17]


# ---- scores


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()["op8_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.collect())
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_labels_of_held_out_rows_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.described(docs.select("doc_id", "text"))
    turned = labels.withColumn("quality", F.when(quality.fold_of(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(rows, x) for x in (labels, turned))
    assert all(np.allclose(p, q) for p, q in zip(a.w, b.w, strict=True))


def test_risk_and_gradient_equal_brute_force(spark):
    r = np.random.default_rng(4)
    p, u = r.normal(0.5, 1, (30, quality.N_FEATURES)), r.normal(0, 1, (200, quality.N_FEATURES))
    net = quality.Network()
    net.mean, net.scale = np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES)
    shapes = [(quality.N_FEATURES, quality.HIDDEN), (quality.HIDDEN,), (quality.HIDDEN,), (1,)]
    start = np.concatenate([r.normal(0, 0.2, int(np.prod(s))) for s in shapes])

    def set_to(flat):
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        net.w = [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)]

    def risks(flat, prior):
        set_to(flat)
        out = [(quality.Network.score(net, x)) for x in (p, u)]
        positive = prior * np.mean([1 - x for x in out[0]])
        negative = np.mean([x for x in out[1]]) - prior * np.mean([x for x in out[0]])
        return positive, negative

    for prior in (0.3, 0.99):  # the second makes the estimate of the risk on negatives fall below zero
        u = u * (1 if prior < 0.9 else 0) - (0 if prior < 0.9 else 0.5) * np.sign(start[-quality.HIDDEN - 1 : -1] @ start[: quality.N_FEATURES * quality.HIDDEN].reshape(shapes[0]).T)
        set_to(start)
        hidden, gradient = net.gradient(net.scaled(p), prior, len(u), net._sums(net.scaled(u)))
        positive, negative = risks(start, prior)
        assert hidden == pytest.approx(negative) and (negative < 0) == (prior == 0.99)
        for i in [*r.choice(len(start), 25), len(start) - 1]:
            up, down = start.copy(), start.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            (p1, n1), (p0, n0) = risks(up, prior), risks(down, prior)
            want = (p1 + n1 - p0 - n0) / 2e-5 if negative >= 0 else (n0 - n1) / 2e-5
            assert gradient[i] == pytest.approx(want, abs=1e-6, rel=1e-4)


def test_steps_over_all_rows_do_not_depend_on_their_deal(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = quality.described(docs).cache()
    p = np.array([r["features"] for r in rows.limit(20).collect()], np.float64)
    u = np.array([r["features"] for r in rows.collect()], np.float64)
    a, b = (quality.Network().fit(p, u[:50], 0.4).go_on(p, x, 0.4, 3) for x in (rows.coalesce(1), rows.repartition(9)))
    c = quality.Network().fit(p, u[:50], 0.4)
    for step in range(quality.STEPS + 1, quality.STEPS + 4):
        c._descend(c.gradient(c.scaled(p), 0.4, len(u), c._sums(c.scaled(u)))[1], step, quality.RATE_OVER_ALL)
    for x in (a, b):
        assert all(np.allclose(v, w) for v, w in zip(x.w, c.w, strict=True))


def test_a_repeated_label_does_not_grow_the_sample(spark):
    rows = quality.described(documents(spark, [(1, "good text")] * 500 + [(i, "bad " * i) for i in range(2, 40)]).select("doc_id", "text"))
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(1, 40)], "doc_id bigint, quality int")
    seen = []
    fit = quality.Network.fit
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality.Network, "fit", lambda self, p, u, prior: seen.append((len(p), len(u))) or fit(self, p, u, prior))
        quality.fit(rows, labels, positives=3, start=50)
    assert seen[0][0] <= 3 and seen[0][1] <= 50


def test_few_labels(spark, sf):
    rows = quality.described(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.fit(rows, none).score(np.zeros((2, quality.N_FEATURES))).tolist() == [1.0, 1.0]


def vocabulary(counts):
    words = sorted(counts, key=lambda w: (-counts[w], w))
    in_bucket = np.zeros(pseudolik.BUCKETS, np.int64)
    for w in words[pseudolik.FREQUENT :]:
        in_bucket[zlib.crc32(w) % pseudolik.BUCKETS] += counts[w]
    found = pseudolik.Vocabulary(words, np.array([counts[w] for w in words], np.int64), in_bucket)
    found.index()
    return found


def test_gradients_of_the_window_network():
    r = np.random.default_rng(0)
    words = vocabulary({w.encode(): 5 for w in "abcdefgh"})
    net = pseudolik.WindowNetwork.start(words)
    word, around = net.contexts([words.numbers(t)[0] for t in ("a b c z d e a b", "", "h g f")])
    assert len(word) == 11 and (around[:, 0] == [0, 0, 2, 3]).all()
    assert all((words.symbols(t) == words.numbers(t)[0]).all() for t in ("a b c z d e a b", "", None, "zz y"))
    loss = lambda values: -pseudolik.WindowNetwork(values).log_probabilities(word, around).mean()
    before = net.values.astype(np.float64)
    memory = [np.full(s, 1e4, np.float32) for s in net.shapes]  # a step is then the gradient over a known number
    net.train(word, around, memory)
    moved = (before - net.values) * 1e2 / pseudolik.RATE
    sizes = np.cumsum([0, *[int(np.prod(s)) for s in net.shapes]])
    for lo, hi in itertools.pairwise(sizes):
        for i in r.choice(np.arange(lo, hi)[np.abs(moved[lo:hi]) > 0.005], 3):
            up, down = before.copy(), before.copy()
            up[i] += 1e-2
            down[i] -= 1e-2
            assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(moved[i], abs=0.02, rel=0.2)


@pytest.mark.parametrize("head", [5, 900, 1 << 17])
def test_scores_equal_brute_force(spark, sf, head):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counts = pseudolik.count_words(docs).cache()
    texts = {r["doc_id"]: (r["text"] or "").encode().split() for r in docs.collect()}
    n = Counter(w for t in texts.values() for w in t)
    assert {r["word"].encode(): r["n"] for r in counts.collect()} == n
    words = pseudolik.Vocabulary.of(counts, head)
    rest = set(n) - set(words.words)
    assert len(words.words) <= head and min((n[w] for w in words.words), default=10**9) > max((n[w] for w in rest), default=0)
    net = pseudolik.fit(docs, words, rounds=2)
    got = {r["doc_id"]: r for r in pseudolik.score(docs, net, words, counts).collect()}
    assert set(got) == set(texts)
    order = sorted(n, key=lambda w: (-n[w], w))
    symbol = {w: i + 1 if i < min(head, len(words.words), pseudolik.FREQUENT) else 1 + pseudolik.FREQUENT + zlib.crc32(w) % pseudolik.BUCKETS for i, w in enumerate(order)}
    of_symbol = Counter()
    for w, k in n.items():
        of_symbol[symbol[w]] += k
    tables, bias, u, c0, v, c1 = (p.astype(np.float64) for p in net.parts)

    def log_softmax(x):
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    for i in sorted(texts)[:40]:
        t, total = texts[i], 0.0
        for p, w in enumerate(t):
            near = [symbol[t[q]] if 0 <= q < len(t) else 0 for q in (p - 2, p - 1, p + 1, p + 2)]
            h = np.tanh(sum(tables[o][x] for o, x in enumerate(near)) + bias)
            kind, inner = divmod(symbol[w], pseudolik.CLASSES)
            total += log_softmax(h @ u + c0)[kind] + log_softmax(h @ v[kind] + c1[kind])[inner] + np.log(n[w] / of_symbol[symbol[w]])
        assert got[i]["n_words"] == len(t) and got[i]["log_likelihood"] == pytest.approx(total, rel=1e-4)
        assert got[i]["n_single"] == sum(n[w] == 1 for w in t)


def test_scores_prefer_what_was_seen(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counts = pseudolik.count_words(docs).cache()
    words = pseudolik.Vocabulary.of(counts)
    net = pseudolik.fit(docs, words)
    shuffled = docs.select("doc_id", F.array_join(F.shuffle(F.split("text", r"\s+")), " ").alias("text"))
    total = lambda x, net: pseudolik.score(x, net, words, counts).agg(F.sum("log_likelihood"), F.sum("n_words")).first()
    seen, mixed, untrained = total(docs, net), total(shuffled, net), total(docs, pseudolik.WindowNetwork.start(words))
    assert seen[1] == mixed[1] and seen[0] > mixed[0] and seen[0] > untrained[0]
    # the deal of rows changes little
    other = total(docs, pseudolik.fit(docs.repartition(7), words))
    assert other[0] / other[1] == pytest.approx(seen[0] / seen[1], abs=0.15)


def test_every_word_is_told_apart(spark):
    names = [f"w{i}" for i in range(3000)]
    docs = documents(spark, [(i, " ".join(names)) for i in range(3)] + [(8, "w7 " * 5), (9, "once " + "long" * 40), (10, "long" * 40)])
    counts = pseudolik.count_words(docs)
    words = pseudolik.Vocabulary.of(counts, 1000)
    got = {r["doc_id"]: r for r in pseudolik.score(docs, pseudolik.WindowNetwork.start(words), words, counts).collect()}
    assert [got[i]["n_single"] for i in (0, 8, 9, 10)] == [0, 0, 1, 0] and len({got[i]["log_likelihood"] for i in (0, 8, 9, 10)}) == 4


# ---- fixity


def test_audit_finds_what_is_damaged_lost_and_added(spark):
    pages = spark.createDataFrame([(i, f"u{i}", prose(i, 5)) for i in range(1200)], "page_id bigint, url string, html string")
    rows = fixity.placed(fixity.numbered(fixity.records(pages))).cache()
    own = fixity.tree(rows)
    assert fixity.audit(own, fixity.tree(rows)).collect() == []
    hurt = rows.withColumn("digest", F.when(F.col("page_id").isin(7, 800), F.lit("x")).otherwise(F.col("digest"))).where("page_id <> 1199")
    more = rows.where("page_id = 3").withColumn("file", F.lit(9).cast("bigint"))
    got = fixity.audit(own, fixity.tree(hurt.unionByName(more))).collect()
    assert sorted((r["file"], r["seq"], r["hash"] is None, r["other_hash"] is None) for r in got) == [(0, 7, False, False), (1, 288, False, False), (2, 175, False, True), (9, 3, True, False)]


def test_files_of_many_records_have_parts(spark):
    pages = spark.range(1100).select(F.lit(5).cast("bigint").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    sizes = {r["part"]: r["count"] for r in fixity.placed(fixity.numbered(fixity.records(pages))).groupBy("part").count().collect()}
    assert sizes == {0: 512, 1: 512, 2: 76}


@pytest.mark.parametrize("repeats", [1, 2, 400])
def test_repeated_page_ids_are_audited_each(spark, tmp_path, repeats):
    pages = [(i // repeats, f"u{i}", prose(i, 3)) for i in range(800)] + [(None, "u", "same")] * 5 + [(5, "twice", "twice")] * 3
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(7)
    archive = fixity.numbered(fixity.records(df))
    index = fixity.store(fixity.placed(archive), "warc-index")
    order = sorted(((r["file"], r["part"], r["seq"], r["page_id"], r["digest"], r["offset"], r["length"]) for r in index.collect()), key=lambda r: r[:3])
    assert len(order) == len(pages) and len({r[:3] for r in order}) == len(pages)
    for _, file in itertools.groupby(order, lambda r: r[0]):
        file = list(file)
        assert [(r[1], r[2]) for r in file] == [divmod(n, fixity.FILE_RECORDS) for n in range(len(file))]
        assert [(r[3] or 0, r[4]) for r in file] == sorted((r[3] or 0, r[4]) for r in file)
        for _, part in itertools.groupby(file, lambda r: r[1]):
            part = list(part)
            assert [r[5] for r in part] == [0, *itertools.accumulate(r[6] for r in part)][:-1]
    assert fixity.report(index, fixity.replica_index(index, archive)).where("damaged or root <> replica_root").count() == 0
    one = archive.where("page_id is not null").agg(F.max(F.struct("page_id", "number"))).first()[0]["number"]
    bad = archive.withColumn("record", F.when(F.col("number") == one, F.encode(F.lit("x"), "utf-8")).otherwise(F.col("record")))
    hit = fixity.report(index, fixity.replica_index(index, bad)).where("damaged").collect()
    first = index.where(F.col("number") == one).first()
    assert [(r["file"], r["part"], r["seq"]) for r in hit] == [(first["file"], first["part"], first["seq"])]
    kept = archive.where("page_id is not null")
    lost = fixity.report(index, fixity.replica_index(index, kept)).collect()
    assert sum(r["damaged"] for r in lost) == 5 and {r["page_id"] for r in lost if r["replica_root"] is None} == {None}


def test_records_parse(spark):
    pages = [(1, "http://a/ü", "<p>ü\r\n\r\nx</p>"), (2, "", ""), (None, None, None), (3, "u", "y" * 100_000)]
    archive = fixity.records(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    got = fixity.parsed(archive).collect()
    assert sorted(((r["uri"], bytes(r["content"]).decode(), r["declared"]) for r in got), key=str) == sorted(((u or None, h or "", len((h or "").encode())) for _, u, h in pages), key=str)
    assert len({r["record_id"] for r in got}) == 3 and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", r["record_id"]) for r in got)
    cut = archive.withColumn("record", F.expr("substring(record, 1, octet_length(record) - 1)"))
    assert [r["content"] for r in fixity.parsed(cut).collect()] == [None] * 4


def test_audit_of_files(spark, tmp_path):
    pages = [(i % 600, f"u{i}", prose(i, 3) * (i % 3)) for i in range(1300)] + [(700, "long", "y" * 300_000)]
    archive = fixity.numbered(fixity.records(spark.createDataFrame(pages, "page_id bigint, url string, html string")))
    index = fixity.store(fixity.placed(archive), "warc-index")
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        fixity.write_files(archive, index, str(tmp_path / name))
    read = fixity.read_files(spark, str(tmp_path / "a")).collect()
    place = lambda r: (r["file"], r["part"] * fixity.FILE_RECORDS + r["seq"])
    want = {(f"{r['file']}-{r['part']}.warc", r["seq"]): (r["offset"], r["length"], r["digest"]) for r in index.collect()}
    assert {place(r): (r["offset"], r["length"], r["digest"]) for r in read} == want
    assert fixity.audit_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect() == []
    (key, (offset, length, _)), *_ = [x for x in want.items() if x[0][1] == 40]
    changed = tmp_path / "b" / key[0]
    data = bytearray(changed.read_bytes())
    data[offset + length - 5] ^= 1
    changed.write_bytes(data)
    hit = fixity.audit_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    assert [place(r) for r in hit] == [key]
    data[offset] ^= 1  # no record starts here any more: the rest of the file is one
    changed.write_bytes(data)
    hit = {place(r): (r["hash"] is None, r["other_hash"] is None) for r in fixity.audit_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert hit == {k: (False, k[1] > 40) for k in want if k[0] == key[0] and k[1] >= 40}
    (tmp_path / "b" / "new.warc").write_bytes(b"no record")
    assert ("new.warc", 0) in [place(r) for r in fixity.audit_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()]


def test_packed_files(spark, tmp_path):
    """A gzip member a record: the members' ranges, the records' digests, and damage that unpacks, does not, or ends early."""
    import gzip

    pages = spark.createDataFrame([(i, f"http://x/{i}", "word " * (i * 50)) for i in range(30)], "page_id long, url string, html string")
    archive = fixity.numbered(fixity.records(pages))
    index = fixity.store(fixity.placed(archive), "warc-index")
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        fixity.write_files(archive, index, str(tmp_path / name), packed=True)
    read = sorted(fixity.read_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r["seq"])
    plain = sorted(index.collect(), key=lambda r: r["seq"])
    file = tmp_path / "a" / "0-0.warc.gz"
    data = file.read_bytes()
    assert [r["digest"] for r in read] == [r["digest"] for r in plain]
    assert [len(gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])) for r in read] == [r["length"] for r in plain]
    assert sum(r["length"] for r in read) == len(data)
    differing = lambda: {r["seq"] for r in fixity.audit_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert differing() == set()
    other, at = tmp_path / "b" / "0-0.warc.gz", read[12]["offset"]
    end = at + read[12]["length"]
    other.write_bytes(data[: at + 20] + b"\xff\xff" + data[at + 22 :])  # cannot be unpacked: the rest of the file is one
    assert differing() == set(range(12, 30))
    other.write_bytes(data[: end - 3])  # cut within a member
    assert differing() == set(range(12, 30))
    changed = gzip.compress(gzip.decompress(data[at:end])[:-1] + b"!", mtime=0)
    other.write_bytes(data[:at] + changed + data[end:])
    assert min(differing()) == 12 and (len(changed) != end - at or differing() == {12})
    (tmp_path / "b" / "empty.warc.gz").write_bytes(b"")
    assert "empty.warc.gz" not in {r["file"] for r in fixity.read_files(spark, str(tmp_path / "b")).collect()}


def test_columns_of_an_archive_may_have_any_name(spark):
    archive = fixity.records(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")).withColumn("head_end", F.lit(7)).withColumn("_head", F.lit("x"))
    row = fixity.parsed(archive).first()
    assert (row["head_end"], row["_head"], row["uri"], bytes(row["content"])) == (7, "x", "u", b"h")


def test_items_that_share_an_id(spark):
    """They are one item, in the count as in the names, in one slice or several; rows without id are one each."""
    passages = [" ".join(f"{w}{i}" for i in range(10)) for w in "abcd"]
    docs = spark.createDataFrame([(1, " ".join(passages))], "doc_id long, text string")
    bench = spark.createDataFrame([("x", passages[0]), ("x", passages[1]), (None, passages[2]), (None, passages[3])], "item_id string, text string")
    for size in (1, 1 << 20):
        m = suffixes.find(docs, bench, slice_bytes=size).first()["matches"]
        assert (m["items"], m["n_items"]) == (["x"], 3)


def test_exact_pairs_of_buckets(spark):
    """Pairs are left out by one-bit sketches where ``apart`` says so; with ``WIDE`` none are."""
    base = [f"w{i}" for i in range(120)]
    rows = [(n, " ".join(base[:at] + [f"x{n}"] + base[at + 1 :])) for n, at in enumerate(range(5, 115, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.groups(docs, 4, apart=neardup.WIDE).collect()}
    assert found == {i: c for i, _, c in brute_groups(rows, 4)}


# ---- pipeline


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_stages(spark, request, which):
    import corpus_pipeline

    path = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path).cache()
        if name != "encoding":
            assert out.columns == docs.columns and out.count() <= docs.count()
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
            texts = {r["doc_id"] for r in out.select("doc_id").collect()}
            firsts = {c for _, n, c in brute_groups(rows, 5)}
            assert texts == firsts | {i for i in (None,) if i in texts}
        if name == "quality":
            rows = docs.select("doc_id", "text").collect()
            model = quality.fit(quality.described(docs.select("doc_id", "text")), spark.read.parquet(f"{path}/labels.parquet"))
            x = np.array([quality.describe(r["text"]) for r in rows])
            z = ((x - model.mean) / model.scale).clip(-20, 20)
            z[:, -2 * quality.GRAMS :] *= quality.GRAM_WEIGHT
            g = np.tanh(z @ model.w[0] + model.w[1]) @ model.w[2] + model.w[3][0]
            keep = Counter((r["doc_id"], r["text"]) for r, p in zip(rows, 1 / (1 + np.exp(-g)), strict=True) if p >= quality.THRESHOLD)
            assert Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()) == keep
        if name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{path}/benchmark.parquet").select("text").collect()]
            cut = [suffixes.words(t) for t in items]
            windows = {tuple(w[i : i + 10]) for w in cut if w for i in range(max(1, len(w) - 9))}
            sizes = {len(w) for w in windows}

            def leaks(text, windows=windows, sizes=sizes):
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
                w = [x.encode() for x in w]
                return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

            want = Counter((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if not leaks(r["text"]))
            assert Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()) == want
        docs = out
    run = corpus_pipeline.run(spark, path).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, run), key=str) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()), key=str)
