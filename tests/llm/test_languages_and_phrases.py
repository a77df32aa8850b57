"""Language identification against a plain model, phrases against brute force and SQL."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import DOCUMENTS, odd_documents
from pyspark.sql import functions as F

from meshframe.llm import langid, phrases, registry

# ---- op11


def plain_kneser_ney(words: dict[str, int]):
    """``p(character | what stands before it in the word)`` by dictionaries of strings."""
    raw = [Counter() for _ in range(langid.ORDER + 1)]
    for w, n in words.items():
        s = f" {w} "
        for i in range(1, len(s)):
            for m in range(1, min(langid.ORDER, i + 1) + 1):
                raw[m][s[i - m + 1 : i + 1]] += n
    counts = [None, *[Counter(c) for c in raw[1:]]]
    for m in range(1, langid.ORDER):
        left = Counter(g[1:] for g in raw[m + 1])
        for g in counts[m]:
            starts = m > 1 and g[0] == " "
            counts[m][g] = raw[m][g] if starts or not left[g] else left[g]
    discount, total, kinds = {}, [None, *[Counter() for _ in range(langid.ORDER)]], [None, *[Counter() for _ in range(langid.ORDER)]]
    for m in range(1, langid.ORDER + 1):
        once, twice = (sum(n == k for n in counts[m].values()) for k in (1, 2))
        discount[m] = once / (once + 2 * twice) if once and twice else 0.5
        for g, n in counts[m].items():
            total[m][g[:-1]] += n
            kinds[m][g[:-1]] += 1

    def p(c: str, before: str) -> float:
        before = before[max(0, len(before) - langid.ORDER + 1) :]
        m = len(before) + 1
        lower = 1 / (len(counts[1]) + 1) if m == 1 else p(c, before[1:])
        if not total[m][before]:
            return lower
        return max(counts[m][before + c] - discount[m], 0) / total[m][before] * (before + c in counts[m]) + discount[m] * kinds[m][before] / total[m][before] * lower

    return p


def test_kneser_ney_is_the_plain_one():
    words = {"banana": 7, "bandana": 1, "an": 3, "cabana": 2, "b": 1, "nab": 2, "abracadabra": 1}
    levels, none = langid.model_of(sorted(words), np.array([words[w] for w in sorted(words)]))
    models = langid.Models(["x"], [levels], [none])
    p = plain_kneser_ney(words)
    for w in [*words, "bananas", "zzz", "cab", "q", "dana"]:
        s = f" {w} "
        wanted = sum(math.log(p(s[i], s[:i])) for i in range(1, len(s)))
        got = models.score_words([w])[0]
        assert got[0] == pytest.approx(wanted, rel=1e-5) and got[1] == len(w) + 1
    for before in (" ", " b", " ban", " zz"):  # probabilities of all characters and of one never seen
        assert sum(p(c, before) for c in [*"abcdnr ", "?"]) == pytest.approx(1, rel=1e-9)


def test_texts_are_sums_of_words():
    levels, none = langid.model_of(["some", "words"], np.array([2, 3]))
    scorer = langid._Scorer(langid.Models(["x"], [levels], [none]))
    texts = ["some words", "", None, "words 12 WORDS!", "123 _ ½", "some " * 3]
    sums = scorer.texts(pa.array(texts))
    one = lambda w: scorer.models.score_words([w])[0]
    assert np.allclose(sums, [one("some") + one("words"), 0 * one("x"), 0 * one("x"), 2 * one("words"), 0 * one("x"), 3 * one("some")])
    long = ("some words " * langid.STRETCH) + "x" * 200
    assert [len(x) for x in langid.words_of(long)] == [langid.STRETCH, langid.STRETCH, 4]


def test_held_out_languages(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = registry.queries()["op11_langid"](spark, sf).join(documents, "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_undetermined_and_rejected(spark, odd):
    rows = registry.queries()["op11_langid"](spark, odd).collect()
    text = {(i, t) for i, t, *_ in odd_documents()}
    none = {i for i, t in text if i is not None and not any(c.isalpha() for c in t or "")}
    for r in rows:
        if r["doc_id"] in none:
            assert (r["lang_pred"], r["score"], r["rejected"], r["cross_entropy"]) == ("und", 0.0, True, None)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "de")
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)


def test_foreign_text_is_rejected(spark):
    r = np.random.default_rng(1)
    make = lambda letters: " ".join("".join(r.choice(list(letters), 5)) for _ in range(60))
    rows = [(i, make("abcdefg" if i % 2 else "hijklmn"), "odd" if i % 2 else "even", None, 0) for i in range(400)]
    models = langid.fit(spark.createDataFrame(rows, DOCUMENTS))
    asked = spark.createDataFrame([(0, make("abcdefg")), (1, make("hijklmn")), (2, make("уфхцчшщ"))], "id int, text string")
    found = {x["id"]: x for x in langid.identify(asked, models).collect()}
    assert [found[i]["lang_pred"] for i in (0, 1)] == ["odd", "even"]
    assert found[0]["score"] > 0.9 and not found[0]["rejected"] and found[2]["rejected"]
    assert not langid.fit(spark.createDataFrame([], DOCUMENTS)).langs


def test_sample_is_bounded_and_covers_long_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20_000)
    long = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(400_000))
    rows = [(1, long, "a"), *[(i, "short text of few words", "b") for i in range(2, 4000)]]
    found = {r["lang"]: r["n"] for r in langid.sampled_words(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    assert found.get("a", 0) <= langid.STRETCH and 2000 < found["b"] < 8000


# ---- op12


def brute_force(rows, least=phrases.LEAST, reported=phrases.REPORTED):
    counts = defaultdict(Counter)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for m in (1, 2, 3):
                counts[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items() if len(q) > len(p)):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:reported], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_rows():
    r = np.random.default_rng(3)
    words = ["the", "New", "york", "a", "b", "ßtraße", "x\u0085y", "\x00", "of", "co-op"]
    texts = [" ".join(r.choice(words, 30, p=[0.2, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05, 0.02, 0.05, 0.03])) for _ in range(40)]
    texts += ["a a a a a a a. A a\ta  a", "new york city\r\nnew york city" * 12, None, "", " . ", "rare words alone", "x" * 100_000, "of\x0bthe\x0cof the " * 15]
    return [(t, ["en", None, "de", "und"][i % 4]) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("most", "least", "reported"), [(1 << 24, 10, 2000), (0, 10, 2000), (20, 3, 5), (1 << 24, 2, 7)])
def test_phrases_by_brute_force(spark, most, least, reported):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(map(tuple, phrases.mine(docs, least, reported, most).collect()))
    assert got == brute_force(rows, least, reported)


@pytest.mark.parametrize("which", ["odd", "nothing", "sf"])
def test_phrases_by_sql(spark, request, which):
    path = request.getfixturevalue(which)
    duck = duckdb.connect()
    glob = "" if which == "sf" else "/*.parquet"
    duck.sql(f"create view documents as select * from '{path}/documents.parquet{glob}'")
    found = registry.queries()["op12_phrases"](spark, path)
    wanted = duck.sql(phrases.SQL["op12_phrases"])
    assert found.columns == wanted.columns and sorted(map(tuple, found.collect())) == sorted(wanted.fetchall())


def test_a_clash_of_hashes_takes_another_seed(spark, monkeypatch):
    rows = [("one two three " * 12, "en"), ("two one " * 12, "en")]
    real, seeds = phrases.counted, []

    def clashing(docs, seed):
        seeds.append(seed)
        found = real(docs, seed)
        return found.withColumn("clash", F.lit(True)) if seed == 42 else found

    monkeypatch.setattr(phrases, "counted", clashing)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.mine(docs).collect())) == brute_force(rows) and seeds == [42, 43]


def test_streams_cut_between_pieces_and_within_long_ones(spark, monkeypatch):
    monkeypatch.setattr(phrases, "STREAM", 7)
    monkeypatch.setattr(phrases, "HELD_IDS", 16)
    monkeypatch.setattr(phrases, "HELD_WORDS", 5)
    rows = phrase_rows()
    got = sorted(map(tuple, phrases.mine(spark.createDataFrame(rows, "text string, lang string").coalesce(1)).collect()))
    assert got == brute_force(rows)
