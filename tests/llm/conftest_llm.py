import random

import pytest

CLASHES = ["n_tokens", "ids", "decoded", "score", "predicted", "shard", "slot", "hilbert", "matches", "features", "sketch", "edited", "text_key", "set_key", "best", "kept_id", "cid", "group", "stream", "block", "tie", "_range", "_tie", "words", "encoded_text", "searched_text", "file", "part", "seq", "record", "number", "digest", "length", "root", "row", "word", "n", "h", "good", "tokens", "inner", "anchors", "_row", "_salt", "kept_key", "row_key"]


def prose(seed: int, n: int, words: int = 300) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + r.choice("klmnopq") * r.randint(1, 3) + str(r.randint(0, words)) for _ in range(n))


def odd_documents() -> list[tuple]:
    """Null, empty, blank, short, very long, repeated and nearly equal texts; null and repeated ids."""
    base = prose(1, 200)
    near = base.split()
    near[100] = "changed"
    texts = [
        (0, base), (1, " ".join(near)), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one"), (8, "One Two"),
        (9, prose(2, 60_000)), (10, "x" * 300_000), (11, " " * 5000 + "y"), (12, "ﬁne ▁ 🙂\x00 <s></s><|endoftext|> ﷐"), (None, base), (None, None), (None, "lonely words without an id"),
        (13, prose(3, 50)), (14, "a\n\n\nb\r\n c  d   e"), (15, "same same same same same same same same"), (2, prose(4, 40)), (-7, prose(5, 30)),
    ]
    return [(i, t, *([None, "en", "de"][n % 3], [None, "s"][n % 2]), None if t is None else len(t)) for n, (i, t) in enumerate(texts)]


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def write(spark):
    """A function that writes tables to a folder and gives its path."""

    def to(path, documents, benchmark=(), labels=(), pages=(), clashes=False):
        df = spark.createDataFrame(documents, DOCUMENTS)
        tables = {"documents": df, "benchmark": spark.createDataFrame(list(benchmark), "item_id bigint, text string"), "labels": spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int"), "pages": spark.createDataFrame(list(pages), "page_id bigint, url string, html string")}
        for name, x in tables.items():
            for n, c in enumerate(CLASHES if clashes else []):
                x = x.selectExpr("*", f"cast({n} as string) as `{c}`")
            x.coalesce(2).write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return to


@pytest.fixture(scope="session")
def odd(write, tmp_path_factory):
    items = [(1, prose(2, 60_000)[5000:5400]), (2, None), (3, ""), (4, "one"), (None, prose(3, 50)), (4, "one"), (5, "nowhere at all")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(16)] + [(None, 1, 1), (3, None, 0), (4, 1, 0), (4, 0, 0)]
    pages = [(1, "http://a", "<p>x</p>"), (1, "http://a", "<p>x</p>"), (2, None, None), (None, "u", "v"), (None, None, ""), (700, "z", "y" * 100_000), (3, "http://b", "ü")]
    return write(tmp_path_factory.mktemp("odd") / "t", odd_documents(), items, labels, pages, clashes=True)


@pytest.fixture(scope="session")
def nothing(write, tmp_path_factory):
    return write(tmp_path_factory.mktemp("nothing") / "t", [])
