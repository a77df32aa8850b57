"""The two jobs: against SQL, over growing input, run again, and from the command line."""

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import registry, site_rank, vocabulary
from meshframe.plans import scratch

REPO = Path(__file__).resolve().parent.parent
DOCUMENTS = "doc_id bigint, text string, lang string, source string"


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_same_rows_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("pages", "documents"):
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found, wanted = registry.QUERIES[name](spark, sf), duck.sql(registry.SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    order = sorted(range(len(wanted.columns)), key=lambda i: wanted.columns[i])
    assert rows(found) == sorted((tuple(r[i] for i in order) for r in wanted.fetchall()), key=repr)


def test_addresses(spark):
    urls = ["http://A.example.com/x/?q#f", "https://a.example.com:81", "ftp://h/p//", "/relative", "", None, "mailto:x"]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select(site_rank.address_of(site_rank.F.col("u")).alias("a"))
    assert [r["a"] for r in found.collect()] == ["a.example.com/x", "a.example.com:81", "h/p", None, None, None, None]


def crawl(spark, path, big=60):
    html = lambda *to: " ".join(f'<a href="{t}">x</a>' for t in to)
    pages = [
        ("http://a.com/1", html("/2", "/2", "http://b.org/", "?no", "#no", "//no", "mailto:n", "")),
        ("http://a.com/2/", html("/1?q=1")),
        ("http://a.com/1#again", None),
        ("http://b.org", html("http://a.com/1")),
        (None, html("/lost")),
        ("no address", html("/lost")),
        *[(f"http://big.net/{i}", html(f"/{i + 1}")) for i in range(big)],
    ]
    spark.createDataFrame(pages, "url string, html string").selectExpr("*", "'x' address", "1 targets").write.mode("overwrite").parquet(path)
    return path


def test_site_rank_again_and_after_the_input_shrank(spark, tmp_path, caplog):
    pages, out = crawl(spark, f"{tmp_path}/pages"), f"{tmp_path}/out"
    with caplog.at_level(logging.INFO, "meshframe.jobs"):
        first = rows(site_rank.run(spark, pages, out, 4, 8))
    assert "66 records, 64 of them with a readable url" in caplog.text and f"wrote {out}/sites: 3 rows" in caplog.text
    by = {r["address"]: r for r in spark.read.parquet(f"{out}/addresses").collect()}
    assert set(by) == {"a.com", "a.com/1", "a.com/2", "b.org", "big.net", *(f"big.net/{i}" for i in range(61))}
    assert (by["a.com/1"]["in_links"], by["a.com/1"]["out_links"], by["a.com/1"]["is_page"]) == (3, 3, True)
    assert (by["big.net"]["in_links"], by["big.net"]["is_page"], by["big.net"]["tld"]) == (60, False, "net")
    assert by["big.net"]["rank"] == max(r["rank"] for r in by.values())
    sites = {r["host"]: r for r in spark.read.parquet(f"{out}/sites").collect()}
    assert (sites["big.net"]["pages"], sites["big.net"]["addresses"], sites["a.com"]["pages"]) == (60, 62, 2)
    assert rows(site_rank.run(spark, pages, out, 4, 8)) == first
    assert rows(site_rank.run(spark, pages, f"{out}2", 4, 1)) == first
    crawl(spark, pages, big=0)
    site_rank.run(spark, pages, out, 4)
    assert {r["tld"] for r in spark.read.parquet(f"{out}/addresses").collect()} == {"com", "org"}


def test_site_rank_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "url string, html string").write.parquet(f"{tmp_path}/pages")
    assert site_rank.run(spark, f"{tmp_path}/pages", f"{tmp_path}/out").collect() == []


def corpus(part):
    texts = [f"Word{i} common-word shared, {i} ÜBER" for i in range(part * 30, part * 30 + 40)] + [None, "", " .. "]
    return [(i, t, [None, "", "en", "de"][i % 4], ["s", None][i % 2]) for i, t in enumerate(texts)]


def test_vocabulary_takes_only_what_is_new(spark, tmp_path, caplog):
    path, out, mark = (f"{tmp_path}/{x}" for x in ("documents", "out", "mark"))
    add = lambda n: spark.createDataFrame(corpus(n), DOCUMENTS).coalesce(1).write.mode("append").parquet(path)
    new = lambda: [r.args[-1] for r in caplog.records if "new documents" in r.msg]
    with caplog.at_level(logging.INFO, "meshframe.jobs"):
        add(0)
        first = rows(vocabulary.run(spark, path, out, mark))
        add(1)
        add(2)
        second = rows(vocabulary.run(spark, path, out, mark, files_per_batch=1))
        third = rows(vocabulary.run(spark, path, out, mark))
    assert new() == [43, 86, 0] and second == third and first != second
    assert {r["batch"] for r in spark.read.parquet(f"{out}/registers").collect()} == {0, 1, 2}
    assert rows(vocabulary.run(spark, path, f"{out}2", f"{mark}2")) == second
    whole = spark.read.parquet(f"{out}/report")
    assert {r["lang"] for r in whole.collect()} == {"und", "en", "de"}
    assert whole.agg({"documents": "sum"}).first()[0] == 129


def test_vocabulary_repeats_a_batch_that_was_stopped(spark, tmp_path, monkeypatch):
    path, out, mark = (f"{tmp_path}/{x}" for x in ("documents", "out", "mark"))
    spark.createDataFrame(corpus(0), DOCUMENTS).coalesce(1).write.parquet(path)
    real = vocabulary.log.info

    def stop(message, *args):
        if message.startswith("wrote %s from"):
            raise RuntimeError("stopped after the files of the batch were written")
        real(message, *args)

    monkeypatch.setattr(vocabulary.log, "info", stop)
    with pytest.raises(Exception, match="stopped"):
        vocabulary.run(spark, path, out, mark)
    monkeypatch.undo()
    assert rows(vocabulary.run(spark, path, out, mark)) == rows(vocabulary.run(spark, path, f"{out}2", f"{mark}2"))


def test_vocabulary_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents")
    assert vocabulary.run(spark, f"{tmp_path}/documents", f"{tmp_path}/out", f"{tmp_path}/mark").collect() == []


def test_settings_stay(spark, sf):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.sources.partitionOverwriteMode")}
    assert scratch.job_path(spark, "x") != scratch.job_path(spark, "x")
    assert before == {k: spark.conf.get(k, None) for k in before}


@pytest.mark.parametrize(("name", "options"), [("site_rank", {"rounds": 2}), ("vocabulary", {"rsd": 0.2})])
def test_command_line(sf, tmp_path, name, options):
    table = {"site_rank": "pages", "vocabulary": "documents"}[name]
    config = {table: "set below", "output": f"{tmp_path}/out"} | options | ({"checkpoint": f"{tmp_path}/mark"} if name == "vocabulary" else {})
    (tmp_path / "config.json").write_text(json.dumps(config))
    command = [sys.executable, str(REPO / "jobs" / f"{name}.py"), "--config", str(tmp_path / "config.json"), "--set", f"{table}={sf}/{table}.parquet"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell", "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"read {sf}/{table}.parquet" in done.stderr and f"wrote {tmp_path}/out" in done.stderr
    assert list((tmp_path / "out").glob("*/*=*/*.parquet"))
