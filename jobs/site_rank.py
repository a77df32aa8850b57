"""Rank the addresses and sites of a crawl by its links.

    spark-submit jobs/site_rank.py --config jobs/site_rank.json

Reads page records (``url, html``), makes the link graph, and writes two tables under ``output``:

* ``addresses``, partitioned by ``tld``: each page or link target with its links in and out and its rank;
* ``sites``, partitioned by ``tld``: each host with its pages, addresses, links from other addresses, and the sum of ranks.

An address is host and path, without query, fragment or slash at the end.  A page links to the targets of
its ``href`` attributes that are whole addresses or absolute paths, each once, to the root of its site, and the
root back to it.  Ranks are those of PageRank-Delta in its normalized mode after ``rounds`` rounds,
over a grid of edges that splits the links of large sites.

Every run writes both tables whole, so a run that is repeated, or that was stopped, ends with the same tables.
Pages without a readable url are counted in the log and left out; a page with several records counts once.
"""

from __future__ import annotations

import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from meshframe.operators import edgegrid, graph
from meshframe.plans.scratch import cut, release

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)"


def host_of(url: Column) -> Column:
    """The host of a whole address, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def address_of(url: Column) -> Column:
    """Host and path of a whole address; null where there is none."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+$", "")))


def targets(html: Column, url: Column) -> Column:
    """The distinct addresses that a page links to, as an array without nulls."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('href="([^"]*)"'), 1)
    own = host_of(url)

    def whole(x: Column) -> Column:
        absolute = x.startswith("/") & ~x.startswith("//")
        return F.when(absolute, F.concat(own, F.regexp_replace(F.regexp_extract(x, "^([^?#]*)", 1), "/+$", ""))).otherwise(address_of(x))

    return F.array_distinct(F.filter(F.transform(found, whole), lambda x: x.isNotNull()))


def links(pages: DataFrame) -> DataFrame:
    """``source, target, kind`` of ``address, host, targets``: links between addresses, each once."""
    written = pages.select(F.col("address").alias("source"), F.explode("targets").alias("target"))
    inner = pages.where("address <> host")
    up = inner.select(F.col("address").alias("source"), F.col("host").alias("target"))
    down = inner.select(F.col("host").alias("source"), F.col("address").alias("target"))
    return written.unionByName(up).unionByName(down).where("source <> target").distinct()


def run(spark: SparkSession, pages: str, output: str, rounds: int = 5, blocks: int = 64) -> DataFrame:
    """Write both tables and give that of the addresses, read back."""
    url, records = F.col("url"), spark.read.parquet(pages).select("url", "html")
    read = records.select(address_of(url).alias("address"), host_of(url).alias("host"), targets(F.col("html"), url).alias("targets")).where("address is not null")
    stored = cut(read, "site-pages")
    log.info("read %s: %s records, %s of them with a readable url", pages, records.count(), stored.count())  # both from the ends of files

    named = cut(links(stored), "site-links")
    names = stored.select("address").union(named.select("target")).union(named.select("source")).distinct()
    key = lambda c: F.unhex(F.md5(c))  # noqa: E731  names of 16 bytes, whatever the length of an address
    vertices = cut(names.select(key("address").alias("id"), "address"), "site-names")
    edges = named.select(key("source").alias("src"), key("target").alias("dst"))
    ranks = edgegrid.pagerank(vertices.select("id"), edges, rounds, blocks)
    out = graph.degree(vertices, edges, "src").withColumnRenamed("degree", "out_links")
    into = graph.degree(vertices, edges, "dst").withColumnRenamed("degree", "in_links")
    own = stored.select(key("address").alias("id")).distinct().withColumn("is_page", F.lit(True))
    host = F.regexp_extract("address", "^([^/]*)", 1)
    found = vertices.join(out, "id").join(into, "id").join(ranks, "id").join(own, "id", "left")
    found = found.select("address", host.alias("host"), F.coalesce("is_page", F.lit(False)).alias("is_page"), "in_links", "out_links", F.round("rank", 6).alias("rank"), F.regexp_extract(host, r"([^.:]*)(:[0-9]*)?$", 1).alias("tld"))
    found = _written(found, f"{output}/addresses")
    sites = found.groupBy("tld", "host").agg(F.count_if("is_page").alias("pages"), F.count(F.lit(1)).alias("addresses"), F.sum("in_links").alias("in_links"), F.round(F.sum("rank"), 4).alias("rank"))
    _written(sites, f"{output}/sites")
    release(stored, named, vertices)
    return found


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written by ``tld`` in place of what was there, logged, and read back."""
    df.write.mode("overwrite").partitionBy("tld").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    log.info("wrote %s: %s rows", path, back.count())
    return back


if __name__ == "__main__":
    main(run, __doc__)
