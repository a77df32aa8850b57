"""The jobs as queries: run twice into a folder of their own under ``spark.checkpoint.dir``, with SQL for what they write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import site_rank, vocabulary
from meshframe.operators import sketch
from meshframe.plans.catalog import mix_sql
from meshframe.plans.scratch import job_path

ROUNDS, RSD = 5, 0.05


def job1_site_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All addresses of ``pages``, ranked, as they stand after a second run over the same tables."""
    path = job_path(spark, "site-rank")
    for _ in range(2):
        found = site_rank.run(spark, f"{sf_dir}/pages.parquet", path, ROUNDS)
    return found


def job2_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of ``documents``, as it stands after a second run that finds nothing new."""
    path = job_path(spark, "vocabulary")
    for _ in range(2):
        found = vocabulary.run(spark, f"{sf_dir}/documents.parquet", f"{path}/tables", f"{path}/checkpoint", RSD)
    return found


def _host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1))"


def _cut(path: str) -> str:
    return f"regexp_replace({path}, '/+$', '')"


def _address(url: str) -> str:
    path = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1)"
    return f"case when {_host(url)} <> '' then {_host(url)} || {_cut(path)} end"


def _site_rank_sql() -> str:
    target = f"case when x like '/%' and x not like '//%' then host || {_cut("regexp_extract(x, '^([^?#]*)', 1)")} else {_address('x')} end"
    out = [
        f"read as (select * from (select {_address('url')} address, {_host('url')} host, coalesce(html, '') html from pages) where address is not null)",
        "found as (select address, host, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) x from read)",
        f"written as (select address source, {target} target from found)",
        "every as (select * from written union all select address, host from read where address <> host union all select host, address from read where address <> host)",
        "links as (select distinct source, target from every where target is not null and source <> target)",
        "names as (select address from read union select source from links union select target from links)",
        "outs as (select source, count(*)::bigint n from links group by 1)",
        "ins as (select target, count(*)::bigint n from links group by 1)",
        "s0 as (select address, coalesce(n, 0) degree, case when n > 0 then 1e0 / n end delta from names left join outs on address = source)",
    ]
    for k in range(1, ROUNDS + 1):
        out.append(f"m{k} as (select target, sum(delta) total from links join s{k - 1} on source = address group by 1)")
        out.append(f"t{k} as (select address, degree, 0.15e0 + 0.85e0 * coalesce(total, 0e0) rank from s0 left join m{k} on address = target)")
        out.append(f"s{k} as (select address, degree, rank, case when degree > 0 then rank / degree end delta from t{k})")
    host = "regexp_extract(address, '^([^/]*)', 1)"
    select = (
        f"select address, {host} host, address in (select address from read) is_page, coalesce(i.n, 0)::bigint in_links, degree::bigint out_links, round(rank, 6) rank, regexp_extract({host}, '([^.:]*)(:[0-9]*)?$', 1) tld "
        f"from s{ROUNDS} left join ins i on address = target"
    )
    return "with " + ",\n".join(out) + "\n" + select


def _vocabulary_sql() -> str:
    p = sketch.Parameters(RSD)
    upper = vocabulary._UPPER
    total = f"(coalesce(s, 0e0) + ({p.m} - used))"
    return ",\n".join(
        [
            "with keyed as (select case when lang <> '' then lang else 'und' end lang, case when source <> '' then source else 'und' end source, coalesce(text, '') body from documents)",
            f"split as (select lang, source, list_filter(string_split_regex(translate(body, '{upper}', '{upper.lower()}'), '{vocabulary._BETWEEN}'), lambda x: x <> '') w from keyed)",
            "counts as (select lang, source, count(*)::bigint documents, sum(len(w))::bigint words from split group by 1, 2)",
            "kinds as (select distinct lang, source, word from (select lang, source, unnest(w) word from split))",
            "numbers as (select word, ('0x' || substr(md5(word), 1, 15))::bigint number from (select distinct word from kinds))",
            "distinct_numbers as (select distinct number from numbers)",
            *mix_sql("distinct_numbers", "number"),
            f"low as (select id, (h % {p.m}::hugeint)::int reg, ((h // {p.m}::hugeint) % 4294967296::hugeint)::bigint l from mixed)",
            "ranks as (select id, reg, case when l = 0 then 0 else bit_count(xor(l, l - 1))::int end rank from low)",
            "regs as (select lang, source, reg, max(rank) rank from kinds join numbers using (word) join ranks on id = number group by 1, 2, 3)",
            "sums as (select lang, source, sum(pow(2e0, -rank)) filter (rank > 0) s, count(*) filter (rank > 0) used from regs group by 1, 2)",
            "every as (select c.lang, c.source, documents, words, s, coalesce(used, 0) used from counts c left join sums using (lang, source))",
        ]
    ) + (
        f"\nselect source, documents, words, round(case when used < {p.m} and {total} > {p.threshold!r}::double then {p.m} * ln({p.m}::double / ({p.m} - used)) else {p.alpha_mm!r}::double / {total} end, 4) distinct_words, lang from every"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_site_rank": job1_site_rank, "job2_vocabulary": job2_vocabulary}
SQL = {"job1_site_rank": _site_rank_sql(), "job2_vocabulary": _vocabulary_sql()}
