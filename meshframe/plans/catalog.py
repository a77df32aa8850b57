"""The queries over the derived graphs, grids, matrices, points and images, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.functions.hashing import GOLDEN, SEED, SHIFTS, with_jenkins64
from meshframe.operators import cluster, edgegrid, graph, grid, halo, image, layout, linalg, sketch, solver
from meshframe.plans.scratch import cut, new_path
from meshframe.sources import bmp, cells, derive, errors, records
from meshframe.streaming import degrees, sketches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(fn):  # noqa: ANN001, ANN202
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _with(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(derive.SQL.get(c, c) for c in ctes) + "\n" + select


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---- graphs

_DEGREE = "degree as (select id, coalesce(n, 0)::bigint degree from {v} left join (select {side} id, count(*) n from {e} group by 1) using (id))"


@query(_with("part_edges", "part_vertices", _DEGREE.format(v="part_vertices", e="part_edges", side="src"), select="select id, degree from degree"))
def graph_out_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(derive.part_vertices(spark, d), derive.part_edges(spark, d))


@query(_with("part_edges", "part_vertices", _DEGREE.format(v="part_vertices", e="part_edges", side="dst"), select="select id, degree from degree"))
def graph_in_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(derive.part_vertices(spark, d), derive.part_edges(spark, d), "dst")


@query(_with("part_edges", "part_vertices", _DEGREE.format(v="part_vertices", e="part_edges", side="src"), select="select id, 1 - 0.85e0 rank, case when degree > 0 then 1e0 / degree end delta, degree from degree"))
def graph_initial_state(spark: SparkSession, d: str) -> DataFrame:
    return graph.initial_state(derive.part_vertices(spark, d), derive.part_edges(spark, d))


@query(_with("part_edges", "part_vertices", _DEGREE.format(v="part_vertices", e="part_edges", side="src"), select="select count(*)::bigint vertices, sum(degree)::bigint edges, max(degree)::bigint largest, count(*) filter (degree = 0)::bigint sinks from degree"))
def graph_vertex_reduce(spark: SparkSession, d: str) -> DataFrame:
    """A reduction over the vertex pass."""
    found = graph.degree(derive.part_vertices(spark, d), derive.part_edges(spark, d))
    return found.agg(F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("edges"), F.max("degree").alias("largest"), F.count_if(F.col("degree") == 0).alias("sinks"))


def _pagerank_sql(v: str, e: str, rounds: int, mode: str, select: str) -> str:
    ctes = [e, v, _DEGREE.format(v=v, e=e, side="src"), "s0 as (select id, degree, case when degree > 0 then 1e0 / degree end delta from degree)"]
    for n in range(1, rounds + 1):
        delta = "total" if mode == "as_written" else "case when degree > 0 then (0.15e0 + 0.85e0 * total) / degree end"
        ctes.append(f"m{n} as (select dst id, sum(delta) total from {e} join s{n - 1} on src = id group by 1)")
        ctes.append(f"t{n} as (select d.id, degree, coalesce(total, 0e0) total from degree d left join m{n} using (id))")
        ctes.append(f"s{n} as (select id, degree, 0.15e0 + 0.85e0 * total rank, {delta} delta from t{n})")
    return _with(*ctes, select=select.format(s=f"s{rounds}"))


_RANKS = "select id, round(rank, 6) rank from {s}"


def _pagerank(name: str, v: str, e: str, rounds: int, mode: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(graph.pagerank_delta(getattr(derive, v)(spark, d), getattr(derive, e)(spark, d), rounds, mode), "rank")

    run.__name__ = name
    query(_pagerank_sql(v, e, rounds, mode, _RANKS))(run)


_pagerank("pagerank_delta_1", "part_vertices", "part_edges", 1, "as_written")
_pagerank("pagerank_as_written_3", "part_vertices", "part_edges", 3, "as_written")
_pagerank("pagerank_normalized_3", "part_vertices", "part_edges", 3, "normalized")
_pagerank("pagerank_user_3", "user_vertices", "user_edges", 3, "normalized")


@query(_pagerank_sql("part_vertices", "part_edges", 3, "normalized", "select id, round(rank, 6) rank from {s} order by round(rank, 6) desc, id limit 20"))
def pagerank_top20(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    return pagerank_normalized(spark, d).orderBy(F.desc("rank"), "id").limit(20)


def pagerank_normalized(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["pagerank_normalized_3"](spark, d)


@query(_with("part_edges", "part_vertices", _DEGREE.format(v="part_vertices", e="part_edges", side="src"), "active as (select p_partkey id from part where p_size >= 25)", select="select dst id, sum(degree)::bigint total from part_edges join degree on src = id where src in (select id from active) group by 1"))
def graph_active_subset_sum(spark: SparkSession, d: str) -> DataFrame:
    """Messages of an active set of sources."""
    edges = derive.part_edges(spark, d)
    values = graph.degree(derive.part_vertices(spark, d), edges)
    active = derive.table(spark, d, "part").where("p_size >= 25").select(F.col("p_partkey").alias("id"))
    return graph.propagate(graph.active_edges(edges, active), values, F.col("degree"), F.sum, "total")


@query(_with("part_edges", "part_vertices", _DEGREE.format(v="part_vertices", e="part_edges", side="src"), select="select id, degree from degree where id in (select p_partkey from part where p_size >= 25)"))
def graph_active_vertices(spark: SparkSession, d: str) -> DataFrame:
    """The vertex pass over an active set."""
    active = derive.table(spark, d, "part").where("p_size >= 25").select(F.col("p_partkey").alias("id"))
    return graph.degree(derive.part_vertices(spark, d), derive.part_edges(spark, d)).join(active, "id", "left_semi")


@query(_with("part_edges", "part_vertices", _DEGREE.format(v="part_vertices", e="part_edges", side="src"), select="select id, degree from degree"))
def vertex_persist(spark: SparkSession, d: str) -> DataFrame:
    """A vertex vector written to the shared folder and loaded again."""
    return cut(graph_out_degree(spark, d), "vertex-vector")


@query(_with("part_edges", select="select src id, count(*)::bigint edges, true even from part_edges group by 1"))
def edge_grid_cover(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each source as the blocks of the grid hold them, and whether no block has over twice the edges of the middle one."""
    g = edgegrid.grid(derive.part_edges(spark, d), 16)
    even = edgegrid.block_table(g).agg((F.max("edges") <= 2 * F.median("edges")).alias("even"))
    return g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("edges")).crossJoin(F.broadcast(even))  # one row


@query(_pagerank_sql("part_vertices", "part_edges", 3, "normalized", _RANKS))
def pagerank_grid_3(spark: SparkSession, d: str) -> DataFrame:
    """PageRank over the blocks of the grid."""
    return _rounded(edgegrid.pagerank(derive.part_vertices(spark, d), derive.part_edges(spark, d), 3, 16), "rank")


FRONTIER_BOUND, FRONTIER_ROUNDS = 0.1, 6


def _frontier_sql() -> list[str]:
    v, e = "part_vertices", "part_edges"
    active = f"pending > {FRONTIER_BOUND!r}::double and degree > 0"
    out = [e, v, _DEGREE.format(v=v, e=e, side="src"), "s0 as (select id, degree, 0.15e0 rank, 0.15e0 pending from degree)"]
    for n in range(1, FRONTIER_ROUNDS + 1):
        out.append(f"a{n} as (select * from s{n - 1} where {active})")
        out.append(f"m{n} as (select dst id, sum(0.85e0 * pending / degree) got from {e} join a{n} on src = id group by 1)")
        out.append(f"s{n} as (select id, degree, rank + coalesce(got, 0) rank, case when {active} then 0 else pending end + coalesce(got, 0) pending from s{n - 1} left join m{n} using (id))")
    return out


def _frontier(spark: SparkSession, d: str) -> graph.Frontier:
    return graph.pagerank_frontier(derive.part_vertices(spark, d), derive.part_edges(spark, d), FRONTIER_BOUND, FRONTIER_ROUNDS)


@query(_with(*_frontier_sql(), select=f"select id, round(rank, 6) rank, round(pending, 6) pending from s{FRONTIER_ROUNDS}"))
def pagerank_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Only vertices with enough to pass on send."""
    return _rounded(_frontier(spark, d).state.select("id", "rank", "pending"), "rank", "pending")


@query(_with(*_frontier_sql(), select=" union all ".join(f"select {n} round, count(*)::bigint vertices, sum(degree)::bigint messages from a{n}" for n in range(1, FRONTIER_ROUNDS + 1))))
def frontier_rounds(spark: SparkSession, d: str) -> DataFrame:
    """What is observed of the rounds: active vertices and their messages."""
    return spark.createDataFrame([(n, *x) for n, x in enumerate(_frontier(spark, d).rounds, 1)], "round int, vertices bigint, messages bigint")


# ---- sketches

_M = 1 << 64
PARAMETERS = sketch.Parameters(0.1)


def mix_sql(source: str, column: str = "id") -> list[str]:
    """CTEs that end in ``mixed`` with ``id, h`` (unsigned)."""
    out = [f"mix0 as (select {column} id, ({SEED}::hugeint + {column}) % {_M}::hugeint a, {SEED}::hugeint b, {GOLDEN}::hugeint c from {source})"]
    for n, by in enumerate(SHIFTS):
        own, first, last = "abc"[n % 3], "abc"[(n + 1) % 3], "abc"[(n + 2) % 3]
        left = f"((({own} - {first} - {last}) % {_M}::hugeint + {_M}::hugeint) % {_M}::hugeint)"
        moved = f"(({last} * {1 << by}::hugeint) % {_M}::hugeint)" if n % 3 == 1 else f"({last} // {1 << by}::hugeint)"
        columns = ", ".join(f"xor({left}, {moved}) {x}" if x == own else x for x in "abc")
        out.append(f"mix{n + 1} as (select id, {columns} from mix{n})")
    return [*out, f"mixed as (select id, c h from mix{len(SHIFTS)})"]


_COUNTERS = [
    f"low as (select id, h, (h % {PARAMETERS.m}::hugeint)::int reg, ((h // {PARAMETERS.m}::hugeint) % 4294967296::hugeint)::bigint l from mixed)",
    "r0 as (select id, reg, case when l = 0 then 0 else bit_count(xor(l, l - 1))::int end rank from low)",
]
_SIGNED = f"(case when h >= {1 << 63}::hugeint then h - {_M}::hugeint else h end)::bigint"


def _estimate_sql(state: str) -> str:
    p = PARAMETERS
    total = f"(coalesce(s, 0e0) + ({p.m} - coalesce(used, 0)))"
    zeros = f"({p.m} - coalesce(used, 0))"
    return (
        f"select id, round(case when {zeros} > 0 and {total} > {p.threshold!r}::double then {p.m} * ln({p.m}::double / {zeros}) else {p.alpha_mm!r}::double / {total} end, 4) estimate "
        f"from (select distinct id from {state}) left join (select id, sum(pow(2e0, -rank)) s, count(*) used from {state} where rank > 0 group by 1) using (id)"
    )


def _anf_sql(v: str, e: str, rounds: int) -> list[str]:
    out = [e, v, *mix_sql(v), *_COUNTERS, f"simple as (select distinct src, dst from {e})"]
    for n in range(1, rounds + 1):
        out.append(f"r{n} as (select id, reg, max(rank) rank from (select * from r{n - 1} union all select dst, reg, rank from simple join r{n - 1} on src = id) group by 1, 2)")
    return out


@query(_with("part_vertices", *mix_sql("part_vertices"), *_COUNTERS, select=f"select id, {_SIGNED} h, reg, rank from low join r0 using (id, reg)"))
def jenkins_hash(spark: SparkSession, d: str) -> DataFrame:
    hashed = with_jenkins64(derive.part_vertices(spark, d), "id", "h")
    return hashed.select("id", "h", sketch.register(F.col("h"), PARAMETERS).alias("reg"), sketch.first_set(F.col("h"), PARAMETERS).alias("rank"))


@query(_with("part_vertices", *mix_sql("part_vertices"), *_COUNTERS, select="select id, reg, rank from r0"))
def hll_register_init(spark: SparkSession, d: str) -> DataFrame:
    return sketch.counters(derive.part_vertices(spark, d), PARAMETERS)


@query(_with(*_anf_sql("part_vertices", "part_edges", 1), select="select id, reg, rank from r1"))
def hll_union_by_source(spark: SparkSession, d: str) -> DataFrame:
    state = sketch.counters(derive.part_vertices(spark, d), PARAMETERS)
    return sketch.union(state, sketch.sent(derive.part_edges(spark, d), state))


@query(_with("part_vertices", *mix_sql("part_vertices"), *_COUNTERS, "whole as (select 0::bigint id, reg, max(rank) rank from r0 group by reg)", select=_estimate_sql("whole")))
def hll_estimate(spark: SparkSession, d: str) -> DataFrame:
    """All parts in one counter."""
    state = sketch.counters(derive.part_vertices(spark, d), PARAMETERS).withColumn("id", F.lit(0).cast("bigint"))
    return _rounded(sketch.estimate(sketch.union(state), PARAMETERS), "estimate", digits=4)


@query(_with(*_anf_sql("user_vertices", "user_edges", 1), select=_estimate_sql("r1")))
def hyperanf_1(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sketch.hyperanf(derive.user_vertices(spark, d), derive.user_edges(spark, d), 1), "estimate", digits=4)


@query(_with(*_anf_sql("part_vertices", "part_edges", 2), select=_estimate_sql("r2")))
def hyperanf_2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sketch.hyperanf(derive.part_vertices(spark, d), derive.part_edges(spark, d), 2), "estimate", digits=4)


_FIXED_AFTER = 8


@query(_with(*_anf_sql("user_vertices", "user_edges", _FIXED_AFTER), select=_estimate_sql(f"r{_FIXED_AFTER}")))
def hyperanf_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Rounds until no counter grows; on these tables that is before the rounds of the SQL end."""
    return _rounded(sketch.hyperanf(derive.user_vertices(spark, d), derive.user_edges(spark, d), None), "estimate", digits=4)


def _grown_sql(n: int) -> str:
    part = f"select id, reg // {sketch.PART} part from r{n}"
    grown = part + " where rank > 0" if n == 0 else f"{part} left join (select id, reg, rank old from r{n - 1}) using (id, reg) where rank > coalesce(old, 0)"
    return f"select {n + 1} round, count(*)::bigint parts, coalesce(sum(n), 0)::bigint messages from (select distinct id, part from ({grown})) join (select src id, count(*) n from simple group by 1) using (id)"


@query(_with(*_anf_sql("part_vertices", "part_edges", 2), select=" union all ".join(map(_grown_sql, range(2)))))
def hyperanf_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Parts of counters that are sent in each of two rounds, and the messages they make."""
    found = sketch.balls(derive.part_vertices(spark, d), derive.part_edges(spark, d), PARAMETERS, 2)
    return spark.createDataFrame([(n, *x) for n, x in enumerate(found.rounds, 1)], "round int, parts bigint, messages bigint")


@query(_with(*_anf_sql("user_vertices", "user_edges", 2), select="select id, bool_or(r2.rank > coalesce(r1.rank, 0)) changed from r2 left join r1 using (id, reg) group by 1"))
def hll_change_flag(spark: SparkSession, d: str) -> DataFrame:
    """Which counters grew in the second round."""
    edges = derive.user_edges(spark, d).distinct()
    state = sketch.counters(derive.user_vertices(spark, d), PARAMETERS)
    one = cut(sketch.union(state, sketch.sent(edges, state)), "anf-state")
    return sketch.changed(one, sketch.union(one, sketch.sent(edges, one)))


@query(_with("part_edges", select="select dst id, count(distinct src)::bigint exact, true sketch_near, true builtin_near from part_edges group by 1"))
def approx_distinct_builtin(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources of each target by Spark's own sketches, beside the exact number, which both must come near."""
    found = derive.part_edges(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("exact"), F.hll_sketch_estimate(F.hll_sketch_agg("src")).alias("s"), F.approx_count_distinct("src").alias("b"))
    near = lambda c, share: (F.abs(F.col(c) - F.col("exact")) <= share * F.col("exact"))
    return found.select("id", "exact", near("s", 0.1).alias("sketch_near"), near("b", 0.3).alias("builtin_near"))


@query(
    "with r as (select s_suppkey id, 0.04e0 + (s_suppkey % 37) / 100e0 rsd from supplier), p as (select id, rsd, pow(2, ceil(log2(pow(1.106e0 / rsd, 2))))::int m from r), "
    "a as (select *, case m when 16 then 0.673e0 when 32 then 0.697e0 when 64 then 0.709e0 else 0.7213e0 / (1 + 1.079e0 / m) end * m * m alpha_mm from p) "
    "select id, round(rsd, 6) rsd, m, round(alpha_mm, 6) alpha_mm, round(alpha_mm / (5 * m / 2e0), 6) threshold from a"
)
def hll_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The sketch that each supplier's deviation asks for."""
    asked = derive.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (0.04 + F.col("s_suppkey") % 37 / 100.0).alias("rsd"))
    return _rounded(sketch.with_parameters(asked), "rsd", "alpha_mm", "threshold")


@query(_with(*_anf_sql("user_vertices", "user_edges", 2), *[f"e{t} as ({_estimate_sql(f'r{t}')})" for t in range(3)], select=" union all ".join(f"select {t} t, round(sum(estimate), 4) pairs from e{t}" for t in range(3))))
def neighbourhood_function(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within 0, 1 and 2 steps."""
    found = sketch.neighbourhood_function(derive.user_vertices(spark, d), derive.user_edges(spark, d), 2)
    return _rounded(found, "pairs", digits=4)


# ---- grids

_SHAPE = "shape as (select max(i) + 1 nx, 5 ny, 5 nz from grid)"
_MISSING = "((i = 0)::int + (i = nx - 1)::int + (j = 0)::int + (j = ny - 1)::int + (k = 0)::int + (k = nz - 1)::int)"


def _stencil_sql(steps: int) -> list[str]:
    out = ["grid", _SHAPE, "s0 as (select i, j, k, v from grid)"]
    for n in range(1, steps + 1):
        moved = " union all ".join(f"select i + {x}, j + {y}, k + {z}, 0.1e0 * v from s{n - 1}" for x, y, z in grid.SIDES)
        out.append(f"h{n} as (select i, j, k, (0.4e0 + 0.1e0 * {_MISSING}) * v v from s{n - 1}, shape union all {moved})")
        out.append(f"s{n} as (select i, j, k, sum(v) v from h{n}, shape where i between 0 and nx - 1 and j between 0 and ny - 1 and k between 0 and nz - 1 group by all)")
    return out


@query(_with("grid", select="select i, j, k, v from grid"))
def grid_build(spark: SparkSession, d: str) -> DataFrame:
    return derive.grid(spark, d).select("i", "j", "k", "v")


@query(_with("grid", _SHAPE, select="select x.i, j, k, ((31 * x.i + 7 * j + k) % 100)::double v from (select unnest(range(nx)) i from shape) x, range(5) y(j), range(5) z(k)"))
def grid_generate(spark: SparkSession, d: str) -> DataFrame:
    """A grid of the shape of that of the table."""
    return grid.generate(spark, derive.grid_shape(spark, d))


def _stencil(name: str, steps: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(grid.run(derive.grid(spark, d), derive.grid_shape(spark, d), steps), "v")

    run.__name__ = name
    query(_with(*_stencil_sql(steps), select=f"select i, j, k, round(v, 6) v from s{steps}"))(run)


_stencil("stencil_1", 1)
_stencil("stencil_3", 3)


@query(_with(*_stencil_sql(3), select="select count(*)::bigint cells, round(sum(v), 4) total, round(min(v), 6) least, round(max(v), 6) greatest, round(sqrt(sum(v * v)), 4) norm from s3"))
def stencil_check(spark: SparkSession, d: str) -> DataFrame:
    found = grid.check(grid.run(derive.grid(spark, d), derive.grid_shape(spark, d), 3))
    return _rounded(_rounded(found, "least", "greatest"), "total", "norm", digits=4)


@query(_with("grid", _SHAPE, select=f"select i, j, k, {_MISSING}::int missing from grid, shape"))
def grid_boundary_faces(spark: SparkSession, d: str) -> DataFrame:
    return grid.boundary_faces(derive.grid(spark, d), derive.grid_shape(spark, d))


@query(_with("grid", select="select cell, i, j, k, v from grid where cell % 100 = 99"))
def grid_sample_nth(spark: SparkSession, d: str) -> DataFrame:
    """A systematic sample: the step is the feature."""
    return grid.sample_nth(derive.grid(spark, d), 100)


# ---- layouts

_REQUESTS = "requests as (select n_nationkey::int request, (60 * (1 + n_nationkey))::bigint nx, (60 * (1 + n_regionkey))::bigint ny, 100::bigint nz, 8::bigint nodes, 100::bigint steps from nation)"
_LAYOUTS = """used as (select *, unnest(range(1, nodes + 1)) used from requests),
x as (select *, unnest(range(1, used + 1)) xp from used),
y as (select *, unnest(range(1, used // xp + 1)) yp from x where used % xp = 0),
z as (select *, used // xp // yp zp from y where (used // xp) % yp = 0),
costed as (select *, 2 * used * ((xp - 1) * ny * nz + (yp - 1) * nx * nz + (zp - 1) * nx * ny) + nx * ny * nz // steps as cost from z),
layouts as (select *, cost <= 2.5e0 * nx * ny * nz feasible from costed)"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    n = derive.table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("int").alias("request"), (60 * (1 + F.col("n_nationkey"))).alias("nx"), (60 * (1 + F.col("n_regionkey"))).alias("ny"), F.lit(100).alias("nz"), F.lit(8).alias("nodes"), F.lit(100).alias("steps"))


@query(_with(_REQUESTS, _LAYOUTS, select="select request, used, xp, yp, zp, cost, feasible from layouts"))
def layout_enumerate(spark: SparkSession, d: str) -> DataFrame:
    return layout.layouts(_requests(spark, d)).select("request", "used", "xp", "yp", "zp", "cost", "feasible")


@query(_with(_REQUESTS, _LAYOUTS, "best as (select *, row_number() over (partition by request order by used desc, cost, xp, yp) rn from layouts where feasible)", select="select r.request, coalesce(used, 1) used, coalesce(xp, 1) xp, coalesce(yp, 1) yp, coalesce(zp, 1) zp, cost from requests r left join (select request, used, xp, yp, zp, cost from best where rn = 1) using (request)"))
def layout_choose(spark: SparkSession, d: str) -> DataFrame:
    return layout.choose(_requests(spark, d))


_CUSTOMER_GRIDS = "requests as (select c_nationkey::int request, (20 * count(*))::bigint nx, (60 * count(distinct c_mktsegment))::bigint ny, greatest(1, max(c_acctbal)::bigint // 100)::bigint nz, 8::bigint nodes, 100::bigint steps from customer group by 1)"


@query(_with(_CUSTOMER_GRIDS, _LAYOUTS, "best as (select *, row_number() over (partition by request order by used desc, cost, xp, yp) rn from layouts where feasible)", select="select r.nx, r.ny, r.nz, coalesce(xp, 1)::int xp, coalesce(yp, 1)::int yp, coalesce(zp, 1)::int zp, request from requests r left join (select request, xp, yp, zp from best where rn = 1) using (request)"))
def layout_published(spark: SparkSession, d: str) -> DataFrame:
    """Layouts of grids as large as the customers of each nation, for the 8 nodes of the published layouts."""
    c = derive.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("int").alias("request"))
    asked = c.agg((20 * F.count(F.lit(1))).alias("nx"), (60 * F.count_distinct("c_mktsegment")).alias("ny"), F.greatest(F.lit(1), F.floor(F.round(F.max("c_acctbal")) / 100)).cast("bigint").alias("nz"))
    asked = asked.withColumns({"nodes": F.lit(8), "steps": F.lit(100)})
    return layout.choose(asked).join(asked, "request").select("nx", "ny", "nz", *[F.col(c).cast("int").alias(c) for c in ("xp", "yp", "zp")], "request")


LAYOUT = (4, 2, 1)
_ASSIGNED = "assigned as (select i, j, k, v, (i * 4 // nx)::int bx, (j * 2 // ny)::int by_, (k * 1 // nz)::int bz from grid, shape)"
_BLOCKS = 'blocks as (select bx, by_ "by", bz, min(i) x0, max(i) + 1 x1, min(j) y0, max(j) + 1 y1, min(k) z0, max(k) + 1 z1 from assigned group by 1, 2, 3)'


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return layout.assign(derive.grid(spark, d).select("i", "j", "k", "v"), derive.grid_shape(spark, d), LAYOUT)


@query(_with("grid", _SHAPE, _ASSIGNED, select='select i, j, k, v, bx, by_ "by", bz from assigned'))
def block_assign(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)


@query(_with("grid", _SHAPE, select='select i, j, k, v, ((i >= nx // 2)::int * 2 + least(1, (i - (i >= nx // 2)::int * (nx // 2)) // (nx // 2 // 2)))::int bx, (j // (ny // 2 + 1))::int "by" from grid, shape'))
def block_assign_shell(spark: SparkSession, d: str) -> DataFrame:
    """The solver's blocks of the plane, 4 by 2 (L3)."""
    return layout.assign_shell(derive.grid(spark, d).select("i", "j", "k", "v"), derive.grid_shape(spark, d), (4, 2))


@query(_with("grid", _SHAPE, _ASSIGNED, _BLOCKS, select="select * from blocks"))
def block_table(spark: SparkSession, d: str) -> DataFrame:
    return layout.blocks(_assigned(spark, d))


@query(_with("grid", _SHAPE, _ASSIGNED, _BLOCKS, 'moves as (select * from (values (0, -1, 0, 0), (1, 0, 1, 0), (2, 1, 0, 0), (3, 0, -1, 0), (4, 0, 0, -1), (5, 0, 0, 1)) t(side, dx, dy, dz))', select='select bx, "by", bz, side, case when bx + dx between 0 and 3 and "by" + dy between 0 and 1 and bz + dz = 0 then ((bx + dx) * 2 + "by" + dy) + bz + dz else -1 end block from blocks, moves'))
def block_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return layout.neighbours(layout.blocks(_assigned(spark, d)), LAYOUT)


@query(_with("grid", _SHAPE, _ASSIGNED, _BLOCKS, select='select bx, "by", bz, ((bx > 0)::int + (bx < 3)::int) * (y1 - y0) * (z1 - z0) + (("by" > 0)::int + ("by" < 1)::int) * (x1 - x0) * (z1 - z0) halo from blocks'))
def halo_sizes(spark: SparkSession, d: str) -> DataFrame:
    return layout.halo_sizes(layout.blocks(_assigned(spark, d)), LAYOUT)


@query(_with(*_stencil_sql(3), select="select i, j, k, round(v, 6) v from s3"))
def stencil_layout_3(spark: SparkSession, d: str) -> DataFrame:
    """The stencil over the blocks that the planner chooses for the grid."""
    return _rounded(halo.planned(derive.grid(spark, d), derive.grid_shape(spark, d), 8, 3).cells, "v")


@query(
    _with(
        "grid",
        _SHAPE,
        _ASSIGNED,
        _BLOCKS,
        'h as (select ((bx > 0)::int + (bx < 3)::int) * (y1 - y0) * (z1 - z0) + (("by" > 0)::int + ("by" < 1)::int) * (x1 - x0) * (z1 - z0) halo from blocks)',
        select="select step, sum(halo)::bigint cells from h, range(1, 4) t(step) group by 1",
    )
)
def halo_exchange(spark: SparkSession, d: str) -> DataFrame:
    """Cells that travel in each of three steps over a layout: those on inner faces, and no others."""
    sent = halo.run(derive.grid(spark, d), derive.grid_shape(spark, d), LAYOUT, 3).sent
    return spark.createDataFrame(list(enumerate(sent, 1)), "step bigint, cells bigint")


# ---- sparse matrices

# Number, x, y and z of the 19 neighbours, as the matrix files have them.
_OFFSETS = """offsets as (select * from (values (0, 0, 0, 0), (1, -1, 0, 0), (2, 1, 0, 0), (3, 0, -1, 0), (4, 0, 1, 0), (5, 1, 1, 0), (6, 1, -1, 0),
(7, -1, -1, 0), (8, -1, 1, 0), (9, 0, 0, -1), (10, -1, 0, -1), (11, 1, 0, -1), (12, 0, -1, -1), (13, 0, 1, -1),
(14, 0, 0, 1), (15, -1, 0, 1), (16, 1, 0, 1), (17, 0, -1, 1), (18, 0, 1, 1)) t(m, dx, dy, dz))"""
_COO = """near as (select cell r, i + dx + case when j + dy < 0 or j + dy >= ny then nx // 2 else 0 end x, greatest(0, least(ny - 1, j + dy)) y, k + dz z, m, nx, ny, nz from grid, shape, offsets),
coo as (select r as "row", (((x % nx) + nx) % nx * ny + y) * nz + z as col, case when m = 0 then 20e0 else -(1e0 + (r * 19 + m) % 7) / 10e0 end val from near where z between 0 and nz - 1),
vec as (select cell as "row", v val from grid)"""
_MATRIX = ["grid", _SHAPE, _OFFSETS, _COO]
_SPMV = '(select a."row", sum(a.val * b.val) val from coo a join {v} b on a.col = b."row" group by 1)'


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return linalg.build(derive.grid(spark, d).select("i", "j", "k"), derive.grid_shape(spark, d))


def _vector(spark: SparkSession, d: str) -> DataFrame:
    return derive.grid(spark, d).select(F.col("cell").alias("row"), F.col("v").alias("val"))


def _zero(spark: SparkSession, d: str) -> DataFrame:
    return derive.grid(spark, d).select(F.col("cell").alias("row"), F.lit(0.0).alias("val"))


@query(_with(*_MATRIX, select='select "row", col, val from coo'))
def coo_build(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


@query(_with(*_MATRIX, 'n as (select "row", count(*) n from coo group by 1)', select='select "row", n, coalesce(sum(n) over (order by "row" rows between unbounded preceding and 1 preceding), 0)::bigint ptr from n'))
def coo_row_ptr(spark: SparkSession, d: str) -> DataFrame:
    return linalg.row_pointers(_matrix(spark, d))


@query(_with(*_MATRIX, select="""select "row", string_agg(col::varchar, ',' order by col) cols, count(*)::int n from coo group by 1"""))
def coo_sorted_rows(spark: SparkSession, d: str) -> DataFrame:
    return linalg.sorted_rows(_matrix(spark, d)).select("row", F.array_join(F.col("cols").cast("array<string>"), ",").alias("cols"), F.size("vals").alias("n"))


@query(_with(*_MATRIX, select=f'select "row", round(val, 6) val from {_SPMV.format(v="vec")}'))
def spmv(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(linalg.spmv(_matrix(spark, d), _vector(spark, d)), "val")


@query(_with(*_MATRIX, select=f'select v."row", round(v.val - s.val, 6) val from vec v join {_SPMV.format(v="vec")} s using ("row")'))
def residual_init(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(linalg.residual(_matrix(spark, d), _vector(spark, d), _vector(spark, d)), "val")


@query(_with(*_MATRIX, select=f'select round(sqrt(sum(pow(v.val - s.val, 2))), 4) norm from vec v join {_SPMV.format(v="vec")} s using ("row")'))
def residual_norm(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(linalg.norm(linalg.residual(_matrix(spark, d), _vector(spark, d), _vector(spark, d))), "norm", digits=4)


@query(_with(*_MATRIX, select=f'select round(sum(v.val * s.val), 3) vs, round(sum(s.val * s.val), 3) ss from vec v join {_SPMV.format(v="vec")} s using ("row")'))
def vector_dot(spark: SparkSession, d: str) -> DataFrame:
    v = _vector(spark, d)
    frame = linalg.align({"v": v, "s": linalg.spmv(_matrix(spark, d), v)})
    return _rounded(linalg.dots(frame, {"vs": ("v", "s"), "ss": ("s", "s")}), "vs", "ss", digits=3)


@query(_with(*_MATRIX, select=f'select v."row", round(v.val + 0.25e0 * s.val, 6) val from vec v join {_SPMV.format(v="vec")} s using ("row")'))
def axpy(spark: SparkSession, d: str) -> DataFrame:
    v = _vector(spark, d)
    frame = linalg.align({"v": v, "s": linalg.spmv(_matrix(spark, d), v)})
    return _rounded(linalg.axpy(frame, "v", 0.25, "s", "val").select("row", "val"), "val")


@query(_with(*_MATRIX, f's1 as {_SPMV.format(v="vec")}', f's2 as {_SPMV.format(v="s1")}', select='select v."row", round(v.val + 0.5e0 * s1.val - 0.125e0 * s2.val, 6) val from vec v join s1 using ("row") join s2 using ("row")'))
def linear_combination(spark: SparkSession, d: str) -> DataFrame:
    matrix, v = _matrix(spark, d), _vector(spark, d)
    one = linalg.spmv(matrix, v)
    frame = linalg.align({"v": v, "s1": one, "s2": linalg.spmv(matrix, one)})
    return _rounded(linalg.combine(frame, "v", {"s1": 0.5, "s2": -0.125}, "val").select("row", "val"), "val")


# ---- solver

BLOCK_ROWS = 250


_TWO_STEPS = [
    *_MATRIX,
    f'q0 as {_SPMV.format(v="vec")}',
    'd0 as (select sum(v.val * q0.val) rq, sum(q0.val * q0.val) qq from vec v join q0 using ("row"))',
    'f1 as (select v."row", rq / qq * v.val x, v.val - rq / qq * q0.val r, v.val p, q0.val q from vec v join q0 using ("row"), d0)',
    'r1 as (select "row", r val from f1)',
    f'a1 as {_SPMV.format(v="r1")}',
    'b1 as (select -sum(a1.val * f1.q) / max(qq) b from a1 join f1 using ("row"), d0)',
    'f2 as (select "row", x, r, r + b * p p, a1.val + b * q q from f1 join a1 using ("row"), b1)',
    "d1 as (select sum(r * q) rq, sum(q * q) qq from f2)",
]


@query(_with(*_TWO_STEPS, select='select "row", round(x + rq / qq * p, 6) val from f2, d1'))
def gcr_unpreconditioned_2(spark: SparkSession, d: str) -> DataFrame:
    """Two steps of the solver without a preconditioner (I4)."""
    found, _ = solver.gcr(_matrix(spark, d), _vector(spark, d), _zero(spark, d), most_steps=2)
    return _rounded(found, "val")


@query(_with(*_TWO_STEPS, select="select 2 steps, false reached, round(sqrt(sum(pow(r - rq / qq * q, 2))), 4) norm from f2, d1"))
def gcr_step_limit(spark: SparkSession, d: str) -> DataFrame:
    """What the solver tells of a run that its limit of steps ends: steps, whether the tolerance was reached, the last norm."""
    _, norms = solver.gcr(_matrix(spark, d), _vector(spark, d), _zero(spark, d), most_steps=2)
    return spark.createDataFrame([(len(norms) - 1, norms[-1] <= solver.TOLERANCE, round(norms[-1], 4))], "steps int, reached boolean, norm double")


_OWN_BLOCK = f'a."row" // {BLOCK_ROWS} = a.col // {BLOCK_ROWS}'


@query(_with(*_MATRIX, select=f'select "row", col, round(sum(val), 6) product from coo a where {_OWN_BLOCK} group by 1, 2'))
def ilu0_factor(spark: SparkSession, d: str) -> DataFrame:
    """The product of the factors at the places of their pattern, which is the matrix there and nowhere else by other factors."""
    return _product(solver.ilu0(_matrix(spark, d), BLOCK_ROWS))


def _product(f: DataFrame) -> DataFrame:
    """The product of factors at the places of their pattern."""
    lower = f.where("col <= row").select(F.col("row").alias("r"), F.col("col").alias("m"), F.when(F.col("col") == F.col("row"), 1.0).otherwise(F.col("val")).alias("l"))
    upper = f.where("col >= row").select(F.col("row").alias("m"), F.col("col").alias("c"), F.col("val").alias("u"))
    product = lower.join(linalg.long(upper), "m").groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum(F.col("l") * F.col("u")).alias("product"))
    return _rounded(f.select("row", "col").join(linalg.long(product), ["row", "col"]), "product")


@query(_with(*_MATRIX, select='select "row", col, round(sum(val), 6) product from coo group by 1, 2'))
def ilu0_by_sweeps(spark: SparkSession, d: str) -> DataFrame:
    """The same of the factors of the whole matrix, found by joins."""
    return _product(solver.ilu0_by_sweeps(_matrix(spark, d))[0])


@query(_with("grid", select='select cell as "row", round(v, 6) val from grid'))
def ilu_apply(spark: SparkSession, d: str) -> DataFrame:
    """A vector through both factors and then multiplied by the upper and the lower one, which gives it back."""
    f = solver.ilu0(_matrix(spark, d), BLOCK_ROWS)
    solved = solver.ilu_solve(f, _vector(spark, d), BLOCK_ROWS)
    upper = linalg.spmv(f.where("col >= row").select("row", "col", "val"), solved)
    unit = F.when(F.col("col") == F.col("row"), 1.0).otherwise(F.col("val"))
    return _rounded(linalg.spmv(f.where("col <= row").select("row", "col", unit.alias("val")), upper), "val")


@query(_with("grid", select='select cell as "row", round(v, 2) val, true converged from grid'))
def gcr_solve(spark: SparkSession, d: str) -> DataFrame:
    """The preconditioned solver to its tolerance, over restarts: the right side is the matrix times the grid's values, which it must find (I4)."""
    matrix = _matrix(spark, d)
    found, norms = solver.gcr(matrix, linalg.spmv(matrix, _vector(spark, d)), _zero(spark, d), BLOCK_ROWS, most_steps=60)
    return _rounded(found, "val", digits=2).withColumn("converged", F.lit(norms[-1] <= solver.TOLERANCE))


# ---- clusters

K, WEIGHT = 4, 100.0
_NUMBERS, _CATEGORIES = ["n0", "n1"], ["c0", "c1"]
_SEEDS = f"k0 as (select (row_number() over (order by id) - 1)::int cluster, n0, n1, c0, c1 from points order by id limit {K})"


def _assign_sql(centres: str, out: str, numbers: list[str] = _NUMBERS, categories: list[str] = _CATEGORIES) -> str:
    squares = [f"(p.{n} - c.{n}) * (p.{n} - c.{n})" for n in numbers]
    dist = " + ".join([*squares, *[f"case when p.{c} <> c.{c} then {WEIGHT}e0 else 0e0 end" for c in categories]])
    return f"{out} as (select * from (select p.*, cluster, {dist} distance, row_number() over (partition by id order by {dist}, cluster) rn from points p, {centres} c) where rn = 1)"


def _update_sql(assigned: str, old: str, out: str, numbers: list[str] = _NUMBERS, categories: list[str] = _CATEGORIES) -> str:
    mode = lambda c: f"(select cluster, {c} from (select cluster, {c}, row_number() over (partition by cluster order by count(*) desc, {c}) rn from {assigned} group by cluster, {c}) where rn = 1)"
    means = ", ".join(f"round(avg({n}), 6) {n}" for n in numbers)
    columns = ", ".join([f"coalesce(m.{n}, o.{n}) {n}" for n in numbers] + [f"coalesce(m_{c}.{c}, o.{c}) {c}" for c in categories])
    joins = " ".join(f"left join {mode(c)} m_{c} using (cluster)" for c in categories)
    return f"{out} as (select o.cluster, {columns}, m.n from {old} o left join (select cluster, count(*) n, {means} from {assigned} group by 1) m using (cluster) {joins})"


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    points = derive.mixed_points(spark, d)
    return points, cluster.seeds(points, K)


@query(_with("points", _SEEDS, _assign_sql("k0", "a0"), select="select id, cluster, round(distance, 6) distance from a0"))
def kproto_assign(spark: SparkSession, d: str) -> DataFrame:
    points, centres = _points(spark, d)
    return _rounded(cluster.assign(points, centres, _NUMBERS, _CATEGORIES, WEIGHT).select("id", "cluster", "distance"), "distance")


@query(_with("points", _SEEDS, select=f"select id, cluster, round((p.n0 - c.n0) * (p.n0 - c.n0) + (p.n1 - c.n1) * (p.n1 - c.n1) + case when p.c0 <> c.c0 then {WEIGHT}e0 else 0e0 end + case when p.c1 <> c.c1 then {WEIGHT}e0 else 0e0 end, 6) distance from points p, k0 c"))
def kproto_distance(spark: SparkSession, d: str) -> DataFrame:
    """The distance of each point to each of the few centres."""
    points, centres = _points(spark, d)
    each = F.array(*[F.struct(F.lit(i).alias("cluster"), cluster.distance(c, _NUMBERS, _CATEGORIES, WEIGHT).alias("distance")) for i, c in enumerate(centres)])
    return _rounded(points.select("id", F.explode(each).alias("e")).select("id", "e.cluster", "e.distance"), "distance")


@query(_with("points", _SEEDS, _assign_sql("k0", "a0"), _update_sql("a0", "k0", "k1"), select="select cluster, n, n0, n1, c0, c1 from k1 where n is not null"))
def kproto_update(spark: SparkSession, d: str) -> DataFrame:
    points, centres = _points(spark, d)
    return cluster.update(cluster.assign(points, centres, _NUMBERS, _CATEGORIES, WEIGHT), _NUMBERS, _CATEGORIES)


@query(_with("points", _SEEDS, _assign_sql("k0", "a0"), _update_sql("a0", "k0", "k1"), _assign_sql("k1", "a1"), _update_sql("a1", "k1", "k2"), _assign_sql("k2", "a2"), _update_sql("a2", "k2", "k3"), _assign_sql("k3", "a3"), select="select id, cluster from a3"))
def kproto_iter3(spark: SparkSession, d: str) -> DataFrame:
    """Assignments after three rounds."""
    points = derive.mixed_points(spark, d)
    centres, _ = cluster.fit(points, K, _NUMBERS, _CATEGORIES, WEIGHT, most_rounds=3)
    return cluster.assign(points, centres, _NUMBERS, _CATEGORIES, WEIGHT).select("id", "cluster")


@query(_with("points", _SEEDS, _assign_sql("k0", "a0").replace("<>", "="), select="select id, cluster from a0"))
def kproto_assign_printed(spark: SparkSession, d: str) -> DataFrame:
    """Assignments where equal categories add to the distance, as the printed formula has it."""
    points, centres = _points(spark, d)
    return cluster.assign(points, centres, _NUMBERS, _CATEGORIES, WEIGHT, "printed").select("id", "cluster")


_KDD = [x.split(":") for x in records.KDD.split()]
_KDD_NUMBERS = [n for n, kind in _KDD if kind != "s" and n not in records.KDD_CATEGORIES]


def _kdd_value(n: int, name: str, kind: str, key: str, other: str) -> str:
    """The same rule in Spark SQL and DuckDB."""
    number = f"({key} * {n + 1} + {other}) % {2 if name in records.KDD_CATEGORIES else 50}"
    return {"i": f"cast({number} as bigint)", "d": f"cast({number} as double) / 100", "s": f"concat('{name[:3]}', cast(({key} + {n}) % 5 as varchar(9)))"}[kind]


_KDD_SQL = "points as (select o_orderkey id, " + ", ".join(f'{_kdd_value(n, name, kind, "o_orderkey", "o_custkey")} "{name}"' for n, (name, kind) in enumerate(_KDD)) + " from orders)"


def _kdd(spark: SparkSession, d: str) -> DataFrame:
    """Connection records of orders, written as a file of commas and read back."""
    made = [F.expr(_kdd_value(n, name, kind, "o_orderkey", "o_custkey").replace("varchar(9)", "string")).alias(name) for n, (name, kind) in enumerate(_KDD)]
    path = new_path(spark, "kdd")
    derive.table(spark, d, "orders").select(*made).write.csv(path)
    return records.kdd(spark, path)


@query(_with(_KDD_SQL, select="select " + ", ".join(f'"{name}"' for name, _ in _KDD) + " from points"))
def kdd_rows(spark: SparkSession, d: str) -> DataFrame:
    return _kdd(spark, d)


_KDD_CENTRES = [{n: 12.0 * c for n in _KDD_NUMBERS} | {n: f"{n[:3]}{c}" if kind == "s" else c % 2 for n, kind in _KDD if n in records.KDD_CATEGORIES} for c in range(4)]
_KDD_SEEDS = "k0 as (" + " union all ".join(f"select {i} cluster, " + ", ".join(f"""{repr(v) if not isinstance(v, float) else f'{v!r}::double'} "{n}\"""" for n, v in c.items()) for i, c in enumerate(_KDD_CENTRES)) + ")"
_KDD_STEP = {"numbers": _KDD_NUMBERS, "categories": records.KDD_CATEGORIES}


@query(_with(_KDD_SQL, _KDD_SEEDS, _assign_sql("k0", "a0", **_KDD_STEP), _update_sql("a0", "k0", "k1", **_KDD_STEP), _assign_sql("k1", "a1", **_KDD_STEP), _update_sql("a1", "k1", "k2", **_KDD_STEP), _assign_sql("k2", "a2", **_KDD_STEP), select="select cluster, label, count(*)::bigint n, round(sum(distance), 3) cost from a2 group by 1, 2"))
def kdd_kproto_2(spark: SparkSession, d: str) -> DataFrame:
    """Connection records from file to clusters in two rounds, and the labels in each."""
    points = _kdd(spark, d)
    numbered = points.withColumn("id", F.lit(0))  # seeds are given, so no key is needed
    centres, _ = cluster.fit(numbered, 4, _KDD_NUMBERS, records.KDD_CATEGORIES, WEIGHT, most_rounds=2, initial=_KDD_CENTRES)
    found = cluster.assign(points, centres, _KDD_NUMBERS, records.KDD_CATEGORIES, WEIGHT)
    return _rounded(found.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("cost")), "cost", digits=3)


@query("""with e as (select vec_id, embedding::double[] v from embeddings), s as (select (row_number() over (order by vec_id) - 1)::int cluster, v from e order by vec_id limit 10)
select vec_id, cluster from (select e.vec_id, cluster, row_number() over (partition by e.vec_id order by list_distance(e.v, s.v), cluster) rn from e, s) where rn = 1""")
def kmeans_embeddings_assign(spark: SparkSession, d: str) -> DataFrame:
    """Numbers alone: each vector and the nearest of the first ten."""
    e = derive.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    centres = [r["v"] for r in e.orderBy("vec_id").limit(10).collect()]
    return cluster.assign_vectors(e, "v", centres).select("vec_id", "cluster")


_SEED_EACH, _SEED_ROUNDS = 8.0, 3


def _draw_sql(turn: int) -> str:
    return f"(('0x' || substr(md5(id::varchar || ':{turn}'), 1, 13))::bigint / 4503599627370496e0)"


def _candidates_sql() -> list[str]:
    far = "(p.n0 - c.n0) * (p.n0 - c.n0) + (p.n1 - c.n1) * (p.n1 - c.n1)" + "".join(f" + case when p.{c} <> c.{c} then {WEIGHT}e0 else 0e0 end" for c in _CATEGORIES)
    out = ["points", f"c0 as (select *, 0 round from points order by {_draw_sql(0)}, id limit 1)"]
    for t in range(1, _SEED_ROUNDS + 1):
        every = " union all ".join(f"select * from c{n}" for n in range(t))
        out.append(f"near{t} as (select p.id, min({far}) d from points p, ({every}) c group by 1)")
        out.append(f"c{t} as (select p.*, {t} round from points p join near{t} using (id), (select sum(d) total from near{t}) where {_draw_sql(t)} < {_SEED_EACH} * d / total)")
    out.append("chosen as (select *, row_number() over (order by round, id) n from (" + " union all ".join(f"select * from c{n}" for n in range(_SEED_ROUNDS + 1)) + "))")
    out.append(f"own as (select * from (select p.id point, c.n, row_number() over (partition by p.id order by {far}, c.n) rn from points p, chosen c) where rn = 1)")
    return out


@query(_with(*_candidates_sql(), select="select id, round, count(point)::bigint weight from chosen left join own using (n) group by 1, 2"))
def kproto_seed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Oversampled seeds of the mixed points, with the points that are nearest to each."""
    found = cluster.candidates(derive.mixed_points(spark, d), _NUMBERS, _CATEGORIES, WEIGHT, _SEED_EACH, _SEED_ROUNDS)
    return spark.createDataFrame([(c["id"], c["round"], c["weight"]) for c in found], "id bigint, round int, weight bigint")


# ---- images

ANGLE, ANGLES = 0.5, [0.0, 0.7, 2.0]
_SIZE = "size as (select max(x) + 1 w, 100 h from pixels)"
_CHANNEL_BITS = {"a": 16777216, "r": 65536, "g": 256, "b": 1}


def _rotate_sql(angles: list[float], keep_frame: bool) -> str:
    turns = "turns as (select * from (values " + ", ".join(f"({n}, {math.cos(a)!r}::double, {math.sin(a)!r}::double)" for n, a in enumerate(angles)) + ") t(frame, c, s))"
    mapped = "mapped as (select frame, x, y, w // 2 + ((x - w // 2) * c - (y - h // 2) * s) sx, h // 2 + ((x - w // 2) * s + (y - h // 2) * c) sy from pixels, size, turns)"
    fx, fy = "(sx - floor(sx))", "(sy - floor(sy))"
    weights = [(0, 0, f"(1 - {fx} - {fy} + {fx} * {fy})"), (1, 0, f"({fx} - {fx} * {fy})"), (0, 1, f"({fy} - {fx} * {fy})"), (1, 1, f"({fx} * {fy})")]
    taps = "taps as (" + " union all ".join(f"select frame, x, y, (floor(sx) + {dx})::bigint tx, (floor(sy) + {dy})::bigint ty, {w} w from mapped" for dx, dy, w in weights) + ")"
    sums = ", ".join(f"floor(round(sum(w * coalesce((p.argb // {b}) % 256, 0)), 9) + 0.5)::bigint {c}" for c, b in _CHANNEL_BITS.items())
    mixed = f"mixed as (select t.frame, t.x, t.y, {sums} from taps t left join pixels p on p.x = t.tx and p.y = t.ty group by 1, 2, 3)"
    frame = "frame, " if keep_frame else ""
    return _with("pixels", _SIZE, turns, mapped, taps, mixed, select=f"select {frame}x, y, a * 16777216 + r * 65536 + g * 256 + b argb from mixed")


@query(_with("pixels", select="select x, y, argb, (argb // 16777216)::int a, ((argb // 65536) % 256)::int r, ((argb // 256) % 256)::int g, (argb % 256)::int b, argb packed from pixels"))
def argb_unpack_pack(spark: SparkSession, d: str) -> DataFrame:
    found = image.unpack(derive.pixels(spark, d))
    return found.withColumn("packed", image.pack(F.col("a"), F.col("r"), F.col("g"), F.col("b")))


@query(_with("pixels", select="select x, 99 - y y, argb from pixels"))
def row_flip(spark: SparkSession, d: str) -> DataFrame:
    return image.flip(derive.pixels(spark, d), derive.IMAGE_HEIGHT)


@query(_with("pixels", select="select x, y, argb % 16777216 argb from pixels"))
def rgb24_to_argb(spark: SparkSession, d: str) -> DataFrame:
    return image.from_rgb24(image.unpack(derive.pixels(spark, d)).drop("argb", "a"))


@query(_with("pixels", _SIZE, select=f"select x, y, round(w // 2 + ((x - w // 2) * {math.cos(ANGLE)!r}::double - (y - h // 2) * {math.sin(ANGLE)!r}::double), 6) sx, round(h // 2 + ((x - w // 2) * {math.sin(ANGLE)!r}::double + (y - h // 2) * {math.cos(ANGLE)!r}::double), 6) sy from pixels, size"))
def rotate_map(spark: SparkSession, d: str) -> DataFrame:
    found = image.rotation_map(derive.pixels(spark, d).select("x", "y"), derive.image_width(spark, d), derive.IMAGE_HEIGHT, ANGLE)
    return _rounded(found, "sx", "sy")


@query(_rotate_sql([ANGLE], False))
def rotate_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return image.rotate(derive.pixels(spark, d), derive.image_width(spark, d), derive.IMAGE_HEIGHT, ANGLE)


@query(_rotate_sql([ANGLE], False))
def rotate_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The rotation with tiles of arrays in place of four rows a pixel."""
    return image.rotate_by_tiles(derive.pixels(spark, d), derive.image_width(spark, d), derive.IMAGE_HEIGHT, ANGLE)


@query(_rotate_sql(ANGLES, True))
def rotate_frames(spark: SparkSession, d: str) -> DataFrame:
    return image.frames(derive.pixels(spark, d), derive.image_width(spark, d), derive.IMAGE_HEIGHT, ANGLES)


@query(_with("pixels", select="select x, y, argb from pixels where x between 10 and 59 and y between 20 and 79"))
def crop_region(spark: SparkSession, d: str) -> DataFrame:
    """A rectangle of the image: the cut is the feature."""
    return image.crop(derive.pixels(spark, d), 10, 20, 60, 80)


@query(_with("pixels", select="select x, y, argb from pixels"))
def image_sink(spark: SparkSession, d: str) -> DataFrame:
    """The image written to the shared folder in rows of pixels, and read again."""
    return cut(derive.pixels(spark, d).repartitionByRange("y").sortWithinPartitions("y", "x"), "image")


# ---- sources and streams

_NAMES = "names as (select * from (values " + ", ".join(f"({c}, '{n}')" for c, n in errors.codes()) + ") t(code, name))"


# each order has a code of the graphics facility, of which all of 700 numbers come, and a general one
_CODES = ["2289434624 + o_orderkey % 700", "case o_orderkey % 5 when 0 then 2147500033 when 1 then 2147500037 when 2 then 2147942487 when 3 then 2147942414 else 0 end"]


@query(_with(_NAMES, "seen as (" + " union all ".join(f"select {x} code from orders" for x in _CODES) + ")", select="select coalesce(name, '???') name, count(*)::bigint n from seen left join names using (code) group by 1"))
def error_code_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the graphics facility and general ones."""
    seen = derive.table(spark, d, "orders").select(F.explode(F.array(*[F.expr(x).cast("bigint") for x in _CODES])).alias("code"))
    return errors.with_name(seen, F.col("code")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(_with("grid", "m as (select unnest(range(19)) m)", "val as (select i, j, k, m, case when m = 0 then 20e0 else -(1e0 + (cell * 19 + m) % 7) / 10e0 end val from grid, m)", select="select i, j, k, count(*)::int n, round(sum(val), 6) total, round(max(val) filter (m = 18), 6) last from val group by 1, 2, 3"))
def text_to_grid_etl(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of all cells written as text lines, read back and gathered by cell."""
    each = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda m: linalg.coefficient(F.col("cell"), m.cast("bigint")))
    path = new_path(spark, "coefficients")
    records.write_coefficient_text(derive.grid(spark, d).select("i", "j", "k", each.alias("coef")), path)
    coef = records.coefficient_text(spark, path)
    total = F.aggregate("coef", F.lit(0.0), lambda a, x: a + x)
    return coef.select("i", "j", "k", F.size("coef").alias("n"), F.round(total, 6).alias("total"), F.round(F.element_at("coef", -1), 6).alias("last"))


@query(_with("grid", select="select i, j, k, v val from grid"))
def vector_text_etl(spark: SparkSession, d: str) -> DataFrame:
    """A vector written as text lines and read back."""
    path = new_path(spark, "vector")
    records.write_vector_text(derive.grid(spark, d).select("i", "j", "k", F.col("v").alias("val")), path)
    return records.vector_text(spark, path)


@query(_with("grid", "m as (select unnest(range(19)) m)", "val as (select i, j, k, m, case when m = 0 then 20e0 else -(1e0 + (cell * 19 + m) % 7) / 10e0 end val from grid, m)", select="select i, j, k, count(*)::int n, round(sum(val), 6) total, round(max(val) filter (m = 18), 6) last from val group by 1, 2, 3"))
def coefficient_records_etl(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of all cells written as binary records and read back."""
    each = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda m: linalg.coefficient(F.col("cell"), m.cast("bigint")))
    path = new_path(spark, "coefficients")
    records.write_coefficient_records(derive.grid(spark, d).select("i", "j", "k", each.alias("coef")), path)
    coef = records.coefficient_records(spark, path)
    total = F.aggregate("coef", F.lit(0.0), lambda a, x: a + x)
    return coef.select(*[F.col(c).cast("bigint").alias(c) for c in "ijk"], F.size("coef").alias("n"), F.round(total, 6).alias("total"), F.round(F.element_at("coef", -1), 6).alias("last"))


@query(_with("grid", select="select i, j, k, v val from grid"))
def vector_records_etl(spark: SparkSession, d: str) -> DataFrame:
    """A vector written as binary records and read back."""
    path = new_path(spark, "vector")
    records.write_vector_records(derive.grid(spark, d).select("i", "j", "k", F.col("v").alias("val")), path)
    return records.vector_records(spark, path).select(*[F.col(c).cast("bigint").alias(c) for c in "ijk"], "val")


@query(_with("grid", select="select i, j, k, v val from grid where i between 2 and 5 and j between 1 and 3"))
def cell_block_read(spark: SparkSession, d: str) -> DataFrame:
    """A block of headerless files of doubles by seeks (S14): the range is the feature."""
    path, shape = new_path(spark, "cells"), derive.grid_shape(spark, d)
    cells.write(derive.grid(spark, d).select("i", "j", "k", F.col("v").alias("val")), path, shape=shape)
    return cells.read(spark, path, shape=shape, i=(2, 6), j=(1, 4)).select(*[F.col(c).cast("bigint").alias(c) for c in "ijk"], "val")


TILE = 40


@query(_with("pixels", select=f"select x, y, case when (x // {TILE}) % 2 = 0 then argb else argb % 16777216 end argb from pixels"))
def bmp_scan(spark: SparkSession, d: str) -> DataFrame:
    """The image written as files of 32 and 24 bits a pixel by turns, and read again."""
    path = new_path(spark, "image")
    bmp.write(bmp.tiles(derive.pixels(spark, d), TILE, derive.IMAGE_HEIGHT, lambda t: 24 if t % 2 else 32), path)
    tile = F.regexp_extract("path", r"(\d+)\.bmp$", 1).cast("bigint")
    return bmp.scan(spark, path).select((tile * TILE + F.col("x")).alias("x"), "y", "argb")


# rule, place in the header, bytes that break it; the first two tiles of ten are whole
_BROKEN = [("not a bitmap", 0, b"MB"), ("offset of pixels", 10, b"\x37"), ("short information header", 14, b"\x0c"), ("size", 18, b"\0"), ("planes", 26, b"\2"), ("bits a pixel", 28, b"\x10"), ("compressed", 30, b"\1")]
_HEADER_TILE = 5
_PROBLEM = " ".join(f"when {n} then '{rule}'" for n, (rule, *_) in enumerate(_BROKEN, 2))


@query(
    _with(
        "pixels",
        f"t as (select x // {_HEADER_TILE} tile, max(x) - (x // {_HEADER_TILE}) * {_HEADER_TILE} + 1 w from pixels group by 1)",
        select=f"select tile, case when tile % 10 in (5, 9) then 0 else w end::int width, case when tile % 10 = 9 then 0 else {derive.IMAGE_HEIGHT} end::int height, case tile % 10 when 7 then 16 when 9 then 0 else 24 + 8 * (tile % 2) end::int bits, case tile % 10 {_PROBLEM} when 9 then 'short file' end problem from t",
    )
)
def bmp_headers(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of the image as files; of ten, two keep the rules of the format, one is cut short, and each other breaks one rule."""
    path, content = new_path(spark, "headers"), F.col("content")
    damaged = F.when(F.col("tile") % 10 == 9, F.substring(content, 1, 30))
    for n, (_, at, wrong) in enumerate(_BROKEN, 2):
        damaged = damaged.when(F.col("tile") % 10 == n, F.concat(F.substring(content, 1, at), F.lit(wrong), F.substring(content, at + len(wrong) + 1, 1 << 30)))
    tiles = bmp.tiles(derive.pixels(spark, d), _HEADER_TILE, derive.IMAGE_HEIGHT, lambda t: 32 if t % 2 else 24)
    bmp.write(tiles.select("tile", damaged.otherwise(content).alias("content")), path)
    tile = F.regexp_extract("path", r"(\d+)\.bmp$", 1).cast("bigint")
    return bmp.headers(spark, path).select(tile.alias("tile"), "width", "height", "bits", "problem")


@query("select user_id, count(*)::bigint events, round(sum(value), 4) total from events group by 1")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts kept over a stream of the events table."""
    return _rounded(degrees.run_available(spark, d, "events.parquet"), "total", digits=4)


_STREAMED = [*mix_sql("(select distinct user_id from events where user_id is not null)", "user_id"), *_COUNTERS, "streamed as (select e.event_type id, reg, max(rank) rank from events e join r0 on e.user_id = r0.id where event_type is not null group by all)"]


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    return sketches.run_available(spark, f"{d}/events.parquet", "event_type", "user_id", PARAMETERS, new_path(spark, "stream-registers"))


@query(_with(*_STREAMED, select="select id, reg, rank from streamed"))
def stream_registers(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the users of each type of event, kept over a stream of the events table (A5)."""
    return _streamed(spark, d)


@query(_with(*_STREAMED, select=_estimate_sql("streamed")))
def stream_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    """Estimates of those counters."""
    return _rounded(sketch.estimate(_streamed(spark, d), PARAMETERS), "estimate", digits=4)


@query(_with("grid", select="select i, j, k, v from grid where i between 2 and 5 and j between 1 and 3"))
def block_read(spark: SparkSession, d: str) -> DataFrame:
    """A block of a stored grid by ranges (S14), which skip the parts of its files that hold none of it: the range is the feature."""
    stored = cut(derive.grid(spark, d).select("i", "j", "k", "v").repartitionByRange("i", "j").sortWithinPartitions("i", "j"), "grid")
    return records.block(stored, (2, 6), (1, 4))
