"""Small published or hand-made values."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.functions.hashing import with_jenkins64
from meshframe.operators import cluster, graph, grid, image, layout, linalg, sketch, solver
from meshframe.plans import catalog, scratch
from meshframe.sources import bmp, errors, records

EDGES = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2)]


def by_id(df, value):
    return [r[value] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(
    ("mode", "rounds", "ranks"),
    [
        ("as_written", 1, [1.0, 0.575, 2.275, 0.15]),
        ("as_written", 2, [2.275, 1.0, 1.425, 0.15]),
        ("as_written", 3, [1.425, 2.275, 3.125, 0.15]),
        ("normalized", 2, [2.08375, 0.575, 1.19125, 0.15]),
        ("normalized", 3, [1.162562, 1.035594, 1.651844, 0.15]),
    ],
)
def test_pagerank(spark, mode, rounds, ranks):
    edges = spark.createDataFrame(EDGES, "src bigint, dst bigint")
    assert by_id(graph.pagerank_delta(spark.range(4), edges, rounds, mode), "rank") == pytest.approx(ranks, abs=1e-6)


def test_sinks_and_empty_graphs(spark):
    edges = spark.createDataFrame([(0, 1)], "src bigint, dst bigint")
    state = graph.initial_state(spark.range(2), edges).orderBy("id").collect()
    assert [r["delta"] for r in state] == [1.0, None]
    none = edges.where("false")
    assert by_id(graph.pagerank_delta(spark.range(2), none, 2), "rank") == pytest.approx([0.15, 0.15])


def test_jenkins(spark):
    wanted = {0: 0x5E9AB5E58DA57395, 1: 0x2FE963595ADEC5ED, 2: 0x5B8B16BCFE1BD75A, 24: 0xE5229991B83EC973, 1999: 0x06ADEE770BFC7C31}
    df = spark.createDataFrame([(i,) for i in wanted], "id bigint")
    got = {r["id"]: r["h"] & (1 << 64) - 1 for r in with_jenkins64(df, "id", "h").collect()}
    assert got == wanted


def test_sketch_parameters():
    assert [sketch.Parameters(x).m for x in (0.4, 0.2, 0.1)] == [8, 32, 128]
    p = sketch.Parameters(0.1)
    assert p.alpha_mm == pytest.approx(11718.9917616) and p.threshold == pytest.approx(36.6218492551)


@pytest.mark.parametrize(("rounds", "sizes"), [(0, [1.0039] * 4), (1, [2.0158, 2.0158, 4.0638, 1.0039]), (2, [4.0638, 3.0357, 4.0638, 1.0039])])
def test_hyperanf(spark, rounds, sizes):
    edges = spark.createDataFrame(EDGES, "src bigint, dst bigint")
    assert by_id(sketch.hyperanf(spark.range(4), edges, rounds), "estimate") == pytest.approx(sizes, abs=1e-4)


def test_one_counter(spark):
    p = sketch.Parameters(0.1)
    for n, size in ((2000, 1996.6926), (150, 152.1240)):
        whole = sketch.union(sketch.counters(spark.range(n), p).withColumn("id", F.lit(0)))
        assert sketch.estimate(whole, p).first()["estimate"] == pytest.approx(size, abs=1e-4)


def test_stencil_spreads_from_the_centre(spark):
    shape = (3, 3, 3)
    cells = spark.range(27).select((F.col("id") / 9).cast("bigint").alias("i"), F.expr("id div 3 % 3").alias("j"), (F.col("id") % 3).alias("k"), (F.col("id") == 13).cast("double").alias("v"))
    one = {(r.i, r.j, r.k): r.v for r in grid.run(cells, shape, 1).collect()}
    assert one[1, 1, 1] == pytest.approx(0.4) and one[0, 1, 1] == pytest.approx(0.1) and one[0, 0, 1] == 0
    two = {(r.i, r.j, r.k): r.v for r in grid.run(cells, shape, 2).collect()}
    assert (two[1, 1, 1], two[0, 1, 1], two[0, 0, 1], two[0, 0, 0]) == pytest.approx((0.22, 0.09, 0.02, 0.0))
    assert grid.check(grid.run(cells, shape, 5)).first()["total"] == pytest.approx(1.0)


def test_layout(spark):
    rows = [(0, 1200, 60, 60, 8, 100), (1, 1200, 1200, 1200, 8, 100), (2, 1200, 1200, 100, 8, 100)]
    found = layout.choose(spark.createDataFrame(rows, "request int, nx int, ny int, nz int, nodes int, steps int")).orderBy("request").collect()
    assert [(r.xp, r.yp, r.zp, r.cost) for r in found] == [(8, 1, 1, 446400), (2, 2, 2, 86400000), (2, 4, 1, 9120000)]


def shell(spark, nx):
    return spark.range(nx * 25).select(F.expr("id div 25").alias("i"), F.expr("id div 5 % 5").alias("j"), (F.col("id") % 5).alias("k"))


def test_shell_matrix(spark):
    built = linalg.build(shell(spark, 8), (8, 5, 5))
    assert built.count() == 3400 == built.select("row", "col").distinct().count()
    with pytest.raises(ValueError):
        linalg.build(shell(spark, 4), (4, 5, 5))


def dense(rows, n):
    out = np.zeros((n, n))
    for r in rows:
        out[r["row"], r["col"]] += r["val"]
    return out


def test_factors_hold_on_the_pattern(spark):
    matrix = linalg.build(shell(spark, 8), (8, 5, 5)).cache()
    a = dense(matrix.collect(), 200)
    lu = dense(solver.ilu0(matrix, 50).collect(), 200)
    product = (np.tril(lu, -1) + np.eye(200)) @ np.triu(lu)
    blocks = np.arange(200) // 50
    inside = (a != 0) & (blocks[:, None] == blocks[None, :])
    assert np.allclose(product[inside], a[inside])
    b = np.arange(200.0)
    vector = spark.createDataFrame(list(enumerate(b.tolist())), "row bigint, val double")
    got = {r["row"]: r["val"] for r in solver.ilu_solve(solver.ilu0(matrix, 50), vector, 50).collect()}
    solved = np.linalg.solve(np.triu(lu), np.linalg.solve(np.tril(lu, -1) + np.eye(200), b))
    assert np.allclose([got[i] for i in range(200)], solved)


@pytest.mark.parametrize(("block_rows", "steps"), [(200, 3), (100, 6)])
def test_solver(spark, block_rows, steps):
    cells = shell(spark, 8)
    matrix = linalg.build(cells, (8, 5, 5))
    row = F.expr("(i * 5 + j) * 5 + k")
    b = cells.select(row.alias("row"), (900 + 0.1 * (row % 1000)).alias("val"))
    x, norms = solver.gcr(matrix, b, b.withColumn("val", F.lit(0.0)), block_rows)
    assert norms[-1] <= solver.TOLERANCE and all(q <= p * (1 + 1e-9) for p, q in zip(norms, norms[1:], strict=False))
    assert abs(len(norms) - 1 - steps) <= 1
    got = {r["row"]: r["val"] for r in x.collect()}
    right = 900 + 0.1 * np.arange(200)
    assert np.allclose(dense(matrix.collect(), 200) @ [got[i] for i in range(200)], right, atol=1e-4)


def test_row_pointers_over_several_blocks(spark):
    rows = [(r, c, 1.0) for r in range(50) for c in range(r % 4)]
    matrix = spark.createDataFrame(rows, "row bigint, col bigint, val double")
    got = {r["row"]: (r["n"], r["ptr"]) for r in linalg.row_pointers(matrix, 7).collect()}
    before = 0
    for r in range(50):
        if r % 4:
            assert got[r] == (r % 4, before)
            before += r % 4


def test_distance(spark):
    point = spark.createDataFrame([(1.0, 2.0, "a", "b")], "n0 double, n1 double, c0 string, c1 string")
    far, same = {"n0": 3.0, "n1": 2.0, "c0": "a", "c1": "z"}, {"n0": 1.0, "n1": 2.0, "c0": "a", "c1": "b"}
    for centre, delta, value in ((far, "mismatch", 4.5), (far, "printed", 4.5), (same, "mismatch", 0.0), (same, "printed", 1.0)):
        assert point.select(cluster.distance(centre, ["n0", "n1"], ["c0", "c1"], 0.5, delta).alias("d")).first()["d"] == value


def test_clustering_cost_does_not_grow(spark, sf):
    from meshframe.sources import derive

    _, costs = cluster.fit(derive.mixed_points(spark, sf), 5, ["n0", "n1"], ["c0", "c1"], 50.0, most_rounds=6)
    assert all(b <= a + 1e-3 for a, b in zip(costs, costs[1:], strict=False))


def test_rotation(spark):
    pixels = spark.createDataFrame([(x, y, (255 << 24) + 10 * x + y) for x in range(8) for y in range(6)], "x bigint, y bigint, argb bigint")
    same = {(r.x, r.y): r.argb for r in image.rotate(pixels, 8, 6, 0.0).collect()}
    assert same == {(r.x, r.y): r.argb for r in pixels.collect()}
    turned = image.rotate(pixels, 8, 6, math.pi).collect()
    assert len(turned) == 48 and any(r.argb == 0 for r in turned)


def test_bilinear_weights(spark):
    pixels = spark.createDataFrame([(0, 0, 10), (1, 0, 20), (0, 1, 30), (1, 1, 40)], "x bigint, y bigint, argb bigint")
    place = spark.createDataFrame([(0, 0.25, 0.5)], "n int, sx double, sy double")
    assert image.sample(pixels, place, ["n"]).first()["argb"] == 23


@pytest.mark.parametrize("bits", [24, 32])
def test_bitmaps(spark, tmp_path, bits):
    argb = np.arange(15, dtype=np.int64).reshape(3, 5) * 0x01020305 & 0xFFFFFFFF
    (tmp_path / "a.bmp").write_bytes(bmp.encode(argb, bits))
    got = np.zeros((3, 5), np.int64)
    for r in bmp.scan(spark, f"{tmp_path}/a.bmp").collect():
        got[r.y, r.x] = r.argb
    assert (got == (argb if bits == 32 else argb & 0xFFFFFF)).all()
    (tmp_path / "b.bmp").write_bytes(b"XX" + bmp.encode(argb)[2:])
    assert {r.path[-5:]: r.problem for r in bmp.headers(spark, f"{tmp_path}/*.bmp").collect()} == {"a.bmp": None, "b.bmp": "not a bitmap"}


def test_records(spark, tmp_path):
    vector = [(i, i + 1, i + 2, i / 3) for i in range(10)]
    (tmp_path / "b.bin").write_bytes(b"".join(struct.pack("<iii4xd", *v) for v in vector))
    assert sorted(tuple(r) for r in records.vector_records(spark, f"{tmp_path}/b.bin").collect()) == vector
    rows = [(i, 0, 1, [float(i + m) for m in range(19)]) for i in range(5)]
    (tmp_path / "a.bin").write_bytes(b"".join(struct.pack("<iii4x19d", *r[:3], *r[3]) for r in rows))
    assert sorted((r.i, r.coef) for r in records.coefficient_records(spark, f"{tmp_path}/a.bin").collect()) == [(r[0], r[3]) for r in rows]
    (tmp_path / "b.txt").write_text("".join(f"{i} {j} {k} {v}\n" for i, j, k, v in vector))
    assert sorted(tuple(r) for r in records.vector_text(spark, f"{tmp_path}/b.txt").collect()) == vector
    line = "0,tcp,http,SF,341,1473,0,0,0,0,0,1,0,0,0,0,0,0,0,0,0,0,7,7,0.00,0.00,0.00,0.00,1.00,0.00,0.00,24,255,1.00,0.00,0.04,0.03,0.00,0.00,0.00,0.00,normal."
    (tmp_path / "k.csv").write_text(line + "\n")
    row = records.kdd(spark, f"{tmp_path}/k.csv").first()
    assert len(row) == 42 and (row["service"], row["same_srv_rate"], row["label"]) == ("http", 1.0, "normal.")


def test_steps_by_blocks_equal_single_steps(spark):
    shape = (9, 7, 5)
    cells = grid.generate(spark, shape).where("pmod(i * 3 + j + k, 4) > 0")  # with holes, which neighbours fill
    one = cells
    for _ in range(3):
        one = grid.step(one, shape)
    key = lambda r: (r["i"], r["j"], r["k"])
    want = {key(r): r["v"] for r in one.collect()}
    for block in (2, 3, 64):
        got = {key(r): r["v"] for r in grid.run(cells, shape, 3, block=block).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def exchanges_over(plan: str, leaf: str) -> bool:
    """Whether an exchange stands between a scan named ``leaf`` and the join or aggregate above it."""
    lines = plan.split("Initial Plan")[0].split("\n")
    depth = lambda s: len(s) - len(s.lstrip(" :+-*"))
    for i, line in enumerate(lines):
        if leaf in line and "FileScan" in line:
            at = depth(line)
            for above in reversed(lines[:i]):
                if depth(above) < at:
                    at = depth(above)
                    if "Exchange" in above:
                        return True
                    if "Join" in above or "Aggregate" in above:
                        break
    return False


@pytest.mark.parametrize("which", ["pagerank", "hyperanf"])
def test_loops_do_not_exchange_their_edges_again(spark, which):
    edges = spark.createDataFrame([(i % 50, i * 7 % 50) for i in range(400)], "src bigint, dst bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.pagerank_delta(spark.range(50), edges, 3) if which == "pagerank" else sketch.hyperanf(spark.range(50), edges, 3, 0.4)
        assert found.count() == 50
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("Initial Plan")[0]
    assert final.count("Bucketed: true") >= 3 and not exchanges_over(plan, "src#")
    assert final.count("Exchange hashpartitioning") <= 4  # one a round, and the first counters by vertex


def test_codes_of_errors(spark):
    known = {0: "DD_OK", 0x887601C2: "DDERR_SURFACELOST", 0x8876021C: "DDERR_WASSTILLDRAWING", 0x8876000A: "DDERR_CANNOTATTACHSURFACE", 0x80070057: "DDERR_INVALIDPARAMS", 0x8007000E: "DDERR_OUTOFMEMORY", 0x80004001: "DDERR_UNSUPPORTED", 0x80004005: "DDERR_GENERIC", 1: "???"}
    df = spark.createDataFrame([(c,) for c in known], "code bigint")
    assert {r["code"]: r["name"] for r in errors.with_name(df, F.col("code")).collect()} == known


def test_ranges_of_a_block_reach_the_scan(spark, sf):
    plan = catalog.QUERIES["block_read"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert all(x in plan for x in ("PushedFilters", "GreaterThanOrEqual(i,2)", "LessThanOrEqual(i,5)", "GreaterThanOrEqual(j,"))


@pytest.mark.parametrize("entries", [[(0, 0, 4.0), (1, 0, 1.0)], [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)]])
def test_rows_without_a_pivot_are_named(spark, entries):
    matrix = spark.createDataFrame(entries, "row bigint, col bigint, val double")
    vector = spark.createDataFrame([(0, 1.0), (1, 1.0)], "row bigint, val double")
    with pytest.raises(Exception, match="row 1 has no pivot"):
        solver.ilu_solve(solver.ilu0(matrix, 10), vector, 10).collect()


def test_blocks_of_the_shell(spark):
    got = {(r["i"], r["j"]): (r["bx"], r["by"]) for r in layout.assign_shell(shell(spark, 10), (10, 5, 5), (4, 2)).collect()}
    assert [got[i, 0][0] for i in range(10)] == [0, 0, 1, 1, 1, 2, 2, 3, 3, 3]
    assert [got[0, j][1] for j in range(5)] == [0, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        layout.assign_shell(shell(spark, 10), (10, 5, 5), (3, 2))


def test_no_local_folder_on_a_cluster(spark):
    class Session:
        class sparkContext:
            master = "yarn"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(RuntimeError):
        scratch.folder(Session)


def test_row_pointers_over_blocks(spark):
    matrix = spark.range(300).select((F.col("id") * 2 % 101).alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))
    rows = linalg.row_pointers(matrix, 3).orderBy("row").collect()
    assert [r["ptr"] for r in rows] == [sum(x["n"] for x in rows[:i]) for i in range(len(rows))]
