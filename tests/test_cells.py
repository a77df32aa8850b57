"""Files of records without a header: forms, blocks by seeks, and what is wrong with a file."""

import struct

import numpy as np
import pytest

from meshframe.sources import cells

SHAPE = (6, 5, 4)


def grid(n=1):
    out = []
    for i in range(SHAPE[0]):
        for j in range(SHAPE[1]):
            for k in range(SHAPE[2]):
                v = [float(1000 * i + 100 * j + 10 * k + m) for m in range(n)]
                out.append((i, j, k, v[0] if n == 1 else v))
    return out


def frame(spark, n=1):
    return spark.createDataFrame(grid(n), "i int, j int, k int, " + ("val double" if n == 1 else "coef array<double>"))


@pytest.mark.parametrize("n", [1, 19])
@pytest.mark.parametrize("headed", [False, True])
def test_there_and_back(spark, tmp_path, n, headed):
    path = str(tmp_path / "x")
    cells.write(frame(spark, n).repartition(3), path, n, headed, SHAPE)
    assert sorted(tuple(r) for r in cells.read(spark, path, n, headed, SHAPE).collect()) == grid(n)
    wanted = [r for r in grid(n) if 1 <= r[0] < 4 and 2 <= r[1] < 5]
    assert sorted(tuple(r) for r in cells.read(spark, path, n, headed, SHAPE, (1, 4), (2, 5)).collect()) == wanted
    names = [x.name for x in (tmp_path / "x").iterdir()]
    assert names and not any(x.startswith(".") for x in names)


def test_foreign_file_and_the_bytes_of_a_block(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(np.arange(120 * 19, dtype="<f8").tobytes())
    found = cells.read(spark, f"{tmp_path}/a.bin", 19, shape=SHAPE, i=(2, 4), j=(1, 3)).collect()
    assert {(r.i, r.j, r.k): r.coef[0] for r in found} == {(i, j, k): 19.0 * ((i * 5 + j) * 4 + k) for i in (2, 3) for j in (1, 2) for k in range(4)}
    planned = lambda **o: sum(p.records() for p in cells.CellsReader({"path": f"{tmp_path}/a.bin", "n": "19", "shape": "6,5,4"} | o).partitions())
    assert planned(i="2:4", j="1:3") == 2 * 2 * 4 and planned(i="2:4") == 40 and planned() == 120 and planned(i="9:12") == 0
    seen = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            seen.append((n, at))
            return self.f.read_at(n, at)

    fs, real = cells.pafs.LocalFileSystem(), cells.opened
    monkeypatch.setattr(cells, "opened", lambda p: (type("Fs", (), {"open_input_file": lambda _, q: Counting(fs.open_input_file(q)), "get_file_info": lambda _, q: fs.get_file_info(q)})(), real(p)[1]))
    reader = cells.CellsReader({"path": f"{tmp_path}/a.bin", "n": "19", "shape": "6,5,4", "i": "2:4", "j": "1:3"})
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 16 and sum(n for n, _ in seen) == 16 * 152 and [at // 152 for _, at in seen] == [44, 64]


def test_filters_become_seeks(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.arange(120, dtype="<f8").tobytes())
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        found = cells.read(spark, f"{tmp_path}/a.bin", shape=SHAPE).where("i >= 2 and i < 4 and j = 1 and val > 50")
        assert sorted(r.val for r in found.collect()) == [64.0, 65.0, 66.0, 67.0]
    finally:
        spark.conf.set(key, before)
    reader = cells.FilteredCellsReader({"path": f"{tmp_path}/a.bin", "shape": "6,5,4"})
    given = [cells.GreaterThan(("i",), 1), cells.LessThanOrEqual(("i",), 3), cells.EqualTo(("j",), 1), cells.LessThan(("val",), 3)]
    assert list(reader.pushFilters(given)) == given and reader.block == {"i": (2, 4), "j": (1, 2)}


def test_pieces_of_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PIECE", 8 * 7)
    (tmp_path / "a.bin").write_bytes(np.arange(120, dtype="<f8").tobytes())
    assert sorted(r.val for r in cells.read(spark, f"{tmp_path}/a.bin", shape=SHAPE).collect()) == list(range(120))
    assert len(cells.CellsReader({"path": f"{tmp_path}/a.bin", "shape": "6,5,4"}).partitions()) == 18


@pytest.mark.parametrize(("rows", "match"), [([0, 1, 3], "must follow"), ([0, 1, 1], "must follow")])
def test_gaps_and_doubles_are_named(spark, tmp_path, rows, match):
    df = spark.createDataFrame([(0, 0, c, 1.0) for c in rows], "i int, j int, k int, val double").coalesce(1)
    with pytest.raises(Exception, match=match):
        cells.write(df, f"{tmp_path}/x", shape=SHAPE)
    assert cells.read(spark, f"{tmp_path}/x", shape=SHAPE).collect() == []


def test_broken_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"1234567")
    with pytest.raises(Exception, match="no whole number of records"):
        cells.read(spark, f"{tmp_path}/a.bin", shape=SHAPE).collect()
    with pytest.raises(Exception, match="shape of the grid"):
        cells.read(spark, f"{tmp_path}/a.bin").collect()
    (tmp_path / "two").mkdir()
    for name in "ab":
        (tmp_path / "two" / name).write_bytes(struct.pack("<d", 1.0))
    with pytest.raises(Exception, match="must name its first cell"):
        cells.read(spark, f"{tmp_path}/two", shape=SHAPE).collect()


def test_nothing(spark, tmp_path):
    cells.write(frame(spark).where("i > 99"), f"{tmp_path}/x", shape=SHAPE)
    assert cells.read(spark, f"{tmp_path}/x", shape=SHAPE).collect() == []
