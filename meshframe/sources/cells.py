"""Files of fixed-width records of grid cells, read by byte ranges and written by tasks.

A file holds doubles and no header: ``n`` of them a record (19 coefficients, or one value).  In ``headed`` files
a record begins with three ints ``i, j, k`` and four bytes of padding, and records may stand in any order.
Without these, a record's place is its cell, ``(i * ny + j) * nz + k``; a folder of such files has, in
the name of each, the cell of its first record (``cells-<first>``), and a lone file begins with cell 0.

A block of the plane, given as ranges of ``i`` and ``j``, becomes seeks where places are cells: only its bytes
are read.  Ranges come as options, or from filters where the session lets filters reach such sources.

Paths are local or of a store that Arrow's file systems open (``file:``, ``hdfs:``, ``s3:``, ...).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

COEFFICIENTS = 19
PIECE = 8 << 20  # bytes of a task's part of a file


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Form:
    """What the options say of a record."""

    n: int
    headed: bool
    shape: tuple[int, int, int] | None

    @staticmethod
    def of(options: dict[str, str]) -> Form:
        shape = tuple(int(x) for x in options["shape"].split(",")) if options.get("shape") else None
        headed = options.get("headed", "false") == "true"
        if not headed and not shape:
            raise ValueError("records without i, j and k need the shape of the grid")
        return Form(int(options.get("n", 1)), headed, shape)

    @property
    def record(self) -> np.dtype:
        head = [("i", "<i4"), ("j", "<i4"), ("k", "<i4"), ("pad", "V4")] if self.headed else []
        return np.dtype([*head, ("v", "<f8", (self.n,))])

    @property
    def arrow(self) -> pa.Schema:
        value = pa.field("val", pa.float64()) if self.n == 1 else pa.field("coef", pa.list_(pa.float64()))
        return pa.schema([*[pa.field(c, pa.int32()) for c in "ijk"], value])

    @property
    def ddl(self) -> str:
        return "i int, j int, k int, " + ("val double" if self.n == 1 else "coef array<double>")


@dataclass
class Piece(InputPartition):
    """Runs of records of one file: ``(place in the file, records)``; ``first`` is the cell of the file's first record."""

    path: str
    first: int
    runs: list[tuple[int, int]]

    def records(self) -> int:
        return sum(n for _, n in self.runs)


class CellsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.form = options["path"], Form.of(options)
        self.block = {c: self._range(options.get(c)) for c in "ij"}

    @staticmethod
    def _range(text: str | None) -> tuple[int, int]:
        low, _, high = (text or ":").partition(":")
        return int(low or 0), int(high) if high else 1 << 31

    def _files(self) -> Iterator[tuple[str, int, int]]:
        """Path, cell of the first record, and number of records of each file."""
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file and x.base_name[0] not in "._"]
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        for x in sorted(files, key=lambda x: x.base_name):
            if x.size % self.form.record.itemsize:
                raise ValueError(f"{x.path}: {x.size} bytes are no whole number of records of {self.form.record.itemsize}")
            named = re.search(r"cells-(\d+)", x.base_name)
            if not named and len(files) > 1 and not self.form.headed:
                raise ValueError(f"{x.path}: one of several files must name its first cell")
            yield x.path, int(named[1]) if named else 0, x.size // self.form.record.itemsize

    def _runs(self, first: int, n: int) -> Iterator[tuple[int, int]]:
        """The records of a file that a block can hold."""
        if self.form.headed:
            yield 0, n
            return
        nx, ny, nz = self.form.shape
        (i0, i1), (j0, j1) = [(max(0, low), min(high, most)) for (low, high), most in zip(self.block.values(), (nx, ny), strict=True)]
        lines = [(i0 * ny * nz, i1 * ny * nz)] if (j0, j1) == (0, ny) else (((i * ny + j0) * nz, (i * ny + j1) * nz) for i in range(max(i0, first // (ny * nz)), min(i1, (first + n) // (ny * nz) + 1)))
        for low, high in lines:
            low, high = max(low, first), min(high, first + n)
            if low < high:
                yield low - first, high - low

    def partitions(self) -> list[Piece]:
        most = max(1, PIECE // self.form.record.itemsize)
        out: list[Piece] = []
        for path, first, n in self._files():
            piece = Piece(path, first, [])
            for at, count in self._runs(first, n):
                while count:
                    room = most - piece.records()
                    piece.runs.append((at, min(room, count)))
                    at, count = at + min(room, count), count - min(room, count)
                    if piece.records() == most:
                        out.append(piece)
                        piece = Piece(path, first, [])
            if piece.runs:
                out.append(piece)
        return out or [Piece("", 0, [])]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        form, record = self.form, self.form.record
        fs, _ = opened(self.path)
        parts = []
        if piece.runs:
            with fs.open_input_file(piece.path) as f:
                for at, count in piece.runs:
                    parts.append((at, np.frombuffer(f.read_at(count * record.itemsize, at * record.itemsize), record)))
        for at, x in parts:
            if form.headed:
                inside = np.logical_and.reduce([(x[c] >= low) & (x[c] < high) for c, (low, high) in self.block.items()])
                x = x[inside]
                i, j, k = x["i"], x["j"], x["k"]
            else:
                _, ny, nz = form.shape
                cell = piece.first + at + np.arange(len(x))
                i, j, k = cell // (ny * nz), cell // nz % ny, cell % nz
            flat = pa.array(np.ascontiguousarray(x["v"]).ravel())
            value = flat if form.n == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, form.n, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in (i, j, k)], value], schema=form.arrow)


class FilteredCellsReader(CellsReader):
    """For sessions that let filters reach such sources; others reject a reader that takes any."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Narrow the block by comparisons of ``i`` and ``j``; Spark applies all filters again."""
        for f in filters:
            column = getattr(f, "attribute", (None,))
            if len(column) == 1 and column[0] in self.block and isinstance(getattr(f, "value", None), int):
                low, high = self.block[column[0]]
                least = {GreaterThanOrEqual: f.value, GreaterThan: f.value + 1, EqualTo: f.value}.get(type(f), low)
                most = {LessThan: f.value, LessThanOrEqual: f.value + 1, EqualTo: f.value + 1}.get(type(f), high)
                self.block[column[0]] = (max(low, least), min(high, most))
            yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # hidden name, name


class FolderWriter(DataSourceArrowWriter):
    """Files under hidden names, which get their own when all tasks have ended well; a repeated attempt leaves none that is read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.options = options["path"], options
        fs, root = opened(self.path)
        fs.create_dir(root)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterable[bytes]]]:
        """Name and content of each file of a task."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        made = []
        for name, content in self.files(iterator):
            hidden = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(hidden) as f:
                for x in content:
                    f.write(x)
            made.append((hidden, f"{root}/{name}"))
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            for hidden, name in m.files if m else []:
                fs.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            for hidden, _ in m.files if m else []:
                fs.delete_file(hidden)


class CellsWriter(FolderWriter):
    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterable[bytes]]]:
        form = Form.of(self.options)
        waiting = (b for b in batches if b.num_rows)
        head = next(waiting, None)
        if head is None:
            return
        first = None

        def content() -> Iterator[bytes]:
            nonlocal first
            following = first
            for b in (head, *waiting):
                x = np.zeros(b.num_rows, form.record)
                values = b.column(3) if form.n == 1 else b.column(3).flatten()
                x["v"] = values.to_numpy(zero_copy_only=False).reshape(-1, form.n)
                if form.headed:
                    for n, c in enumerate("ijk"):
                        x[c] = b.column(n).to_numpy()
                else:
                    cell = _cell(b, form.shape)
                    if (cell != following + np.arange(len(cell))).any():
                        raise ValueError(f"cells of a file must follow each other; after {following - 1} came {cell[cell != following + np.arange(len(cell))][0]}")
                    following += len(cell)
                yield x.tobytes()

        if form.headed:
            name = f"part-{uuid.uuid4().hex}"
        else:
            first = int(_cell(head.slice(0, 1), form.shape)[0])
            name = f"cells-{first:018d}"
        yield name, content()


def _cell(b: pa.RecordBatch, shape: tuple[int, int, int]) -> np.ndarray:
    i, j, k = (b.column(n).to_numpy().astype(np.int64) for n in range(3))
    return (i * shape[1] + j) * shape[2] + k


class Cells(DataSource):
    """The source and sink ``cells``."""

    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self) -> str:
        return Form.of(self.options).ddl

    def reader(self, schema) -> CellsReader:  # noqa: ANN001, ARG002
        return (FilteredCellsReader if self.options.get("pushed") == "true" else CellsReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> CellsWriter:  # noqa: ANN001, ARG002
        return CellsWriter(dict(self.options))


class FilesWriter(FolderWriter):
    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterable[bytes]]]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                yield name.as_py(), [content.as_py()]


class Files(DataSource):
    """The sink ``named_files``: a file for each row of ``name, content``; Spark's ``binaryFile`` reads them."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:  # noqa: ANN001, ARG002
        return FilesWriter(dict(self.options))


def _options(n: int, headed: bool, shape: tuple[int, int, int] | None) -> dict[str, str]:
    return {"n": str(n), "headed": str(headed).lower()} | ({"shape": ",".join(map(str, shape))} if shape else {})


def read(spark: SparkSession, path: str, n: int = 1, headed: bool = False, shape: tuple[int, int, int] | None = None, i: tuple[int, int] | None = None, j: tuple[int, int] | None = None) -> DataFrame:
    """``i, j, k`` and ``val`` (``n`` 1) or ``coef`` of the cells of a file or folder, of the block ``i`` by ``j`` (ends exclusive) alone if given."""
    spark.dataSource.register(Cells)
    block = {c: f"{r[0]}:{r[1]}" for c, r in (("i", i), ("j", j)) if r} | {"pushed": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    return spark.read.format("cells").options(**_options(n, headed, shape), **block).load(path)


def write(cells: DataFrame, path: str, n: int = 1, headed: bool = False, shape: tuple[int, int, int] | None = None) -> None:
    """Write ``i, j, k`` and ``val`` or ``coef`` into a new folder, a file a task.

    Without ``headed``, cells are sorted by place and dealt by range, and none may lack between the
    first and the last of a file, or stand twice; an error names the place.
    """
    cells.sparkSession.dataSource.register(Cells)
    columns = [*[F.col(c).cast("int").alias(c) for c in "ijk"], F.col("val" if n == 1 else "coef")]
    cells = cells.select(*columns)
    if not headed:
        place = (F.col("i").cast("bigint") * shape[1] + F.col("j")) * shape[2] + F.col("k")
        cells = cells.withColumn("place", place).repartitionByRange("place").sortWithinPartitions("place").drop("place")
    cells.write.format("cells").options(**_options(n, headed, shape)).mode("append").save(path)


def write_named(files: DataFrame, path: str) -> None:
    """A file in the folder ``path`` for each row of ``name, content``, written by tasks."""
    files.sparkSession.dataSource.register(Files)
    files.select("name", "content").write.format("named_files").mode("append").save(path)
