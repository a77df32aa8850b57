"""Uncompressed 24- and 32-bit BMP files as pixel rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.sources.cells import write_named

MAGIC, HEADERS = 0x4D42, 14 + 40
STRIP_PIXELS = 1 << 18


def headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, width, height, bits, problem`` of each file (M19, S2); ``problem`` is null for files that can be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *_header(bytes(c))) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "width", "height", "bits", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, HEADERS).alias("content"))
    return files.mapInPandas(read, "path string, width int, height int, bits int, problem string")


def _header(head: bytes) -> tuple[int, int, int, str | None]:
    if len(head) < HEADERS:
        return 0, 0, 0, "short file"
    magic, _, _, _, offset, size, width, height, planes, bits, compression = struct.unpack("<HIHHIIiiHHI", head[:34])
    rules = {"not a bitmap": magic != MAGIC, "short information header": size < 40, "planes": planes != 1, "bits a pixel": bits not in (24, 32), "compressed": compression != 0, "offset of pixels": offset != HEADERS, "size": width <= 0 or height == 0}
    return width, height, bits, next((k for k, wrong in rules.items() if wrong), None)


def scan(spark: SparkSession, path: str, opaque: bool = False) -> DataFrame:
    """``path, x, y, argb`` of all pixels, from the top row down.

    Rows of a file are padded to four bytes.  24-bit files have no alpha: it is 0, or 255 if
    ``opaque``.  A file that breaks a rule of the format, or ends early, raises an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                content = bytes(content)
                width, height, bits, problem = _header(content[:HEADERS])
                if problem:
                    raise ValueError(f"{name}: {problem}")
                stride, rows = (width * bits // 8 + 3) // 4 * 4, abs(height)
                if len(content) < HEADERS + stride * rows:
                    raise ValueError(f"{name}: short file")
                data = np.frombuffer(content, np.uint8, stride * rows, HEADERS).reshape(rows, stride)[:, : width * bits // 8].reshape(rows, width, bits // 8)
                for at in range(0, rows, step := max(1, STRIP_PIXELS // width)):
                    part = data[at : at + step].astype(np.int64)
                    alpha = part[..., 3] if bits == 32 else np.full(part.shape[:2], 255 if opaque else 0)
                    argb = alpha << 24 | part[..., 2] << 16 | part[..., 1] << 8 | part[..., 0]
                    line, x = np.indices(argb.shape)
                    y = rows - 1 - (line + at) if height > 0 else line + at
                    yield pd.DataFrame({"path": name, "x": x.ravel(), "y": y.ravel(), "argb": argb.ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, x bigint, y bigint, argb bigint")


def encode(argb: np.ndarray, bits: int = 32) -> bytes:
    """The file of an array of rows from the top down."""
    height, width = argb.shape
    channels = np.stack([argb >> s & 255 for s in (0, 8, 16, 24)], -1).astype(np.uint8)[::-1, :, : bits // 8]
    stride = (width * bits // 8 + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : width * bits // 8] = channels.reshape(height, -1)
    head = struct.pack("<HIHHI", MAGIC, HEADERS + body.size, 0, 0, HEADERS) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, body.size, 0, 0, 0, 0)
    return head + body.tobytes()


def tiles(pixels: DataFrame, tile_width: int, height: int, bits) -> DataFrame:  # noqa: ANN001
    """``tile, content``: files of ``x, y, argb`` cut into tiles of ``tile_width`` columns; tile ``t`` has ``bits(t)`` bits a pixel.

    Pixels that are lacking are 0.  A tile, and so a file, has a bounded size.
    """

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        tile = key[0].as_py()
        x, y = (rows.column(c).to_numpy() for c in "xy")
        argb = np.zeros((height, int(x.max()) - tile * tile_width + 1), np.int64)
        argb[y, x - tile * tile_width] = rows.column("argb").to_numpy()
        return pa.table({"tile": pa.array([tile], pa.int64()), "content": pa.array([encode(argb, bits(tile))], pa.binary())})

    cut = pixels.select(F.expr(f"x div {tile_width}L").alias("tile"), "x", "y", "argb")
    return cut.groupBy("tile").applyInArrow(build, "tile bigint, content binary")


def write(files: DataFrame, folder: str) -> None:
    """A file ``<tile>.bmp`` in ``folder`` for each row, written by tasks."""
    write_named(files.select(F.concat(F.col("tile").cast("string"), F.lit(".bmp")).alias("name"), "content"), folder)
