"""Rasters as TIFF files: headers are indexed as a table of blocks, and only the blocks that are asked for are read.

``index`` reads a few kilobytes of each file; what a window needs is then an ordinary filter on the index, and
``read`` takes the byte ranges of the blocks that are left.  ``write`` makes files of bounded size side by side.

Read: classic and big TIFF of either byte order, tiles or strips, whole numbers and floats, without compression or with
deflate, predictors 1 to 3; the first band.  Anything else is named in ``problem``.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.functions import constants as C
from hydrospark.operators.graph import checkpointed
from hydrospark.operators.raster import Grid
from hydrospark.session import ship
from hydrospark.sources.tables import list_files

INDEX = (
    "key string, block long, offset long, bytes long, row long, col long, height int, width int, block_height int, block_width int, samples int, dtype string, compression int, predictor int, "
    "nodata double, epsg int, a double, b double, c double, d double, e double, f double, problem string"
)
_NAMES = [p.split()[0] for p in INDEX.split(", ")]
#: Fixed values of the format: bytes and struct letters of field types; tags by name.
_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
_TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strip_offsets", 277: "samples", 278: "strip_rows", 279: "strip_bytes", 284: "planar", 317: "predictor",
    322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_bytes", 339: "format", 33550: "scale", 33922: "tie", 34264: "matrix", 34735: "keys", 42113: "nodata",
}
#: No block may unpack to more cells than this.
MOST_CELLS = 1 << 26


def opened(path: str):
    """A file of any store that Arrow knows, to be read in ranges."""
    fs, name = _store(path)
    return fs.open_input_file(name)


def _store(path: str):
    """Arrow's file system of a path as Spark writes it (not escaped), and the name there."""
    from pyarrow import fs

    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://"), ("file:/", "file:///")):
        if path.startswith(hadoop) and not path.startswith(arrow):
            path = arrow + path[len(hadoop):].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe="/:@") if "://" in path else path)


def _fields(f, size: int) -> tuple[str, dict]:
    """The byte order and the known tags of a file's first image."""

    def at(where: int, n: int) -> bytes:
        if where < 0 or n < 0 or where + n > size:
            raise ValueError("a field lies outside the file")
        f.seek(where)
        return f.read(n)

    head = at(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order:
        raise ValueError("not a TIFF file")
    kind = struct.unpack(order + "H", head[2:4])[0]
    if kind == 42:
        first, entry, count, word = struct.unpack(order + "I", head[4:8])[0], 12, "H", 4
    elif kind == 43:
        first, entry, count, word = struct.unpack(order + "Q", at(8, 8))[0], 20, "Q", 8
    else:
        raise ValueError("not a TIFF file")
    n = struct.unpack(order + count, at(first, struct.calcsize(count)))[0]
    start = first + struct.calcsize(count)
    raw, out = at(start, n * entry), {}
    for i in range(n):
        e = raw[i * entry : (i + 1) * entry]
        tag, kind_ = struct.unpack(order + "HH", e[:4])
        many = struct.unpack(order + ("I" if word == 4 else "Q"), e[4 : 4 + word])[0]
        if tag not in _TAGS or kind_ not in _TYPES:
            continue
        wide, letter = _TYPES[kind_]
        data = e[4 + word :][: many * wide] if many * wide <= word else at(struct.unpack(order + ("I" if word == 4 else "Q"), e[4 + word :])[0], many * wide)
        out[_TAGS[tag]] = data if kind_ == 2 else struct.unpack(f"{order}{many}{letter}", data)
    return order, out


def _described(key: str, size: int) -> list[tuple]:
    """The rows of ``INDEX`` of one file."""
    with opened(key) as f:
        order, t = _fields(f, size)
    one = lambda name, otherwise=None: t[name][0] if t.get(name) else otherwise
    w, h, samples, compression, predictor = one("width", 0), one("height", 0), one("samples", 1), one("compression", 1), one("predictor", 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one("format", 1))
    bits = one("bits", 1)
    if not w or not h:
        raise ValueError("an image without cells")
    if compression not in (1, 8, 32946):
        raise ValueError(f"compression {compression} is not known")
    if kind is None or bits not in ((8, 16, 32, 64) if kind != "f" else (32, 64)) or predictor not in (1, 2, 3) or (predictor == 3 and kind != "f"):
        raise ValueError(f"cells of {bits} bits, format {one('format', 1)}, predictor {predictor} are not known")
    tiled = "tile_offsets" in t
    bw, bh = (one("tile_width", 0), one("tile_height", 0)) if tiled else (w, min(one("strip_rows", h), h))
    offsets, lengths = (t.get("tile_offsets"), t.get("tile_bytes")) if tiled else (t.get("strip_offsets"), t.get("strip_bytes"))
    inside = 1 if one("planar", 1) == 2 else samples
    if not bw or not bh or bw * bh * inside > MOST_CELLS:
        raise ValueError(f"blocks of {bh} x {bw} cells are not read")
    across, down = -(-w // bw), -(-h // bh)
    if not offsets or not lengths or min(len(offsets), len(lengths)) < across * down:
        raise ValueError("blocks are missing")
    if t.get("matrix"):
        m = t["matrix"]
        grid = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif t.get("scale") and t.get("tie"):
        (sx, sy, *_), (i, j, _, x, y, *_) = t["scale"], t["tie"]
        grid = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        grid = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    keys = t.get("keys") or ()
    named = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    epsg = named.get(3072) or named.get(2048)
    try:
        nodata = float(t["nodata"].rstrip(b"\0 ")) if t.get("nodata") else None
    except ValueError:
        nodata = None
    dtype = f"{order}{kind}{bits // 8}"
    rows = []
    for n in range(across * down):
        r, c = n // across * bh, n % across * bw
        # Strips end with the image; tiles are whole and reach beyond it.
        tall = bh if tiled else min(bh, h - r)
        rows.append((key, n, offsets[n], lengths[n], r, c, min(bh, h - r), min(bw, w - c), tall, bw, inside, dtype, compression, predictor, nodata, epsg, *map(float, grid), None))
    return rows


def index(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff}", parts: int | None = None) -> DataFrame:
    """A row for every block of every file (columns ``INDEX``), from the headers alone.

    A file that cannot be read has one row with ``problem`` and no block, and is skipped by ``read``; files of no bytes
    are not listed by Spark and have no row.  Files are dealt to ``parts`` tasks.
    """
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, size in pdf[["key", "bytes"]].itertuples(index=False, name=None):
                try:
                    rows = _described(key, int(size))
                except (ValueError, OSError, struct.error, OverflowError) as e:
                    rows = [(key, *[None] * (len(_NAMES) - 2), f"{type(e).__name__}: {e}")]
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k : k + 10_000], columns=_NAMES).astype({"block": "Int64", "offset": "Int64", "bytes": "Int64", "row": "Int64", "col": "Int64", "height": "Int32", "width": "Int32", "block_height": "Int32", "block_width": "Int32", "samples": "Int32", "compression": "Int32", "predictor": "Int32", "epsg": "Int32", "problem": "object"})

    files = list_files(spark, path, pattern).select("key", "bytes")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "key").mapInPandas(run, INDEX)


def in_window(blocks: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The blocks whose box meets a window in map units; an ordinary filter, so it can be combined with others."""
    corner = lambda dr, dc: (F.col("row") + dr, F.col("col") + dc)
    four = [corner(r, c) for r in (F.lit(0), F.col("height")) for c in (F.lit(0), F.col("width"))]
    xs = [F.col("c") + c * F.col("a") + r * F.col("b") for r, c in four]
    ys = [F.col("f") + c * F.col("d") + r * F.col("e") for r, c in four]
    return blocks.where((F.least(*xs) < x1) & (F.greatest(*xs) > x0) & (F.least(*ys) < y1) & (F.greatest(*ys) > y0))


def _decoded(data: bytes, b) -> np.ndarray:
    """A block's cells in the machine's byte order: height x width, the first sample."""
    kind = np.dtype(b.dtype)
    shape = (int(b.block_height), int(b.block_width), int(b.samples))
    need = math.prod(shape) * kind.itemsize
    if b.compression != 1:
        data = zlib.decompressobj().decompress(data, need)
    if len(data) < need:
        raise ValueError(f"{len(data)} bytes of {need}")
    if b.predictor == 3:
        # Bytes of a row lie by their weight, the heaviest first, each as the difference from the one before.
        flat = np.frombuffer(data, np.uint8, need).reshape(shape[0], -1, shape[2]).cumsum(axis=1, dtype=np.uint8)
        planes = flat.reshape(shape[0], kind.itemsize, -1).transpose(0, 2, 1)
        cells = np.ascontiguousarray(planes).view(f">f{kind.itemsize}").reshape(shape)
    elif b.predictor == 2:
        whole = np.dtype(f"{kind.byteorder}u{kind.itemsize}")
        raw = np.frombuffer(data, whole, math.prod(shape)).reshape(shape).astype(whole.newbyteorder("="))
        cells = raw.cumsum(axis=1, dtype=raw.dtype).view(kind.newbyteorder("="))
    else:
        cells = np.frombuffer(data, kind, math.prod(shape)).reshape(shape)
    return cells[: int(b.height), : int(b.width), 0].astype(np.float64)


def read(blocks: DataFrame, grid: Grid | None = None, skip_broken: bool = False, parts: int | None = None) -> DataFrame:
    """``key, row, col, value`` of the indexed blocks' cells; cells without data have no row.

    Rows and columns are those of the file, or of ``grid`` where one is given (files of one system and cell size, as
    tiles of a mosaic are).  A block that cannot be unpacked fails the job and names its file, or has no rows
    with ``skip_broken``.  A file whose cells are not of the grid's size fails the job: resample it instead.
    """
    spark = blocks.sparkSession
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, some in pdf.groupby("key", sort=False):
                with opened(key) as f:
                    for b in some.sort_values("offset").itertuples(index=False):
                        if b.bytes == 0:
                            continue  # a sparse file leaves out blocks without data
                        try:
                            f.seek(int(b.offset))
                            v = _decoded(f.read(int(b.bytes)), b)
                        except (ValueError, OSError, zlib.error) as e:
                            if skip_broken:
                                continue
                            raise ValueError(f"block {b.block} of {key}: {e}") from e
                        ok = np.isfinite(v) if b.nodata is None or pd.isna(b.nodata) else np.isfinite(v) & (v != b.nodata)
                        r, c = np.nonzero(ok)
                        value, r, c = v[ok], r + int(b.row), c + int(b.col)
                        if grid is not None:
                            x, y = b.c + (c + 0.5) * b.a + (r + 0.5) * b.b, b.f + (c + 0.5) * b.d + (r + 0.5) * b.e
                            ga, gb, gc, gd, ge, gf = grid
                            det = ga * ge - gb * gd
                            if not math.isclose(abs(b.a * b.e - b.b * b.d), abs(det), rel_tol=1e-6):
                                raise ValueError(f"cells of {key} are not of the grid's size")
                            r, c = np.floor((ga * (y - gf) - gd * (x - gc)) / det).astype(np.int64), np.floor((ge * (x - gc) - gb * (y - gf)) / det).astype(np.int64)
                        yield pd.DataFrame({"key": key, "row": r.astype(np.int32), "col": c.astype(np.int32), "value": value})

    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.where("problem is null").repartition(n, "key", "block").mapInPandas(run, "key string, row int, col int, value double")


def _file(cells: np.ndarray, grid: Grid, epsg: int | None, nodata: float, block: int) -> bytes:
    """One TIFF of tiles, deflate, predictor 2: float32 or uint8 cells."""
    h, w = cells.shape
    kind = cells.dtype.newbyteorder("<")
    body, offsets, lengths = bytearray(), [], []
    for r in range(0, h, block):
        for c in range(0, w, block):
            tile = np.full((block, block), nodata, kind)
            part = cells[r : r + block, c : c + block]
            tile[: part.shape[0], : part.shape[1]] = part
            raw = tile.view(f"<u{kind.itemsize}")
            raw[:, 1:] -= raw[:, :-1].copy()
            packed = zlib.compress(raw.tobytes(), 6)
            offsets.append(len(body))
            lengths.append(len(packed))
            body += packed
    a, b, c, d, e, f = grid
    text = f"{nodata:g}".encode() + b"\0"
    # GeoKeys: model type, cells are areas, and the system's number; EPSG's degrees are below 5000.
    known = [(1024, 2 if 4000 <= epsg < 5000 else 1), (1025, 1), (2048 if 4000 <= epsg < 5000 else 3072, epsg)] if epsg else [(1025, 1)]
    keys = [1, 1, 0, len(known)] + [v for k, n in known for v in (k, 0, 1, n)]
    tags = [
        (256, "I", [w]), (257, "I", [h]), (258, "H", [kind.itemsize * 8]), (259, "H", [8]), (262, "H", [1]), (277, "H", [1]), (284, "H", [1]), (317, "H", [2]), (322, "I", [block]), (323, "I", [block]),
        (324, "I", offsets), (325, "I", lengths), (339, "H", [3 if kind.kind == "f" else 1]), (34264, "d", [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1]), (34735, "H", keys), (42113, "c", text),
    ]
    sizes = [struct.calcsize(f"<{len(v)}{k}") for _, k, v in tags]
    far = 8 + 2 + 12 * len(tags) + 4
    base = far + sum(n for n in sizes if n > 4)
    codes = {"H": 3, "I": 4, "d": 12, "c": 2}
    entries, extra = b"", b""
    for (tag, k, v), n in zip(tags, sizes):
        v = [o + base for o in v] if tag == 324 else v
        data = v if k == "c" else struct.pack(f"<{len(v)}{k}", *v)
        entries += struct.pack("<HHI", tag, codes[k], len(v)) + (data.ljust(4, b"\0") if n <= 4 else struct.pack("<I", far + len(extra)))
        extra += data if n > 4 else b""
    return struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + entries + struct.pack("<I", 0) + extra + bytes(body)


def write(cells: DataFrame, path: str, grid: Grid, value: str = "value", epsg: int | None = None, mask: bool = False, side: int = 2048, block: int = 256) -> DataFrame:
    """Cells as a folder of TIFF files of ``side`` cells squared at most; returns ``key, cells``, a row a file.

    Floats have -9999 for no data, masks (``mask``: cells that are in the table) 0.  Of two rows for one cell the larger value stays.
    A file is one task's work (16 MB unpacked), is written beside its place and then moved, so a task that runs again leaves one file.
    The files are written when this is called.
    """
    ship(cells.sparkSession)
    a, b, c, d, e, f = map(float, grid)
    v = X.number(value) if not mask else F.lit(1.0)
    kept = cells.select("row", "col", v.cast("float").alias("v")).where(F.col("v").isNotNull() & (F.col("v") != C.RASTER_NODATA))
    kept = kept.groupBy("row", "col").agg(F.max("v").alias("v"))
    kept = kept.withColumns({"tr": F.floor(F.col("row") / side), "tc": F.floor(F.col("col") / side)})
    empty = 0.0 if mask else float(C.RASTER_NODATA)
    root = path.rstrip("/")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = (int(k) * side for k in key)
        r, k = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        out = np.full((r.max() + 1, k.max() + 1), empty, np.uint8 if mask else np.float32)
        out[r, k] = pdf["v"].to_numpy()
        data = _file(out, (a, b, c + c0 * a + r0 * b, d, e, f + c0 * d + r0 * e), epsg, empty, block)
        fs, folder = _store(root)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/r{key[0]}_c{key[1]}.tif"
        beside = f"{folder}/_{uuid.uuid4().hex}.part"
        with fs.open_output_stream(beside) as s:
            s.write(data)
        fs.move(beside, name)
        return pd.DataFrame({"key": [f"{root}/r{key[0]}_c{key[1]}.tif"], "cells": [len(pdf)]})

    return checkpointed(kept.groupBy("tr", "tc").applyInPandas(run, "key string, cells long"))
