"""TIFF files: round trips, windows that leave other blocks unread, other writers' layouts, broken files."""

import struct
import zlib

import numpy as np
import pytest
from test_terrain import cells

from hydrospark.sources import tiff

GRID = (2.0, 0.0, 1000.0, 0.0, -2.0, 5000.0)


def found(df):
    return {(r.row, r.col): r.value for r in df.collect()}


@pytest.fixture
def field():
    v = np.random.default_rng(5).normal(size=(70, 90)).astype(np.float32).astype(float)
    v[10:20, 30:40] = np.nan
    return v


def test_round_trip_over_several_files(spark, tmp_path, field):
    files = tiff.write(cells(spark, field), str(tmp_path / "t"), GRID, epsg=32615, side=48, block=16)
    assert files.count() == 4
    idx = tiff.index(spark, str(tmp_path / "t"))
    assert {r.epsg for r in idx.collect()} == {32615} and idx.where("problem is not null").count() == 0
    want = {(r, c): field[r, c] for r, c in zip(*np.nonzero(np.isfinite(field)))}
    assert found(tiff.read(idx, GRID)) == want
    # Written again over itself: the same files, nothing left beside them.
    tiff.write(cells(spark, field), str(tmp_path / "t"), GRID, epsg=32615, side=48, block=16)
    assert len(list((tmp_path / "t").glob("[!.]*"))) == 4


def test_mask_and_no_cells(spark, tmp_path, field):
    tiff.write(cells(spark, field), str(tmp_path / "m"), GRID, mask=True)
    got = found(tiff.read(tiff.index(spark, str(tmp_path / "m")), GRID))
    assert set(got) == set(zip(*np.nonzero(np.isfinite(field)))) and set(got.values()) == {1.0}
    assert tiff.write(cells(spark, field).where("row < 0"), str(tmp_path / "none"), GRID).count() == 0


def test_a_window_leaves_other_blocks_unread(spark, tmp_path, field):
    (path,) = [r.key for r in tiff.write(cells(spark, field), str(tmp_path / "w"), GRID, block=16).collect()]
    box = (1000.0, 5000.0 - 2 * 16, 1000.0 + 2 * 16, 5000.0)  # the first block, whose far sides only touch the next
    idx = tiff.index(spark, str(tmp_path / "w")).collect()
    data = bytearray(open(path, "rb").read())
    for b in idx:
        if b.block != 0:
            data[b.offset : b.offset + b.bytes] = b"\xff" * b.bytes
    open(path, "wb").write(data)
    near = tiff.in_window(tiff.index(spark, str(tmp_path / "w")), *box)
    assert near.count() == 1
    got = found(tiff.read(near, GRID))
    assert got == {(r, c): field[r, c] for r in range(16) for c in range(16)}
    with pytest.raises(Exception, match="block"):
        tiff.read(tiff.index(spark, str(tmp_path / "w"))).count()
    assert found(tiff.read(tiff.index(spark, str(tmp_path / "w")), GRID, skip_broken=True)) == got


def other(cells, order, big, predictor, rows, compression=8):
    """A file in strips as another program might write it."""
    h, w = cells.shape
    kind = cells.dtype.newbyteorder(order)
    strips = []
    for r in range(0, h, rows):
        part = cells[r : r + rows].astype(kind)
        if predictor == 3:
            heavy = part.astype(kind.newbyteorder(">")).view(np.uint8).reshape(len(part), w, kind.itemsize).transpose(0, 2, 1).reshape(len(part), -1)
            raw = np.diff(heavy, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).astype(np.uint8).tobytes()
        elif predictor == 2:
            n = part.view(f"{order}u{kind.itemsize}").astype(f"u{kind.itemsize}")
            n[:, 1:] -= n[:, :-1].copy()
            raw = n.astype(f"{order}u{kind.itemsize}").tobytes()
        else:
            raw = part.tobytes()
        strips.append(zlib.compress(raw) if compression == 8 else raw)
    word, entry, ptr = (8, 20, "Q") if big else (4, 12, "I")
    code = {"H": 3, "I": 4, "Q": 16, "d": 12, "c": 2}
    start = 16 if big else 8
    fmt = {"f": 3, "i": 2, "u": 1}[kind.kind]
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [kind.itemsize * 8]), (259, "H", [compression]), (273, ptr, [0] * len(strips)), (277, "H", [1]), (278, "I", [rows]), (279, ptr, [len(s) for s in strips]), (317, "H", [predictor]), (339, "H", [fmt]), (33550, "d", [2.0, 2.0, 0.0]), (33922, "d", [0, 0, 0, 1000.0, 5000.0, 0]), (42113, "c", b"-9999\0")]
    far = start + (8 if big else 2) + entry * len(tags) + word
    sizes = [struct.calcsize(f"{order}{len(v)}{k}") for _, k, v in tags]
    at = far + sum(n for n in sizes if n > word)
    places = [at + sum(map(len, strips[:k])) for k in range(len(strips))]
    entries = extra = b""
    for (tag, k, v), n in zip(tags, sizes):
        d = v if k == "c" else struct.pack(f"{order}{len(v)}{k}", *(places if tag == 273 else v))
        entries += struct.pack(f"{order}HH{ptr}", tag, code[k], len(v)) + (d.ljust(word, b"\0") if n <= word else struct.pack(order + ptr, far + len(extra)))
        extra += d if n > word else b""
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQQ", 43, 8, 0, 16, len(tags)) if big else struct.pack(order + "HIH", 42, 8, len(tags)))
    return head + entries + struct.pack(order + ptr, 0) + extra + b"".join(strips)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("kind, predictor, compression", [("f4", 3, 8), ("f8", 3, 8), ("f4", 2, 8), ("i2", 2, 8), ("u1", 1, 1), ("f8", 1, 1)])
def test_other_layouts(spark, tmp_path, order, big, kind, predictor, compression):
    v = (np.random.default_rng(7).normal(size=(11, 13)) * 50).clip(0 if kind == "u1" else -99, 99).astype(kind)
    if kind != "u1":
        v[3, 4] = -9999
    (tmp_path / "a.tif").write_bytes(other(v, order, big, predictor, 4, compression))
    idx = tiff.index(spark, str(tmp_path))
    assert idx.count() == 3
    want = {(r, c): float(v[r, c]) for r in range(11) for c in range(13) if v[r, c] != -9999}
    assert found(tiff.read(idx)) == want == found(tiff.read(idx, GRID))


def test_broken_files_are_named_and_skipped(spark, tmp_path, field):
    tiff.write(cells(spark, field), str(tmp_path / "b"), GRID)
    good = next((tmp_path / "b").glob("r*.tif")).read_bytes()
    lzw = bytearray(good)
    k = good.index(struct.pack("<HHIH", 259, 3, 1, 8))
    lzw[k + 8] = 5
    huge = bytearray(good)
    k = good.index(struct.pack("<HHI", 322, 4, 1))
    huge[k + 8 : k + 12] = b"\xff\xff\xff\x7f"
    for name, data in (("empty", b""), ("text", b"no raster at all"), ("cut", good[:60]), ("lzw", bytes(lzw)), ("huge", bytes(huge))):
        (tmp_path / "b" / f"{name}.tif").write_bytes(data)
    idx = tiff.index(spark, str(tmp_path / "b"))
    bad = {r.key.rsplit("/", 1)[1]: r.problem for r in idx.where("problem is not null").collect()}
    # Spark does not list files of no bytes.
    assert set(bad) == {"text.tif", "cut.tif", "lzw.tif", "huge.tif"}
    assert "compression 5" in bad["lzw.tif"]
    assert len(found(tiff.read(idx, GRID))) == np.isfinite(field).sum()


def test_names_with_blanks_and_other_grids(spark, tmp_path, field):
    folder = str(tmp_path / "a b%20c")
    tiff.write(cells(spark, field), folder, GRID)
    idx = tiff.index(spark, folder)
    assert len(found(tiff.read(idx, GRID))) == np.isfinite(field).sum()
    with pytest.raises(Exception, match="not of the grid's size"):
        tiff.read(idx, (3.0, 0.0, 1000.0, 0.0, -3.0, 5000.0)).count()
