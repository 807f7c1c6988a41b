"""Line dedup over content-defined chunks of lines, and over passages around their bounds.

A rolling hash over the last ``ROLL`` line hashes sets a boundary wherever it is divisible by ``MEAN``, so boundaries
depend on the lines nearby and not on their place in the document.  A chunk of several lines and at least ``MIN_WORDS``
words, or a single line of more than ``LONG_LINE``, goes where the same chunk came before.  As a passage's first and
last lines share chunks with what stands around it, pairs of adjacent lines are looked up as well: where pairs that follow each other
first stood in one place and one after the other, the whole stretch stood there, and it goes if it
has more than ``LONG_LINE`` words.  Chunks and pairs whose hash occurs more than once in the corpus are compared byte for
byte; the first occurrence (smallest doc_id, then position) stays.  What goes stood in the corpus before as it is, so
no line is lost everywhere.

Scale: the first pass moves one narrow row (hash, doc_id, row, place) for each piece.  The
text of documents with a repeated hash is read again for the comparison, and texts
are joined with what to remove once more.  Hashes and bytes are counted with map-side
combining, so a piece that a third of all documents share is one row from each task, and the
place where it first stood is sent to its rows, not its rows to one task.

Defined results: a null text has no lines and stays null; empty texts stay; blank lines
are kept unless inside a removed run or chunk; rows that share a doc_id or have none are told
apart by a row number, in no set order, and those without one come last; a document of which
no word is left is dropped by ``remove``; empty tables give empty results; other columns pass
through.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh64_intdigest

from hydrospark.llm.common import aside, join_counted, numbered, ship, sliced, stored, table

ROLL = 2
MEAN = 3
LONG_LINE = 50
MIN_WORDS = 25
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def _lines(text: str) -> tuple[list[bytes], list[int]]:
    """The lines as bytes, and how many words each has."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [len(x.split()) for x in lines]


def bounds(lines: list[bytes], words: list[int]) -> list[tuple[int, int]]:
    """The content-defined chunks as (first line, one past the last); long lines stand alone."""
    hashes = [xxh64_intdigest(x) for x in lines]
    out: list[tuple[int, int]] = []
    start = 0
    for i in range(len(lines)):
        if words[i] > LONG_LINE:
            if start < i:
                out.append((start, i))
            out.append((i, i + 1))
            start = i + 1
            continue
        roll = 0
        for h in hashes[max(start, i - ROLL + 1) : i + 1]:
            roll = (roll * _BASE + h) & _MASK
        if (roll >> 32) % MEAN == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def pieces(text: str | None) -> list[tuple[int, int, int]]:
    """Chunks and pairs as (which, first line, one past the last); which is twice the first line, one more for a chunk."""
    if not text:
        return []
    lines, words = _lines(text)
    whole = [(2 * a + 1, a, z) for a, z in bounds(lines, words) if words[a] > LONG_LINE or (z - a > 1 and sum(words[a:z]) >= MIN_WORDS)]
    return whole + [(2 * i, i, i + 2) for i in range(len(lines) - 1)]


def _hashed(text: str | None):
    """(which, hash, bytes) of the pieces; a chunk's hash has another seed than a pair's."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    for which, a, z in pieces(text):
        body = b"\n".join(lines[a:z])
        h = xxh64_intdigest(body, which & 1)
        yield which, h - (1 << 64) if h >> 63 else h, body


def piece_table(rows: DataFrame) -> DataFrame:
    """``doc_id, row, which, h`` for every piece of numbered rows."""

    def run(batches):
        for b in sliced(batches):
            keys, which, h = [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                for w, x, _ in _hashed(t):
                    keys.append(k)
                    which.append(w)
                    h.append(x)
            at = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("row").take(at), pa.array(which, pa.int32()), pa.array(h, pa.int64())], names=["doc_id", "row", "which", "h"])

    ship(rows.sparkSession)
    docs = rows.where("text is not null").select("doc_id", F.col("__row").alias("row"), "text")
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, which int, h long")


def _bodies(docs: DataFrame) -> DataFrame:
    """``doc_id, row, which, key, body``: the bytes of those pieces whose hash is in the array ``hs``; key is their digest."""

    def run(batches):
        for b in sliced(batches):
            keys, which, key, body = [], [], [], []
            for k, (t, hs) in enumerate(zip(b.column("text").to_pylist(), b.column("hs").to_pylist())):
                wanted = set(hs)
                for w, x, raw in _hashed(t):
                    if x in wanted:
                        keys.append(k)
                        which.append(w)
                        key.append(xxh3_128_digest(raw, w & 1))
                        body.append(raw)
            at = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("row").take(at), pa.array(which, pa.int32()), pa.array(key, pa.binary()), pa.array(body, pa.binary())], names=["doc_id", "row", "which", "key", "body"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, which int, key binary, body binary")


def repeats(rows: DataFrame) -> DataFrame:
    """``doc_id, row, found``: the pieces that repeat, byte for byte, an earlier one; each with the row and place of the first."""
    all_pieces = stored(piece_table(rows), "line-pieces")
    # As a table: a join of two scans is one whose hot partitions Spark can split.
    often = stored(all_pieces.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "line-often")
    suspects = all_pieces.join(often, "h").groupBy("doc_id", "row").agg(F.collect_set("h").alias("hs")).withColumnsRenamed({"doc_id": "__id", "row": "__r"})
    docs = rows.select("doc_id", F.col("__row").alias("row"), "text")
    body = stored(_bodies(docs.join(suspects, docs["doc_id"].eqNullSafe(suspects["__id"]) & (docs["row"] == suspects["__r"])).select("doc_id", "row", "text", "hs")), "line-bodies")
    # The digest only groups; equal bytes decide, and of two bodies with one digest neither would count.
    place = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row", "which")
    first = body.groupBy("key", "body").agg(F.min(place).alias("f"), F.count("*").alias("n")).groupBy("key").agg(F.min("f").alias("f"), F.sum("n").alias("n"), F.count("*").alias("bodies"))
    known = stored(first.where("n > 1 and bodies = 1").select("key", "f", "n"), "line-firsts")
    met = join_counted(body.select("doc_id", "row", "which", "key"), known, "key", "n").where(~place.eqNullSafe(F.col("f")))
    of = F.struct("which", F.col("f.doc_id").cast("string").alias("doc"), F.col("f.row").alias("row"), F.col("f.which").alias("first"))
    return met.select("doc_id", "row", of.alias("one")).groupBy("doc_id", "row").agg(F.collect_list("one").alias("found"))


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__found``, the repeated pieces (null: none)."""
    rows = numbered(docs)
    gone = repeats(rows).withColumnsRenamed({"doc_id": "__id", "row": "__r", "found": "__found"})
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (rows["__row"] == gone["__r"]), "left").drop("__id", "__r", "__row")


def spans(text: str, found: list[dict]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """What goes, as (first line, one past the last): repeated chunks, and stretches of pairs that first stood as they stand here."""
    lines, words = _lines(text)
    chunk = {p["which"] // 2 for p in found if p["which"] % 2}
    start = {p["which"] // 2: (p["doc"], p["row"], p["first"] // 2 - p["which"] // 2) for p in found if p["which"] % 2 == 0}
    whole = [(a, z) for a, z in bounds(lines, words) if a in chunk]
    stretches, a = [], 0
    while a < len(lines):
        z = a + 1
        if a in start:
            while z in start and start[z] == start[a]:
                z += 1
            if sum(words[a : z + 1]) > LONG_LINE:
                stretches.append((a, z + 1))
        a = z
    return whole, stretches


def cut(text: str, found: list[dict]) -> tuple[str, int, int]:
    """The text without the repeated chunks and stretches, how many lines went, and how many of them by chunks."""
    whole, stretches = spans(text, found)
    by_chunk = {i for a, z in whole for i in range(a, z)}
    drop = by_chunk | {i for a, z in stretches for i in range(a, z)}
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop), len(drop), len(by_chunk)


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``; ``n_chars``, where present, follows."""
    docs, back = aside(docs)
    rows = marked(docs)

    def run(batches):
        for b in sliced(batches):
            texts, mask = [], []
            for t, found in zip(b.column("text").to_pylist(), b.column("__found").to_pylist()):
                if t is not None and found:
                    t = cut(t, found)[0]
                    mask.append(bool(t.split()))
                else:
                    mask.append(True)
                texts.append(t)
            names = [c for c in b.schema.names if c != "__found"]
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(mask, pa.bool_()))

    out = rows.mapInArrow(run, T.StructType([f for f in rows.schema if f.name != "__found"])).select(*docs.columns)
    return back(out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed and those of them that chunks removed, and the text that is left with its SHA-256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = marked(docs)

    def run(batches):
        for b in sliced(batches):
            n, gone, chunked, left, digest = [], [], [], [], []
            for t, found in zip(b.column("text").to_pylist(), b.column("__found").to_pylist()):
                after, k, c = cut(t, found) if t is not None and found else (t, 0, 0)
                n.append(t.count("\n") + 1 if t else 0)
                gone.append(k)
                chunked.append(c)
                left.append(after)
                digest.append(hashlib.sha256((after or "").encode("utf-8", "surrogatepass")).hexdigest())
            counts = [pa.array(x, pa.int64()) for x in (n, gone, chunked)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array(left, pa.string())], names=["doc_id", "n_lines", "n_removed", "n_chunked", "text_sha256", "text"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_lines long, n_removed long, n_chunked long, text_sha256 string, text string")
