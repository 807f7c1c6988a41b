"""Token-id files with a minimal perfect hash index.

Documents are encoded where they lie, dealt to shards by ranges of doc_id, and each shard is
written as one file in ascending doc_id order.  A file holds, in this order: the raw
payload (ids as little-endian unsigned 16-bit integers, or 32-bit if the vocabulary needs
them), the index, and a fixed tail that says where the parts begin.  The index is a minimal
perfect hash in the manner of BBHash (Limasset et al. 2017): levels of bit arrays in which a
key owns a bit if no other key of that level falls on it; the rank of the bit is the key's
number.  Numbers lead to a stored 32-bit fingerprint of the key, which tells foreign keys
off, and to the row whose offset and length give the ids in the payload.

Scale: ids are compressed for the shuffle; a task holds one batch of ids and the index of
its shard (about 30 bytes for a document), never a shard's payload.  Shards take about
``SHARD_BYTES`` each, or a ``MOST_SHARDS``th of the corpus if that is more; a doc_id with more rows than a shard takes is dealt
to several neighbouring ones.  Files are read back in blocks of ``BLOCK_BYTES``, a few documents
or many to a request.  A shard is written under a name of its own attempt and then moved in
place, so tasks can be repeated and lost executors cost only their shards; what failed attempts
leave is removed when all shards are there.

Defined results: a null text is empty and gets only the end id; doc_ids are whole numbers (of
any other type a ValueError says so); null doc_ids come first; equal doc_ids lie next to each
other, in the order of their ids' bytes within a shard, and each shard's index leads to the first
of them that it holds (``copies`` says how many it holds); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrospark.llm.common import shared_path, stored, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Bytes of text that a shard takes, about, as long as there are no more than MOST_SHARDS of them.
SHARD_BYTES = 16 << 20
MOST_SHARDS = 20_000
#: What a document counts for beside its text.
DOC_BYTES = 64
#: Bytes of payload in one read.
BLOCK_BYTES = 8 << 20
#: Words and marks whose ids a worker remembers (about 25 bytes each).
CACHE_PIECES = 1_500_000
#: Bytes of text that are cut into words at once.
AT_ONCE = 4 << 20
GAMMA = 1.7
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters and figures that stay one letter or figure when normalised; marks after them stand alone.
_PLAIN_END = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]$"
_TAIL = struct.Struct("<8sQQQQB")
_MAGIC = b"HSTOKEN1"
_NULL = -(1 << 63)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The vocabulary cuts texts at white space, lower-cases and parts letters from marks before
    anything else, so words between ASCII blanks are encoded one by one, the ASCII marks that end
    a word by themselves, and their ids are remembered.  Words are cut,
    numbered and looked up by Arrow, a few megabytes of text at once.  New words of letters go to
    the tokenizer many in one text; as each ends with an end-of-word id, the ids are cut there.
    Where the count of ends does not fit, and for words of anything else, each goes to the
    tokenizer by itself.
    """

    def __init__(self, vocabulary: str, end_id: int = END_ID):
        # Spark's tasks are the parallelism; threads within one would only add memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.last = np.zeros(size, bool)  # ids that end a word
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        """The known pieces: their texts, their ids one after the other, and where each one's begin."""
        self.pieces = pa.array([""], pa.string())
        self.ids = np.zeros(0, self.kind)
        self.starts = np.zeros(2, np.int64)

    def __call__(self, text: str | None) -> bytes:
        return next(self.many(pa.array([text], pa.string())))

    def many(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, with the end id."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for k, n in enumerate(sizes.tolist()):
            if size and size + n > AT_ONCE:
                yield from self._some(texts.slice(start, k - start))
                start, size = k, 0
            size += n
            if n > AT_ONCE:
                yield b"".join(x[: -len(self.end)] for piece in _cut(texts[k].as_py()) for x in self._some(pa.array([piece]))) + self.end
                start, size = k + 1, 0
        yield from self._some(texts.slice(start))

    def _some(self, texts: pa.Array) -> Iterator[bytes]:
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary
        core = pc.utf8_rtrim(words, _MARKS)
        core = pc.if_else(pc.and_not(pc.match_substring_regex(core, _PLAIN_END), pc.match_substring(words, "<|")), core, words)
        mark = self._marks(words, core)
        first, length = self._places(core, mark)
        word = numbered.indices.to_numpy(zero_copy_only=False)
        each = length.sum(1, dtype=np.int64)[word]
        before = np.concatenate(([0], np.cumsum(each)))
        size = length[word].ravel()
        at = first[word].ravel() - (np.cumsum(size) - size)
        out = self.ids[np.repeat(at, size) + np.arange(before[-1])]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        a = 0
        for b in before[ends].tolist():
            yield out[a:b].tobytes() + self.end
            a = b

    def _marks(self, words: pa.Array, core: pa.Array) -> pa.Array:
        """What is left of each word after its core."""
        n = pc.utf8_length(core).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(n != pc.utf8_length(words).to_numpy(zero_copy_only=False))
        rest = [w[k:] for w, k in zip(words.take(pa.array(cut)).to_pylist(), n[cut].tolist())]
        kinds = {m: k for k, m in enumerate(dict.fromkeys(["", *rest]))}
        code = np.zeros(len(words), np.int64)
        code[cut] = [kinds[m] for m in rest]
        return pa.array(list(kinds)).take(pa.array(code))

    def _places(self, core: pa.Array, mark: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each core and mark begin, and how many they are."""
        if len(self.pieces) > CACHE_PIECES:
            self._forget()
        both = pa.concat_arrays([core, mark]).dictionary_encode()
        known = pc.index_in(both.dictionary, self.pieces)
        missing = pc.is_null(known)
        if pc.any(missing).as_py():
            new, base = both.dictionary.filter(missing), len(self.pieces)
            self._learn(new.to_pylist())
            known = pc.replace_with_mask(known, missing, pc.add(pc.index_in(new, self.pieces.slice(base)), pa.scalar(base, pa.int32())))
        k = known.to_numpy()[both.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T]
        return self.starts[k], self.starts[k + 1] - self.starts[k]

    def _learn(self, new: list[str]) -> None:
        letters = [w for w in new if w.isalpha()]
        parts = [letters[k : k + 50] for k in range(0, len(letters), 50)]
        each = [w for w in new if not w.isalpha()]
        names, ids, sizes = [], [], []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            found = np.array(e.ids, self.kind)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) != len(part):
                each += part
                continue
            names += part
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        for w, e in zip(each, self.tokenizer.encode_batch_fast(each, add_special_tokens=False)):
            names.append(w)
            ids.append(np.array(e.ids, self.kind))
            sizes.append(np.array([len(e.ids)]))
        self.pieces = pa.concat_arrays([self.pieces, pa.array(names, pa.string())])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
        self.ids = np.concatenate([self.ids, *ids])


def _cut(text: str) -> Iterator[str]:
    """A very long text in pieces that end at an ASCII blank, where there is one."""
    a = 0
    while a < len(text):
        b = a + AT_ONCE // 4
        while b < len(text) and text[b] not in " \t\n\x0b\x0c\r":
            b += 1
        yield text[a:b]
        a = b


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of 64-bit keys (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys; ``of`` gives -1 where no level takes a key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        base = 0
        for bits in levels:
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
            self.ranks.append(base + counts)
            base += int(counts[-1])
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys.astype(np.uint64)
        while len(rest):
            words = max(1, int(len(rest) * GAMMA) // 64 + 1)
            at = mix(rest, len(levels)) % np.uint64(words * 64)
            _, where, times = np.unique(at, return_inverse=True, return_counts=True)
            alone = times[where] == 1
            bits = np.zeros(words, np.uint64)
            np.bitwise_or.at(bits, (at[alone] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at[alone] & np.uint64(63)))
            levels.append(bits)
            rest = rest[~alone]
        return cls(levels)

    def of(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = mix(keys[left], k) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            owned = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[owned]] = (rank[word] + below)[owned]
            left = left[~owned]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0xF1) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    """One file: payload as it comes, index and tail at the end."""

    def __init__(self, sink, kind: np.dtype):
        self.sink, self.kind = sink, kind
        self.keys: list[int] = []
        self.ends: list[int] = []
        self.size = 0

    def add(self, key: int, ids: bytes) -> None:
        self.sink.write(ids)
        self.size += len(ids)
        self.keys.append(key)
        self.ends.append(self.size // self.kind.itemsize)

    def close(self) -> None:
        keys, ends = np.array(self.keys, "<i8"), np.array(self.ends, "<u8")
        distinct, first = np.unique(keys, return_index=True)
        index = PerfectHash.build(distinct.view(np.uint64))
        number = index.of(distinct.view(np.uint64))
        row, mark = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
        row[number], mark[number] = first, fingerprints(distinct.view(np.uint64))
        self.sink.write(keys.tobytes() + ends.tobytes())
        self.sink.write(row.tobytes() + mark.tobytes())
        for bits in index.levels:
            self.sink.write(struct.pack("<Q", len(bits)) + bits.astype("<u8").tobytes())
        self.sink.write(_TAIL.pack(_MAGIC, self.size, len(keys), len(distinct), len(index.levels), self.kind.itemsize))


class ShardReader:
    """Constant-time keyed access to a shard file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.payload, n, m, levels, width = _TAIL.unpack(source.read_at(_TAIL.size, size - _TAIL.size))
        if magic != _MAGIC:
            raise ValueError("not a token file")
        self.kind = np.dtype(f"<u{width}")
        body = source.read_at(size - _TAIL.size - self.payload, self.payload)
        self.keys = np.frombuffer(body, "<i8", n)
        self.ends = np.frombuffer(body, "<u8", n, 8 * n)
        self.row = np.frombuffer(body, "<u4", m, 16 * n)
        self.mark = np.frombuffer(body, "<u4", m, 16 * n + 4 * m)
        at, bits = 16 * n + 8 * m, []
        for _ in range(levels):
            (words,) = struct.unpack_from("<Q", body, at)
            bits.append(np.frombuffer(body, "<u8", words, at + 8))
            at += 8 + 8 * words
        self.index = PerfectHash(bits)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 where the shard does not hold it."""
        keys = np.ascontiguousarray(keys, "<i8").view(np.uint64)
        number = self.index.of(keys)
        found = number >= 0
        found[found] = self.mark[number[found]] == fingerprints(keys[found])
        out = np.full(len(keys), -1, np.int64)
        out[found] = self.row[number[found]]
        return out

    def copies(self, row: int) -> int:
        """How many rows from this one on have its key."""
        n = 1
        while row + n < len(self.keys) and self.keys[row + n] == self.keys[row]:
            n += 1
        return n

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of all rows, a block of the payload at a time."""
        w, row = self.kind.itemsize, 0
        ends = self.ends.astype(np.int64)
        while row < len(ends):
            start = int(ends[row - 1]) if row else 0
            last = max(row + 1, int(np.searchsorted(ends, start + BLOCK_BYTES // w, "right")))
            block = np.frombuffer(self.source.read_at((int(ends[last - 1]) - start) * w, start * w), self.kind)
            for r in range(row, last):
                a = int(ends[r - 1]) if r else 0
                yield r, block[a - start : int(ends[r]) - start]
            row = last

    def ids(self, row: int) -> np.ndarray:
        start = int(self.ends[row - 1]) if row else 0
        w = self.kind.itemsize
        return np.frombuffer(self.source.read_at((int(self.ends[row]) - start) * w, start * w), self.kind)


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` (as long; null: the least long), and the ids' bytes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = Encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = [pack.compress(x) for x in encode.many(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(ids, pa.binary())], names=["k", "ids"])
            pa.default_memory_pool().release_unused()

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("k"), "text").mapInArrow(run, "k long, ids binary")


def write_files(docs: DataFrame, path: str, vocabulary: str, n_shards: int) -> DataFrame:
    """Write the shards; ``shard, file, n_docs, n_ids`` of each.

    Shards are ranges of doc_id, cut at its approximate quantiles.
    """
    key = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("k"))
    cuts = sorted(int(c) for c in key.approxQuantile("k", [i / n_shards for i in range(1, n_shards)], 0.2 / n_shards)) if n_shards > 1 else []
    width = Encoder(vocabulary).kind
    # A doc_id that is several cuts has enough rows for as many shards; they are dealt evenly to those.
    under, upto = _below(cuts, "<"), _below(cuts, "<=")
    spread = F.pmod(F.xxhash64("ids", F.monotonically_increasing_id()), upto - under + 1).cast("int")
    shard = under + F.when(upto - under > 1, spread).otherwise(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(path)
        unpack = zstandard.ZstdDecompressor()
        writer, now, sink, part = None, None, None, None

        def finish():
            writer.close()
            sink.close()
            name = f"{root}/shard-{now:06d}.ids"
            place.move(part, name)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([f"shard-{now:06d}.ids"]), pa.array([len(writer.keys)], pa.int64()), pa.array([writer.size // width.itemsize], pa.int64())], names=["shard", "file", "n_docs", "n_ids"])

        for b in batches:
            for s, k, ids in zip(b.column("shard").to_pylist(), b.column("k").to_pylist(), b.column("ids")):
                if s != now:
                    if writer:
                        yield finish()
                    place.create_dir(root, recursive=True)
                    part = f"{root}/.part-{uuid.uuid4().hex}"
                    sink = place.open_output_stream(part)
                    writer, now = ShardWriter(sink, width), s
                writer.add(k, unpack.decompress(ids.as_buffer()))
        if writer:
            yield finish()

    rows = encoded(docs, vocabulary).withColumn("shard", shard.cast("int"))
    return rows.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "k", "ids").mapInArrow(run, "shard int, file string, n_docs long, n_ids long")


def _below(cuts: list[int], how: str):
    """How many of the sorted cuts are under ``k`` (or equal to it as well), by binary search."""
    if not cuts:
        return F.lit(0)
    steps = F.array(*[F.lit(c).cast("long") for c in cuts])
    powers = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    fits = lambda at: at < F.col("k") if how == "<" else at <= F.col("k")
    return F.aggregate(powers, F.lit(0), lambda found, b: F.when((found + b <= len(cuts)) & fits(F.get(steps, found + b - 1)), found + b).otherwise(found))


def read_files(manifest: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, copies`` of every document, looked up by key in the files.

    ``manifest`` has the shards' names and the ids before each (``before``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for name, before in zip(b.column("file").to_pylist(), b.column("before").to_pylist()):
                with place.open_input_file(f"{root}/{name}") as source:
                    shard = ShardReader(source)
                    first = np.concatenate(([True], shard.keys[1:] != shard.keys[:-1])) if len(shard.keys) else np.zeros(0, bool)
                    # The index leads every key to its first row; the rows that follow are its copies.
                    rows = shard.rows(shard.keys[first])
                    if not np.array_equal(rows, np.flatnonzero(first)):
                        raise ValueError(f"the index of {name} does not fit its rows")
                    copies = np.diff(np.append(rows, len(shard.keys)))[np.cumsum(first) - 1]
                    out: list[tuple] = []
                    for r, ids in shard.blocks():
                        key, start = int(shard.keys[r]), before + (int(shard.ends[r - 1]) if r else 0)
                        out.append((None if key == _NULL else key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), int(copies[r])))
                        if len(out) == 10_000:
                            yield _table(out)
                            out = []
                    if out:
                        yield _table(out)

    return manifest.select("file", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, copies long")


def _table(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32", "copies"])


def _tidy(spark: SparkSession, path: str) -> None:
    """Remove what attempts that failed have left."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    disk = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for left in disk.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/.part-*")) or []:
        disk.delete(left.getPath(), False)


def token_files(docs: DataFrame, path: str, vocabulary: str) -> DataFrame:
    """Write token files of ``docs`` under ``path`` and read them back, one row for each document."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be a whole number")
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + DOC_BYTES), F.lit(0)).alias("b")).first()["b"]
    n_shards = min(max(8, -(-size // SHARD_BYTES)), MOST_SHARDS) if size else 1
    written = stored(write_files(docs, path, vocabulary, n_shards), "token-manifest")
    _tidy(docs.sparkSession, path)
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    manifest = written.withColumn("before", before)  # a row for each shard
    return read_files(manifest.repartition(n_shards, "shard"), path)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns."""
    import public_tokenizers

    found = token_files(table(spark, sf_dir, "documents"), shared_path(spark, "token-files"), public_tokenizers.path(VOCABULARY))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
