"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and one end.  Words with at least one in ``2 ** HEAD_BITS`` of all training
tokens, the end, and an escape for all other words are the leaves of a Huffman tree, so that a token is a row of
bits, and each bit is predicted at its node of the tree.  The predictors are the node itself and the node in
the contexts of the last one, two and three tokens, whose counts of zeros and ones over all training texts lie in a
hashed table.  Their log odds are added up with weights that a gate (how often each context has been seen)
chooses; a document moves its own weights on by its bits, a block of tokens at a time; and an adaptive map of the result's
log odds corrects it.  After an escape comes the word: its smoothed share among all such words, with
one share left for words that training has not seen.  The score is the sum of all these logarithms, the
probability of the text where all unknown words count as one; ``bits_per_byte`` spreads it over its bytes.

Weights and map are fitted on all training documents, by Newton's steps over sums of all of them.  Documents are
dealt to ``PARTS`` by their checksum, and each meets the counts of the training documents of the other parts, so that none is
foretold by its own counts.  Scoring then uses the counts of all training documents.  Tokens that a task finds again in the
same part after the same leaves have the same bits and slots, so such a token is worked once, with its number (``_met``).

Scale: word counts are combined in each task before they are shuffled, and all of them are kept.  The tree has at most
``2 ** HEAD_BITS + 2`` leaves by its definition, the counts sent along are at most ``2 ** KNOWN_BITS``, and the hashed
table has ``2 ** SLOT_BITS`` slots: all are sent to the executors (under 40 MB).  Tasks give the table in blocks, which are shuffled and summed one by one, so that
what training gathers follows the input and no task holds more than one table.  Rarer words are
joined with their counts, once for each document and word, and summed by document.

Defined results: a null text is an empty one, which is the end alone; rows that share a doc_id are scored each
for itself; a null doc_id counts as a training row; with an empty table, or one without training rows, nothing is known
and the escape is all that there is; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm.common import ship, stored, table

#: A word is coded by the tree if it is one training token in two to this power, or more.
HEAD_BITS = 14
#: The count of a word that is one training token in two to this power, or more, is sent to the executors; rarer words are joined.
KNOWN_BITS = 18
SLOT_BITS = 21
ORDERS = 3
#: Parts of the training documents; each teaches weights and map with the counts of the others.
PARTS = 4
#: Checksums are kept by this modulus, a multiple of PARTS and of the contract's 7.
FOLD = 140
#: Tokens after which a document's own weights move, and how far.
BLOCK = 32
RATE = 0.3
#: Knots of the map, over log odds of -8 to 8.
KNOTS = 33
STEPS = 2
#: Words that a task counts before it passes them on.
COUNTED_AT_ONCE = 300_000
#: Tokens that are worked at once.
TOKENS_AT_ONCE = 100_000
#: Training tokens among which equal ones in equal contexts are counted, and tokens whose bits are looked up at once.
MET_AT_ONCE = 1_500_000
BITS_OF_AT_ONCE = 16_384
BLOCK_SLOTS = 4096
_END = b""  # no word is empty
_MIX = np.uint32(0x9E3779B1)
_MORE = np.uint32(0x85EBCA77)


def tokens(text: str | None) -> list[bytes]:
    """Words of the lower-cased text (A-Z), and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), _END]


def remainder(doc_id: str, by: int):
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` of all tokens of ``text``; the end is the empty word."""

    def run(batches):
        def passed():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        seen: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update(tokens(text))
            if len(seen) >= COUNTED_AT_ONCE:
                yield passed()
                seen = Counter()
        yield passed()

    ship(texts.sparkSession)
    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Coder:
    """The Huffman tree of the frequent tokens: for each leaf its way, a node and a bit at a time.

    Leaves 0 to n - 1 are the words, then come the escape and the end; ``start`` stands before a text.
    """

    def __init__(self, words: list[tuple[bytes, int]], rest: int, ends: int):
        words = sorted((w, c) for w, c in words if w != _END)
        self.number = {w: k for k, (w, _) in enumerate(words)}
        self.escape, self.end, self.start = len(words), len(words) + 1, len(words) + 2
        weight = [*(c for _, c in words), max(rest, 1), max(ends, 1)]
        leaves = len(weight)
        heap = [(c, k) for k, c in enumerate(weight)]
        heapq.heapify(heap)
        up = [(-1, 0)] * (2 * leaves - 1)
        zeros_ones = []
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            at = leaves + len(zeros_ones)
            up[x], up[y] = (at, 0), (at, 1)
            zeros_ones.append((a, b))
            heapq.heappush(heap, (a + b, at))
        node, bit, self.length = [], [], np.zeros(leaves, np.int32)
        for leaf in range(leaves):
            way, at = [], leaf
            while up[at][0] >= 0:
                way.append(up[at])
                at = up[at][0]
            node += [n - leaves for n, _ in reversed(way)]
            bit += [x for _, x in reversed(way)]
            self.length[leaf] = len(way)
        self.first = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.node, self.bit = np.array(node, np.uint32), np.array(bit, np.int8)
        n = np.array(zeros_ones, float).reshape(-1, 2)
        self.odds = np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4)).clip(-8, 8).astype(np.float32)

    def coded(self, words: list[bytes]) -> np.ndarray:
        """Leaf numbers of a text's tokens; the last is the end."""
        out = np.fromiter(map(self.number.get, words, [self.escape] * len(words)), np.uint16, len(words))
        out[-1] = self.end
        return out

    def lasts(self, ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The leaves that stand before each token of texts laid end to end (text i stops before ``ends[i]``), the nearest first."""
        before = np.concatenate((np.full(ORDERS, self.start, np.uint32), ids.astype(np.uint32)))
        out = [before[ORDERS - k : len(before) - k].copy() for k in range(1, ORDERS + 1)]
        starts, size = np.concatenate(([0], ends[:-1])), np.diff(ends, prepend=0)
        for k, last in enumerate(out, 1):
            for nth in range(k):
                last[starts[size > nth] + nth] = self.start
        return out

    def events(self, ids: np.ndarray, ends: np.ndarray):
        """For the bits of texts laid end to end (text i stops before ``ends[i]``): token, node, bit, slots of each order."""
        return self.bits(ids, self.lasts(ids, ends))

    def bits(self, ids: np.ndarray, lasts: list[np.ndarray]):
        """For the bits of tokens, each after its own ``lasts``: token, node, bit, slots of each order."""
        contexts, context = [], np.zeros(len(ids), np.uint32)
        for k, last in enumerate(lasts, 1):
            context = (context ^ (last + np.uint32(1))) * _MIX
            context ^= context >> np.uint32(15)
            contexts.append(context + np.uint32(k))
        size = self.length[ids]
        place = np.repeat(np.arange(len(ids)), size)
        way = np.arange(len(place))
        way += np.repeat(self.first[ids] - (np.cumsum(size) - size), size)
        node, bit = self.node[way], self.bit[way]
        at_node = node * _MORE
        slots = []
        for context in contexts:
            x = np.repeat(context, size)
            x ^= at_node
            x *= _MIX
            x ^= x >> np.uint32(16)
            x *= _MORE
            x >>= np.uint32(32 - SLOT_BITS)
            slots.append(x)
        return place, node, bit, slots


_SEEN = np.array([0, 1, 1, *[2] * 13, 3], np.uint16)


def packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Counts as 16 bits: log odds in steps of a sixteenth, and how often the slot was seen (none, to 2, to 15, more)."""
    odds = np.rint(16 * np.log((ones + 0.4) / (zeros + 0.4))).clip(-128, 127).astype(np.int32) + 128
    return (odds.astype(np.uint16) << np.uint16(2)) | _SEEN[np.minimum(zeros + ones, 16)]


GATES = 4**ORDERS
INPUTS = ORDERS + 1


class Mixer:
    """The trained model: coder, packed table, weights of each gate, and the map."""

    def __init__(self, coder: Coder, slots: np.ndarray, weights: np.ndarray | None = None, fixed: np.ndarray | None = None):
        self.coder, self.slots = coder, slots
        self.weights = np.full((GATES, INPUTS), 0.35, np.float32) if weights is None else weights
        self.fixed = 1 / (1 + np.exp(-np.linspace(-8, 8, KNOTS))) if fixed is None else fixed

    def inputs(self, node, slots):
        """Log odds of each predictor, and the gate of each bit."""
        x, gate = [self.coder.odds[node]], np.zeros(len(node), np.uint8)
        for at in slots:
            code = self.slots.take(at)
            x.append(((code >> np.uint16(2)).astype(np.float32) - np.float32(128)) / np.float32(16))
            gate = (gate << np.uint8(2)) | (code & np.uint16(3)).astype(np.uint8)
        return x, gate

    def odds(self, x, gate) -> np.ndarray:
        """Log odds of each bit by the weights of its gate."""
        gate = gate.astype(np.intp)
        return sum(w[gate] * a for w, a in zip(self.weights.T.copy(), x))

    def refined(self, odds: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of a one, half from the map."""
        at = (odds + 8) * ((KNOTS - 1) / 16)
        low = at.astype(np.intp).clip(0, KNOTS - 2)
        part = at - low
        return (p + self.fixed[low] * (1 - part) + self.fixed[low + 1] * part) / 2

    def scores(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text's leaves."""
        n = np.diff(ends, prepend=0)
        # Longest texts first, so that those still running are the first ones; then block by block.
        by_length = np.argsort(-n, kind="stable")
        rank = np.empty(len(n), np.int32)
        rank[by_length] = np.arange(len(n))
        who = np.repeat(rank, n)
        block = ((np.arange(len(ids)) - np.repeat(ends - n, n)) // BLOCK).astype(np.int32)
        order = np.argsort(block, kind="stable")
        ids, lasts = ids[order], [x[order] for x in self.coder.lasts(ids, ends)]
        parts = []
        for k in range(0, len(ids), BITS_OF_AT_ONCE):
            some = slice(k, k + BITS_OF_AT_ONCE)
            place, node, bit, slots = self.coder.bits(ids[some], [x[some] for x in lasts])
            x, gate = self.inputs(node, slots)
            parts.append((place + k, bit, self.odds(x, gate), *x))
        place, bit, odds, *x = map(np.concatenate, zip(*parts))
        who, one = who[order][place].astype(np.intp), bit.astype(np.float32)
        cuts = np.searchsorted(block[order][place], np.arange(int(block.max(initial=-1)) + 2))
        own = np.zeros((INPUTS, len(n)), np.float32)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            w, here = who[a:b], odds[a:b]
            for k in range(INPUTS):
                here += own[k][w] * x[k][a:b]
            np.clip(here, -8, 8, out=here)
            err = one[a:b] - 1 / (1 + np.exp(-here))
            m = int(w.max()) + 1
            step = RATE / np.maximum(np.bincount(w, minlength=m), 1)
            for k in range(INPUTS):
                own[k, :m] += step * np.bincount(w, err * x[k][a:b], m)
        logs = np.empty(len(odds))
        for k in range(0, len(odds), 8 * BITS_OF_AT_ONCE):
            some = slice(k, k + 8 * BITS_OF_AT_ONCE)
            final = self.refined(odds[some], 1 / (1 + np.exp(-odds[some])))
            np.log10(np.where(bit[some], final, 1 - final), out=logs[some])
        return np.bincount(who, logs, len(n))[rank]


def _held(batches, many: int = TOKENS_AT_ONCE):
    """Groups of rows with at least ``many`` tokens: (batches, leaf numbers, ends)."""
    group, ids, size = [], [], 0
    for b in batches:
        for k in range(0, b.num_rows, 512):
            part = b.slice(k, 512)
            each = [np.frombuffer(x, np.uint16) for x in part.column("ids").to_pylist()]
            group.append(part)
            ids += each
            size += sum(map(len, each))
            if size >= many:
                yield group, np.concatenate(ids), np.cumsum([len(x) for x in ids])
                group, ids, size = [], [], 0
    if ids:
        yield group, np.concatenate(ids), np.cumsum([len(x) for x in ids])


def coded_texts(docs: DataFrame, coder: Coder, known: dict[bytes, int]) -> DataFrame:
    """``row, doc_id, rest, ids, n_bytes, some, logs, words, times``: leaf numbers of each text, and its words under the escape.

    Of those with a known count there are ``some``, and ``logs`` is the sum of their log10 of count and one;
    the others come as ``words`` with how often they come.
    """
    sent = docs.sparkSession.sparkContext.broadcast((coder, known))

    def run(batches):
        coder, known = sent.value
        log = {c: math.log10(c + 1) for c in set(known.values())}
        names = ["ids", "n_bytes", "some", "logs", "words", "times"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                found = tokens(text)
                at = coder.coded(found)
                under = [found[k] for k in np.flatnonzero(at == coder.escape).tolist()]
                met = [known[w] for w in under if w in known]
                rare = Counter([w for w in under if w not in known]) if len(met) < len(under) else {}
                out.append((at.tobytes(), len((text or "").encode("utf-8", "surrogatepass")), len(met), math.fsum(map(log.__getitem__, met)), list(rare), list(rare.values())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rest"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["doc_id", "rest", *names])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", remainder("doc_id", FOLD).cast("int").alias("rest"), "text").mapInArrow(run, f"doc_id {kind}, rest int, ids binary, n_bytes long, some long, logs double, words array<binary>, times array<int>")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "coded-texts")


def slot_counts(training: DataFrame, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """The packed tables of the training texts: without each part, end to end, and of all."""
    sent = training.sparkSession.sparkContext.broadcast(coder)
    size = 1 << SLOT_BITS

    def count(batches):
        n = np.zeros(PARTS * 2 * size, np.int32)
        for part, times, ids, lasts in _met(batches, sent.value):
            place, _, bit, slots = sent.value.bits(ids, lasts)
            side, often = (part * (2 * size))[place] + bit, times[place]
            for at in slots:
                np.add.at(n, side + (at.astype(np.int64) << 1), often)
        n = n.reshape(PARTS, 2 * size)
        press = zstandard.ZstdCompressor(level=1)
        for k in range(0, size, BLOCK_SLOTS):
            part = n[:, 2 * k : 2 * (k + BLOCK_SLOTS)]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK_SLOTS], pa.int32()), pa.array([press.compress(part.T.tobytes())], pa.binary())], names=["block", "n"])

    def merged(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("n").to_pylist()):
                part = np.frombuffer(zstandard.decompress(raw), np.int32).astype(np.int64)
                total[block] = total[block] + part if block in total else part
        for block, n in total.items():
            n = n.reshape(BLOCK_SLOTS, 2, PARTS)  # slot, bit, part
            whole = n.sum(2)
            both = [b"".join(packed(*(whole - n[:, :, k]).T).tobytes() for k in range(PARTS)), packed(*whole.T).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in both)], names=["block", "others", "all"])

    parts = int(training.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = training.select("rest", "ids").mapInArrow(count, "block int, n binary").repartition(parts, "block").mapInArrow(merged, "block int, others binary, all binary")
    empty = packed(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    others, whole = np.full((PARTS, size), empty, np.uint16), np.full(size, empty, np.uint16)
    for r in blocks.collect():
        at = slice(r["block"] * BLOCK_SLOTS, (r["block"] + 1) * BLOCK_SLOTS)
        others[:, at], whole[at] = np.frombuffer(r["others"], np.uint16).reshape(PARTS, -1), np.frombuffer(r["all"], np.uint16)
    return others.ravel(), whole


def _met(batches, coder: Coder):
    """The tokens of training texts: (part, how often, leaf numbers, leaves before them).

    A token counts once for all that are like it, in the same part and after the same leaves, among those held at once.
    """
    wide, low = np.uint64(HEAD_BITS + 1), np.uint64((1 << (HEAD_BITS + 1)) - 1)
    for group, ids, ends in _held(batches, MET_AT_ONCE):
        part = np.concatenate([b.column("rest").to_numpy(zero_copy_only=False) for b in group]) % PARTS
        key = np.repeat(part.astype(np.uint64), np.diff(ends, prepend=0))
        for x in (*coder.lasts(ids, ends), ids):
            key <<= wide
            key |= x
        del group
        key, times = np.unique(key, return_counts=True)
        for k in range(0, len(key), BITS_OF_AT_ONCE):
            some = key[k : k + BITS_OF_AT_ONCE]
            leaves = [(some >> (wide * np.uint64(n)) & low).astype(np.uint32) for n in range(ORDERS + 1)]
            yield (some >> (wide * np.uint64(ORDERS + 1))).astype(np.int64), times[k : k + BITS_OF_AT_ONCE].astype(np.int32), leaves[0], leaves[:0:-1]


def _summed(training: DataFrame, mixer: Mixer, sums, shape: tuple[int, ...]) -> np.ndarray:
    """``sums(inputs, gates, bits, odds, times)`` over all training texts, an array of that shape; the mixer has the tables without each part."""
    sent = training.sparkSession.sparkContext.broadcast(mixer)

    def run(batches):
        total = np.zeros(shape)
        for part, times, ids, lasts in _met(batches, sent.value.coder):
            place, node, bit, slots = sent.value.coder.bits(ids, lasts)
            table = (part << SLOT_BITS).astype(np.uint32)[place]
            x, gate = sent.value.inputs(node, [at | table for at in slots])
            odds = sent.value.odds(x, gate).clip(-8, 8)
            total += sums(x, gate, bit, odds, times[place])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

    out = np.zeros(int(np.prod(shape)))
    for r in training.select("rest", "ids").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out.reshape(shape)


def _newton(x, gate, bit, odds, times):
    """Gradient and curvature of each gate, side by side."""
    order = np.argsort(gate, kind="stable")
    p = 1 / (1 + np.exp(-odds.astype(float)))
    err, bend = (times * (bit - p))[order], (times * p * (1 - p))[order]
    x = np.stack([a[order] for a in x]).astype(float)
    bent = x * bend
    cuts = np.searchsorted(gate[order], np.arange(GATES + 1))
    out = np.zeros((GATES, INPUTS, INPUTS + 1))
    for g in np.flatnonzero(np.diff(cuts)):
        at = slice(cuts[g], cuts[g + 1])
        out[g, :, :INPUTS] = bent[:, at] @ x[:, at].T
        out[g, :, INPUTS] = x[:, at] @ err[at]
    return out


def _knots(x, gate, bit, odds, times):
    """For each knot of the map, the ones and all bits near it."""
    at = (odds + 8) * ((KNOTS - 1) / 16)
    low = at.astype(np.int64).clip(0, KNOTS - 2)
    part = at - low
    sides = [(low, 1 - part), (low + 1, part)]
    return np.stack([sum(np.bincount(k, w * y, KNOTS) for k, w in sides) for y in (times * bit, times)])


def trained(training: DataFrame, coder: Coder) -> Mixer:
    """The model of the coded training texts; sums are rounded, so that their order does not show."""
    others, whole = slot_counts(training, coder)
    mixer = Mixer(coder, others)
    for _ in range(STEPS):
        s = _summed(training, mixer, _newton, (GATES, INPUTS, INPUTS + 1))
        bend = s[:, :, :INPUTS] + 10.0 * np.eye(INPUTS)
        step = np.linalg.solve(bend, s[:, :, INPUTS:])[:, :, 0].clip(-0.5, 0.5)
        mixer = Mixer(coder, others, np.rint((mixer.weights + step) * 1024).astype(np.float32) / 1024)
    seen = _summed(training, mixer, _knots, (2, KNOTS))
    fixed = (seen[0] + 16 * mixer.fixed) / (seen[1] + 16)
    return Mixer(coder, whole, mixer.weights, np.rint(fixed.clip(1e-5, 1 - 1e-5) * (1 << 20)) / (1 << 20))


def score(docs: DataFrame, part: int = 2, by: int = 7) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row.

    Rows whose id's checksum leaves ``part`` when divided by ``by`` are held out; ``by`` divides FOLD.
    """
    spark = docs.sparkSession
    ship(spark)
    if FOLD % by:
        raise ValueError(f"{by} does not divide {FOLD}")
    docs = docs.select("doc_id", "text")
    counts = stored(word_counts(docs.where(remainder("doc_id", by) != part)), "word-counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(_END), F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v = whole["n"], whole["v"]
    often = counts.where((F.col("c") * (1 << KNOWN_BITS) >= n) & (F.col("word") != F.lit(_END))).collect()  # at most 2 ** KNOWN_BITS
    words = [(bytes(r["word"]), r["c"]) for r in often if r["c"] << HEAD_BITS >= n]  # at most 2 ** HEAD_BITS
    rest, kinds = n - whole["ends"] - sum(c for _, c in words), v - len(words) - (whole["ends"] > 0)
    coder = Coder(words, rest, whole["ends"])
    coded = coded_texts(docs, coder, {bytes(r["word"]): r["c"] for r in often if r["c"] << HEAD_BITS < n})
    mixer = trained(coded.where(F.col("rest") % by != part), coder)
    count = np.zeros(coder.start)
    for w, c in words:
        count[coder.number[w]] = c
    count[coder.end] = whole["ends"]
    base = np.log10((count + 1) / (n + v + 1))
    base[coder.escape] = 0.0
    sent = spark.sparkContext.broadcast((mixer, count, base))
    through = ("row", "n_bytes", "some", "logs")

    def run(batches):
        mixer, count, base = sent.value
        for group, ids, ends in _held(batches):
            size = np.diff(ends, prepend=0)
            text = np.repeat(np.arange(len(size)), size)
            cols = [pa.chunked_array([b.column(c) for b in group]).combine_chunks() for c in ("doc_id", *through)]
            escapes = np.bincount(text, ids == mixer.coder.escape, len(size)).astype(np.int64)
            sums = [size, np.bincount(text, count[ids] > 0, len(size)).astype(np.int64), escapes, np.bincount(text, base[ids], len(size)), mixer.scores(ids, ends)]
            held = np.concatenate([b.column("rest").to_numpy(zero_copy_only=False) for b in group]) % by == part
            yield pa.RecordBatch.from_arrays([*cols, pa.array(held), *map(pa.array, sums)], names=["doc_id", *through, "held_out", "n_tokens", "n_known", "escapes", "base", "coded"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = coded.select("doc_id", "rest", *through, "ids").mapInArrow(run, f"doc_id {kind}, row long, n_bytes long, some long, logs double, held_out boolean, n_tokens long, n_known long, escapes long, base double, coded double")
    rare = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    # A word that training has not seen adds the logarithm of one, which is nothing.
    met = rare.join(counts.where(F.col("c") * (1 << KNOWN_BITS) < n), "word").select("row", "times", (F.col("times") * F.log10(F.col("c") + 1)).alias("l"))
    tail = met.groupBy("row").agg(F.sum("times").alias("t_known"), F.sum("l").alias("t_logs"))
    logs = F.col("logs") + F.coalesce("t_logs", F.lit(0.0))
    out = scored.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("some") + F.coalesce("t_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("escapes") * math.log10(n + v + 1)).alias("base_score"), (F.col("coded") + logs - F.col("escapes") * math.log10(rest + kinds + 1)).alias("score"), "n_bytes",
    )
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))).drop("n_bytes")


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, with the bits for each byte beside them."""
    return score(table(spark, sf_dir, "documents"))
