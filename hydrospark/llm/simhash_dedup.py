"""SimHash near-duplicates found with BK-trees.

Every text gets a 64-bit SimHash of its 3-word shingles.  Two fingerprints link at
``RADIUS`` or fewer differing bits.  Cut into four 16-bit quarters, linked fingerprints
agree on a quarter, and with the other 48 bits cut into four they agree on one of those
as well; so each distinct fingerprint goes to 16 shards of 28 agreed bits, and no link
is lost.  The members of a shard form a BK-tree (children keyed by their Hamming distance
to the parent); each member walks the tree along edges within the radius.  A task
builds and walks the trees of all its shards together, level by level, in numpy.

Of the links found in a shard only a spanning set leaves the task: a group of n
fingerprints sends n - 1 links, not n * n.  A shard of more than ``TREE_QUERIES``
members is broadcast: its tree goes to several tasks, each with a part of the members as
queries.

Scale: texts are read once and never shuffled; what moves is 16 rows of 24 bytes for
each *distinct* fingerprint.  Copies share a fingerprint, so a hot group of copies is
one row.

The pipeline's stage (``keep_one``) takes near-duplicates as texts whose sets of 5-word shingles have a Jaccard
similarity of ``LEAST_JACCARD`` or more.  Fingerprints alone neither tell them (pages with a common frame are within the
radius) nor find them all (some ten bits differ), so links of the radius and pairs that share MinHash bands are
candidates, and every pair's texts are compared.  A text goes only if it reaches the similarity with one that
stays: chains delete nothing.  Bands alone, two bands that follow each other and three of them are
the keys of buckets; all members of a bucket meet its ``HEADS`` smallest texts (more in narrower buckets), and the
survivors are dealt to buckets again while that finds many new links (for one text in twenty).  That takes most texts out cheaply; then survivors that
share a bucket of one band, or a fingerprint, are compared.  In buckets of at most ``FEW`` all pairs are, unless their sizes
rule the similarity out.  Texts of larger buckets meet by their rarest shingles: in any one order of all
shingles two texts that reach the similarity share one of their first few (about a ninth, for texts of equal sizes), so
that pairs which share none of these cannot reach it, and are left out without being listed.
Where a link lets texts come back that have not been compared with all that stay, these are compared as well.
In the end no two survivors of one bucket reach the similarity.
What grows with the texts is joined by merging, whatever its size on disk: keys and texts are many times larger in memory
than in files, where digests that come again are written once, and a broadcast is held whole by the driver.

Defined results: a null or wordless text has fingerprint zero; repeated rows share a
component; a null doc_id stays a row and never names a component unless nothing else
is in it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from hydrospark.llm.common import aside, join_counted, numbered, ship, sliced, stored, table
from hydrospark.operators.graph import components

RADIUS = 3
WORDS = 3
#: The stage's second measure: shingles of so many words, the least similarity, and bands of so many minima.
WIDE_WORDS = 5
LEAST_JACCARD = 0.8
BANDS = 14
BAND_ROWS = 4
#: Members that all others of a bucket of one band, two and three meet; in the first pass it is one, of one band.
HEADS = (1, 2, 4)
#: Members of a bucket that are all compared with each other; those of larger ones meet by their rarest shingles.
FEW = 16
#: More texts than these meet the heads before all that can be near are compared, and again if that finds links for one in twenty.
MANY = 1000
#: Shingles are put in order by how often those of the same slot come; a power of two.
SLOTS = 1 << 20
SEED = 42
#: Members of a shard that one task uses as queries; larger shards are walked by several tasks.
TREE_QUERIES = 20_000
#: Rows that a task holds at once, beyond the shard it is reading.
ROWS_AT_ONCE = 400_000


def shingle_hashes(text: str | None) -> np.ndarray:
    """The hash of every shingle of ``WORDS`` words; a shorter text is one shingle, a wordless one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length) - 1
    start = end - length + 1
    cuts = zip(start[: 1 - WORDS].tolist(), end[WORDS - 1 :].tolist())
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(words) - WORDS + 1)


def fingerprint(text: str | None) -> int:
    """The SimHash: bit i is set if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a signed long) of every row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def shard_keys(radius: int = RADIUS) -> list[str]:
    """SQL for the 16 shard keys of ``fp``: quarter i of it, and part j of the other 48 bits."""
    assert radius == 3, "the blocks are cut for three differing bits"
    keys = []
    for i in range(4):
        quarter = f"(shiftrightunsigned(fp, {16 * i}) & 65535)"
        low = f"(fp & {(1 << 16 * i) - 1})" if i else "0L"
        high = f"shiftleft(shiftrightunsigned(fp, {16 * i + 16}), {16 * i})" if i < 3 else "0L"
        rest = f"({low} | {high})"
        for j in range(4):
            keys.append(f"(shiftleft({4 * i + j}L, 28) | shiftleft({quarter}, 12) | (shiftrightunsigned({rest}, {12 * j}) & 4095))")
    return keys


class Forest:
    """BK-trees of many shards at once.

    Nodes are positions in ``fp``.  The first member of a shard is its root; the others
    are dealt by their distance to it, the first of each distance becomes the child on
    that edge, and so on: the tree that inserting them one by one gives.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp, n = fp, len(fp)
        edges: list[np.ndarray] = []
        node = np.arange(n)
        _, first, group = np.unique(shard, return_index=True, return_inverse=True)
        self.root_of = first[group]
        parent = self.root_of
        rest = node[node != parent]
        parent = parent[rest]
        while len(rest):
            far = np.bitwise_count(fp[rest] ^ fp[parent]).astype(np.int64)
            key = parent * 65 + far
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            child = rest[first]
            edges.append(np.stack((parent[first], far[first], child)))
            head = child[group]
            inner = rest != head
            rest, parent = rest[inner], head[inner]
        e = np.concatenate(edges, axis=1) if edges else np.zeros((3, 0), np.int64)
        order = np.argsort(e[0] * 65 + e[1], kind="stable")
        self.edge = (e[0] * 65 + e[1])[order]
        self.child = e[2][order]

    def within(self, query: np.ndarray, fp: np.ndarray, radius: int):
        """Pairs (query, node): from each query's root, along edges within the radius."""
        q, node = np.arange(len(query)), self.root_of[query]
        while len(q):
            far = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
            near = far <= radius
            yield query[q[near]], node[near]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(far - radius, 0), "left")
            high = np.searchsorted(self.edge, node * 65 + np.minimum(far + radius, 64), "right")
            times = high - low
            q = np.repeat(q, times)
            node = self.child[np.repeat(low - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]


def spanning(shard: np.ndarray, fp: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links of the queries do."""
    forest = Forest(shard, fp)
    top = np.arange(len(fp))
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = int(top[x])
        return x

    for k in range(0, len(queries), 4096):
        part = queries[k : k + 4096]
        for q, node in forest.within(part, fp[part], radius):
            q, node = q[fp[q] != fp[node]], node[fp[q] != fp[node]]
            while len(q):  # pairs whose ends are known to be joined drop out in bulk
                apart = top[q] != top[node]
                q, node = q[apart], node[apart]
                _, one = np.unique(top[q] * len(fp) + top[node], return_index=True)
                for a, b in zip(q[one].tolist(), node[one].tolist()):
                    x, y = find(a), find(b)
                    if x != y:
                        top[max(x, y)] = min(x, y)
                        out.append((int(fp[a]), int(fp[b])))
                while not np.array_equal(top, top[top]):
                    top = top[top]
    return out


def _links(batches):
    """Links within the shards of a task; rows come sorted by shard."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray):
        queries = np.flatnonzero(rows[2])
        found = spanning(rows[0], rows[1].view(np.uint64), queries)
        pair = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    size = 0
    for b in batches:
        held.append(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "fp", "query")]))
        size += b.num_rows
        if size >= ROWS_AT_ONCE:
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1], "left"))  # the last shard may go on
            if cut:
                yield solve(rows[:, :cut])
            held, size = [rows[:, cut:]], rows.shape[1] - cut
    if size:
        yield solve(np.concatenate(held, axis=1))


def near_links(distinct: DataFrame) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints ``fp`` within the radius."""
    dealt = distinct.select("fp", F.explode(F.array(*[F.expr(k) for k in shard_keys()])).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n"))
    # A fingerprint alone in a shard has no link there.  By merging: to the planner 16 rows of an array look like one.
    shared = dealt.join(sizes.where("n > 1").hint("merge"), "key")
    parts = F.ceil(F.col("n") / TREE_QUERIES).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts)
    placed = shared.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select(
        F.xxhash64("key", "part").alias("shard"), "fp", (F.col("own") == F.col("part")).cast("long").alias("query")
    )
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "shard").sortWithinPartitions("shard", "fp").mapInArrow(_links, "a long, b long").distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row."""
    printed = stored(fingerprints(docs), "simhash")
    distinct = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    groups = components(near_links(distinct))
    named = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = stored(named.join(least, "root").select("fp", "n", "component_id"), "simhash-labels")
    return join_counted(printed, label, "fp", "n").select("doc_id", "fp", "component_id")


_ODD = np.uint64(0x9E3779B97F4A7C15)
_DRAW = np.random.default_rng(SEED)
_TIMES = _DRAW.integers(1 << 63, size=(BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(1 << 63, size=(BANDS * BAND_ROWS, 1), dtype=np.uint64)


def wide_shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of ``WIDE_WORDS`` words, as numbers made of the words' hashes; a shorter text is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    number = {w: xxh64_intdigest(w, SEED) for w in dict.fromkeys(words)}
    each = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    size = min(WIDE_WORDS, len(each))
    out = np.zeros(len(each) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * _ODD + each[k : k + len(out)]
    return np.unique(out ^ (out >> np.uint64(32)))


def bands(text: str | None) -> list[int]:
    """The MinHash bands of the 5-word shingles, each as one signed number; none for a wordless text."""
    return bands_of(wide_shingles(text))


def bands_of(hashes: np.ndarray) -> list[int]:
    """``bands`` of a text's shingles."""
    if not len(hashes):
        return []
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[k : k + 4096] * _TIMES + _PLUS).min(1))
    raw = least.tobytes()
    size = 8 * BAND_ROWS
    return np.array([xxh64_intdigest(raw[k : k + size], k) for k in range(0, len(raw), size)], np.uint64).view(np.int64).tolist()


def jaccard(a: str | None, b: str | None) -> float:
    """Similarity of the sets of 5-word shingles."""
    x, y = wide_shingles(a), wide_shingles(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def digest(text: str | None) -> bytes:
    """What stands for all texts of the same lower-cased words."""
    return xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))


def _banded(rows: DataFrame) -> DataFrame:
    """``doc_id, row, node, fp, bands, size`` of numbered rows; node is the digest, size the number of distinct 5-word shingles."""

    def run(batches):
        for b in sliced(batches):
            texts = b.column("text").to_pylist()
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            node = pa.array([digest(t) for t in texts], pa.binary())
            wide = [(bands_of(h), len(h)) for h in map(wide_shingles, texts)]
            made = [pa.array(fp), pa.array([w for w, _ in wide], pa.list_(pa.int64())), pa.array([n for _, n in wide], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), node, *made], names=["doc_id", "row", "node", "fp", "bands", "size"])

    ship(rows.sparkSession)
    return rows.select("doc_id", F.col("__row").alias("row"), "text").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, row long, node binary, fp long, bands array<long>, size long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def radius_pairs(distinct: DataFrame) -> DataFrame:
    """Candidates ``a, b`` of the radius: every text with the smallest of its fingerprint, and those of linked fingerprints."""
    least = stored(distinct.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "simhash-least")
    same = join_counted(distinct.select("node", "fp"), least, "fp", "n").select(F.col("node").alias("a"), F.col("least").alias("b"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"__{c}")).hint("merge")
    linked = near_links(least.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))
    return _ordered(same.unionByName(linked))


def first_pairs(distinct: DataFrame) -> DataFrame:
    """``node, head``: every text of a band's bucket of several, with the smallest one (which may be itself)."""
    dealt = stored(distinct.select("node", F.explode("bands").alias("key")), "simhash-bands")
    shared = stored(dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1"), "simhash-heads")
    return stored(join_counted(dealt, shared, "key", "n").select("node", "head").distinct(), "simhash-met")


def band_pairs(live: DataFrame) -> DataFrame:
    """Candidates ``a, b``: every text with the smallest ones of each of its buckets, of one band, two and three."""
    at = lambda i, *more: F.xxhash64(*[F.element_at("bands", (i + k) % BANDS + 1) for k in more], F.lit(len(more)))
    places = F.sequence(F.lit(0), F.lit(BANDS - 1))
    key = lambda k, bands: F.struct(k.alias("key"), F.lit(HEADS[bands - 1]).alias("most"))
    keys = F.concat(F.transform("bands", lambda b: key(b, 1)), F.transform(places, lambda i: key(at(i, 0, 1), 2)), F.transform(places, lambda i: key(at(i, 0, 1, 2), 3)))
    dealt = stored(live.select("node", F.explode(keys).alias("k")).select("node", "k.*"), "simhash-bands")
    first = dealt.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("node"))).where(F.col("nth") <= F.least("most", F.lit(max(HEADS))))
    heads = stored(first.groupBy("key").agg(F.collect_list("node").alias("heads")), "simhash-heads")
    # A text has each head once, whatever buckets they share.
    met = dealt.join(heads.hint("merge"), "key").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("heads"))).alias("heads"))
    smaller = met.select("node", F.filter("heads", lambda h: h < F.col("node")).alias("heads"))
    return _ordered(smaller.select(F.col("node").alias("a"), F.explode("heads").alias("b")))


def bucket_keys() -> Column:
    """The keys of a text's buckets: its bands, and its fingerprint."""
    return F.concat("bands", F.array(F.xxhash64("fp", F.lit(0))))


def _may_reach(n: str, m: str) -> Column:
    """Sets of these sizes can have ``LEAST_JACCARD``."""
    return F.least(n, m) >= F.greatest(n, m) * LEAST_JACCARD - 1e-6


def bucket_pairs(live: DataFrame, fresh: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """Candidates ``a, b``: all pairs that share a band or a fingerprint and whose sizes let them reach ``LEAST_JACCARD``.

    One of each pair is ``fresh`` where these are given; buckets of the keys ``without`` are left out.
    """

    def dealt(rows: DataFrame) -> DataFrame:
        out = rows.select("node", "size", F.explode(bucket_keys()).alias("key"))
        return stored(out.join(without, "key", "left_anti") if without is not None else out, "simhash-buckets")

    mine = dealt(live if fresh is None else fresh)
    other = (mine if fresh is None else dealt(live)).select(F.col("node").alias("b"), F.col("size").alias("m"), "key")
    order = F.col("node") < F.col("b") if fresh is None else F.col("node") != F.col("b")
    return _ordered(mine.join(other.hint("merge"), "key").where(order & _may_reach("size", "m")).select(F.col("node").alias("a"), "b"))


def slot_counts(texts: DataFrame) -> np.ndarray:
    """How many of ``texts`` have a shingle of each slot, counted by shingle."""

    def run(batches):
        n = np.zeros(SLOTS, np.int64)
        for b in sliced(batches):
            each = [wide_shingles(t) for t in b.column("text").to_pylist()]
            if each:
                n += np.bincount((np.concatenate(each) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])

    ship(texts.sparkSession)
    counts = texts.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    return out


def _overlap(n: int) -> int:
    """The least that a set of ``n`` shares with another one at ``LEAST_JACCARD``."""
    return int(np.ceil(n * LEAST_JACCARD - 1e-6))


def rarest(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """``node, size, nth, shingle`` of the shingles of each text of which two texts at ``LEAST_JACCARD`` share one; rarest first.

    ``counts`` are those of all texts that may be compared: a shingle alone in its slot is in no other text.
    """
    sent = texts.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))

    def run(batches):
        for b in sliced(batches, 256):
            rows: list[tuple] = []
            for node, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist()):
                hashes = wide_shingles(text)
                times = sent.value[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
                first = np.lexsort((hashes, times))[: len(hashes) - _overlap(len(hashes)) + 1]
                rows += [(node, len(hashes), int(k), int(hashes[first[k]])) for k in np.flatnonzero(times[first] > 1)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            made = [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(np.array(cols[3], np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(made, names=["node", "size", "nth", "shingle"])

    return texts.mapInArrow(run, "node binary, size long, nth long, shingle long")


def rare_pairs(rare: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """Candidates ``a, b`` of the shingles of ``rarest``: no pair at ``LEAST_JACCARD`` is missing.  One of each is ``fresh`` where these are given.

    A shingle counts only as far as what comes from it on in both texts can still be enough.
    """
    mine = rare if fresh is None else rare.join(fresh.select("node"), "node", "left_semi")
    other = rare.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("nth").alias("mth"), "shingle")
    order = F.col("node") < F.col("b") if fresh is None else F.col("node") != F.col("b")
    least = F.ceil((F.col("size") + F.col("m")) * (LEAST_JACCARD / (1 + LEAST_JACCARD)) - 1e-6)
    enough = (F.col("size") - F.col("nth") >= least) & (F.col("m") - F.col("mth") >= least)
    return _ordered(mine.join(other.hint("merge"), "shingle").where(order & _may_reach("size", "m") & enough).select(F.col("node").alias("a"), "b"))


def texts_of(rows: DataFrame, distinct: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the ``nodes``; ``distinct`` has each node's row as ``first``."""
    wanted = distinct.join(nodes, "node", "left_semi").select("node", F.col("first.doc_id").alias("__id"), F.col("first.row").alias("__r"))
    return stored(rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["__id"]) & (rows["__row"] == wanted["__r"])).select("node", "text"), "simhash-texts")


def similar(rows: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the stored ``pairs`` whose texts reach ``LEAST_JACCARD``; ``distinct`` has each node's row as ``first``."""
    texts = texts_of(rows, distinct, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    of = lambda c, text: texts.select(F.col("node").alias(c), F.col("text").alias(text)).hint("merge")
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")

    def run(batches):
        for t in sliced(batches):
            near = [jaccard(x, y) >= LEAST_JACCARD for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist())]
            yield t.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def covered(links: DataFrame) -> DataFrame:
    """The nodes that go: in the order of their digests, whatever has a link (a < b) to a smaller one that stays.

    Round by round, nodes without a smaller neighbour stay and take theirs along; digests are random, so
    the rounds grow with the logarithm of the nodes.
    """
    edges, gone = links, None
    while not edges.isEmpty():
        stay = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_anti")
        hit = stored(edges.join(stay, "a", "left_semi").select(F.col("b").alias("node")).distinct(), "simhash-gone")
        gone = hit if gone is None else gone.unionByName(hit)
        edges = stored(edges.join(hit, edges["a"] == hit["node"], "left_anti").join(hit, edges["b"] == hit["node"], "left_anti"), "simhash-left")
    return gone if gone is not None else links.select(F.col("b").alias("node"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of texts of the same words the one of the smallest doc_id, and of those each that reaches ``LEAST_JACCARD`` with none that stays.

    Among near-duplicates the smaller digest stays.  Rows that share a doc_id or have none are told
    apart by a row number; those without one stay only where no other row of the same words has one.
    """
    docs, back = aside(docs)
    rows = numbered(docs)
    printed = _banded(rows)
    key = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row")
    distinct = stored(printed.groupBy("node").agg(F.min(F.struct(key.alias("first"), "fp", "bands", "size")).alias("m")).select("node", "m.*"), "simhash-distinct")
    met = first_pairs(distinct)
    pairs = stored(_ordered(radius_pairs(distinct).unionByName(met.select(F.col("node").alias("a"), F.col("head").alias("b")))), "simhash-pairs")
    seen, links = pairs, stored(similar(rows, distinct, pairs), "simhash-links")
    # Only texts that share a bucket with another can meet one in a later pass.
    several = met.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    crowd = stored(distinct.join(several, "node", "left_semi"), "simhash-crowd")
    dense = stored(crowd.select(F.explode(bucket_keys()).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("key"), "simhash-dense")
    texts = counts = rare = compared = None
    while True:
        gone = stored(covered(links), "simhash-covered")
        live = stored(crowd.join(gone, "node", "left_anti"), "simhash-live")
        # All pairs of what stayed last time have been compared.
        fresh = live if compared is None else stored(live.join(compared.select("node"), "node", "left_anti"), "simhash-fresh")
        many, found = fresh.count(), []
        if not many:
            break
        if many > MANY:
            pairs = stored(band_pairs(live).join(seen, ["a", "b"], "left_anti"), "simhash-pairs")
            found.append(stored(similar(rows, crowd, pairs), "simhash-links"))
            seen = seen.unionByName(pairs)
        if not found or 20 * found[0].count() <= many:
            pairs = bucket_pairs(live, None if compared is None else fresh, dense)
            if texts is None and not dense.isEmpty():
                inside = crowd.select("node", F.explode(bucket_keys()).alias("key")).join(dense, "key", "left_semi").select("node")
                texts = texts_of(rows, crowd, inside)
                counts = slot_counts(texts)
            if texts is not None:
                new = texts.join(fresh.select("node"), "node", "left_semi")
                new = stored(rarest(new if rare is None else new.join(rare.select("node"), "node", "left_anti"), counts), "simhash-rarest")
                rare = new if rare is None else rare.unionByName(new)
                pairs = pairs.unionByName(rare_pairs(rare.join(live.select("node"), "node", "left_semi"), None if compared is None else fresh)).distinct()
            pairs = stored(pairs.join(seen, ["a", "b"], "left_anti"), "simhash-pairs")
            found.append(stored(similar(rows, crowd, pairs), "simhash-links"))
            seen, compared = seen.unionByName(pairs), live
        if all(x.isEmpty() for x in found):
            break
        for x in found:
            links = links.unionByName(x)
        links = stored(links, "simhash-links")
    stay = distinct.join(gone, "node", "left_anti").select(F.col("first.doc_id").alias("__id"), F.col("first.row").alias("__r"))
    return back(rows.join(stay, rows["doc_id"].eqNullSafe(stay["__id"]) & (rows["__row"] == stay["__r"]), "left_semi"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns."""
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
