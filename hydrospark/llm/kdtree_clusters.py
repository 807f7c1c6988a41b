"""K-means over whole-number vectors, filtered through kd-trees.

Every task cuts its vectors into kd-trees of at most ``TREE_POINTS``; a node holds the count, the sums and the
bounding box of its vectors.  The trees are stored once, and each round streams them past the
centroids: at a node the centroid nearest to the box's middle stays, and every other one that
is strictly farther from all of the box goes; a node with one centroid left is assigned whole, by its
count and sums, and leaves are resolved vector by vector.  All of it is in whole numbers, so results
do not depend on how vectors are dealt, and ties go to the smaller number.

Scale: no vector is shuffled; a round moves one row for each centroid and component from each task, and the
driver holds nothing but the centroids.

Defined results: only vectors with exactly the given number of components, none null, NaN or infinite, are
kept; repeated rows count each for itself; vectors without an id come last when the first centroids are
chosen, equal ids go by their components; with fewer vectors than centroids there are as many
centroids as vectors; an empty table gives an empty result; other columns are not read.  A component beyond
``LARGEST`` after scaling stops the job with a message, as its squares would leave 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm.common import ship, stored, table

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
#: Vectors of one tree, and of a leaf.
TREE_POINTS = 4096
LEAF_POINTS = 32
LARGEST = 1 << 26


def scaled(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: kept vectors as whole numbers."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).where((F.size("e") == dims) & F.coalesce(F.forall("e", sound), F.lit(False)))
    far = F.exists("e", lambda x: F.abs(x) * scale > LARGEST)
    e = F.when(far, F.raise_error(F.lit(f"a component is over {LARGEST} after scaling"))).otherwise(F.col("e"))
    return kept.select("vec_id", F.transform(e, lambda x: F.floor(scale * x)).alias("v"))


def first_centroids(kept: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest digests of ``seed:vec_id``, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Tree:
    """A kd-tree over the rows of ``points``; node i holds rows ``order[start[i]:end[i]]``, children are ``left[i]`` and the next."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        spans, left = [(0, len(points))], []
        for a, b in spans:  # grows while it is read
            at = self.order[a:b]
            wide = points[at].max(0) - points[at].min(0)
            if b - a <= LEAF_POINTS or not wide.any():
                left.append(-1)
                continue
            mid = (b - a) // 2
            self.order[a:b] = at[np.argpartition(points[at, int(wide.argmax())], mid)]
            left.append(len(spans))
            spans += [(a, a + mid), (a + mid, b)]
        self.start, self.end = np.array(spans, np.int64).reshape(-1, 2).T
        self.left = np.array(left, np.int64)
        self.points = points[self.order]
        self.low = np.stack([self.points[a:b].min(0) for a, b in spans])
        self.high = np.stack([self.points[a:b].max(0) for a, b in spans])
        self.total = np.stack([self.points[a:b].sum(0) for a, b in spans])


def nearest(points: np.ndarray, centroids: np.ndarray, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each point's nearest centroid; the first of equals.  ``some`` tells which each point may take."""
    far = np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)
    if some is not None:
        far = np.where(some, far, np.iinfo(np.int64).max)
    best = far.argmin(1)
    return best, far[np.arange(len(points)), best]


def filtered(tree: Tree, centroids: np.ndarray):
    """Yield (node, centroid) for nodes that one centroid takes whole, then (rows, clusters) of the leaves' rest, as arrays.

    Works level by level, all nodes of a level at once.
    """
    node, may = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    squares = (centroids**2).sum(1)
    while len(node):
        low, high = tree.low[node], tree.high[node]
        middle = np.stack([((2 * c - low - high) ** 2).sum(1) for c in centroids], axis=1)
        star = np.where(may, middle, np.iinfo(np.int64).max).argmin(1)
        for z, c in enumerate(centroids):
            toward = c - centroids[star]
            corner = np.where(toward > 0, high, low)  # of the box, the one that favours z most
            may[:, z] &= squares[z] - squares[star] - 2 * (corner * toward).sum(1) <= 0
        alone = may.sum(1) == 1
        leaf = ~alone & (tree.left[node] < 0)
        size = tree.end[node[leaf]] - tree.start[node[leaf]]
        rows = np.repeat(tree.start[node[leaf]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        yield node[alone], star[alone], rows, nearest(tree.points[rows], centroids, np.repeat(may[leaf], size, axis=0))[0] if len(rows) else rows
        on = ~alone & ~leaf
        node, may = np.concatenate((tree.left[node[on]], tree.left[node[on]] + 1)), np.concatenate((may[on], may[on]))


_PARTS = ("order", "start", "end", "left", "points", "low", "high", "total")


def forest(kept: DataFrame) -> DataFrame:
    """One row for each tree: its vectors' ids and its arrays."""
    kind = dict(kept.dtypes)["vec_id"]

    def trees(ids: list, held: list[np.ndarray]):
        tree = Tree(np.concatenate(held))
        ids = pa.concat_arrays(ids).take(pa.array(tree.order))
        width = tree.points.shape[1]
        raw = [pa.array([getattr(tree, p).astype("<i8").tobytes()], pa.binary()) for p in _PARTS]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([width], pa.int32()), *raw], names=["ids", "width", *_PARTS])

    def run(batches):
        ids, held, n = [], [], 0
        for b in batches:
            lists = b.column("v")
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
            for k in range(0, b.num_rows, TREE_POINTS):
                part = at[k : k + TREE_POINTS]
                if n + len(part) > TREE_POINTS and n:
                    yield trees(ids, held)
                    ids, held, n = [], [], 0
                ids.append(b.column("vec_id").slice(k, len(part)))
                held.append(part)
                n += len(part)
        if n:
            yield trees(ids, held)

    ship(kept.sparkSession)
    return kept.mapInArrow(run, f"ids array<{kind}>, width int, " + ", ".join(f"{p} binary" for p in _PARTS))


def _trees(batch):
    """(ids, tree) for each row of a stored forest."""
    for k in range(batch.num_rows):
        tree, width = Tree.__new__(Tree), batch.column("width")[k].as_py()
        for p in _PARTS:
            x = np.frombuffer(batch.column(p)[k].as_buffer(), "<i8")
            setattr(tree, p, x.reshape(-1, width) if p in ("points", "low", "high", "total") else x)
        yield batch.column("ids")[k].values, tree


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floors of the means of what each takes."""
    sent = trees.sparkSession.sparkContext.broadcast(centroids)
    k, width = centroids.shape

    def run(batches):
        c, total, n = sent.value, np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for _, tree in _trees(b):
                for node, whole, rows, cluster in filtered(tree, c):
                    np.add.at(total, whole, tree.total[node])
                    np.add.at(n, whole, tree.end[node] - tree.start[node])
                    np.add.at(total, cluster, tree.points[rows])
                    n += np.bincount(cluster, minlength=k)
        cluster, at = np.repeat(np.arange(k), width), np.tile(np.arange(width), k)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(at, pa.int32()), pa.array(total.ravel()), pa.array(np.repeat(n, width))], names=["cluster", "at", "s", "n"])

    sums = trees.mapInArrow(run, "cluster int, at int, s long, n long").groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.where("n > 0").collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // int(r["n"])
    return out


def assigned(trees: DataFrame, centroids: np.ndarray, kind: str = "bigint") -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    sent = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = sent.value
        for b in batches:
            for ids, tree in _trees(b):
                took = np.zeros(len(tree.points), np.int64)
                for node, whole, rows, cluster in filtered(tree, c):
                    took[rows] = cluster
                    for i, z in zip(node.tolist(), whole.tolist()):
                        took[tree.start[i] : tree.end[i]] = z
                far = ((tree.points - c[took]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(took, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """Every kept vector's ``vec_id, cluster, distance``, and the centroids."""
    kept = stored(scaled(vectors, dims, scale), "kept-vectors")
    centroids = first_centroids(kept, k, seed)
    kind = dict(kept.dtypes)["vec_id"]
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    trees = stored(forest(kept), "kd-trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    return assigned(trees, centroids, kind), centroids


def op11_kdtree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns."""
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    rows = stored(rows, "assigned-vectors")
    each = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    # One row for each centroid.
    known = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(F.broadcast(each), "cluster").crossJoin(F.broadcast(rows.agg(F.sum("distance").alias("inertia"))))
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ROUND = """
a{n} AS (SELECT r, any_value(v) AS v, min({{'d': d, 'k': k}}) AS b FROM (SELECT r, v, k, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM kept, c{n}) GROUP BY r)"""
_MOVE = """,
m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT b.k AS k, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{n}) GROUP BY 1, 2),
f{n} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{n} GROUP BY k),
c{next} AS (SELECT c{n}.k, coalesce(f{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN f{n} USING (k)),"""
OP11_SQL = (
    """
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS k, v AS c FROM kept QUALIFY k < 16),"""
    + "".join(_ROUND.format(n=n) + _MOVE.format(n=n, next=n + 1) for n in range(ROUNDS))
    + _ROUND.format(n=ROUNDS)
    + f"""
SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.k = b.k"""
)
