"""Importance resampling towards a target distribution, over hashed runs of words.

The features of a text are its runs of 1 to ``RUN`` words, each hashed to a bucket.  A bucket's
gain is the log ratio of its smoothed shares in the target and in the corpus; a text's weight is the mean
gain of its features.  Documents are drawn without replacement by the largest sums of weight and Gumbel noise.

Equal texts are collapsed first by grouping whole texts: features are made and weighed once
for each distinct text, its counts are multiplied by its copies, and the weight is joined back before
the noise, which depends on the document alone.

Scale: texts are shuffled once, with their copies counted before; the bucket counts are one row
for each task and block of buckets; joins carry digests, and a text with very many copies is joined where its rows lie
(``join_counted``).  What is broadcast is one number for each bucket.  The order of the draw comes from a
range partition and the sizes of its partitions, so no task sees all scores.

Defined results: a null text is an empty one; a text without features weighs 0; a null doc_id has
the noise of an empty id and comes last among equal scores; rows that share a doc_id are drawn each for itself,
ties among them by weight, features, then in no set order; without a target every gain follows from the
corpus alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm.common import join_counted, ship, stored, table
from hydrospark.llm.decontamination import words_of

RUN = 2
BUCKETS = 10_000
#: Buckets whose counts travel together.
BLOCK = 250
LEAST_WORDS = 20
PERCENT = 25
SEED = 7


def features(words: list[bytes], run: int = RUN) -> np.ndarray:
    """The checksums of all runs of 1 to ``run`` words, joined by blanks, repeats included."""
    ends = [b" " + w for w in words]
    sums = list(map(zlib.crc32, words))
    out = [np.array(sums, np.uint32)]
    for n in range(1, min(run, len(words))):
        sums = list(map(zlib.crc32, ends[n:], sums))  # a run's checksum goes on from that of the run before its last word
        out.append(np.array(sums, np.uint32))
    return np.concatenate(out)


def collapsed(docs: DataFrame) -> DataFrame:
    """``key, text, copies`` of every distinct text; key is its digest."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select(F.sha2("text", 256).alias("key"), "text", "copies")


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all copies in each bucket.

    A task gives its counts in blocks of buckets, which are added up one by one.
    """
    spark = texts.sparkSession

    def count(batches):
        total = np.zeros(-(-buckets // BLOCK) * BLOCK, np.int64)
        for b in batches:
            for text, copies in zip(b.column("text").to_pylist(), b.column("copies").to_pylist()):
                total += copies * np.bincount(features(words_of(text), run) % np.uint32(buckets), minlength=len(total))
        blocks = total.reshape(-1, BLOCK)
        at = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([blocks[k].tobytes() for k in at], pa.binary())], names=["block", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("block").to_pylist(), b.column("n").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(raw, np.int64)
        for k, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * BLOCK, (k + 1) * BLOCK), pa.int32()), pa.array(n)], names=["bucket", "n"]).filter(pa.array(n > 0))

    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return texts.select("text", "copies").mapInArrow(count, "block int, n binary").repartition(parts, "block").mapInArrow(add, "bucket int, n long")


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """One whole number for each bucket: 1000 times the log ratio of its shares, floored."""
    spark = corpus.sparkSession
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    each = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(both)
    known = stored(each.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "bucket-counts")
    whole = known.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1) * F.lit(whole["s"] + buckets) / ((F.col("s") + 1) * F.lit(whole["t"] + buckets))
    rows = known.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def weighed(texts: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """``key, copies, n_words, n_features, weight`` of every distinct text."""
    sent = texts.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches):
        gain = sent.value
        for b in batches:
            n_words, n_features, weight = [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                found = features(words, run)
                n_words.append(len(words))
                n_features.append(len(found))
                weight.append(int(gain[found % np.uint32(len(gain))].sum()) // len(found) if len(found) else 0)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=["key", "copies", "n_words", "n_features", "weight"])

    return texts.mapInArrow(weigh, "key string, copies long, n_words long, n_features long, weight long")


def noise(doc_id: str = "doc_id", seed: int = SEED):
    """Gumbel noise in thousandths, floored, from a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(scored: DataFrame, many: int) -> DataFrame:
    """``scored`` rows that are eligible, with ``rank`` 1 to ``many`` by score and doc_id; null beyond."""
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("salt")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.repartitionByRange(n, *order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    placed = stored(dealt.withColumns({"part": part, "nth": F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)}), "draw-order")
    before, offsets = 0, []
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["part"], before))
        before += r["n"]
    first = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    rank = F.col("before") + F.col("nth") + 1
    return placed.join(first, "part").withColumn("rank", F.when(rank <= many, rank))


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``target`` needs ``text``.

    ``rank`` numbers the drawn rows: ``percent`` of those with at least ``least_words`` words.
    """
    ship(docs.sparkSession)
    texts = stored(collapsed(docs), "distinct-texts")
    gain = gains(bucket_counts(texts, run, buckets), bucket_counts(collapsed(target), run, buckets), buckets)
    known = stored(weighed(texts, gain, run), "text-weights")
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    joined = join_counted(rows, known, "key", "copies").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(seed=seed)).alias("score"))
    scored = stored(joined.withColumn("salt", F.monotonically_increasing_id()), "scores")
    may = scored.where(F.col("n_words") >= least_words)
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    n = may.count()
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*out)
    return rest.unionByName(drawn(may, n * percent // 100).select(*out)) if n else rest


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The checksum by its table, once for each distinct feature.
OP13_SQL = r"""
WITH RECURSIVE
step(n, k, c) AS (SELECT r, 0, r FROM range(256) t(r) UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8),
x AS (SELECT row_number() OVER () AS r, doc_id, text, 's' AS side FROM documents UNION ALL SELECT row_number() OVER (), NULL, text, 't' FROM benchmark),
w AS (SELECT r, doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT r, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS h, octet_length(encode(f)) AS n FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, n), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) % 10000 AS bucket FROM u, crc),
fb AS (SELECT r, side, bucket FROM f JOIN b USING (f)),
whole AS (SELECT CAST(count(*) FILTER (side = 's') AS DOUBLE) AS s, CAST(count(*) FILTER (side = 't') AS DOUBLE) AS t FROM fb),
g AS (SELECT bucket, floor(1000 * ln((CAST(count(*) FILTER (side = 't') AS DOUBLE) + 1) * (any_value(whole.s) + 10000) / ((CAST(count(*) FILTER (side = 's') AS DOUBLE) + 1) * (any_value(whole.t) + 10000)))) AS gain FROM fb, whole GROUP BY bucket),
d AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM fb JOIN g USING (bucket) WHERE side = 's' GROUP BY r),
sc AS (SELECT r, doc_id, len(w) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN d USING (r) WHERE side = 's'),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS k, count(*) OVER () AS n FROM sc WHERE may)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank FROM sc LEFT JOIN o USING (r)
"""
