"""Sharding by fixed virtual slots.

Records are hashed into ``N_SLOTS`` virtual slots; the bytes of each slot are summed, and a
versioned map gives every slot a shard.  Version 1 places the heaviest slots first, each
on the lightest shard, so shards are near equal in bytes (law ``bytes``).  The map is a table
under a path of the caller's, a folder for each version; ``shard`` uses its latest version
where there is one, and ``rebalance`` edits that into the next: slots move into the new
shards, or from overfull into light ones, and nowhere else.  The slot of a record never changes.

Scale: one pass over doc_id and the text's length; what is shuffled is (slot, doc_id, size)
to number the records, and the keys of rows that are repeated.  A slot holds a small, even part
of the rows whatever the sources or texts are, as slots hash doc_id, text and, of rows equal in
both, which copy it is.  The map has ``N_SLOTS`` rows and the driver sees one sum for each slot.

Defined results: a null text has no bytes and checksum 0; null doc_ids hash like a value;
rows equal in id and text are copies 0, 1, ... in no set order and go to slots of their own; an
empty table gives an empty result and a map of empty slots; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrospark.llm.common import shared_path, stored, table

N_SLOTS = 4096
N_SHARDS = 40
ROW_BYTES = 16
#: Copies of one row that are numbered together.
BLOCK = 100_000


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot`` of every row."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    plain = docs.select("doc_id", (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = stored(plain.withColumn("__at", F.monotonically_increasing_id()), "sizes")
    same = ["doc_id", "size", "text_crc32"]
    often = rows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"__{c}") for c in same])
    often = stored(often, "repeated-rows")
    if often.isEmpty():
        copies = rows.withColumn("copy", F.lit(0).cast("long"))
    else:
        equal = rows["doc_id"].eqNullSafe(often["__doc_id"]) & (rows["size"] == often["__size"]) & (rows["text_crc32"] == often["__text_crc32"])
        # Numbered in blocks of rows that lie together, then the blocks one after the other: no task holds all copies of a row.
        block = F.floor(F.col("__at") / (1 << 33))
        some = stored(rows.join(often, equal, "left_semi").withColumns({"__part": block, "__sub": F.floor(F.col("__at") % (1 << 33) / BLOCK)}), "copies")
        blocks = some.groupBy(*same, "__part", "__sub").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy(*same).orderBy("__part", "__sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        offset = blocks.select(*[F.col(c).alias(f"__{c}") for c in same], F.col("__part").alias("__p"), F.col("__sub").alias("__s"), before.alias("__before"))
        nth = F.row_number().over(W.partitionBy(*same, "__part", "__sub").orderBy("__at")) - 1
        numbered = some.withColumn("__nth", nth)
        there = numbered["doc_id"].eqNullSafe(offset["__doc_id"]) & (numbered["size"] == offset["__size"]) & (numbered["text_crc32"] == offset["__text_crc32"]) & (numbered["__part"] == offset["__p"]) & (numbered["__sub"] == offset["__s"])
        copied = numbered.join(offset, there).select(*same, (F.col("__before") + F.col("__nth")).cast("long").alias("copy"))
        copies = rows.join(often, equal, "left_anti").select(*same, F.lit(0).cast("long").alias("copy")).unionByName(copied)
    which = F.when(F.col("copy") > 0, F.concat(F.lit(":"), F.col("copy").cast("string"))).otherwise("")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string"), which))
    return copies.select(*same, (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n_slots).cast("int").alias("vslot"))


def slot_loads(rows: DataFrame, n_slots: int = N_SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of each slot; at most ``n_slots`` rows reach the driver."""
    found = {r["vslot"]: (r["b"], r["n"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    return [found.get(s, (0, 0)) for s in range(n_slots)]


def balanced(loads: list[tuple[int, int]], n_shards: int = N_SHARDS) -> list[int]:
    """Version 1 of the map: heaviest slot first, to the lightest shard (ties: the lower number)."""
    out = [0] * len(loads)
    heap = [(0, s) for s in range(n_shards)]
    for slot in sorted(range(len(loads)), key=lambda k: (-loads[k][0], k)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + loads[slot][0], shard))
    return out


def grown(slot_map: list[int], loads: list[tuple[int, int]], more: int = 1) -> list[int]:
    """The next version, with ``more`` further shards: slots move into those and nowhere else.

    Slots leave the fullest shard, largest that fits first, until each new shard has its even part.
    """
    out = list(slot_map)
    for new in range(max(out) + 1, max(out) + 1 + more):
        total = [0] * (new + 1)
        members: list[list[int]] = [[] for _ in range(new)]
        for slot, shard in enumerate(out):
            total[shard] += loads[slot][0]
            members[shard].append(slot)
        goal = sum(total) / (new + 1)
        for m in members:
            m.sort(key=lambda s: (loads[s][0], s))
        while total[new] < goal:
            donor = max((s for s in range(new) if members[s]), key=lambda s: (total[s], -s), default=None)
            fits = [s for s in members[donor] if loads[s][0] and total[new] + loads[s][0] <= goal] if donor is not None else []
            if not fits or total[donor] <= goal:
                break
            slot = fits[-1]
            members[donor].remove(slot)
            total[donor] -= loads[slot][0]
            total[new] += loads[slot][0]
            out[slot] = new
    return out


def evened(slot_map: list[int], loads: list[tuple[int, int]], slack: float = 0.02) -> list[int]:
    """The next version for a corpus that has grown: slots of overfull shards go to the lightest, while that helps.

    Shards within ``slack`` of the mean keep their slots.
    """
    out = list(slot_map)
    n = max(out) + 1
    total = [0] * n
    members: list[list[int]] = [[] for _ in range(n)]
    for slot, shard in enumerate(out):
        total[shard] += loads[slot][0]
        members[shard].append(slot)
    limit = sum(total) / n * (1 + slack)
    for donor in sorted(range(n), key=lambda s: -total[s]):
        for slot in sorted(members[donor], key=lambda k: (-loads[k][0], k)):
            to = min(range(n), key=lambda s: (total[s], s))
            if total[donor] <= limit:
                break
            if loads[slot][0] and total[to] + loads[slot][0] < total[donor] and total[to] + loads[slot][0] <= limit:
                total[donor] -= loads[slot][0]
                total[to] += loads[slot][0]
                out[slot] = to
    return out


_MAP = "version int, vslot int, shard int, bytes long, rows long"


def write_map(spark: SparkSession, slot_map: list[int], loads: list[tuple[int, int]], path: str, version: int) -> None:
    """Write one version of the map; a version that is there already is never overwritten."""
    rows = [(version, slot, shard, *loads[slot]) for slot, shard in enumerate(slot_map)]
    spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("error").parquet(f"{path}/version={version:06d}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]] | None:
    """(version, shard of each slot), of the latest version unless one is named; None where there is no map."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    disk = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not disk.exists(root):
        return None
    names = [x.getPath().getName() for x in disk.listStatus(root)]
    whole = [int(n.split("=")[1]) for n in names if n.startswith("version=") and disk.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    if version is None and not whole:
        return None
    version = max(whole) if version is None else version
    rows = spark.read.schema(_MAP).parquet(f"{path}/version={version:06d}").select("vslot", "shard").collect()
    return version, [s for _, s in sorted((r["vslot"], r["shard"]) for r in rows)]


def rebalance(docs: DataFrame, path: str, more: int = 0) -> int:
    """Edit the latest map for what ``docs`` weighs now, with ``more`` further shards, and write it as the next version; its number."""
    spark = docs.sparkSession
    known = read_map(spark, path)
    if known is None:
        raise ValueError(f"{path} holds no map of slots; shard() with this path makes one")
    version, old = known
    loads = slot_loads(slotted(docs, len(old)), len(old))
    write_map(spark, grown(old, loads, more) if more else evened(old, loads), loads, path, version + 1)
    return version + 1


def shard(docs: DataFrame, n_shards: int | None = None, n_slots: int | None = None, path: str | None = None, version: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, vslot``; slot numbers the records of a shard from 0.

    With a ``path``, the map there is used (the latest version, or the one named); where it has none, and
    without a path, version 1 is made for ``n_shards`` and ``n_slots``.  Numbers that are given must be those of a map that is there.
    """
    spark = docs.sparkSession
    known = read_map(spark, path, version) if path else None
    if known:
        for name, given, has in (("shards", n_shards, max(known[1]) + 1), ("slots", n_slots, len(known[1]))):
            if given not in (None, has):
                raise ValueError(f"the map at {path} has {has} {name}, not {given}; rebalance() edits it")
    n_shards, n_slots = n_shards or N_SHARDS, len(known[1]) if known else n_slots or N_SLOTS
    rows = slotted(docs, n_slots)
    loads = slot_loads(rows, n_slots)
    slot_map = known[1] if known else balanced(loads, n_shards)
    if not known:
        write_map(spark, slot_map, loads, path or shared_path(spark, "slot-map"), 1)
    before: dict[int, int] = {}
    firsts = []
    for slot, to in enumerate(slot_map):
        firsts.append((slot, to, before.get(to, 0)))
        before[to] = before.get(to, 0) + loads[slot][1]
    placed = spark.createDataFrame(firsts, "vslot int, shard int, first long")
    in_slot = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("nth", in_slot).join(F.broadcast(placed), "vslot").select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot"), "vslot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, with the virtual slot beside them.  The law is ``bytes``."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


#: The checksum by its table, the map by a recursion over the slots from the heaviest to the lightest.
OP5_SQL = r"""
WITH RECURSIVE
step(n, k, c) AS (SELECT r, 0, r FROM range(256) t(r) UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT r, doc_id, text, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM d),
b AS (SELECT r, doc_id, n, list_transform(range(0, n), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)) AS bytes FROM h),
s AS (SELECT r, doc_id, CAST(n + 16 AS BIGINT) AS size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS text_crc32 FROM b, crc),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS copy FROM s),
v AS (SELECT *, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || CASE WHEN copy > 0 THEN ':' || copy ELSE '' END), 1, 8) AS BIGINT) % 4096 AS INTEGER) AS vslot FROM k),
loads AS (SELECT k AS vslot, CAST(coalesce(sum(size), 0) AS BIGINT) AS b, count(size) AS n FROM range(4096) t(k) LEFT JOIN v ON vslot = k GROUP BY 1),
ordered AS (SELECT *, row_number() OVER (ORDER BY b DESC, vslot) AS i FROM loads),
greedy(i, slot, shard, total) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), list_transform(range(40), lambda x: CAST(0 AS BIGINT))
  UNION ALL
  SELECT o.i, o.vslot, list_position(total, list_min(total)) - 1,
    list_transform(range(1, 41), lambda k: total[k] + CASE WHEN k = list_position(total, list_min(total)) THEN o.b ELSE 0 END)
  FROM greedy g JOIN ordered o ON o.i = g.i + 1),
placed AS (SELECT slot AS vslot, CAST(shard AS INTEGER) AS shard FROM greedy WHERE slot IS NOT NULL),
firsts AS (SELECT vslot, shard, CAST(coalesce(sum(n) OVER (PARTITION BY shard ORDER BY vslot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM placed JOIN loads USING (vslot))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, first + row_number() OVER (PARTITION BY vslot ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, vslot FROM v JOIN firsts USING (vslot)
"""
