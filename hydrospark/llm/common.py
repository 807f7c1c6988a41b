"""Helpers shared by the corpus operators: shared-folder tables and small byte utilities."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.session import ship, table

__all__ = ["aside", "join_counted", "numbered", "scratch", "shared_path", "shared_root", "ship", "sliced", "stored", "table"]


_scopes: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir``; only where a local session has none (tests) a
    temporary folder of the driver is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        root = spark.sparkContext.getCheckpointDir()
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def shared_path(spark: SparkSession, label: str, lasting: bool = False) -> str:
    """A new path in the shared folder, deleted at the end of the innermost ``scratch`` unless it is lasting, else when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    if _scopes and not lasting:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end the tables that operators have stored within it; what is to stay is written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _scopes.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder (at ``path`` where one is given) and read it back.

    Later steps then read the table instead of computing ``df`` again, and the
    lineage ends at files that outlive any executor.
    """
    spark = df.sparkSession
    ship(spark)
    path = path or shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches, rows: int = 1024):
    """Record batches of at most so many rows, so that what a task makes of one stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def aside(docs: DataFrame, used: tuple[str, ...] = ("doc_id", "text", "n_chars")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but the used ones renamed, so that none clashes with an operator's own; and the way back."""
    ship(docs.sparkSession)
    names = [c if c in used else f"other_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``: a number of its own for each row without a doc_id of its own, else zero.  A ``__row`` in ``docs`` is replaced."""
    ship(docs.sparkSession)
    docs = docs.drop("__row")
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__id"))
    shared = stored(shared, "shared-ids")
    if shared.isEmpty():
        return docs.withColumn("__row", F.lit(0).cast("long"))
    named = shared.where("__id is not null")
    some, rest = docs.where("doc_id is null"), docs.where("doc_id is not null")
    if not named.isEmpty():
        same = rest["doc_id"] == named["__id"]
        some, rest = some.unionByName(rest.join(named, same, "left_semi")), rest.join(named, same, "left_anti")
    # Stored, as the numbers would differ from one computation to the next.
    rows = stored(some.withColumn("__row", F.monotonically_increasing_id() + 1), "shared-id-rows")
    return rest.withColumn("__row", F.lit(0).cast("long")).unionByName(rows)


#: A key of so many rows is joined by itself.
HOT_ROWS = 100_000


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str, hot_rows: int | None = None) -> DataFrame:
    """Inner join on ``key``, where ``counted`` has each key once, with the number ``n`` of its rows.

    Keys of ``hot_rows`` rows or more stay where they are: what is known of them is broadcast,
    one row for that many rows at least.  The others meet by a shuffle.
    """
    limit = hot_rows or HOT_ROWS
    hot = F.broadcast(counted.where(F.col(n) >= limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(counted.where(F.col(n) < limit), key)
    return rows.join(hot, key).unionByName(cold)
