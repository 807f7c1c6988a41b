"""Exact order statistics of groups of any size.

``percentile`` keeps all distinct values of a group in one buffer.  Groups of up to ``LARGE`` values are left to
it.  In a larger one the wanted ranks are looked for by narrowing: a mergeable sketch brackets each rank, counts tell
exactly how many values lie below, at and between the bracket's ends, and only what is between is looked at
again; each round leaves about a thousandth.  Many equal values end the search, as a rank falls on an end.  No task
holds more than a sketch for each rank, until no more than ``LARGE`` values are left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrospark.operators.graph import checkpointed

LARGE = 1_000_000
#: The sketch's accuracy, and how far from a rank (as a share of the values) its bracket reaches.
ACCURACY = 10_000
REACH = 0.0005


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"__{k}"])
    return cond


def _marked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__{k}" for k in keys})


def _between(lower: Column, higher: Column, at: Column) -> Column:
    """What lies at a rank between two whole ones, as ``percentile`` has it."""
    low = F.floor(at)
    return F.when(lower == higher, lower).otherwise((low + 1 - at) * lower + (at - low) * higher)


def ranked_values(rows: DataFrame, targets: DataFrame, keys: Sequence[str], large: int = LARGE, max_rounds: int = 64) -> DataFrame:
    """``keys, rank, found``: the value of each wanted rank (0 is the least); ``rows`` has ``keys`` and ``v`` without nulls.

    ``targets`` has ``keys, rank, n``, n being the number of the group's values.
    """
    marks = [f"__{k}" for k in keys]
    # Open brackets; null is no bound.
    nothing = F.lit(None).cast("double")
    live = checkpointed(_marked(targets.select(*keys, "rank", F.lit(0).cast("long").alias("base"), F.col("n").alias("left"), nothing.alias("lo"), nothing.alias("hi"), nothing.alias("found")), keys))
    done = []
    for _ in range(max_rounds):
        done.append(live.where("found is not null"))
        live = live.where("found is null")
        if live.where(F.col("left") > large).isEmpty():
            break
        some = live.where(F.col("left") > large)
        inside = rows.join(some, _same(rows, some, keys) & (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi"))))
        state = [*marks, "rank", "base", "left", "lo", "hi"]
        # Quantiles of an even grid, of which the two around the rank are the bracket.
        sketch = inside.groupBy(*state).agg(F.percentile_approx("v", F.array(*[F.lit(k * REACH) for k in range(int(1 / REACH) + 1)]), ACCURACY).alias("grid"))
        share = (F.col("rank") - F.col("base")) / F.greatest(F.col("left") - 1, F.lit(1)) / REACH
        steps = F.lit(int(1 / REACH) + 1)
        end = lambda k: F.element_at("grid", F.greatest(F.least(k, steps), F.lit(1)).cast("int"))
        cut = checkpointed(sketch.select(*state, end(F.floor(share)).alias("a"), end(F.ceil(share) + 2).alias("b")))
        inside = rows.join(cut, _same(rows, cut, keys) & (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi"))))
        n = lambda c: F.count(F.when(c, 1))
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        counts = inside.groupBy(*state, "a", "b").agg(n(v < a).alias("below"), n(v == a).alias("at_a"), n((v > a) & (v < b)).alias("mid"), n((v == b) & (a < b)).alias("at_b"), n(v > b).alias("above"))
        k = F.col("rank") - F.col("base")
        s1 = F.col("below")
        s2 = s1 + F.col("at_a")
        s3 = s2 + F.col("mid")
        s4 = s3 + F.col("at_b")
        pick = lambda *c: F.when(k < s1, c[0]).when(k < s2, c[1]).when(k < s3, c[2]).when(k < s4, c[3]).otherwise(c[4])
        none = F.lit(None).cast("double")
        narrowed = counts.select(
            *marks, "rank", (F.col("base") + pick(F.lit(0), s1, s2, s3, s4)).alias("base"), pick(F.col("below"), F.col("at_a"), F.col("mid"), F.col("at_b"), F.col("above")).alias("left"),
            pick(F.col("lo"), none, a, none, b).alias("lo"), pick(a, none, b, none, F.col("hi")).alias("hi"), pick(none, a, none, b, none).alias("found"),
        )
        live = checkpointed(narrowed.unionByName(live.where(F.col("left") <= large)))
    else:
        raise RuntimeError("ranks did not settle")
    # A few values are left for each rank: they are put in order, those of several brackets in several tasks.
    inside = rows.join(live, _same(rows, live, keys) & (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi"))))
    nth = F.row_number().over(W.partitionBy(*marks, "rank").orderBy("v")) - 1
    out = inside.withColumn("__nth", nth).where(F.col("__nth") == F.col("rank") - F.col("base")).select(*marks, "rank", F.col("v").alias("found"))
    for d in done:
        out = out.unionByName(d.select(*marks, "rank", "found"))
    return out.withColumnsRenamed({f"__{k}": k for k in keys})


def percentiles(rows: DataFrame, value: str, wanted: Mapping[str, float], by: Sequence[str] = (), large: int = LARGE) -> DataFrame:
    """One row for each group, with its exact percentiles (linear between ranks) under the wanted names; nulls do not count."""
    keys = [f"k{i}" for i in range(len(by))] or ["k0"]
    named = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)] if by else [F.lit(0).alias("k0")], F.col(value).cast("double").alias("v"))
    back = {k: c for c, k in zip(by, keys)}
    whole = named.where("v is not null")
    plain = [F.percentile("v", F.lit(q)).alias(name) for name, q in wanted.items()]
    sizes = checkpointed(whole.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > large))
    final = lambda df: df.withColumnsRenamed(back).select(*by, *wanted)
    if sizes.isEmpty():
        return final(named.groupBy(*keys).agg(*plain))
    big = _marked(sizes.drop("n"), keys)
    small = named.join(big, _same(named, big, keys), "left_anti")
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(q)), F.floor(at(q)) + (at(q) > F.floor(at(q))).cast("long")) for q in wanted.values()])))
    targets = sizes.select(*keys, "n", F.explode(ranks).alias("rank"))
    found = ranked_values(whole, targets, keys, large)
    held = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("m"))
    marked = _marked(held, keys)
    met = sizes.join(marked, _same(sizes, marked, keys))
    get = lambda q, up: F.element_at("m", F.floor(at(q)) + (at(q) > F.floor(at(q))).cast("long") * up)
    large_rows = met.select(*keys, *[_between(get(q, 0), get(q, 1), at(q)).alias(name) for name, q in wanted.items()])
    return final(small.groupBy(*keys).agg(*plain).unionByName(large_rows) if by else large_rows)
