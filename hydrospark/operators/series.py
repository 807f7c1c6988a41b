"""Operators on time series and profiles: one row for each point, many series side by side.

Every operator takes the columns that name the series (``by``) and the one that orders it, so
it works on all series at once; the work is split by series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrospark.functions import columns as X

TIME_NAMES = ("time", "valid_time", "datetime", "forecast_time")
FLOW_NAMES = ("flow_cfs", "streamflow", "flow", "discharge", "value")


def resolve(df: DataFrame, candidates: Sequence[str], what: str = "column") -> str:
    """The first candidate that is a column of ``df``."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"no {what}: one of {', '.join(candidates)} is needed")


def existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """X11: those of the columns that exist, in the order asked for."""
    return df.select(*[c for c in names if c in df.columns])


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: str = "last") -> DataFrame:
    """One row for each key, the first or last in a total order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranked = W.partitionBy(*keys).orderBy(*[c.desc() for c in cols] if keep == "last" else cols)
    return df.withColumn("__nth", F.row_number().over(ranked)).where("__nth = 1").drop("__nth")


def normalize_hydrograph(df: DataFrame, by: Sequence[str] = ("series_id",), flow_unit: str = "cfs", seq: str | None = None) -> DataFrame:
    """``by, time, flow_cfs`` with clean values; of equal times the last stays.

    Last is by ``seq`` if given, else the largest flow.
    """
    time, flow = resolve(df, TIME_NAMES, "time"), resolve(df, FLOW_NAMES, "flow")
    cols = [*by, X.moment(time).alias("time"), X.to_cfs(X.number(flow), flow_unit).alias("flow_cfs")]
    clean = df.select(*cols, *([F.col(seq).alias("__seq")] if seq else [])).where("time is not null and flow_cfs is not null")
    order = (F.struct("__seq", "flow_cfs") if seq else F.col("flow_cfs"))
    return clean.groupBy(*by, "time").agg(F.max_by("flow_cfs", order).alias("flow_cfs"))


def excess_volume(hydrograph: DataFrame, bankfull: Column | str | float, by: Sequence[str] = ("series_id",), max_gap_hours: float = 3.0) -> DataFrame:
    """The volume above bankfull, by trapezoids between neighbours no further apart than the gap.

    ``bankfull`` is a number or a column that is constant in a series.  The excess is clamped
    before the trapezoid; an interval counts as exceeding if either end does.
    """
    gap = max(float(max_gap_hours), 0.01)
    w = W.partitionBy(*by).orderBy("time")
    rows = hydrograph.withColumn("__bf", F.greatest(X.col(bankfull).cast("double"), F.lit(0.0)))
    rows = rows.withColumn("__e", F.greatest(F.col("flow_cfs") - F.col("__bf"), F.lit(0.0)) * X.C.CFS_TO_CMS)
    rows = rows.withColumns({"__dt": X.seconds_between(F.lag("time").over(w), "time"), "__e0": F.lag("__e").over(w)})
    used = (F.col("__dt") > 0) & (F.col("__dt") <= gap * 3600.0)
    return rows.groupBy(*by).agg(
        F.count("*").alias("point_count"),
        F.min("time").alias("start_time"),
        F.max("time").alias("end_time"),
        (X.seconds_between(F.min("time"), F.max("time")) / 3600.0).alias("horizon_hours"),
        F.greatest(F.coalesce(F.sum(F.when(used, 0.5 * (F.col("__e0") + F.col("__e")) * F.col("__dt"))), F.lit(0.0)), F.lit(0.0)).alias("excess_volume_m3"),
        F.max("flow_cfs").alias("peak_flow_cfs"),
        F.max("__bf").alias("bankfull_flow_cfs"),
        F.count(F.when(used, 1)).alias("intervals_used"),
        F.count(F.when(F.col("__dt") > gap * 3600.0, 1)).alias("intervals_skipped_large_gap"),
        (F.coalesce(F.sum(F.when(used & ((F.col("__e0") > 0) | (F.col("__e") > 0)), F.col("__dt"))), F.lit(0.0)) / 3600.0).alias("exceedance_interval_hours"),
    )


def both_ways(by: Sequence[str], *order: str):
    """Windows from the start of a series to a row, and from its end: with ``last`` they look back and ahead.

    Rows that are equal in the order see each other.  (A frame that ends at the series' end is
    worked anew for every row; the reverse of one that begins at its start is not.)
    """
    frame = (W.unboundedPreceding, W.currentRow)
    return W.partitionBy(*by).orderBy(*order).rangeBetween(*frame), W.partitionBy(*by).orderBy(*[F.desc_nulls_last(c) for c in order]).rangeBetween(*frame)


def asof_nearest(left: DataFrame, right: DataFrame, value: str, by: Sequence[str], time: str = "time", tolerance_seconds: float = 1800.0) -> DataFrame:
    """Every row of ``left`` with the ``value`` of ``right`` that is nearest in time.

    The tolerance is inclusive; of two at the same distance the earlier wins; rows of
    ``left`` without a partner stay out.  Both sides are dealt to spans of time, 32 tolerances
    long, and values near the end of a span to the next one as well, so that a long series is
    spread over many tasks; one shuffle then, and neighbours by looking back in a window and in its reverse.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    reach = max(int(tolerance_seconds * 1_000_000), 0)
    span = max(32 * reach, 1_000_000)
    own = [c for c in left.columns if c not in (*by, time)]
    part = lambda t: F.floor(t / span)
    a = left.select(*by, part(micros(time)).alias("__span"), F.col(time).alias("__t"), F.struct(*[F.col(c) for c in own], F.lit(True).alias("__is")).alias("__l"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast(left.schema[time].dataType).alias("__vt"))
    b = right.where(F.col(value).isNotNull()).select(*by, F.explode(F.sequence(part(micros(time) - reach), part(micros(time) + reach))).alias("__span"), F.col(time).alias("__t"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.col(value).alias("__v"), F.col(time).alias("__vt"))
    known = F.when(F.col("__vt").isNotNull(), F.struct("__vt", "__v"))
    w, back = both_ways((*by, "__span"), "__t")
    near = a.unionByName(b).withColumns({"__before": F.last(known, ignorenulls=True).over(w), "__after": F.last(known, ignorenulls=True).over(back)}).where("__l is not null")
    db, da = X.seconds_between("__before.__vt", "__t"), X.seconds_between("__t", "__after.__vt")
    earlier = da.isNull() | (db <= da)
    picked = F.when(db.isNotNull() & earlier, F.col("__before")).otherwise(F.col("__after"))
    gap = F.when(db.isNotNull() & earlier, db).otherwise(da)
    return near.where(gap <= tolerance_seconds).select(*by, F.col("__t").alias(time), *[F.col(f"__l.{c}").alias(c) for c in own], picked["__v"].alias(f"{value}_nearest"))


def hydrograph_skill(pairs: DataFrame, by: Sequence[str] = (), observed: str = "observed_cfs", modeled: str = "modeled_cfs", time: str = "time") -> DataFrame:
    """Errors and efficiencies of matched pairs; peaks are the first of equal ones."""
    o, m = F.col(observed), F.col(modeled)
    err = m - o
    peak = lambda x: F.max_by(time, F.struct(x, -F.unix_micros(F.col(time).cast("timestamp"))))
    n = pairs.where(o.isNotNull() & m.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("matched_points"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae_cfs"), F.avg(err).alias("bias_cfs"), F.sum(err).alias("se"), F.sum(o).alias("so"),
        F.avg(o).alias("mo"), F.avg(m).alias("mm"), F.stddev_pop(o).alias("sdo"), F.stddev_pop(m).alias("sdm"), F.covar_pop(m, o).alias("cov"), F.max(o).alias("observed_peak_cfs"), F.max(m).alias("modeled_peak_cfs"), peak(o).alias("observed_peak_time"), peak(m).alias("modeled_peak_time"),
    )
    r = F.when((F.col("matched_points") > 1) & (F.col("sdm") > 0) & (F.col("sdo") > 0), X.safe_divide("cov", F.col("sdm") * F.col("sdo")))
    out = n.withColumn("pearson_r", r)
    alpha, beta = X.safe_divide("sdm", "sdo"), X.safe_divide("mm", "mo")
    square = lambda x: x * x
    return out.select(
        *by, "matched_points", F.sqrt("mse").alias("rmse_cfs"), "mae_cfs", "bias_cfs",
        F.when(F.abs("so") > 1e-9, 100.0 * F.col("se") / F.col("so")).alias("percent_bias"),
        "pearson_r",
        F.when(F.col("sdo") > 0, 1.0 - F.col("mse") / square(F.col("sdo"))).alias("nse"),
        (1.0 - F.sqrt(square(F.col("pearson_r") - 1) + square(alpha - 1) + square(beta - 1))).alias("kge"),
        "observed_peak_cfs", "modeled_peak_cfs",
        F.when(F.col("observed_peak_cfs") > 0, F.col("modeled_peak_cfs") / F.col("observed_peak_cfs")).alias("peak_ratio"),
        (X.seconds_between("observed_peak_time", "modeled_peak_time") / 3600.0).alias("peak_timing_error_hours"),
    )


def point_errors(pairs: DataFrame, observed: str, modeled: str, by: Sequence[str] = ()) -> DataFrame:
    """Errors over the pairs in which both are known; null if there is none."""
    e = X.number(modeled) - X.number(observed)
    return pairs.withColumn("__e", e).groupBy(*by).agg(F.count("*").alias("point_count"), F.count("__e").alias("valid_comparison_count"), F.avg(F.abs("__e")).alias("mae"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.avg("__e").alias("bias"))


def latest(df: DataFrame, by: Sequence[str], time: str = "time", tie: str | None = None) -> DataFrame:
    """The last row of each series, with whatever it holds."""
    rest = [c for c in df.columns if c not in by]
    order = F.struct(time, tie) if tie else F.col(time)
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*by, "__r.*")


def last_known(df: DataFrame, by: Sequence[str], value: str, seq: str) -> DataFrame:
    """The last value that is known, by ``seq``."""
    return df.where(X.number(value).isNotNull()).groupBy(*by).agg(F.max_by(X.number(value), seq).alias(value))


def peak(df: DataFrame, by: Sequence[str], value: str, time: str = "time") -> DataFrame:
    """The largest value and its first time."""
    first = F.struct(F.col(value), -F.unix_micros(F.col(time).cast("timestamp")))
    return df.groupBy(*by).agg(F.max(value).alias(f"peak_{value}"), F.max_by(time, first).alias("peak_time"))


def period_summary(df: DataFrame, by: Sequence[str], value: str, time: str = "time") -> DataFrame:
    """What a record spans."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def rain_total(df: DataFrame, by: Sequence[str] = (), value: str = "precip_in") -> DataFrame:
    """A10: the sum, 0 where there is nothing."""
    return df.groupBy(*by).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.count(value).alias("n"))


def pivot_last(df: DataFrame, keys: Sequence[str], parameter: str, codes: Sequence[str], value: str, seq: str) -> DataFrame:
    """A column for each code with its last known value by ``seq``."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).pivot(parameter, list(codes)).agg(F.max_by(value, seq))


def newest_issue(df: DataFrame, by: Sequence[str], issued: str = "issued_time") -> DataFrame:
    """The rows of the newest issue, all of them."""
    return df.join(df.groupBy(*by).agg(F.max(issued).alias("__newest")), list(by)).where(F.col(issued) == F.col("__newest")).drop("__newest")


def tail(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows, of the table or of each group."""
    if not by:
        return df.orderBy(*[F.desc(c) for c in order]).limit(n)
    return df.withColumn("__nth", F.row_number().over(W.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))).where(F.col("__nth") <= n).drop("__nth")


def stride(df: DataFrame, by: Sequence[str], order: Sequence[str], most: int = 4000, floor: bool = False) -> DataFrame:
    """Every k-th row of a series that has more than ``most``.

    k is ceil(n / most), so at most ``most`` rows stay; with ``floor`` it is the whole part of
    n / most, which leaves up to twice as many.
    """
    w = W.partitionBy(*by)
    k = F.floor(F.col("__n") / most) if floor else F.ceil(F.col("__n") / most)
    rows = df.withColumns({"__n": F.count("*").over(w), "__i": F.row_number().over(w.orderBy(*order)) - 1})
    return rows.where(F.col("__i") % F.greatest(k, F.lit(1)) == 0).drop("__n", "__i")


def ring_buffer(df: DataFrame, by: Sequence[str], order: Sequence[str], item: str, n: int = 120) -> DataFrame:
    """The last ``n`` items of each group as an array, oldest first."""
    return tail(df, n, order, by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, item))), lambda x: x[item]).alias("items"))


# Windows over an ordered profile ------------------------------------------------------------


def middle(values: Column) -> Column:
    """The median of an array, null if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)


def rolling_median(value: Column | str, w, size: int) -> Column:
    """Centred median of ``size`` rows; nulls are skipped and the ends have fewer rows."""
    half = size // 2
    return middle(F.collect_list(value).over(w.rowsBetween(-half, half)))


def median_filter3(value: Column | str, w) -> Column:
    """Median of 3 rows in which the ends are repeated."""
    x = X.col(value)
    return middle(F.array(F.coalesce(F.lag(x).over(w), x), x, F.coalesce(F.lead(x).over(w), x)))


def fill_linear(value: Column | str, at: Column | str, by: Sequence[str], *order: str) -> Column:
    """Gaps of the series ``by``, in ``order``, are bridged linearly along ``at``; beyond the known ends the nearest value holds."""
    v, s = X.col(value), X.col(at).cast("double")
    ahead, back = both_ways(by, *order)
    known = F.when(v.isNotNull(), F.struct(s.alias("s"), v.cast("double").alias("v")))
    before, after = F.last(known, ignorenulls=True).over(ahead), F.last(known, ignorenulls=True).over(back)
    share = F.coalesce(X.safe_divide(s - before["s"], after["s"] - before["s"]), F.lit(0.0))
    return F.when(before.isNull(), after["v"]).when(after.isNull(), before["v"]).otherwise(before["v"] + share * (after["v"] - before["v"]))


def fill_by_row(value: Column | str, by: Sequence[str], *order: str) -> Column:
    """As fill_linear, with row numbers for distances."""
    return fill_linear(value, F.row_number().over(W.partitionBy(*by).orderBy(*order)), by, *order)


def gradient(value: Column | str, at: Column | str, w) -> Column:
    """Slope along uneven steps, second order within and first order at the ends."""
    f, s = X.col(value), X.col(at).cast("double")
    h1, h2 = s - F.lag(s).over(w), F.lead(s).over(w) - s
    f0, f1, f2 = F.lag(f).over(w), f, F.lead(f).over(w)
    inner = -h2 / (h1 * (h1 + h2)) * f0 + (h2 - h1) / (h1 * h2) * f1 + h1 / (h2 * (h1 + h2)) * f2
    return F.when(h1.isNull(), (f2 - f1) / h2).when(h2.isNull(), (f1 - f0) / h1).otherwise(inner)


#: Savitzky-Golay weights of window 9, order 2: the inner rows, and the first four (the last four mirror them).
SAVGOL9 = tuple(x / 231 for x in (-21, 14, 39, 54, 59, 54, 39, 14, -21))


def savgol_edge(i: int, n: int = 9) -> tuple[float, ...]:
    """Weights that give sample ``i`` of the quadratic fitted to ``n`` samples."""
    h = (n - 1) / 2
    t = [k - h for k in range(n)]
    s2, s4 = sum(x**2 for x in t), sum(x**4 for x in t)
    det = n * s4 - s2 * s2
    x = i - h
    return tuple((s4 - s2 * u * u) / det + x * u / s2 + (n * u * u - s2) / det * x * x for u in t)


def savgol(value: Column | str, w, size: int = 9) -> Column:
    """Quadratic smoothing over ``size`` rows; series shorter than that come back as they are.

    Near an end the quadratic through the outermost ``size`` rows is used.
    """
    x, half = X.col(value).cast("double"), size // 2
    around = F.collect_list(x).over(w.rowsBetween(-(size - 1), size - 1))
    n = F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    before = F.least(F.row_number().over(w) - 1, F.lit(size - 1))
    nth, left = F.row_number().over(w) - 1, n - F.row_number().over(w)
    place = F.when(nth < half, nth).when(left < half, size - 1 - left).otherwise(half).cast("int")
    weights = F.element_at(F.array(*[F.array(*map(F.lit, savgol_edge(i, size))) for i in range(size)]), place + 1)
    products = F.zip_with(F.slice(around, before - place + 1, F.lit(size)), weights, lambda v, k: v * k)
    return F.when(n < size, x).otherwise(F.aggregate(products, F.lit(0.0), lambda t, v: t + v))


def outlier_add(value: Column | str, w, limit: float, exempt_first: bool = True) -> Column:
    """Further than ``limit`` from the rolling median of 5; the first row may be exempt."""
    x = X.col(value)
    far = F.coalesce(F.abs(x - rolling_median(x, w, 5)) > limit, F.lit(False))
    return far & (F.row_number().over(w) > 1) if exempt_first else far


def outlier_ratio(value: Column | str, w, factor: float, positive: bool = True) -> Column:
    """Over ``factor`` times the rolling median of 5, or under its reciprocal.

    Unless all values count, only positive ones with a positive median can be outliers.  Where all do, any value over a
    median of zero is one, and what is null stays null.
    """
    x, f = X.col(value), max(float(factor), 1.01)
    med = rolling_median(x, w, 5)
    far = lambda r: (r > f) | (r < 1.0 / f)
    if positive:
        return F.coalesce(far(F.when((med > 0) & (x > 0), x / med)), F.lit(False))
    return F.when((med == 0) & x.isNotNull(), True).otherwise(far(X.safe_divide(x, med)))


def station(x: Column | str, y: Column | str, w) -> Column:
    """Distance along a path from its first vertex."""
    step = F.hypot(X.col(x) - F.lag(X.col(x)).over(w), X.col(y) - F.lag(X.col(y)).over(w))
    return F.sum(F.coalesce(step, F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))


def tangents(path: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", at: str = "station_m", reach: float = 30.0) -> DataFrame:
    """Unit direction of a path, from the vertices ``reach`` up and down, and its left normal.

    Where no other vertex is in reach, two rows up and down are taken.
    """
    keys = ", ".join(f"`{c}`" for c in by)
    over = f"OVER (PARTITION BY {keys} ORDER BY `{at}` {{0}})"
    near = over.format(f"RANGE BETWEEN {float(reach)!r}D PRECEDING AND {float(reach)!r}D FOLLOWING")
    rows = over.format("ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING")
    ends = path.withColumn("__n", F.expr(f"count(*) {near}"))
    for name, frame in (("n", near), ("r", rows)):
        ends = ends.withColumns({f"__{name}{e}{c}": F.expr(f"{f}(`{c}`) {frame}") for f, e in (("first", 0), ("last", 1)) for c in (x, y)})
    pick = lambda e, c: F.when(F.col("__n") > 1, F.col(f"__n{e}{c}")).otherwise(F.col(f"__r{e}{c}"))
    dx, dy = pick("1", x) - pick("0", x), pick("1", y) - pick("0", y)
    size = F.hypot(dx, dy)
    out = ends.withColumns({"tangent_dx": X.safe_divide(dx, size), "tangent_dy": X.safe_divide(dy, size)})
    return out.withColumns({"cross_dx": -F.col("tangent_dy"), "cross_dy": F.col("tangent_dx")}).select(*path.columns, "tangent_dx", "tangent_dy", "cross_dx", "cross_dy")


def pick_sections(path: DataFrame, by: Sequence[str], at: str = "station_m", spacing: float = 150.0) -> DataFrame:
    """The vertices nearest to equal steps along a path; the end is added if more than half a step remains.

    Of two vertices at the same distance the lower wins, and repeats are dropped.
    """
    ends = path.groupBy(*by).agg(F.max(at).alias("__end"))
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.col("__end") / spacing).cast("int")), lambda k: k * F.lit(float(spacing)))
    left = F.col("__end") - F.element_at(steps, -1)
    goals = ends.select(*by, F.explode(F.when(left > spacing / 2, F.concat(steps, F.array("__end"))).otherwise(steps)).alias("__goal"))
    both = path.select(*by, F.col(at).alias("__s"), F.col(at).alias("__v")).unionByName(goals.select(*by, F.col("__goal").alias("__s"), F.lit(None).cast("double").alias("__v")))
    w, back = both_ways(by, "__s")
    near = both.withColumns({"__b": F.last("__v", ignorenulls=True).over(w), "__a": F.last("__v", ignorenulls=True).over(back)}).where("__v is null")
    chosen = F.when(F.col("__b").isNotNull() & (F.col("__a").isNull() | (F.col("__s") - F.col("__b") <= F.col("__a") - F.col("__s"))), F.col("__b")).otherwise(F.col("__a"))
    return near.select(*by, chosen.alias(at)).distinct()


def keep_rising(df: DataFrame, by: Sequence[str], value: str, step: float = 1e-9, tie: str | None = None) -> DataFrame:
    """Drop a row that rises no more than ``step`` over the one before it; of equal ones the least ``tie`` is first."""
    w = W.partitionBy(*by).orderBy(value, *([tie] if tie else []))
    before = F.lag(value).over(w)
    return df.withColumn("__b", before).where(F.col("__b").isNull() | (F.col(value) - F.col("__b") > step)).drop("__b")


def first_satisfying(df: DataFrame, by: Sequence[str], condition: Column, order: str) -> DataFrame:
    """Of each group the row with the least ``order`` for which the condition holds."""
    rest = [c for c in df.columns if c not in by]
    return df.where(condition).groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*by, "__r.*")


def gap_sessions(df: DataFrame, by: Sequence[str], time: str = "time", gap_hours: float = 3.0) -> DataFrame:
    """R07 over a table: runs of readings no further apart than the gap, numbered from 0."""
    w = W.partitionBy(*by).orderBy(time)
    far = F.coalesce(X.seconds_between(F.lag(time).over(w), time) > gap_hours * 3600.0, F.lit(False))
    return df.withColumn("__new", far.cast("long")).withColumn("session", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def upsert_latest(current: DataFrame, arrived: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Both tables together, of equal keys the row with the highest ``seq``."""
    return latest(current.unionByName(arrived, allowMissingColumns=True), keys, seq)
