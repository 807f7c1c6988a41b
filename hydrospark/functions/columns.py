"""Column expressions: units, hydrology, names, places, times.  Each runs inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrospark.functions import constants as C


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# Numbers ---------------------------------------------------------------------------------


def number(x) -> Column:
    """A number, null where it is none; NaN and infinities are null as well."""
    v = col(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def moment(x) -> Column:
    """A timestamp, null where it is none."""
    return col(x).try_cast("timestamp")


def safe_divide(a, b) -> Column:
    """null where the divisor is zero or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def json_safe(x) -> Column:
    """NaN and infinities become null."""
    return number(x)


def clip(x, low, high) -> Column:
    """null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, col(high)), col(low)))


def seconds_between(start, end) -> Column:
    """elapsed seconds, to the microsecond."""
    return (F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))) / 1e6


# Units -----------------------------------------------------------------------------------


def to_cfs(flow, unit: str) -> Column:
    """X06 in hydrograph normalisation: m3/s are divided by the m3/s of a ft3/s."""
    u = unit.strip().lower()
    if u in C.CFS_UNITS:
        return col(flow)
    if u in C.CMS_UNITS:
        return col(flow) / C.CFS_TO_CMS
    raise ValueError(f"unsupported flow unit: {unit}")


def to_cfs_by_factor(flow, unit: str) -> Column:
    """X06 at validation and refresh: m3/s are multiplied by the published factor."""
    u = unit.strip().lower()
    if u in C.CFS_UNITS:
        return col(flow)
    if u in C.CMS_UNITS:
        return col(flow) * C.CMS_TO_CFS
    raise ValueError(f"unsupported flow unit: {unit}")


def level_to_m(level, unit: str) -> Column:
    """X06 for water levels."""
    u = unit.strip().lower()
    if u in ("ft", "feet", "foot"):
        return col(level) * C.FT_TO_M
    if u in ("m", "meter", "meters"):
        return col(level)
    raise ValueError(f"unsupported level unit: {unit}")


# Hydrology -------------------------------------------------------------------------------


def scs_runoff_in(rain_in, curve_number) -> Column:
    """Runoff depth by the curve number method, in inches."""
    p = F.greatest(col(rain_in), F.lit(0.0))
    s = 1000.0 / clip(curve_number, 30.0, 98.0) - 10.0
    ia = 0.2 * s
    return F.when(p <= ia, 0.0).otherwise((p - ia) * (p - ia) / (p - ia + s))


def kirpich_hours(length_m, slope) -> Column:
    """Time of concentration, between a quarter hour and three days."""
    length = F.greatest(col(length_m), F.lit(100.0))
    minutes = 0.01947 * F.pow(length, F.lit(0.77)) * F.pow(clip(slope, 0.0001, 0.02), F.lit(-0.385))
    return clip(minutes / 60.0, 0.25, 72.0)


def area_scaled_flow(gauge_flow, area, gauge_area, exponent: float = 0.85) -> Column:
    """A flow carried along the river by drainage area."""
    ratio = clip(col(area) / F.greatest(col(gauge_area), F.lit(1e-6)), 0.0, 1.5)
    return F.greatest(col(gauge_flow), F.lit(0.0)) * F.pow(ratio, F.lit(float(exponent)))


def conveyance(area, radius, slope) -> Column:
    """A R^(2/3) S^(1/2); null unless all are positive."""
    a, r, s = col(area), col(radius), col(slope)
    return F.when((a > 0) & (r > 0) & (s > 0), a * F.pow(r, F.lit(2.0 / 3.0)) * F.sqrt(s))


def curve_number(wetness) -> Column:
    """by antecedent wetness; what is unknown counts as normal."""
    w = F.lower(F.trim(col(wetness)))
    out = F.lit(C.CURVE_NUMBERS["normal"])
    for name, value in C.CURVE_NUMBERS.items():
        out = F.when(w == name, value).otherwise(out)
    return out


def excess_volume_proxy_m3(flow, bankfull, hours, fraction=1.0) -> Column:
    """A constant excess over some hours, and the part of it that the floodplain takes."""
    excess = F.greatest(col(flow) - col(bankfull), F.lit(0.0))
    return excess * C.CFS_TO_CMS * 3600.0 * F.greatest(col(hours), F.lit(0.0)) * clip(fraction, 0.0, 1.0)


def peak_difference(google_peak, national_peak) -> Column:
    """(percent difference, ``close`` or ``divergent``); null unless a peak is positive."""
    g, n = col(google_peak), col(national_peak)
    pct = 100.0 * (g - n) / F.greatest(n, F.lit(1e-6))
    return F.when(F.greatest(g, n) > 0, F.struct(pct.alias("percent"), F.when(F.abs(pct) <= 25, "close").otherwise("divergent").alias("agreement")))


# Quality flags and status ------------------------------------------------------------------


def section_flags(channel_distance, left_distance, right_distance, left_ft, right_ft, freeboard_ft) -> Column:
    """What speaks against a cross section, in this order; empty if nothing does."""
    ch, ld, rd = col(channel_distance), col(left_distance), col(right_distance)
    return F.array_compact(
        F.array(
            F.when(F.abs(ch) > 15.0, "channel_low_far_from_mainstem_center"),
            F.when(F.abs(ld - ch) > 70.0, "left_bank_far_from_channel"),
            F.when(F.abs(rd - ch) > 70.0, "right_bank_far_from_channel"),
            F.when(F.abs(col(left_ft) - col(right_ft)) > 8.0, "bank_elevation_asymmetry_gt_8ft"),
            F.when(col(freeboard_ft) < 4.0, "lower_bank_relief_lt_4ft"),
            F.when(col(freeboard_ft) > 30.0, "lower_bank_relief_gt_30ft"),
        )
    )


def aoi_warnings(gauge_inside, covered, basin_overlap, touches_mainstem, gauge_distance) -> Column:
    """Warnings on an area of interest, in this order."""
    return F.array_compact(
        F.array(
            F.when(~col(gauge_inside), "gauge_outside_dem_model_domain"),
            F.when(col(covered) < 0.999, "aoi_not_fully_covered_by_dem"),
            F.when(col(basin_overlap) < 0.50, "aoi_has_less_than_50pct_overlap_with_gauge_upstream_basin"),
            F.when(~col(touches_mainstem), "aoi_does_not_intersect_current_mainstem"),
            F.when(col(gauge_distance) > 0, "gauge_outside_display_aoi_but_can_be_used_if_same_hydraulic_network"),
        )
    )


def aoi_status(gauge_inside, covered, basin_overlap) -> Column:
    """May the area be modelled with this gauge?"""
    return (
        F.when(~col(gauge_inside) | (col(covered) < 0.95), "model_domain_needs_expansion")
        .when(col(basin_overlap) < 0.10, "current_gauge_basin_probably_not_applicable")
        .otherwise("supported")
    )


def datum_candidate(altitude_ft, datum) -> Column:
    """(value, status); only heights on NAVD88 are taken."""
    alt, d = number(altitude_ft), F.upper(F.coalesce(col(datum), F.lit("")))
    ok = F.contains(d, F.lit("NAVD")) & F.contains(d, F.lit("88"))
    status = (
        F.when(alt.isNull(), "missing_gage_datum")
        .when(ok, "provisional_navd88_metadata")
        .when(F.contains(d, F.lit("NGVD")) | F.contains(d, F.lit("29")), "ngvd29_requires_conversion_or_manual_override")
        .otherwise("vertical_datum_not_navd88")
    )
    return F.struct(F.when(ok, alt).alias("value"), status.alias("status"))


# Names -----------------------------------------------------------------------------------


def slugify(x) -> Column:
    """lower case, runs of anything else become one underscore, at most 80 characters; a fixed name where nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(col(x))), "[^a-z0-9]+", "_")
    s = F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, 80)
    return F.when(s == "", C.EMPTY_SLUG).otherwise(s)


def name_tokens(x) -> Column:
    """Words of a name in lower case."""
    s = F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z0-9]+", " ")
    return F.filter(F.split(F.trim(s), " "), lambda w: w != "")


def waterway_tokens(x) -> Column:
    """creek and river shortened, words of place dropped."""
    s = F.replace(F.replace(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("creek"), F.lit("ck")), F.lit("river"), F.lit("rv"))
    return F.filter(name_tokens(s), lambda w: ~w.isin(*C.WATERWAY_STOP_WORDS))


def waterway_name(x) -> Column:
    """F02 as text."""
    return F.array_join(waterway_tokens(x), " ")


def same_waterway(a, b) -> Column:
    """One name within the other, or enough words in common; false if a name says nothing."""
    at, bt = F.array_distinct(waterway_tokens(a)), F.array_distinct(waterway_tokens(b))
    an, bn = waterway_name(a), waterway_name(b)
    some = F.greatest(F.lit(1), F.least(F.lit(2), F.size(at)))
    return (an != "") & (bn != "") & (F.contains(bn, an) | F.contains(an, bn) | (F.size(F.array_intersect(at, bt)) >= some))


def base_name(x) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(F.trim(col(x)), "/"), -1)


def tile_key(x) -> Column:
    """a tile's name without path, suffix, state of release and punctuation."""
    s = F.regexp_replace(F.lower(base_name(x)), r"\.(tif|tiff|las|laz|shp)$", "")
    return F.regexp_replace(F.regexp_replace(s, "preliminary|final|draft", ""), "[^a-z0-9]+", "")


def site_number(x) -> Column:
    """what follows the last hyphen."""
    return F.element_at(F.split(F.coalesce(col(x), F.lit("")), "-"), -1)


def long_tokens(x) -> Column:
    """words of more than two letters."""
    return F.filter(name_tokens(x), lambda w: F.length(w) > 2)


def named_values(*columns: str) -> Column:
    """the non-empty values of some columns; those of name-like columns first."""
    first = ("name", "tile", "tilename", "tile_name")
    ordered = [c for c in columns if c.lower() in first] + [c for c in columns if c.lower() not in first]
    values = F.array(*[F.trim(F.col(c).cast("string")) for c in ordered])
    return F.filter(values, lambda v: v.isNotNull() & (v != "") & ~F.lower(v).isin("nan", "none", "null"))


# Times -----------------------------------------------------------------------------------


def iso_seconds(x) -> Column:
    """seconds of an ISO 8601 duration of days, hours, minutes and seconds; 0 for anything else."""
    s = F.coalesce(col(x), F.lit(""))
    form = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda k: F.coalesce(F.regexp_extract(s, form, k).try_cast("double"), F.lit(0.0))
    return F.when(s.rlike(form), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)).otherwise(0.0)


def valid_time(x) -> Column:
    """(start, seconds) of ``start/duration``."""
    parts = F.split(F.coalesce(col(x), F.lit("")), "/", 2)
    return F.struct(moment(F.get(parts, 0)).alias("start"), iso_seconds(F.coalesce(F.get(parts, 1), F.lit(""))).alias("seconds"))


# Places ----------------------------------------------------------------------------------


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """great-circle distance."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = p2 - p1, F.radians(col(lon2)) - F.radians(col(lon1))
    a = F.pow(F.sin(dp / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), F.lit(2.0))
    return 2 * C.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def flat_km(lat1, lon1, lat2, lon2) -> Column:
    """distance on a plane that touches at the second point."""
    east = (col(lon1) - col(lon2)) * C.KM_PER_DEGREE * F.greatest(F.cos(F.radians(col(lat2))), F.lit(C.LEAST_COS_LAT))
    return F.hypot((col(lat1) - col(lat2)) * C.KM_PER_DEGREE, east)


def degree_box(lat, lon, radius_km) -> Column:
    """the box of degrees around a point."""
    dlat = col(radius_km) / C.KM_PER_DEGREE
    dlon = col(radius_km) / (C.KM_PER_DEGREE * F.greatest(F.cos(F.radians(col(lat))), F.lit(C.LEAST_COS_LAT)))
    return F.struct((col(lon) - dlon).alias("west"), (col(lat) - dlat).alias("south"), (col(lon) + dlon).alias("east"), (col(lat) + dlat).alias("north"))


_A, _F, _K0, _E0 = 6378137.0, 1 / 298.257222101, 0.9996, 500_000.0
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon, lat, zone: int = 15) -> Column:
    """F16: (x, y) in a northern UTM zone by the Krueger series to the third order."""
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - (zone * 6 - 183))
    c = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.struct((_E0 + _K0 * _R * east).alias("x"), (_K0 * _R * north).alias("y"))


def from_utm(x, y, zone: int = 15) -> Column:
    """F16: (lon, lat) from a northern UTM zone."""
    xi, eta = col(y) / (_K0 * _R), (col(x) - _E0) / (_K0 * _R)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (zone * 6 - 183)).alias("lon"), F.degrees(phi).alias("lat"))


def cell_of(x, y, grid: tuple[float, float, float, float, float, float]) -> Column:
    """(row, col) of the cell that holds a point; grid is (a, b, c, d, e, f) of the affine transform."""
    a, b, c, d, e, f = map(float, grid)
    det = a * e - b * d
    dx, dy = col(x) - c, col(y) - f
    return F.struct(F.floor((a * dy - d * dx) / det).cast("int").alias("row"), F.floor((e * dx - b * dy) / det).cast("int").alias("col"))


def cell_center(row, column, grid: tuple[float, float, float, float, float, float]) -> Column:
    """(x, y) of a cell's centre."""
    a, b, c, d, e, f = map(float, grid)
    r, k = col(row) + 0.5, col(column) + 0.5
    return F.struct((c + k * a + r * b).alias("x"), (f + k * d + r * e).alias("y"))


# Lookups ---------------------------------------------------------------------------------


def interpolate(x, points) -> Column:
    """J15 for a fixed short curve of (x, y) in ascending x: linear, flat beyond its ends."""
    x = col(x)
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        out = F.when(x < x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(out)
    return F.when(x.isNull(), None).when(x <= points[0][0], float(points[0][1])).otherwise(out)


def ramp_colour(share) -> Column:
    """red, green, blue of the depth ramp at a share of 0 to 1."""
    return F.struct(*[F.floor(interpolate(share, [(s[0], float(s[k])) for s in C.DEPTH_RAMP])).cast("int").alias(n) for k, n in ((1, "red"), (2, "green"), (3, "blue"))])


def point_in_rings(x, y, rings) -> Column:
    """Is a point inside the rings (array of arrays of {x, y}) or on their line?"""
    px, py = col(x), col(y)

    def ring_edges(ring):
        return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    edges = F.flatten(F.transform(col(rings), ring_edges))

    def crosses(e):
        p, q = e["p"], e["q"]
        return ((p["y"] > py) != (q["y"] > py)) & (px < p["x"] + (py - p["y"]) * F.try_divide(q["x"] - p["x"], q["y"] - p["y"]))

    def on_line(e):
        p, q = e["p"], e["q"]
        flat = (q["x"] - p["x"]) * (py - p["y"]) - (q["y"] - p["y"]) * (px - p["x"])
        return (flat == 0) & px.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & py.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    inside = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return inside | F.exists(edges, on_line)


def point_to_segment(px, py, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    t = clip(F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0)), 0.0, 1.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def line_meets_rings(line, rings) -> Column:
    """J02 for a line (array of {x, y}): has it a point in the rings, or a stretch that crosses one of their edges?"""
    def stretches(points):
        return F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def side(a, b, c):
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def cross(s, e):
        return (side(s["p"], s["q"], e["p"]) * side(s["p"], s["q"], e["q"]) < 0) & (side(e["p"], e["q"], s["p"]) * side(e["p"], e["q"], s["q"]) < 0)

    edges = F.flatten(F.transform(col(rings), stretches))
    return F.exists(col(line), lambda p: point_in_rings(p["x"], p["y"], rings)) | F.exists(stretches(col(line)), lambda s: F.exists(edges, lambda e: cross(s, e)))


def distance_to_rings(x, y, rings) -> Column:
    """How far a point lies from a shape; zero inside it."""
    px, py = col(x), col(y)

    def gap(p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.greatest(F.least(F.coalesce(F.try_divide((px - p["x"]) * dx + (py - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        return F.hypot(px - p["x"] - t * dx, py - p["y"] - t * dy)

    gaps = F.flatten(F.transform(col(rings), lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), gap)))
    return F.when(point_in_rings(px, py, rings), 0.0).otherwise(F.array_min(gaps))
