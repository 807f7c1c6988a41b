"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for three fixed kinds of secret (an assignment to a telling name, an
access key, a long hexadecimal run) and for wider candidates: mixed tokens of 20 or more
characters, and PEM private key blocks.  The hash of each value is counted over the corpus
by distinct repositories and owners.  A value that ``EXAMPLE_OWNERS`` or more owners
carry is a widely copied example; one that a single owner has, and that does not look like a
placeholder, is live-looking; between them it is shared.  A wider candidate becomes a
span unless it is an example or a placeholder; spans of the fixed kinds always stay.

``source`` names the repository; its part before the first slash is the owner.

Scale: texts are read once and never shuffled.  Candidates (a hash and a source each)
are counted with map-side combining, so a value in a third of all rows is a row or two
from each task; joining the verdicts back moves only candidates, and not those of values
that are very frequent.  Only hashes of values
are stored, never the values.

Defined results: a null text is empty; each row without a source is an owner of its own; repeated
rows each keep their spans and count one owner; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm.common import join_counted, stored, table

KINDS = ("assign", "access", "hex", "token", "pem")
EXAMPLE_OWNERS = 3
_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{64,}-----END [A-Z ]{0,40}PRIVATE KEY-----")
_PLACEHOLDER = re.compile(r"(?i)example|sample|changeme|change_me|placeholder|dummy|your[_-]?|xxxx|(.)\1{7}|1234567890|abcdefgh")


def candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind; wider kinds only where no fixed kind is."""
    text = text or ""
    found: list[tuple[str, int, int, str]] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    fixed = _joined((a, b) for _, a, b, _ in found)
    starts = [a for a, _ in fixed]
    wide = [("token", *m.span(), m[0]) for m in _TOKEN.finditer(text) if _mixed(m[0])]
    if "PRIVATE KEY-----" in text:
        wide += [("pem", *m.span(), m[0]) for m in _PEM.finditer(text)]
    for x in wide:
        k = bisect_left(starts, x[2])  # stretches before k begin before x ends, and the last of them ends last
        if not k or fixed[k - 1][1] <= x[1]:
            found.append(x)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _joined(spans) -> list[tuple[int, int]]:
    """Overlapping stretches as one, by start."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _mixed(x: str) -> bool:
    return len(set(x)) >= 10 and re.search("[0-9]", x) is not None and re.search("[a-z]", x) is not None and re.search("[A-Z]", x) is not None


def line_of(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = "array<struct<kind:string,start:int,end:int,hash:string,placeholder:boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, source, found``: every candidate of every row, with the hash of its value."""

    def run(batches):
        for b in batches:
            rows = [
                [{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), "placeholder": _PLACEHOLDER.search(v) is not None} for k, s, e, v in candidates(t)]
                for t in b.column("text").to_pylist()
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("placeholder", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(rows, kind)], names=["doc_id", "source", "found"])

    return docs.select("doc_id", "text", F.col("source").cast("string").alias("source")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, source string, found {_FOUND}")


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n_rows, n_repositories, n_owners`` of every candidate value (columns hash, source, row)."""
    by_source = found.withColumn("source", F.coalesce("source", F.concat(F.lit("\x00"), F.col("row").cast("string")))).groupBy("hash", "source").agg(F.count("*").alias("n"))
    by_owner = by_source.groupBy("hash", F.substring_index("source", "/", 1).alias("owner")).agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: the spans of the fixed kinds, and all spans with their verdicts.

    ``spans`` is an array of (start, kind number, kind, end, verdict, n_repositories, n_owners), by start.
    """
    scanned = stored(scan(docs).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = scanned.where(F.size("found") > 0).select("row", "source", F.inline("found"))
    owned = stored(ownership(each.select("hash", "source", "row")), "secret-owners")
    verdict = F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example").when(F.col("placeholder"), "placeholder").when(F.col("n_owners") == 1, "live").otherwise("shared")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = (
        join_counted(each, owned, "hash", "n_rows")
        .withColumns({"verdict": verdict, "nth": order})
        .where("nth <= 3 or verdict in ('live', 'shared')")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "nth", "kind", "end", "verdict", "n_repositories", "n_owners"))).alias("spans"))
    )
    return scanned.join(spans, "row", "left").select("doc_id", F.expr("filter(found, x -> x.kind in ('assign', 'access', 'hex'))").alias("base"), F.coalesce("spans", F.expr("array()")).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, with the numbers of spans by verdict beside them."""
    line = "array_join(transform({0}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.expr(line.format("base")), 256).alias("base_sha256"),
        F.expr(line.format("spans")).alias("spans"),
        *[F.expr(f"cast(size(filter(spans, x -> x.verdict = '{v}')) as long)").alias(f"n_{v}") for v in ("live", "shared", "example", "placeholder")],
    )


_FIXED = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "(AKIA[A-Z0-9]+)",
    "hex": "([0-9a-f]+)",
    "token": "([A-Za-z0-9+/_=-]+)",
}
_LEAST = {"assign": 12, "access": 18, "hex": 16, "token": 20}

#: Every match of a kind with its place: matches and what lies between them are cut by the same
#: pattern, and their lengths add up.  (PEM blocks are left to the tests.)
OP1_SQL = (
    "WITH d0 AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents), d AS (SELECT r, doc_id, coalesce(source, 'no source ' || r) AS source, text FROM d0), m AS ("
    + " UNION ALL ".join(
        f"""SELECT r, source, '{k}' AS kind, {n} AS nth, list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS a, hits[i] AS hit, vals[i] AS v
FROM (SELECT r, source, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
  SELECT r, source, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', 1) AS vals FROM (SELECT r, source, text FROM d) q))
WHERE len(vals[i]) >= {_LEAST[k]}"""
        for n, (k, p) in enumerate(_FIXED.items(), 1)
    )
    + r"""), s AS (SELECT r, source, kind, nth, CAST(a AS BIGINT) AS a, CAST(a + len(hit) AS BIGINT) AS b, v FROM m),
base AS (SELECT * FROM s WHERE nth <= 3),
wide AS (SELECT * FROM s WHERE nth = 4 AND len(list_distinct(string_split(v, ''))) >= 10 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = s.r AND base.a < s.b AND s.a < base.b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM wide),
owned AS (SELECT v, count(DISTINCT string_split(source, '/')[1]) AS n_owners FROM every GROUP BY v),
judged AS (SELECT every.*, CASE WHEN n_owners >= 3 THEN 'example'
  WHEN regexp_matches(v, '(?i)example|sample|changeme|change_me|placeholder|dummy|your[_-]?|xxxx|1234567890|abcdefgh') OR len(list_filter(range(1, len(v) - 6), lambda i: v[i:i + 7] = repeat(v[i], 8))) > 0 THEN 'placeholder'
  WHEN n_owners = 1 THEN 'live' ELSE 'shared' END AS verdict FROM every JOIN owned USING (v)),
out AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, nth) FILTER (nth <= 3) AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, nth) AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'shared') AS n_shared, count(*) FILTER (verdict = 'example') AS n_example, count(*) FILTER (verdict = 'placeholder') AS n_placeholder
  FROM judged WHERE nth <= 3 OR verdict IN ('live', 'shared') GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example, coalesce(n_placeholder, 0) AS n_placeholder
FROM d LEFT JOIN out USING (r)"""
)
