"""Best-fit packing with conflicts.

Documents are packed into sequences of ``CAPACITY`` words.  Bins are ordered by the room
left and carry two bitmaps, of sources and of duplicate clusters; two pieces of one
source, or of one cluster of equal texts, never share a bin.  Each piece, largest first,
goes to the tightest bin that has room and no conflict: the search starts at the first bin
with enough room and continues to its successors until one is compatible; else a
bin is opened.  A document longer than a sequence is cut; its whole sequences fill bins
of their own, and the remainder is packed.

Scale: only (doc_id, size, source, cluster) moves.  Documents are dealt by a hash of doc_id,
text and, of rows without a doc_id of their own, a row number, to groups of about ``GROUP_ROWS``
rows, so that every group, and so every task's memory, is bounded and a hot source, a repeated
row or a missing id is spread over all groups; each group is packed on its own.

Defined results: null and wordless texts get a row without a bin; null sources count
as one source of their own kind; repeated rows are packed like any others (they are one
cluster, so never together); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm.common import numbered, stored, table

CAPACITY = 2048
GROUP_ROWS = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, source, cluster`` of every row, by built-in functions."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return docs.select("doc_id", words.cast("long").alias("n_words"), F.coalesce("source", F.lit("\x00null")).alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"))


def best_fit(items: list[tuple[int, str, int]], capacity: int = CAPACITY) -> list[int]:
    """A bin number for each (size, source, cluster); sizes are 1 to ``capacity``.

    Largest first; ties in the order given.  Bins with the same room are tried in the
    order of their numbers.
    """
    source_bit: dict[str, int] = {}
    cluster_bit: dict[int, int] = {}
    open_bins: list[tuple[int, int]] = []  # (room left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = [-1] * len(items)
    for k in sorted(range(len(items)), key=lambda k: -items[k][0]):
        size, source, cluster = items[k]
        s = 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        for at in range(bisect_left(open_bins, (size, -1)), len(open_bins)):
            room, b = open_bins[at]
            if not (sources[b] & s or clusters[b] & c):
                del open_bins[at]
                break
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        if room > size:
            insort(open_bins, (room - size, b))
        out[k] = b
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start_word, n_words, bin, bin_offset``.

    ``bin`` is null for documents without words.
    """
    rows = stored(sizes(docs), "packing-sizes")
    n_groups = max(1, -(-rows.count() // GROUP_ROWS))
    kind = dict(docs.dtypes)["doc_id"]
    dealt = numbered(rows).withColumn("grp", F.pmod(F.xxhash64("doc_id", "cluster", "__row"), F.lit(n_groups))).drop("__row")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "cluster"], kind="stable", ignore_index=True)
        row, piece, start, size = [], [], [], []
        for k, n in enumerate(pdf["n_words"].tolist()):
            for p in range(max(1, -(-n // capacity))):
                row.append(k)
                piece.append(p)
                start.append(p * capacity)
                size.append(min(capacity, n - p * capacity))
        source, cluster = pdf["source"].tolist(), pdf["cluster"].tolist()
        real = [i for i, n in enumerate(size) if n]
        bins: list[int | None] = [None] * len(size)
        for i, b in zip(real, best_fit([(size[i], source[row[i]], cluster[row[i]]) for i in real], capacity)):
            bins[i] = b
        filled: dict[int, int] = {}
        offset: list[int | None] = [None] * len(size)
        for i in real:
            offset[i] = filled.get(bins[i], 0)
            filled[bins[i]] = offset[i] + size[i]
        group = int(key[0]) << 32
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].take(row).array,
                "piece": piece,
                "start_word": start,
                "n_words": size,
                "bin": pd.array([None if b is None else group + b for b in bins], "Int64"),
                "bin_offset": pd.array(offset, "Int64"),
            }
        )

    return dealt.groupBy("grp").applyInPandas(run, f"doc_id {kind}, piece int, start_word long, n_words long, bin long, bin_offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of CAPACITY words."""
    return pack(table(spark, sf_dir, "documents"))
