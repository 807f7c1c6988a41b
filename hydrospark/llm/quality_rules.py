"""Quality rules by weak supervision.

Nine rules each vote good (1), bad (-1) or abstain (0) on a document.  How often
every pattern of votes occurs is counted over the whole corpus; expectation
maximisation over those counts (each rule has its own rate of right votes for good and
for bad documents; an abstention is weak evidence, of at most ABSTAIN nats) estimates the
rules' accuracies, and the posterior probability of a good document replaces the usual
"every rule must pass".

Scale: one narrow pass over the texts, no shuffle of text.  The driver sees at most
3**9 = 19,683 pattern counts, whatever the size of the corpus.

Defined results: a null text has no words and is treated as empty; a document
without words fails the base rule; repeated rows and null ids are judged row by row;
an empty table gives an empty result; other columns are neither read nor changed, whatever
their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrospark.llm.common import aside, stored, table

RULES = ("length", "repetition", "symbols", "dup_lines", "word_length", "capitals", "variety", "letters", "wordlike")
#: (rule, bad below, good from, good to, bad above); between them the rule abstains.
LIMITS = {
    "length": (50, 80, None, None),
    "repetition": (None, None, 0.20, 0.50),
    "symbols": (None, None, 0.10, 0.30),
    "dup_lines": (None, None, 0.20, 0.50),
    "word_length": (2.5, 3.5, 7.0, 9.0),
    "capitals": (None, None, 0.15, 0.50),
    "variety": (0.65, 0.80, None, None),
    "letters": (0.60, 0.70, None, None),
    "wordlike": (0.80, 0.95, None, None),
}
KEEP_FROM = 0.5
#: A rule votes "bad" on this share of good documents at most: a bound of the maximisation, as the thresholds are set for that.
FALSE_ALARM = 0.01
#: Most that one abstention moves the log odds.  The README has what happens without either bound.
ABSTAIN = 1.0
_WORDLIKE = re.compile(rb"[A-Za-z0-9\x80-\xff]").search
_ASCII_RUN = re.compile("[\x00-\x7f]+").sub
_ASCII_OTHERS = bytes(c for c in range(128) if not chr(c).isalpha())
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes string"


def measure(text: str | None) -> dict:
    """The base counts of one text and what the rules look at."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = 0
    if n >= 4:
        pair = code[:-1] * len(ids) + code[1:]
        if len(ids) >= 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        window = pair[:-1] * len(ids) + code[2:]
        _, at, times = np.unique(window, return_inverse=True, return_counts=True)
        start = np.flatnonzero(times[at] > 1)
        if len(start):
            hit = np.zeros(n, bool)
            hit[start] = hit[start + 1] = hit[start + 2] = True
            repeated = int(hit.sum())
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    some, dup = max(n, 1), len(lines) - len(set(lines))
    seen = {
        "length": n,
        "repetition": repeated / some,
        "symbols": symbols / some,
        "dup_lines": dup / max(len(lines), 1),
        "word_length": chars / some,
        "capitals": sum(map(bytes.isupper, words)) / some,
        "variety": math.log(max(len(ids), 1)) / math.log(n) if n > 1 else 1.0,
        "letters": _letters(text) / max(chars, 1),
        "wordlike": sum(w.isalnum() or _WORDLIKE(w) is not None for w in words) / some,
    }
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
        "base_failed": n < 50 or 100 * repeated > 50 * n,
        "votes": "".join(_vote(seen[r], *LIMITS[r]) for r in RULES),
    }


def _letters(text: str) -> int:
    """How many characters are letters or marks on them; only those beyond ASCII are looked at one by one."""
    other = _ASCII_RUN("", text)
    return len(text.encode("ascii", "ignore").translate(None, _ASCII_OTHERS)) + (len(other) if other.isalpha() else sum(c.isalpha() or unicodedata.category(c)[0] == "M" for c in other))


def _vote(x: float, bad_below, good_from, good_to, bad_above) -> str:
    if (bad_below is not None and x < bad_below) or (bad_above is not None and x > bad_above):
        return "-"
    if (good_from is None or x >= good_from) and (good_to is None or x <= good_to):
        return "+"
    return "0"


def features(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, base counts and votes of every row."""
    picked = docs.select(*keys, F.col(text_col).alias("__text"))
    out = ", ".join([f"`{k}` {t}" for k, t in picked.dtypes if k != "__text"] + [_SCHEMA])
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = [measure(t) for t in b.column("__text").to_pylist()]
            kept = [b.column(k) for k in keys]
            made = [pa.array([r[n] for r in rows], pa.bool_() if n == "base_failed" else pa.string() if n == "votes" else pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*keys, *names])

    return picked.mapInArrow(run, out)


def fit(counts: dict[str, int], rounds: int = 200, smooth: float = 1.0) -> dict[str, float]:
    """Posterior probability of a good document for every vote pattern, by expectation maximisation.

    The start is the share of good among the votes cast.  Rates are smoothed by
    ``smooth`` pseudo-votes, and a rule's rate of "bad" votes on good documents is held
    to FALSE_ALARM, so that the class of good documents cannot take in a kind of junk.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    kind = np.array([["-0+".index(c) for c in p] for p in patterns])
    onehot = np.eye(3)[kind]  # pattern, rule, vote
    good, bad = onehot[:, :, 2].sum(1), onehot[:, :, 0].sum(1)
    post = (good + 0.5) / (good + bad + 1.0)
    for _ in range(rounds):
        rates = []
        for weight in (post * n, (1 - post) * n):
            r = np.einsum("p,prv->rv", weight, onehot) + smooth
            rates.append(r / r.sum(1, keepdims=True))
        g, b = rates
        over = g[:, 0] > FALSE_ALARM
        g[over] *= (1 - FALSE_ALARM) / (1 - g[over, :1])
        g[over, 0] = FALSE_ALARM
        prior = np.clip((post * n).sum() / n.sum(), 0.01, 0.99)
        weight = np.log(g) - np.log(b)
        weight[:, 1] = np.clip(weight[:, 1], -ABSTAIN, ABSTAIN)
        score = np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", onehot, weight)
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        done, post = np.abs(new - post).max() < 1e-9, new
        if done:
            break
    return dict(zip(patterns, map(float, post)))


def pattern_counts(measured: DataFrame) -> dict[str, int]:
    """How often each vote pattern occurs: at most 3**9 rows reach the driver."""
    return {r["votes"]: r["count"] for r in measured.groupBy("votes").count().collect()}


def score(docs: DataFrame) -> DataFrame:
    """Base counts, posterior and verdict of every row (``doc_id`` and ``text`` are read)."""
    measured = stored(features(docs), "quality")
    post = fit(pattern_counts(measured))
    spark = docs.sparkSession
    known = spark.createDataFrame(list(post.items()), "votes string, posterior double")
    verdict = measured.join(F.broadcast(known), "votes", "left")
    return verdict.withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= KEEP_FROM))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are.

    Texts are measured once and written with their votes; the votes are then counted and
    judged where they lie.
    """
    docs, back = aside(docs)
    schema = T.StructType([*docs.schema, T.StructField("__votes", T.StringType()), T.StructField("__failed", T.BooleanType())])

    def run(batches):
        for b in batches:
            rows = [measure(t) for t in b.column("text").to_pylist()]
            made = [pa.array([r["votes"] for r in rows], pa.string()), pa.array([r["base_failed"] for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "__votes", "__failed"])

    voted = stored(docs.mapInArrow(run, schema), "quality-votes")
    post = fit(pattern_counts(voted.select(F.col("__votes").alias("votes"))))
    good = docs.sparkSession.createDataFrame([(v,) for v, x in post.items() if x >= KEEP_FROM], "__good string")
    return back(voted.where("not __failed").join(F.broadcast(good), F.col("__votes") == F.col("__good"), "left_semi"))


def accuracy(counts: Counter | dict[str, int]) -> dict[str, tuple[float, float]]:
    """Estimated rate of a right vote among votes cast, for good and for bad documents."""
    post, out = fit(dict(counts)), {}
    for i, rule in enumerate(RULES):
        cast = {v: [sum(n * (post[p] if side else 1 - post[p]) for p, n in counts.items() if p[i] == v) for side in (1, 0)] for v in "+-"}
        out[rule] = (cast["+"][0] / max(cast["+"][0] + cast["-"][0], 1e-9), cast["-"][1] / max(cast["+"][1] + cast["-"][1], 1e-9))
    return out


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, with the votes and the posterior beside them."""
    return score(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes"
    )
