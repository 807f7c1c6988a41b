"""Clustering, importance resampling and LM scoring: odd tables, skew, and brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.llm import context_mixing as C
from hydrospark.llm import kdtree_clusters as K
from hydrospark.llm import resampling as R

# 11 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_filtering_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-20 if seed % 2 else -3, 4, size=(700, 5)) + 40 * rng.integers(0, 3, size=(700, 1))
    centroids = points[rng.choice(700, 9)]
    tree = K.Tree(points)
    got = np.full(700, -1)
    for node, whole, rows, cluster in K.filtered(tree, centroids):
        got[rows] = cluster
        for i, z in zip(node, whole):
            got[tree.start[i] : tree.end[i]] = z
            assert (tree.total[i] == tree.points[tree.start[i] : tree.end[i]].sum(0)).all()
    assert (got == K.nearest(points[tree.order], centroids)[0]).all()


def test_vectors_that_are_not_kept_and_repeats(spark):
    good = [[float(i)] * 64 for i in (0, 0, 5, 5, 9)]
    bad = [[1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [math.nan], [math.inf] * 64, None, []]
    rows = [(k, v, "x") for k, v in enumerate(good + bad)] + [(None, [2.0] * 64, "x"), (1, good[1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")
    out, centroids = K.cluster(df, k=16)
    got = out.collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(["0", "1", "1", "2", "3", "4", "None"])
    assert len(centroids) == 7 and all(r.distance == 0 for r in got)
    out, centroids = K.cluster(df.where("vec_id >= 5"), k=16)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="after scaling"):
        K.cluster(spark.createDataFrame([(1, [1e30] * 64)], df.select("vec_id", "embedding").schema))[0].collect()


# 13 --------------------------------------------------------------------------------------


def plain_resample(docs, bench):
    words = lambda t: R.words_of(t)
    feats = lambda ws: [zlib.crc32(x) % 10000 for x in ws] + [zlib.crc32(a + b" " + b) % 10000 for a, b in zip(ws, ws[1:])]
    count = lambda texts: np.bincount([f for t in texts for f in feats(words(t))] or [0], minlength=10000) - (0 if any(words(t) for t in texts) else np.eye(1, 10000)[0].astype(int))
    s, t = count([x for _, x in docs]), count(bench)
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(t.sum() * 0 + s.sum()) + 10000) / ((float(s[b]) + 1) * (float(t.sum()) + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        f = feats(words(text))
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= 20])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(may[: 25 * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resampling_with_a_hot_text_and_odd_rows(spark, monkeypatch):
    from hydrospark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rng = random.Random(3)
    some = ["river", "Bank", "flood", "été", "gauge", "a1", "ñ"]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    docs += [(1000 + i, "the same text again and again " * 5) for i in range(80)]
    docs += [(None, docs[5][1]), (7, docs[7][1]), (7, docs[8][1]), (2000, None), (2001, ""), (2002, "?!"), (2003, "x" * 200_000), (2004, "word " * 70_000)]
    bench = ["river flood gauge", None, "bank bank"]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "weight", "copies", "part")})
    b = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string")
    assert sorted((tuple(r) for r in R.resample(d, b).collect()), key=repr) == plain_resample(docs, bench)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b " * 20)], none.schema)
    assert R.resample(one, none).count() == 1


# 12 --------------------------------------------------------------------------------------


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def plain_base(docs):
    """Counts and the smoothed score, told with loops."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    seen = {}
    for i, t in docs:
        if not held_out(i):
            for w in toks(t):
                seen[w] = seen.get(w, 0) + 1
    n, v = sum(seen.values()), len(seen)
    return [(i, held_out(i), len(toks(t)), sum(w in seen for w in toks(t)), n, sum(math.log10((seen.get(w, 0) + 1) / (n + v + 1)) for w in toks(t))) for i, t in docs]


def odd_docs():
    rng = random.Random(8)
    some = [f"w{k}" for k in range(40)] + ["Été", "ÑANDÚ", "x\x0by", "日本"]
    docs = [(i, " ".join(rng.choice(some[: 5 + i % 39]) for _ in range(rng.randrange(0, 80)))) for i in range(300)]
    return docs + [(None, "w1 w2 w3"), (None, None), (7, "w1"), (7, "w1 w2"), (2000, None), (2001, ""), (2002, " \t\n"), (2003, "q" * 300_000), (2004, "w1 w2 w3 " * 30_000), *[(5000 + i, "the same text again " * 9) for i in range(150)]]


def test_lm_base_counts_and_odd_rows(spark):
    docs = odd_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "rest", "ids", "word", "c", "score")})
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in C.score(df).collect()), key=repr)
    assert got == sorted(((*r[:5], round(r[5], 5)) for r in plain_base(docs)), key=repr)


def test_lm_learns_contexts_and_only_from_training_rows(spark):
    rng = random.Random(4)
    pairs = {f"w{k}": [f"w{(7 * k + j) % 60}" for j in range(3)] for k in range(60)}

    def walk(n):
        out = ["w0"]
        while len(out) < n:
            out.append(rng.choice(pairs[out[-1]]))
        return " ".join(out)

    docs = [(i, walk(120)) for i in range(200)]
    a = {r.doc_id: r for r in C.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    held = [i for i, _ in docs if held_out(i)]
    assert sum(a[i].score for i in held) > 0.7 * sum(a[i].base_score for i in held)  # three of sixty words can follow
    other = [(i, "secret words " * 50 if i == held[0] else t) for i, t in docs]
    b = {r.doc_id: r for r in C.score(spark.createDataFrame(other, "doc_id long, text string").repartition(7)).collect()}
    assert all(abs(a[i].score - b[i].score) < 1e-3 for i, _ in docs if i != held[0])
    assert b[held[0]].n_known == 1


def test_lm_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    coder = C.Coder([(f"w{k}".encode(), 5 + k * k) for k in range(30)], 17, 9)
    slots = C.packed(rng.integers(0, 30, 1 << C.SLOT_BITS), rng.integers(0, 30, 1 << C.SLOT_BITS))
    mixer = C.Mixer(coder, slots, rng.normal(0.3, 0.1, (C.GATES, C.INPUTS)).astype(np.float32))
    way = rng.integers(0, 31, 100).astype(np.uint16)
    for n in (0, 1, 31, 32, 33, 99):
        texts = [np.append(way[:n], np.uint16(leaf)) for leaf in range(coder.start)]
        after = mixer.scores(np.concatenate(texts), np.cumsum([n + 1] * len(texts)))
        before = mixer.scores(way[:n], np.array([n])) if n else 0
        assert abs((10 ** (after - before)).sum() - 1) < 1e-3


def test_lm_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert C.score(none).count() == 0
    alone = next(i for i in range(100) if held_out(i))
    (row,) = C.score(spark.createDataFrame([(alone, "nothing is known")], none.schema)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (4, 0, 0, 0.0)
