"""Every operator and stage on empty tables, nulls, repeats, ties, very long texts and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hydrospark.llm import decontamination, language_id, licenses, line_dedup, packing, quality_rules, secrets, sharding, simhash_dedup, token_files
from hydrospark.llm.common import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["which", "found", "row", "h", "fp", "key", "n", "spans", "places", "votes", "shard", "slot", "root", "node", "cluster", "grp", "posterior", "label", "nth"]
GOOD = "the river rose over its banks in the night and the people of the town went up to the hill with what they could carry while the rain went on and on"
ROWS = [
    (1, GOOD + " one " + GOOD.replace("river", "water") + " end", "en", "a/x", 10),
    (2, None, "en", "a/x", None),
    (3, "", None, None, 0),
    (4, " \n\t\n ", "fr", "b", 5),
    (5, "l'eau est montée dans la nuit\n" * 40, "fr", "b", 7),
    (5, "l'eau est montée dans la nuit\n" * 40, "fr", "b", 7),
    (None, GOOD, "en", None, 1),
    (None, None, None, None, None),
    (7, " ".join(f"w{i} x{i % 97}" for i in range(60_000)), "en", "c", 1),
    (8, "日本語 текст ñandú 😀 á z", "xx", "d", 3),
    (9, "x" * 300_000, "en", "c", 1),
]


def vocabulary():
    return pytest.importorskip("public_tokenizers").path(token_files.VOCABULARY)


def run_all(docs, benchmark):
    spark = docs.sparkSession
    return {
        "secrets": secrets.secrets(docs),
        "packing": packing.pack(docs),
        "licenses": licenses.licenses(docs),
        "language": language_id.identify(docs, language_id.dictionaries(docs)),
        "sharding": sharding.shard(docs, 4, 64),
        "tokens": token_files.token_files(docs, shared_path(spark, "t"), vocabulary()),
        "lines": line_dedup.marked(docs),
        "quality": quality_rules.score(docs),
        "simhash": simhash_dedup.dedup(docs),
        "benchmark": decontamination.report(docs, benchmark),
    }


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA})
    bench = spark.createDataFrame([(1, GOOD), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    out = {k: df.collect() for k, df in run_all(docs, bench).items()}
    for name, rows in out.items():
        if name != "packing":
            assert len(rows) == len(ROWS), name
    assert {r.doc_id for r in out["packing"]} == {r[0] for r in ROWS}
    sim = {r.doc_id: r for r in out["simhash"]}
    assert sim[2].fp == 0 and sim[3].component_id == sim[4].component_id == 2
    assert [r.lang_pred for r in out["language"] if r.doc_id in (2, 3, 4)] == ["und"] * 3
    assert all(r.n_words == 0 and not r.contaminated for r in out["benchmark"] if r.doc_id in (2, 3, 4))
    assert sum(r.contaminated for r in out["benchmark"]) == 2
    assert sorted(r.copies for r in out["tokens"]) == [1] * 7 + [2] * 4
    assert all(r.license == "none" for r in out["licenses"])


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA})
    bench = spark.createDataFrame([(1, GOOD)], "item_id long, text string")
    for out in (quality_rules.keep(docs), line_dedup.remove(docs), simhash_dedup.keep_one(docs), decontamination.decontaminate(docs, bench)):
        assert out.columns == docs.columns
        assert out.count() <= len(ROWS)
    assert simhash_dedup.keep_one(docs).where("doc_id = 5").count() == 1
    assert simhash_dedup.keep_one(docs).where("doc_id in (2, 3, 4)").count() == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    for name, df in run_all(docs, bench).items():
        assert df.count() == 0, name
    for out in (quality_rules.keep(docs), line_dedup.remove(docs), simhash_dedup.keep_one(docs), decontamination.decontaminate(docs, bench)):
        assert out.columns == docs.columns and out.count() == 0


def test_empty_benchmark_changes_nothing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(docs, bench).where("n_hit > 0").count() == 0
    assert sorted(r.text or "" for r in decontamination.decontaminate(docs, bench).select("text").collect()) == sorted(r[1] or "" for r in ROWS)


def test_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
