"""The language sample, what the trained network gets right, and columns that a caller brings along."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeline.llm import language, query_text

SF = "/root/testdata/sf0.01"


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)


@pytest.mark.parametrize("size", [3, 20])
def test_sample_is_the_same_for_the_same_texts(spark, monkeypatch, size):
    monkeypatch.setattr(language, "SAMPLE", size)
    rng = random.Random(1)
    many = [(k, "one text of aa that stands very often", "aa") for k in range(2000)]
    rare = [(5000 + k, f"rare words {k} of bb", "bb") for k in range(150)]
    few = [(9000 + k, f"cc {k}", "cc") for k in range(5)]
    more = [(20000 + k, f"{k} dd {rng.random()}", "dd") for k in range(1500)]
    first = language.sample(frame(spark, many + rare + few + more, 3))
    assert language.sample(frame(spark, more + few + rare + many[:1], 5)) == first
    held = {x: {t for t, y in first if y == x} for x in ("aa", "bb", "cc", "dd")}
    assert {x: len(t) for x, t in held.items()} == {"aa": 1, "bb": size, "cc": min(5, size), "dd": size} and len(first) == sum(map(len, held.values()))
    hashes = {r[0]: r[1] for r in frame(spark, rare, 1).select("text", F.xxhash64("text")).collect()}
    assert held["bb"] == set(sorted(hashes, key=hashes.get)[:size])


def test_sample_takes_a_language_again_where_the_estimate_was_too_high(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 40)
    rows = frame(spark, [(k, f"text {k}", "aa") for k in range(400)], 2)
    whole = language.sample(rows)
    monkeypatch.setattr(language.F, "approx_count_distinct", lambda c: F.count(c) * 100)
    assert language.sample(rows) == whole and len(whole) == 40


def test_sample_of_nothing(spark):
    assert language.sample(frame(spark, [(1, None, "aa"), (2, "x", None)], 1)) == []
    assert language.sample(spark.createDataFrame([], "doc_id long, text string, lang string")) == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = query_text.op3_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, total = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert total > 200 and right >= 0.98 * total


#: Names that stages and their operators use for columns of their own.
INTERNAL = ("raw", "n_bytes", "passages", "spans", "lang_pred", "score", "_lang", "_score", "whole", "component_id", "class_id", "n_words", "hits", "n_hit", "items", "node", "tokens", "piece", "start")


def test_stages_leave_other_columns_alone(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(90)) for _ in range(n))
    passage = prose(80)
    texts = [prose(60), prose(60) + " " + passage, passage + " " + prose(30), None, "…", prose(5)]
    rows = [(k, t, "en", "s", 7) for k, t in enumerate([*texts, texts[0]])]
    extra = {c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in INTERNAL}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra)
    spark.createDataFrame([("i", prose(20))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, kinds = [], docs.dtypes
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.dtypes == kinds
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            found = docs.collect()
            assert all(r[c] == f"{c} of {r.doc_id}" for r in found for c in INTERNAL)
            kept.append(sorted(r.doc_id for r in found))
    assert kept == [[0, 1, 2, 5, 6], [0, 1, 2, 5], [0, 1, 2, 5], [0, 1, 2, 5]]
    assert {r.doc_id for r in docs.collect()} == {0, 1, 2, 5}
