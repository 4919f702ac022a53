"""Joins by a key that most rows share."""

import pytest
from pyspark.sql import functions as F
from vecspark.llm import common, line_dedup, simhash_dedup


@pytest.mark.parametrize("hot_keys", [1, 4, 1 << 14])
def test_join_counted(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"))
    side = big.where("k <> 11").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = common.join_counted(big, side, ["k"], 3000)
    assert sorted(got.columns) == ["id", "k", "top"]
    want = {(r.id, r.top) for r in big.join(side, "k").collect()}
    rows = [(r.id, r.top) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_hot_passage_is_not_dealt_by_its_key(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 16)
    passage = " ".join(f"p{j}" for j in range(60))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + "\nown "), F.col("id").cast("string")).alias("text")).repartition(8)
    got = line_dedup.dedup(docs)
    assert got.where("_removed = 1").count() == 3999
    assert got.where("doc_id = 0").first()._removed == 0


def test_one_fingerprint_and_one_component_for_many_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 16)
    fps = common.cut(spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id")).cast("long").alias("fp")))
    got = {r.doc_id: r.component_id for r in simhash_dedup.groups(fps).collect()}
    assert len(got) == 3000
    assert all(got[i] == 0 for i in range(0, 3000, 3))
