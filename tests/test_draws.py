"""Draws of the paired tests in bounded memory."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovel.operators import metrics


def test_draws_are_a_row_each_not_one_for_each_query(spark):
    pairs = spark.createDataFrame([("c", m, i, None if i == 3 else (i * 7 % 5) / 10) for m, n in (("m", 40), ("k", 9)) for i in range(n)], "comparison string, metric string, query_id long, delta double")
    assert metrics._draws(pairs, 150, 42).count() == 300
    d = {m: [None if i == 3 else (i * 7 % 5) / 10 for i in range(n)] for m, n in (("m", 40), ("k", 9))}
    for r in metrics._draws(pairs, 150, 42).where("draw in (0, 99, 149)").collect():
        own = d[r.metric]
        h = [int(hashlib.md5(f"42:{r.draw}:{i}".encode()).hexdigest()[:8], 16) for i in range(len(own))]
        drawn = [own[x % len(own)] for x in h]
        flipped = [v if x % 2 == 0 else -v for v, x in zip(own, h, strict=True) if v is not None]
        assert r.drawn == pytest.approx(np.mean([x for x in drawn if x is not None])) and r.flipped == pytest.approx(np.mean(flipped))


def test_exact_tests_in_parts_draw_the_same(spark, monkeypatch):
    pairs = spark.createDataFrame([("c", "m", i, (i * 7 % 11) / 10 - 0.3) for i in range(37)], "comparison string, metric string, query_id long, delta double")
    whole = tuple(metrics.exact_tests(pairs, draws=500).first())
    monkeypatch.setattr(metrics, "DRAWN", 1_000)
    assert tuple(metrics.exact_tests(pairs, draws=500).first()) == whole


def test_small_results_are_kept_without_their_plans(spark):
    from trovel.plans.model import Model

    m = Model(spark, "nowhere")
    first = m.once("a", lambda: spark.range(50).groupBy((F.col("id") % 5).alias("k")).agg(F.count("*").alias("n")))
    second = m.once("b", lambda: first.join(first.withColumnRenamed("n", "m"), "k").groupBy("k").agg(F.sum("m").alias("m")))
    assert "Aggregate" not in second._jdf.queryExecution().toString() and second.where("m = 10").count() == 5
    assert m.once("b", None) is second


def test_nodes_and_edges_read_the_texts_once(spark, tmp_path):
    from trovel.plans.model import Model

    spark.createDataFrame([(7, "abcdefghijklmnop 123", "en", "web", 20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    nodes, edges = Model(spark, str(tmp_path)).graph()
    assert edges.count() == 10 and nodes.count() == 9
    for df in (nodes, edges):  # a plan over what is kept, not over the texts
        assert "InMemoryTableScan" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "FileScan" not in plan.split("InMemoryRelation")[0]
