"""The registered graph builders against exact k-NN."""

import pytest
from pyspark.sql import functions as F
from vecspark.operators import candidates as C
from vecspark.operators import evaluate as E
from vecspark.operators import graph as G
from vecspark.operators.knn import knn_graph
from vecspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, least", [("graph_nndescent", 0.8), ("graph_fixed_buckets", 0.8), ("graph_bounded_buckets", 0.8), ("graph_projection", 0.5)])
def test_registered_builder_recall(spark, name, least):
    exact = knn_graph(catalog.points(spark, SF), catalog.K)
    found = catalog.QUERIES[name](spark, SF)
    assert E.set_recall(exact, found, catalog.K).agg(F.avg("recall")).first()[0] >= least


def test_plain_ends_with_an_exact_search(spark):
    points = catalog.points(spark, SF).limit(60).cache()
    found = G.plain(points, 5, recall=0.99, hash_length=16, most=16)
    assert E.set_recall(knn_graph(points, 5), found, 5).agg(F.avg("recall")).first()[0] == 1


def test_sketched_descent(spark):
    points = catalog.points(spark, SF).cache()
    found = G.nndescent(points, catalog.K, repetitions=4, use_sketching=True)
    assert E.set_recall(knn_graph(points, catalog.K), found, catalog.K).agg(F.avg("recall")).first()[0] > 0.4


def test_random_pairs_of_sparse_ids(spark, monkeypatch):
    """Positions do not depend on the buckets."""
    ids = spark.range(40).select((F.col("id") * 987654321987 - 10**13).alias("id"))
    want = {tuple(r) for r in C.random_pairs(ids, 3).collect()}
    monkeypatch.setattr(C, "POSITION_ROWS", 7)
    assert {tuple(r) for r in C.random_pairs(ids, 3).collect()} == want and len(want) > 100
