"""Index against exact search: every family and source reaches the recall it was asked for, whatever the ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecspark.operators import evaluate as E
from vecspark.operators import index as I
from vecspark.operators.adapters import instantiate
from vecspark.operators.hashing import Independent, MinHash, Tensor, hash_codes, prefix_collision
from vecspark.operators.index import Index
from vecspark.operators.knn import knn

N, DIM, K = 400, 20, 5


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, DIM))
    return x, x[:40] + 0.3 * rng.normal(size=(40, DIM))


def recall(spark, index, x, q, first, asked):
    points, queries = frame(spark, x, first), frame(spark, q)
    found = index.fit(points).search(queries, K, asked)
    rows = found.collect()
    assert len({(r.src, r.dst) for r in rows}) == len(rows)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (q, x))
    assert all(r.sim == pytest.approx((a[r.src] @ b[r.dst - first] + 1) / 2, abs=1e-6) for r in rows)
    return E.set_recall(knn(queries, points, K), found, K).agg(F.avg("recall")).first()[0]


@pytest.mark.parametrize("family", ["simhash", "crosspolytope", "fht_crosspolytope"])
@pytest.mark.parametrize("source", ["pool", "independent", "tensor"])
def test_recall_of_families_and_sources(spark, vectors, monkeypatch, family, source):
    monkeypatch.setattr(I, "PAIR_COST", 0)  # never exact because of the costs
    assert recall(spark, Index("angular", DIM, 25, family, source), *vectors, -N, 0.9) >= 0.9


@pytest.mark.parametrize("asked, filter_type", [(0.2, "filter"), (0.5, "none"), (0.95, "filter")])
def test_recall_asked_for(spark, vectors, monkeypatch, asked, filter_type):
    monkeypatch.setattr(I, "PAIR_COST", 0)
    assert recall(spark, Index("angular", DIM, 25, filter_type=filter_type), *vectors, -20, asked) >= asked


def test_costly_queries_are_exact(spark, vectors):
    assert recall(spark, Index("angular", DIM, 25), *vectors, -N, 0.5) == 1


def test_negative_ids_in_adapters(spark, vectors):
    x, q = vectors
    points, queries = frame(spark, x, -N), frame(spark, q)
    for name, options in (("ivf", {"n_list": 4, "n_probe": 4}), ("lsh-index", {"dim": DIM})):
        found = instantiate(name, **options).fit(points).query(queries, K)
        assert E.set_recall(knn(queries, points, K), found, K).agg(F.avg("recall")).first()[0] >= 0.9


def test_options(spark, vectors):
    x, _ = vectors
    index = Index("angular", DIM, memory_limit=N * DIM * 2 + 3 * (N * 8 + 65536), hash_args={"num_rotations": 2, "estimation_eps": 0.05, "estimation_repetitions": 100}, source_args={"num_functions": 60})
    assert index.fit(frame(spark, x)).tables == 3 and index.codes.select("table_id").distinct().count() == 3
    assert index.family.rotations == 2 and index.source.functions(index.family.bits) == 10
    for bad in ({"hash_args": {"x": 1}}, {"hash_function": "minhash"}, {"memory_limit": 10}):
        with pytest.raises(ValueError):
            Index("angular", DIM, **bad).fit(frame(spark, x))


def test_prefix_collisions(spark):
    """Formulas of whole and part functions against counted collisions of random pairs."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base + 0.6 * rng.normal(size=base.shape)
    sims = ((base * near).sum(axis=1) / np.linalg.norm(base, axis=1) / np.linalg.norm(near, axis=1) + 1) / 2
    for name in ("simhash", "crosspolytope", "fht_crosspolytope"):
        index = Index("angular", 16, 64, name, "independent")
        a, b = ({(r.table_id, r.id): r.h for r in index.hashed(frame(spark, v)).collect()} for v in (base, near))
        for depth in (2, 5, 8):
            got = np.mean([a[k] >> 24 - depth == b[k] >> 24 - depth for k in a])
            said = spark.createDataFrame([(float(s),) for s in sims], "s double").select(F.avg(prefix_collision(index.family, F.col("s"), depth))).first()[0]
            assert abs(got - said) < 0.03, (name, depth)


def test_failure_of_sources(spark):
    """One bit at similarity 1/2 collides with 1/2; a square of 4 tables has two halves of each side."""
    one = lambda c: spark.range(1).select(c).first()[0]
    family = MinHash(2, one_bit=True)
    assert one(Independent(3, 8).failure(family, F.lit(0.0), 1)) == pytest.approx(1)
    sets = spark.createDataFrame([(0, [0, 1]), (1, [0])], "id long, tokens array<long>")
    assert hash_codes(sets, family, Tensor(4, 8), True).count() == 8
    p = one(prefix_collision(family, F.lit(0.5), 2))
    assert one(Tensor(4, 8).failure(family, F.lit(0.5), 4)) == pytest.approx(1 - (1 - (1 - p) ** 2) ** 2)
