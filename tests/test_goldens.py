"""Small inputs with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecspark.functions import bits as B
from vecspark.functions import probability as P
from vecspark.functions import vectors as V
from vecspark.operators import candidates as C
from vecspark.operators import evaluate as E
from vecspark.operators.adapters import instantiate
from vecspark.operators.graph import build_graph
from vecspark.operators.hashing import CrossPolytope, FHTCrossPolytope, Independent, MinHash, Pool, SimHash, Tensor, cross_polytope_estimates, hadamard, hash_codes
from vecspark.operators.index import Index, search_ids, tables_for_memory
from vecspark.operators.knn import adjacency, knn, knn_graph, topk


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vec array<float>")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lists(df):
    return {r.src: r.neighbors for r in adjacency(df).collect()}


def pairs(df):
    return {(r.i, r.j) for r in df.collect()}


def test_brute_force_graph(spark):
    p = vecs(spark, [(1, 0), (-1, 0), (0.5, 0.5), (0.4, 0.6), (-0.1, 1)])
    assert lists(knn_graph(p, 2)) == {0: [2, 3], 1: [4, 3], 2: [3, 0], 3: [2, 4], 4: [3, 2]}
    assert knn_graph(p.limit(1), 2).count() == 0
    assert knn_graph(p.where("false"), 2).count() == 0


@pytest.mark.parametrize("k, want", [(1, [0]), (2, [0, 4]), (5, [0, 4, 2, 3, 1]), (10, [0, 4, 2, 3, 1])])
def test_brute_force_query(spark, k, want):
    p = vecs(spark, [(1, 0), (-1, -1), (1, 0.15), (1, 0.2), (1, -0.1)])
    q = vecs(spark, [(1, 0)])
    assert lists(knn(q, p, k))[0] == want
    assert lists(Index("angular", 2, tables=4).fit(p).search(q, k))[0] == want


def test_no_neighbours_asked_for(spark):
    p = vecs(spark, [(1, 0), (0, 1)])
    assert Index("angular", 2, tables=4).fit(p).search(p, 0).count() == 0
    assert build_graph("angular", p, 0).count() == 0


def hashes(spark, codes, **more):
    names = "table_id int, id long, h long" + "".join(f", {k} {'boolean' if k == 'frozen' else 'int' if k == 'len' else 'long'}" for k in more)
    return spark.createDataFrame([(0, i, h, *(v[i] for v in more.values())) for i, h in enumerate(codes)], names)


def test_block_pairs(spark):
    h = hashes(spark, [0b0100, 0b1111, 0b0000, 0b0110, 0b0001], sk=[0, 4, 6, 6, 4], thr=[1] * 5)
    assert pairs(C.block_pairs(h, 2, 4)) == {(0, 3), (2, 4)}
    assert pairs(C.block_pairs(h, 2, 4, sketched=True)) == {(2, 4)}
    assert pairs(C.block_pairs(h, 8, 4)) == set()


def test_bucket_pairs(spark):
    h = hashes(spark, [1, 3, 0, 1, 0, 1], sk=[0, 4, 6, 6, 4, 2], thr=[1] * 6)
    assert pairs(C.bucket_pairs(h)) == {(0, 3), (0, 5), (3, 5), (2, 4)}
    assert pairs(C.bucket_pairs(h, sketched=True)) == {(0, 5), (3, 5), (2, 4)}
    frozen = hashes(spark, [1, 3, 0, 1, 0, 1], frozen=[True, False, False, True, False, False])
    assert pairs(C.bucket_pairs(frozen)) == {(0, 5), (3, 5), (2, 4)}
    assert pairs(C.bucket_pairs(frozen, keep_frozen=False)) == {(2, 4)}


def test_varying_pairs(spark):
    h = hashes(spark, [1, 3, 0, 1, 0], len=[2, 2, 1, 1, 2], sk=[0, 7, 3, 1, 2], thr=[1] * 5)
    assert pairs(C.varying_pairs(h, 2)) == {(0, 2), (0, 3), (2, 3), (2, 4)}
    assert pairs(C.varying_pairs(h, 2, sketched=True)) == {(0, 3), (2, 3), (2, 4)}


def test_projection_pairs(spark):
    h = hashes(spark, [0b010, 0b110, 0b001, 0b010, 0b000], sk=[0, 7, 3, 1, 2], thr=[1] * 5)
    assert pairs(C.projection_pairs(h, {0: [4, -0.5, 1]}, 2)) == {(0, 3), (1, 4)}
    assert pairs(C.projection_pairs(h, {0: [4, -0.5, 1]}, 2, sketched=True)) == {(0, 3)}


def test_bounded_pairs(spark):
    h = hashes(spark, [0, 0, 1, 2, 3, 3])
    # at most 2 rows: 0 and 0 share all bits, 1 is alone with two bits, 2, 3, 3 need two bits
    assert pairs(C.bounded_pairs(h, 2, 2)) == {(0, 1), (4, 5)}
    assert len(pairs(C.bounded_pairs(h, 6, 2))) == 15


def test_descent_round(spark):
    edges = [(0, 1), (0, 2), (1, 3), (3, 4)]
    e = spark.createDataFrame([x for a, b in edges for x in ((a, b), (b, a))], "src long, dst long")
    around = pairs(C.descent_pairs(e, 5)) | {(a, b) for a, b in edges}
    assert around == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (1, 4), (3, 4)}


@pytest.mark.parametrize("k, rows, want", [(2, [(100, 1), (50, 2), (105, 3)], [105, 50]), (2, [(1, 1), (2, 5), (3, -3), (4, 0), (5, 5), (6, 9), (7, 7), (8, 8)], [6, 8]), (2, [(1, 1)] * 3, [1]), (0, [(1, 1)], []), (3, [(1, 5), (2, 5), (3, 4)], [2, 1, 3])])
def test_top_k(spark, k, rows, want):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in rows], "src long, dst long, sim double")
    assert [r.dst for r in topk(df, k).orderBy("rank").collect()] == want


def test_scalars(spark):
    arr = lambda *x: F.lit([float(v) for v in x])
    assert value(spark, V.normalize(arr(3, -4, 0))) == [0.6, -0.8, 0]
    assert value(spark, V.normalize(arr(0, 0))) == [0, 0]
    assert value(spark, V.q15_encode(arr(0.99999, 1, -1, 0, 0.5, -0.5))) == [32767, 32767, -32768, 0, 16384, -16384]
    assert value(spark, V.q15_decode(F.lit([0, 0x4000, -0x6000, -0x8000, 0x7FFF]))) == [0, 0.5, -0.75, -1, 32767 / 32768]
    one = F.lit([32767] + [0] * 3)
    assert value(spark, V.q15_dot(one, one)) == 32766
    big = F.lit([-32768, 0])
    assert value(spark, V.q15_dot(big, big)) == 32768 and value(spark, V.q15_dot(big, big, True)) == -32768
    for a, b, want in [([], [], 0), ([1, 2, 3], [1, 2, 3], 1), ([1, 2, 3], [3, 4, 5], 1 / 5), ([1], [1, 2, 3, 4, 5, 6], 1 / 6), ([1, 2, 3], [4, 5, 6], 0), ([1, 5, 7], [1, 2, 3, 4, 5, 6], 2 / 7)]:
        got = value(spark, V.jaccard(F.lit(a).cast("array<int>") if a else F.array().cast("array<int>"), F.lit(b).cast("array<int>") if b else F.array().cast("array<int>")))
        assert got == pytest.approx(want)
    assert value(spark, V.sim_l2(arr(0, 0.3), arr(0, 0))) == pytest.approx(1 / 1.09)
    assert value(spark, V.text_to_set(F.lit("3 1 3 2"))) == [1, 2, 3]
    assert value(spark, V.text_to_bits(F.lit("0 1 1"))) == [False, True, True]
    assert [value(spark, F.struct(*B.index_pair(F.lit(i)))) for i in range(5)] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2)]
    assert [value(spark, B.gray_to_binary(F.lit(i ^ (i >> 1)))) for i in range(40)] == list(range(40))
    assert B.ceil_log2(100) == 7
    assert [value(spark, P.minhash_p(F.lit(s), 100, 7)) for s in (0.0, 0.5, 1.0)] == pytest.approx([0, 0.5, 1])


def test_families(spark):
    assert [f.bits for f in (FHTCrossPolytope(100), CrossPolytope(100), SimHash(100), MinHash(100), MinHash(100, one_bit=True))] == [8, 8, 1, 7, 1]
    assert Tensor(5, 8).pairs() == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2)]
    x = np.random.default_rng(1).normal(size=(3, 16))
    naive = x @ np.array([[(-1) ** (i & j).bit_count() for j in range(16)] for i in range(16)])
    assert np.allclose(hadamard(x), naive)


def test_collision_calibration():
    """SimHash and MinHash collide as often as their formulas say."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(400, 32))
    b = a + rng.normal(size=a.shape)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    f = SimHash(32, 5)
    params = f.draw(500)
    want = (1 - np.arccos((a * b).sum(axis=1)) / math.pi).mean()
    assert abs((f.apply(a, params) == f.apply(b, params)).mean() - want) < 0.02
    m = MinHash(100, 5)
    # linear hashes are only nearly min-wise independent: averaged over sets
    draws = [rng.permutation(100)[:30] for _ in range(40)]
    codes = [m.apply([d[:20], d[10:]], m.draw(500)) for d in draws]
    assert abs(np.mean([(c[0] == c[1]).mean() for c in codes]) - 1 / 3) < 0.03
    est = cross_polytope_estimates(16, 200, 0.1)
    assert est[0, 0] == 1 and est[5, 10] == 1 and est[5, 2] < est[5, 8]


def unit(spark, n=500, dim=100, seed=7):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return vecs(spark, x / np.linalg.norm(x, axis=1, keepdims=True))


@pytest.mark.parametrize("method, options", [("varying_repetitions", {"recall": 0.5, "initial_hash_length": 10}), ("varying_repetitions", {"recall": 0.5, "initial_hash_length": 10, "keep_points": False, "use_sketching": False}), ("plain", {"recall": 0.5, "hash_length": 7}), ("fixed_buckets", {"repetitions": 64, "hash_length": 16}), ("bounded_buckets", {"repetitions": 48, "hash_length": 12, "bucket_size": 48}), ("projection", {"repetitions": 64, "hash_length": 16, "block_size": 24}), ("nndescent", {"repetitions": 4}), ("equal_failure_prob", {"success_prob": 0.2, "hash_length": 16})])
def test_graph_recall(spark, method, options):
    p = unit(spark, 300).cache()
    exact, approx = knn_graph(p, 10), build_graph("angular", p, 10, method, **options)
    rows = approx.collect()
    assert all(r.src != r.dst for r in rows) and len({(r.src, r.dst) for r in rows}) == len(rows)
    assert E.set_recall(exact, approx, 10).agg(F.avg("recall")).first()[0] > 0.5


@pytest.mark.parametrize("source", ["pool", "independent", "tensor"])
def test_index_recall(spark, source):
    p = unit(spark, 400, 20).cache()
    q = p.where("id < 40")
    found = Index("angular", 20, tables=24, hash_source=source).fit(p).search(q, 5, 0.8)
    assert E.set_recall(knn(q, p, 5), found, 5).agg(F.avg("recall")).first()[0] >= 0.75
    assert {len(r.ids) for r in search_ids(found).collect()} == {5}


def test_bad_options(spark):
    p = vecs(spark, [(1, 0), (0, 1)])
    for bad in (lambda: build_graph("euclidean", p, 1), lambda: build_graph("angular", p, 1, "none"), lambda: build_graph("angular", p, 1, "plain", hash_function="simhash"), lambda: Index("hamming", 2), lambda: Index("angular", 2, hash_source="x"), lambda: tables_for_memory(10, 10, 10), lambda: instantiate("x")):
        with pytest.raises(ValueError):
            bad()


def test_codes_do_not_depend_on_partitions(spark):
    p = unit(spark, 50, 16)
    one = {(r.table_id, r.id, r.h) for r in hash_codes(p, SimHash(16), Pool(3, 8, 20)).collect()}
    assert one == {(r.table_id, r.id, r.h) for r in hash_codes(p.repartition(7), SimHash(16), Pool(3, 8, 20)).collect()}
    assert max(h for _, _, h in one) < 256
    assert len({t for t, _, _ in {(r.table_id, r.id, r.h) for r in hash_codes(p, SimHash(16), Independent(3, 8)).collect()}}) == 3


@pytest.mark.parametrize("name", ["bruteforce", "hamming-rank", "ivf", "rp-forest", "lsh-index", "dummy", "nndescent"])
def test_adapters(spark, name):
    p = unit(spark, 150, 16)
    options = {"hamming-rank": {"dim": 16}, "rp-forest": {"dim": 16}, "lsh-index": {"dim": 16, "tables": 16}, "ivf": {"n_list": 4, "n_probe": 2}, "nndescent": {"repetitions": 1}}.get(name, {})
    got = instantiate(name, **options).fit(p).query(p.where("id < 10"), 3).collect()
    assert {r.src for r in got} == set(range(10)) and max(r["rank"] for r in got) <= 3


def test_metrics(spark):
    truth = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.25)], "qid long, rank int, distance double")
    for found, want in [([0.2, 0.3], 0.5), ([0.2], 0.5), ([0.2, 0.25], 1.0)]:
        f = spark.createDataFrame([(0, 0, d) for d in found], "run_id long, qid long, distance double")
        assert E.recall_knn(f, truth, 2, 1).first().recall == want
    truth = spark.createDataFrame([(0, i + 1, d) for i, d in enumerate([0.05, 0.08, 0.24, 0.3])], "qid long, rank int, distance double")
    f = spark.createDataFrame([(0, 0, d) for d in [0.1, 0.2, 0.55, 0.7]], "run_id long, qid long, distance double")
    assert [E.epsilon_recall(f, truth, 4, 1, e).first().recall for e in (1e-4, 1, 2)] == [0.5, 0.75, 1.0]
    truth = spark.createDataFrame([(0, 1, d) for d in [0.1, 0.2, 0.25, 0.3]], "qid long, rank int, distance double")
    f = spark.createDataFrame([(0, 0, d) for d in [0.1, 0.2, 0.55, 0.9]], "run_id long, qid long, distance double")
    assert E.relative_error(f, truth).first().error == pytest.approx(1.75 / 0.85)
