"""Searches inside groups shuffle rows, not pairs of rows; groups in blocks give the same as whole ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecspark.operators import graph as G
from vecspark.operators import grouped
from vecspark.operators.adapters import IVF
from vecspark.operators.knn import graph_of, knn, knn_graph, score_pairs, topk
from vecspark.plans import catalog

SF = "/root/testdata/sf0.1"
N = 2000


def shuffled(spark, run) -> int:
    """Rows that the stages of run() write for others."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    listed = lambda: store.stageList(jvm.java.util.ArrayList(), False, False, getattr(store, "stageList$default$4")(), jvm.java.util.ArrayList())
    written = lambda: (lambda s: sum(s.apply(i).shuffleWriteRecords() for i in range(s.size())))(listed())
    before = written()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return written() - before


def one_bucket(spark, sf_dir):
    return catalog.points(spark, sf_dir).select(F.lit(0).alias("table_id"), "id", F.lit(0).cast("long").alias("h"))


def rows_of(df):
    return {tuple(r) for r in df.select("src", "dst", F.round("sim", 6), "rank").collect()}


@pytest.mark.parametrize("name", ["lsh_bucket_topk", "set_recall", "sampled_recall"])
def test_bucket_queries_shuffle_rows_not_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(catalog, "codes", one_bucket)
    assert shuffled(spark, lambda: catalog.QUERIES[name](spark, SF).collect()) < 100 * N  # there are N * N / 2 pairs


def test_one_bucket_is_the_exact_graph(spark, monkeypatch):
    monkeypatch.setattr(catalog, "codes", one_bucket)
    monkeypatch.setattr(grouped, "ROWS", 600)
    monkeypatch.setattr(grouped, "CELLS", 5000)
    assert rows_of(catalog.QUERIES["lsh_bucket_topk"](spark, SF)) == rows_of(catalog.edges_out(knn_graph(catalog.points(spark, SF), catalog.K)))


def test_copies_are_ranked_by_id(spark):
    p = spark.createDataFrame([(i, [1.0, 2.0] if i < 40 else [float(i), 1.0]) for i in range(60)], "id long, vec array<float>").cache()
    h = p.select(F.lit(0).alias("table_id"), "id", F.lit(0).cast("long").alias("h"))
    assert rows_of(topk(grouped.bucket_topk(h, p, 7), 7)) == rows_of(knn_graph(p, 7))


def test_best_counts_nan_as_largest():
    s = np.array([[0.1, np.nan, 0.3, 0.2], [0.0, 0.5, 0.5, -1.0]])
    rows, cols, _ = grouped.best(s, 2)
    assert list(zip(rows.tolist(), cols.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_cells_shuffle_rows_not_pairs(spark):
    p = catalog.points(spark, SF)
    one = lambda: IVF(n_probe=1, centers=[[0.0] * catalog.DIM]).fit(p).query(p, catalog.K)
    assert rows_of(one()) == rows_of(knn(p, p, catalog.K))
    assert shuffled(spark, lambda: one().collect()) < 100 * N


def all_pairs(points):
    return points.select(F.col("id").alias("i")).crossJoin(points.select(F.col("id").alias("j"))).where("i < j")


@pytest.mark.parametrize("sketched", [False, True])
def test_varying_lengths_give_the_best_of_their_pairs(spark, monkeypatch, sketched):
    from vecspark.operators import candidates as C

    monkeypatch.setattr(grouped, "ROWS", 100)
    p = catalog.points(spark, SF).limit(400).cache()
    h = G._codes(p, catalog.DIM, 3, 6, 5).withColumn("len", (F.col("id") % 5).cast("int"))
    if sketched:
        h = G._with_sketches(h, p, catalog.DIM, 6, None, 7).withColumn("thr", (26 + F.col("id") % 9).cast("int"))
    h = h.cache()
    want = graph_of(score_pairs(C.varying_pairs(h, 6, sketched), p), 5)
    assert rows_of(topk(G._varying_topk(h, p, 5, 6, sketched), 5)) == rows_of(want)


@pytest.mark.parametrize("method, options", [("plain", {"hash_length": 1, "recall": 0.5}), ("varying_repetitions", {"initial_hash_length": 1, "recall": 0.5}), ("equal_failure_prob", {"hash_length": 2, "success_prob": 0.4})])
def test_builders_shuffle_rows_not_pairs(spark, method, options):
    p = catalog.points(spark, SF).cache()
    assert shuffled(spark, lambda: G.build_graph("angular", p, 5, method, **options).collect()) < 800 * N


def brute(sets: dict, asked, k: int):
    out = set()
    for i in asked:
        sims = sorted(((len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])), j) for j in sets), reverse=True)
        out |= {(i, j, round(v, 6), r + 1) for r, (v, j) in enumerate(sims[:k]) if v > 0}
    return out


def random_sets(spark, n=300, universe=60):
    rng = np.random.default_rng(4)
    sets = {i: set(rng.integers(0, universe, size=rng.integers(0, 12)).tolist()) for i in range(n)}
    return sets, spark.createDataFrame([(i, sorted(t)) for i, t in sets.items()], "id long, tokens array<long>").cache()


def test_set_search_in_blocks(spark, monkeypatch):
    from vecspark.operators.index import Index

    for name, value in (("QUERY_TOKENS", 200), ("POINT_TOKENS", 150), ("MATCHES", 50), ("CELLS", 300)):
        monkeypatch.setattr(grouped, name, value)
    sets, df = random_sets(spark)
    index = Index("jaccard", 60).insert(df)
    asked = df.where("id % 7 = 0")
    assert rows_of(index._exact(asked, 6)) == brute(sets, [i for i in sets if i % 7 == 0], 6)
    pairs = spark.range(300).where("id % 7 = 0").select(F.col("id").alias("src"), ((F.col("id") * 31 + 5) % 300).alias("dst"))
    want = {(i, (i * 31 + 5) % 300) for i in range(0, 300, 7)}
    want = {(i, j, round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6)) for i, j in want if sets[i] & sets[j]}
    assert {(r.src, r.dst, round(r.sim, 6)) for r in index._score(pairs, df, 6).collect()} == want


def test_set_search_shuffles_sets_not_pairs(spark):
    from vecspark.operators.index import Index

    df = spark.range(3000).select("id", F.array(F.lit(1).cast("long"), (F.col("id") + 2)).alias("tokens")).cache()
    assert shuffled(spark, lambda: Index("jaccard", 4000).insert(df)._exact(df, 5).collect()) < 100_000  # 9,000,000 pairs


def test_depths_shuffle_codes_not_pairs(spark):
    from vecspark.operators.index import depth_histogram

    c = spark.range(3000).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("table_id"), "id").withColumn("h", F.pmod(F.xxhash64("table_id", "id"), F.lit(32))).cache()
    assert shuffled(spark, lambda: depth_histogram(c, c, 6).collect()) < 100_000  # 9,000,000 pairs


def test_equal_sets_are_compared_once(spark, monkeypatch):
    from vecspark.operators import knn as knn_module

    sets, df = random_sets(spark, 200, 8)
    want = {(i, j, round(len(a & b) / len(a | b), 6)) for i, a in sets.items() for j, b in sets.items() if i < j and a | b and len(a & b) >= 0.6 * len(a | b)}
    monkeypatch.setattr(knn_module, "MEMBERS", 3)
    got = [(r.i, r.j, round(r.sim, 6)) for r in knn_module.jaccard_pairs(df, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.undo()
    copies = spark.range(2000).select("id", F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("tokens")).cache()
    assert shuffled(spark, lambda: knn_module.jaccard_pairs(copies, 0.8).count()) < 20_000  # 1,999,000 pairs


def test_varying_pairs_meet_once(spark):
    from vecspark.operators import candidates as C

    p = catalog.points(spark, SF).limit(300)
    h = G._codes(p, catalog.DIM, 4, 6, 5).withColumn("len", (F.col("id") % 4 + F.col("table_id") % 2).cast("int"))
    h = h.where("id % 11 > 0 or table_id <> 1").cache()
    rows = h.collect()
    want = set()
    for a in rows:
        for b in rows:
            if a.table_id == b.table_id and a.h >> (6 - a.len) == b.h >> (6 - a.len) and (b.h, b.id) > (a.h, a.id):
                want.add((min(a.id, b.id), max(a.id, b.id)))
    got = [tuple(r) for r in C.varying_pairs(h, 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert shuffled(spark, lambda: C.varying_pairs(h, 6).count()) < len(want)


def test_descent_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(G.C, "descent_pairs", lambda *a: pytest.fail("pairs as rows"))
    p = catalog.points(spark, SF).limit(300).cache()
    assert G.nndescent(p, 5, repetitions=1).count() == 5 * 300


def test_depths_of_ids_with_any_codes(spark, monkeypatch):
    from vecspark.operators.index import depth_histogram

    rng = np.random.default_rng(8)
    rows = [(t, i, int(h)) for i in range(120) for t in (3, 0, 7) for h in rng.integers(0, 32, size=1 if i < 60 else rng.integers(0, 4))]
    rows += [(t, None, t) for t in (0, 3)] + [(t, i, 9) for i in range(200, 260) for t in (0, 3, 7)] + [(11, 5, 2), (0, 7, None)]
    df = spark.createDataFrame(rows, "table_id int, id long, h long").cache()
    best = {}
    for t, i, a in rows:
        for u, j, b in rows:
            if t == u and i is not None and i % 4 == 0 and None not in (a, b) and (a ^ b) < 16:
                best[i, j] = max(best.get((i, j), 0), 5 - (a ^ b).bit_length())
    want = {}
    for (i, _), d in best.items():
        want[i, d] = want.get((i, d), 0) + 1
    want = {(i, d, n, sum(m for (j, e), m in want.items() if j == i and e >= d)) for (i, d), n in want.items()}
    for cells, least in ((1 << 16, 1 << 25), (7, 100)):
        monkeypatch.setattr(grouped, "DEPTH_CELLS", cells, raising=False)
        monkeypatch.setattr(grouped, "LEAST_PAIRS", least, raising=False)
        got = [tuple(r) for r in depth_histogram(df.where("id % 4 = 0"), df, 5).select("src", "depth", "count", "deeper").collect()]
        assert len(got) == len(want) and set(got) == want


def test_copies_are_compared_once(spark, monkeypatch):
    from vecspark.operators.index import depth_histogram

    monkeypatch.setattr(grouped, "LEAST_PAIRS", 1 << 12, raising=False)
    monkeypatch.setattr(grouped, "MOST_PAIRS", 1 << 16, raising=False)
    c = spark.range(60_000).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("table_id"), "id").withColumn("h", F.pmod(F.xxhash64("table_id", F.col("id") % 50), F.lit(32))).cache()
    seen = []
    sent = type(c).repartitionById
    monkeypatch.setattr(type(c), "repartitionById", lambda self, n, col: seen.append(self.count()) or sent(self, n, col))
    out = depth_histogram(c.where("id % 20 = 0"), c, 5)
    assert out.groupBy("src").agg(F.max("deeper").alias("n")).where("n >= 1200").count() == 3000
    assert seen and seen[0] < 60_000  # 3,000 queries and 50 codes, some of them sent to several tasks
