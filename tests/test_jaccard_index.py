"""lsh_index_search_sets against exact Jaccard search over whole baskets."""

from collections import defaultdict

import pytest
from vecspark.plans import catalog

SF = "/root/testdata/sf0.01"


def test_set_search_is_over_whole_baskets(spark):
    sets = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect():
        sets[r.l_suppkey].add(r.l_partkey)
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    found = defaultdict(list)
    for r in catalog.QUERIES["lsh_index_search_sets"](spark, SF).collect():
        assert r.sim == pytest.approx(sim(r.src, r.dst), abs=1e-6)
        found[r.src].append(r.sim)
    asked = [i for i in sets if i % 20 == 0]
    assert set(found) == set(asked)
    hits = 0
    for i in asked:
        kth = sorted((sim(i, j) for j in sets), reverse=True)[catalog.K - 1]
        hits += sum(s >= kth - 1e-6 for s in found[i])
    assert hits >= 0.9 * catalog.K * len(asked)
