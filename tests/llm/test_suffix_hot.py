"""A passage that stands in every document: whole results, and no task that holds its surroundings."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from test_operators import rows, suffix_brute

from vecspark.llm import suffix_dedup


def _passages(n):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    shared = " ".join(word() for _ in range(40))
    other = " ".join(word() for _ in range(20))
    out = []
    for i in range(n):
        text = " ".join([*(word() for _ in range(rng.randint(0, 6))), shared, *(word() for _ in range(rng.randint(0, 6)))])
        out.append((i if i % 9 else None, text + other[: rng.randint(0, len(other))] * (i % 3)))
    return [*out, out[1], (0, ""), (3, None), (-5, shared[10:80])]


@pytest.mark.parametrize("hot", [2, 40, suffix_dedup.HOT])
def test_hot_passage(spark, hot):
    df = spark.createDataFrame(_passages(160), "doc_id long, text string").repartition(7)
    got = sorted(map(str, map(tuple, suffix_dedup.dedup(df, hot=hot).collect())))
    assert got == sorted(map(str, suffix_brute(rows(df)).elements()))


def test_hot_passage_is_spread():
    data = [(i, t) for i, (_, t) in enumerate(_passages(1200)) if t]
    buckets = 16
    firsts = [suffix_dedup._first_round(pa.table({"batch": [b] * len(d), "key": [k for k, _ in d], "body": [t.encode() for _, t in d]}), buckets) for b in range(8) for d in [data[b::8]]]
    ranks = pa.concat_tables(firsts)
    sizes = {}
    for hot in (100, suffix_dedup.HOT):
        held = [suffix_dedup._repeated(ranks.filter(pc.equal(ranks["bucket"], b)), hot) for b in set(ranks["bucket"].to_pylist())]
        held = pa.concat_tables(held)
        load = np.zeros(buckets, np.int64)
        for b in range(8):
            d = data[b::8]
            docs = pa.table({"batch": [b] * len(d), "key": [k for k, _ in d], "body": [t.encode() for _, t in d]})
            out = suffix_dedup._second_round(docs, held.filter(pc.equal(held["batch"], b)), buckets)
            for bucket, c, w in zip(out["bucket"].to_pylist(), out["contexts"].to_pylist(), out["windows"].to_pylist(), strict=True):
                load[bucket] += len(suffix_dedup._unpacked(c, suffix_dedup.CONTEXT)) if c else 0
                load[bucket] += len(suffix_dedup._unpacked(w, suffix_dedup.HELD)) if w else 0
        sizes[hot] = load
    assert sizes[100].max() < 1.5 * sizes[100].mean()
    assert sizes[suffix_dedup.HOT].max() > 3 * sizes[suffix_dedup.HOT].mean()
