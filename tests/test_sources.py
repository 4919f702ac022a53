import math
"""Readers, generators, the result store, runs and the stream."""

import gzip
import struct

import numpy as np
from pyspark.sql import functions as F
from vecspark.operators.evaluate import padded
from vecspark.operators.hashing import Independent, SimHash, hash_codes
from vecspark.operators.runner import run
from vecspark.sources import datasets as D
from vecspark.sources import results as R
from vecspark.streaming.incremental import append_codes, read_codes


def test_text_readers(spark, tmp_path):
    (tmp_path / "glove.txt").write_text("the 0.5 -1 2\nof 1 2 3\n")
    assert [(r.word, list(r.vec)) for r in D.read_glove(spark, str(tmp_path / "glove.txt"), 3).collect()] == [("the", [0.5, -1, 2]), ("of", [1, 2, 3])]
    (tmp_path / "w2b.txt").write_text("2 3\na 1 -1 1\nb -1 -1 1\n")
    assert [r.bits for r in D.read_word2bits(spark, str(tmp_path / "w2b.txt")).collect()] == [[True, False, True], [False, False, True]]
    (tmp_path / "bits.txt").write_text("1" + "0" * 63 + "1" * 64 + "\n")
    row = D.read_bit_strings(spark, str(tmp_path / "bits.txt"), 128).first()
    assert (row.w0, row.w1) == (1, -1)
    (tmp_path / "exact.txt").write_text("1 2 3\n4 5 6\n")
    assert [r.neighbors for r in D.read_exact(spark, str(tmp_path / "exact.txt")).orderBy("line").collect()] == [[1, 2, 3], [4, 5, 6]]
    (tmp_path / "docword.txt").write_text("2\n3\n4\n1 1 2\n1 2 1\n2 1 1\n")
    terms = D.read_docword(spark, str(tmp_path / "docword.txt"))
    assert terms.count() == 3
    lengths = D.tfidf(terms, 2).groupBy("doc").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in lengths)


def test_binary_readers(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<i", 4) + r.tobytes() for r in m))
    got = D.read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("row").collect()
    assert [list(r.vec) for r in got] == m.tolist()
    raw = bytes([0, 0, 8, 3]) + struct.pack(">iii", 2, 2, 2) + bytes(range(8))
    (tmp_path / "b.gz").write_bytes(gzip.compress(raw))
    assert [list(r.vec) for r in D.read_idx(spark, str(tmp_path / "b.gz")).orderBy("row").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_generators_and_datasets(spark, tmp_path):
    assert len(D.DATASETS) >= 20
    b = D.blobs(spark, 200, 8, 3)
    assert b.exceptAll(D.blobs(spark, 200, 8, 3)).isEmpty()
    n = D.random_unit(spark, 50, 8).select(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-6 for r in n)
    sizes = [len(r.tokens) for r in D.random_sets(spark, 200, 100).collect()]
    assert 25 < np.mean(sizes) < 35
    train, test = D.train_test_split(b, 20)
    assert (train.count(), test.count()) == (180, 20)
    D.write_dataset(train, test, str(tmp_path / "d"), "euclidean", 5)
    assert D.read_dataset(spark, str(tmp_path / "d"))["neighbors"].count() == 100
    up = D.mips_augment(b).select(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("n")).agg(F.stddev("n")).first()[0]
    assert up < 1e-6


def test_runs_and_store(spark, tmp_path):
    p = D.random_unit(spark, 60, 8)
    out = run("bruteforce", p, p.where("id < 5"), 3, "tiny")
    R.store(out, str(tmp_path / "r"), 4)
    got = R.scan(spark, str(tmp_path / "r"), dataset="tiny", count=3)
    assert got.count() == 5 and all(len(r.neighbors) == 4 and r.neighbors[3] == -1 for r in got.collect())
    assert [r.algo for r in R.algorithms(spark, str(tmp_path / "r")).collect()] == ["bruteforce"]
    assert R.scan(spark, str(tmp_path / "r"), batch=True).count() == 0
    assert spark.range(1).select(padded(F.lit([1]), 3, -1).alias("v")).first().v == [1, -1, -1]


def test_factors(spark):
    ratings = spark.createDataFrame([(u, i, float(1 + (u * i) % 5)) for u in range(12) for i in range(8) if (u + i) % 3], "user int, item int, count double")
    users, items = D.factors(ratings, 4)
    assert users.count() == 12 and len(items.first().vec) == 4


def test_bm25(spark):
    rows = [(0, 0, 2.0), (0, 1, 4.0), (1, 0, 6.0), (2, 2, 3.0)]
    got = {(r.user, r.item): r.rating for r in D.bm25(spark.createDataFrame(rows, "user int, item int, count double")).collect()}
    of_item = {i: sum(c for _, j, c in rows if j == i) for i in range(3)}
    of_user = {u: sum(1 for v, _, _ in rows if v == u) for u in range(3)}
    for u, i, c in rows:
        norm = 0.2 + 0.8 * of_item[i] / (sum(of_item.values()) / 3)
        assert abs(got[u, i] - c * 101 / (100 * norm + c) * math.log(3 / (1 + of_user[u]))) < 1e-9


def test_stream_appends_codes(spark, tmp_path):
    p = D.random_unit(spark, 40, 8)
    family, source = SimHash(8), Independent(2, 6)
    p.where("id < 20").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long, vec array<double>").parquet(str(tmp_path / "in"))
    append_codes(stream(), str(tmp_path / "codes"), str(tmp_path / "cp"), family, source).awaitTermination()
    p.where("id >= 20").write.mode("append").parquet(str(tmp_path / "in"))
    append_codes(stream(), str(tmp_path / "codes"), str(tmp_path / "cp"), family, source).awaitTermination()
    want = {tuple(r) for r in hash_codes(p, family, source).collect()}
    assert {(r.table_id, r.id, r.h) for r in read_codes(spark, str(tmp_path / "codes")).collect()} == want
