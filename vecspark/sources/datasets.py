"""Benchmark datasets: text and binary readers, generators, transforms, splits with exact ground truth."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import vectors as V
from ..operators.knn import knn


def read_glove(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Lines `word f1 .. fd` as (word, vec)."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("value != ''").select(parts[0].alias("word"), F.transform(F.slice(parts, 2, dim), lambda x: x.cast("float")).alias("vec"))


def read_word2bits(spark: SparkSession, path: str) -> DataFrame:
    """A header `n k`, then lines `word f1 .. fk`; bits are signs."""
    lines = spark.read.text(path).withColumn("p", F.split(F.trim("value"), " +")).where(F.size("p") > 2)
    return lines.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, 1 << 20), lambda x: x.cast("float") > 0).alias("bits"))


def read_bit_strings(spark: SparkSession, path: str, size: int = 256) -> DataFrame:
    """Lines of 0 and 1 as packed words w0 .."""
    lines = spark.read.text(path).select(F.transform(F.split(F.trim("value"), ""), lambda c: c == "1").alias("bits")).where(F.size("bits") >= size)
    return lines.select("bits", *(B.pack(F.col("bits"), w, size).alias(f"w{w}") for w in range(-(-size // 64))))


def read_exact(spark: SparkSession, path: str) -> DataFrame:
    """Files of k ids a line, the line being the query: (line, neighbors). Each file is one split, so lines keep their numbers."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n")).alias("line", "value")).withColumn("line", F.col("line").cast("long"))
    return lines.select("line", F.transform(F.split(F.trim("value"), " +"), lambda x: x.cast("long")).alias("neighbors"))


def _binary(spark: SparkSession, path: str, parse: Callable[[bytes], np.ndarray], column: str = "vec") -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                m = parse(content.as_py())
                for at in range(0, len(m), 4096):
                    part = np.ascontiguousarray(m[at : at + 4096], np.float32)
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array(np.arange(at, at + len(part))), pa.ListArray.from_arrays(offsets, pa.array(part.reshape(-1)))], names=["file", "row", column])

    return files.mapInArrow(run, f"file string, row long, {column} array<float>")


def parse_fvecs(content: bytes) -> np.ndarray:
    """Each row: its length as int32, then so many float32."""
    if not content:
        return np.empty((0, 0), np.float32)
    dim = int(np.frombuffer(content, "<i4", 1)[0])
    return np.frombuffer(content, "<f4").reshape(-1, dim + 1)[:, 1:]


#: Fixed values of the IDX format: element types.
IDX_TYPES = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}


def parse_idx(content: bytes) -> np.ndarray:
    """Big-endian IDX, gzipped or not; rows are flattened."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    kind, dims = IDX_TYPES[raw[2]], raw[3]
    shape = [int(x) for x in np.frombuffer(raw, ">i4", dims, 4)]
    return np.frombuffer(raw, kind, -1, 4 + 4 * dims).reshape(shape[0], -1)


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_fvecs)


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_idx)


def read_docword(spark: SparkSession, path: str) -> DataFrame:
    """Bag of words `doc word count`, after three header lines of one number: (doc, word, tf)."""
    p = F.split(F.trim("value"), " +")
    return spark.read.text(path).where(F.size(p) == 3).select(p[0].cast("long").alias("doc"), p[1].cast("long").alias("word"), p[2].cast("double").alias("tf"))


def tfidf(terms: DataFrame, n_docs: int) -> DataFrame:
    """(doc, word, weight): tf * (ln((1 + n) / (1 + df)) + 1), rows of unit length."""
    df = terms.groupBy("word").agg(F.count("*").alias("df"))
    raw = terms.join(df, "word").withColumn("w", F.col("tf") * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1))
    length = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, "doc").select("doc", "word", (F.col("w") / F.col("len")).alias("weight"))


def gaussian_projection(weights: DataFrame, params: DataFrame) -> DataFrame:
    """(doc, axis, value) of (doc, word, weight) and parameters (word, axis, r)."""
    return weights.join(params, "word").groupBy("doc", "axis").agg(F.sum(F.col("weight") * F.col("r")).alias("value"))


def blobs(spark: SparkSession, n: int, dim: int, centers: int = 10, seed: int = 41) -> DataFrame:
    """Gaussian blobs (id, vec): the centre is drawn for each row, its place from the centre's number."""
    c = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(centers))
    place = lambda i: (F.pmod(F.xxhash64("c", i, F.lit(seed + 1)), F.lit(2001)) - 1000) / 100.0
    unit = lambda i, s: (F.shiftrightunsigned(F.xxhash64("id", i, F.lit(s)), 11).cast("double") + 0.5) / float(1 << 53)
    noise = lambda i: F.sqrt(-2 * F.log(unit(i, seed + 2))) * F.cos(2 * np.pi * unit(i, seed + 3))
    return spark.range(n).withColumn("c", c).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (place(i) + noise(i)).cast("float")).alias("vec"))


def random_unit(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    return blobs(spark, n, dim, 1, seed).select("id", V.normalize(F.transform("vec", lambda x: x)).alias("vec"))


def random_sets(spark: SparkSession, n: int, universe: int, share: float = 0.3, seed: int = 43) -> DataFrame:
    """(id, tokens): each token below universe with the given chance."""
    keep = lambda t: F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return spark.range(n).select("id", F.filter(F.sequence(F.lit(0), F.lit(universe - 1)), keep).alias("tokens"))


def sign_bits(df: DataFrame) -> DataFrame:
    return df.select("id", F.transform("vec", lambda x: x > 0).alias("bits"))


def mips_augment(df: DataFrame, largest: float | None = None) -> DataFrame:
    """Appends sqrt(max norm ** 2 - norm ** 2), so that inner products become cosines; queries get 0 appended."""
    sq = F.aggregate(V.doubles(F.col("vec")), F.lit(0.0), lambda a, x: a + x * x)
    if largest is None:
        top = df.agg(F.max(sq).alias("_top"))
        df = df.crossJoin(F.broadcast(top))  # one row
        extra = F.sqrt(F.greatest(F.col("_top") - sq, F.lit(0.0)))
    else:
        extra = F.sqrt(F.greatest(F.lit(largest) - sq, F.lit(0.0)))
    return df.select("id", F.concat(V.doubles(F.col("vec")), F.array(extra)).alias("vec"))


def bm25(ratings: DataFrame, k1: float = 100.0, b: float = 0.8) -> DataFrame:
    """BM25 weights (user, item, rating) of (user, item, count). Items are the documents and users the terms.

    A user with nearly all items has a weight of zero or below, which implicit ALS takes as no preference.
    """
    lengths = ratings.groupBy("item").agg(F.sum("count").alias("len"))
    total = lengths.agg(F.avg("len").alias("mean"), F.count("*").cast("double").alias("n"))
    df = ratings.groupBy("user").agg(F.count("*").alias("df"))
    norm = (1 - b) + b * F.col("len") / F.col("mean")
    w = F.col("count") * (k1 + 1) / (k1 * norm + F.col("count")) * F.log(F.col("n") / (1 + F.col("df")))
    # total is one row
    return ratings.join(lengths, "item").join(df, "user").crossJoin(F.broadcast(total)).select("user", "item", w.alias("rating"))


def factors(ratings: DataFrame, dim: int, seed: int = 44, k1: float = 100.0, b: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Implicit ALS factors of users and items after BM25 weights, from (user, item, count)."""
    from pyspark.ml.recommendation import ALS

    model = ALS(rank=dim, implicitPrefs=True, userCol="user", itemCol="item", ratingCol="rating", seed=seed).fit(bm25(ratings, k1, b))
    return model.userFactors.withColumnRenamed("features", "vec"), model.itemFactors.withColumnRenamed("features", "vec")


def train_test_split(df: DataFrame, test_size: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(train, test): the test rows are the first by the md5 of seed and id, whatever the partitioning."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    test = df.withColumn("_k", key).orderBy("_k", "id").limit(test_size).drop("_k")
    return df.join(test.select("id"), "id", "left_anti"), test


def ground_truth(train: DataFrame, test: DataFrame, count: int = 100, metric: str = "angular") -> DataFrame:
    """(src, dst, sim, rank) of each test row's nearest train rows."""
    return knn(test, train, count, metric)


def write_dataset(train: DataFrame, test: DataFrame, folder: str, metric: str, count: int = 100) -> None:
    train.write.mode("overwrite").parquet(f"{folder}/train")
    test.write.mode("overwrite").parquet(f"{folder}/test")
    ground_truth(train, test, count, metric).write.mode("overwrite").parquet(f"{folder}/neighbors")
    train.sparkSession.createDataFrame([(metric, count)], "distance string, count int").write.mode("overwrite").parquet(f"{folder}/properties")


def read_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}") for t in ("train", "test", "neighbors", "properties")}


#: Named datasets: reader or generator, distance. Readers take (spark, path), generators (spark).
DATASETS: dict[str, tuple[Callable[..., DataFrame], str]] = {
    **{f"glove-{d}-angular": (lambda spark, path, d=d: read_glove(spark, path, d), "angular") for d in (25, 50, 100, 200)},
    "glove-2m-300-angular": (lambda spark, path: read_glove(spark, path, 300), "angular"),
    "fashion-mnist-784-euclidean": (read_idx, "euclidean"),
    "mnist-784-euclidean": (read_idx, "euclidean"),
    "sift-128-euclidean": (read_fvecs, "euclidean"),
    "gist-960-euclidean": (read_fvecs, "euclidean"),
    "nytimes-256-angular": (read_docword, "angular"),
    "nytimes-16-angular": (read_docword, "angular"),
    "word2bits-800-hamming": (read_word2bits, "hamming"),
    "sift-256-hamming": (read_bit_strings, "hamming"),
    "random-xs-20-euclidean": (lambda spark: blobs(spark, 10000, 20, 100), "euclidean"),
    "random-s-100-euclidean": (lambda spark: blobs(spark, 100000, 100, 1000), "euclidean"),
    "random-xs-20-angular": (lambda spark: blobs(spark, 10000, 20, 100), "angular"),
    "random-s-100-angular": (lambda spark: blobs(spark, 100000, 100, 1000), "angular"),
    "random-xs-16-hamming": (lambda spark: sign_bits(blobs(spark, 10000, 16)), "hamming"),
    "random-s-128-hamming": (lambda spark: sign_bits(blobs(spark, 50000, 128)), "hamming"),
    "random-l-256-hamming": (lambda spark: sign_bits(blobs(spark, 100000, 256)), "hamming"),
    "lastfm-64-dot": (lambda spark, path: mips_augment(factors(spark.read.parquet(path), 64)[1]), "angular"),
}


def windowed_rank(df: DataFrame) -> DataFrame:
    """(qid, rank, distance) of (qid, distance), nearest first."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance")))
