"""Registered queries over the driver's tables, with DuckDB SQL for all that SQL can express.

Hash parameters are integers drawn on the driver; the SQL gets the same numbers as VALUES.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import probability as P
from ..functions import vectors as V
from ..lineage import saved
from ..operators import candidates as C
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators.adapters import IVF, Dummy, HammingRank, tree_votes
from ..operators.grouped import bucket_topk
from ..operators.hashing import CrossPolytope, FHTCrossPolytope, Independent, MinHash, Pool, SimHash, Tensor, hadamard, hash_codes, in_batches, matrix, sketches
from ..operators.index import Index, depth_histogram
from ..operators.knn import adjacency, graph_of, jaccard_pairs, knn, knn_graph, kth_similarity, score_pairs, topk
from ..sources import datasets as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = 10
DIM = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of each customer's orders, as small integer sets: (id, tokens)."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.month("o_orderdate").cast("long").alias("t"))
    return o.groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("tokens"))


def part_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts that each supplier has delivered: (id, tokens)."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("tokens"))


def rounded(df: DataFrame, **cols) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) for c, n in cols.items()})


def ints(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


PTS = "pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)"
SETS = "sets AS (SELECT o_custkey AS id, list_sort(list(DISTINCT month(o_orderdate)::BIGINT)) AS tokens FROM orders GROUP BY 1)"
Q15 = "q15 AS (SELECT id, list_transform(vec, lambda x: least(32767, trunc(x * 32768))) AS q FROM pts)"
COS = "(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) + 1) / 2"


def cos(a: str, b: str) -> str:
    return f"round({COS.format(a=a, b=b)}, 9)"


def top_sql(source: str, k: int = K) -> str:
    """src, dst, sim, rank of rows (src, dst, sim)."""
    return f"SELECT src, dst, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst DESC) AS rank FROM (SELECT DISTINCT src, dst, sim FROM {source} WHERE sim > 0)) WHERE rank <= {k}"


def graph_sql(pairs: str, k: int = K) -> str:
    """Pairs (i, j) scored and used both ways; needs pts."""
    return f"""scored AS (SELECT p.i, p.j, {cos("a.vec", "b.vec")} AS sim FROM (SELECT DISTINCT i, j FROM {pairs}) p JOIN pts a ON a.id = p.i JOIN pts b ON b.id = p.j),
both_ways AS (SELECT i AS src, j AS dst, sim FROM scored UNION ALL SELECT j, i, sim FROM scored)
SELECT src, dst, round(sim, 6) AS sim, rank FROM ({top_sql("both_ways", k)})"""


def edges_out(df: DataFrame) -> DataFrame:
    return ints(rounded(df.select("src", "dst", "sim", "rank"), sim=6), "rank")


# ---- scalar functions


@query(f"WITH {PTS}, n AS (SELECT id, vec, sqrt(list_dot_product(vec, vec)) AS n FROM pts) SELECT id, pos - 1 AS pos, round(vec[pos] / n, 6) AS x FROM n, range(1, 65) r(pos)")
def vec_normalize(spark, sf_dir):
    df = points(spark, sf_dir).select("id", F.posexplode(V.normalize(F.col("vec"))).alias("pos", "x"))
    return ints(rounded(df, x=6), "pos")


@query(f"WITH {PTS} SELECT id, round(sqrt(list_dot_product(vec, vec)), 6) AS norm FROM pts")
def vec_norm(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.round(V.norm(F.col("vec")), 6).alias("norm"))


def _neighbours(spark, sf_dir) -> DataFrame:
    """Each point and the next: (id, a, b)."""
    p = points(spark, sf_dir)
    return p.select("id", F.col("vec").alias("a")).join(p.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b")), "id")


NEXT = f"WITH {PTS}, n AS (SELECT x.id, x.vec AS a, y.vec AS b FROM pts x JOIN pts y ON y.id = x.id + 1) "
L2 = "list_sum(list_transform(list_zip(a, b), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


@query(NEXT + "SELECT id, round(list_dot_product(a, b), 6) AS dot FROM n")
def vec_dot(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("id", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("dot"))


@query(NEXT + f"SELECT id, round({L2}, 6) AS d FROM n")
def vec_l2(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("id", F.round(V.l2_squared(F.col("a"), F.col("b")), 6).alias("d"))


@query(NEXT + f"SELECT id, round(1 / (1 + {L2}), 6) AS sim FROM n")
def vec_sim_l2(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("id", F.round(V.sim_l2(F.col("a"), F.col("b")), 6).alias("sim"))


@query(NEXT + "SELECT id, round((list_dot_product(a, b) + 1) / 2, 6) AS sim FROM n")
def vec_sim_cosine(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("id", F.round(V.sim_cosine(F.col("a"), F.col("b")), 6).alias("sim"))


@query(f"WITH {PTS}, {Q15} SELECT id, pos - 1 AS pos, q[pos]::BIGINT AS q FROM q15, range(1, 65) r(pos)")
def vec_fixed_encode(spark, sf_dir):
    return ints(points(spark, sf_dir).select("id", F.posexplode(V.q15_encode(F.col("vec"))).alias("pos", "q")), "pos", "q")


@query(f"WITH {PTS}, {Q15} SELECT id, pos - 1 AS pos, q[pos] / 32768 AS x FROM q15, range(1, 65) r(pos)")
def vec_fixed_decode(spark, sf_dir):
    return ints(points(spark, sf_dir).select("id", F.posexplode(V.q15_decode(V.q15_encode(F.col("vec")))).alias("pos", "x")), "pos")


@query(f"WITH {PTS}, {Q15}, s AS (SELECT x.id, list_sum(list_transform(list_zip(x.q, y.q), lambda t: floor((t[1] * t[2] + 16384) / 32768)))::BIGINT AS dot FROM q15 x JOIN q15 y ON y.id = x.id + 1) SELECT id, dot, ((dot + 32768 + 65536) % 65536) - 32768 AS dot_i16 FROM s")
def vec_fixed_dot(spark, sf_dir):
    n = _neighbours(spark, sf_dir).select("id", V.q15_encode(F.col("a")).alias("a"), V.q15_encode(F.col("b")).alias("b"))
    return ints(n.select("id", V.q15_dot(F.col("a"), F.col("b")).alias("dot"), V.q15_dot(F.col("a"), F.col("b"), True).alias("dot_i16")), "dot", "dot_i16")


@query(NEXT + f"SELECT id, round(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine, round(sqrt({L2}), 6) AS euclidean, round(list_sum(list_transform(list_zip(a, b), lambda t: ((t[1] > 0) <> (t[2] > 0))::INT)) / 64, 6) AS hamming FROM n")
def harness_distances(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    bits = [F.transform(x, lambda v: v > 0) for x in (a, b)]
    return rounded(_neighbours(spark, sf_dir).select("id", V.distance_cosine(a, b).alias("cosine"), V.distance_euclidean(a, b).alias("euclidean"), V.distance_hamming(*bits).alias("hamming")), cosine=6, euclidean=6, hamming=6)


@query(f"WITH {SETS}, n AS (SELECT x.id, x.tokens AS a, y.tokens AS b FROM sets x JOIN sets y ON y.id = x.id + 1), j AS (SELECT id, len(list_intersect(a, b)) AS both_n, len(a) + len(b) AS all_n FROM n), d AS (SELECT id, CASE WHEN all_n > both_n THEN both_n / (all_n - both_n) ELSE 0.0 END AS jac FROM j) SELECT id, round(jac, 6) AS sim, 1 - jac < 1 - 1e-5 AS valid FROM d")
def set_jaccard(spark, sf_dir):
    s = baskets(spark, sf_dir)
    n = s.select("id", F.col("tokens").alias("a")).join(s.select((F.col("id") - 1).alias("id"), F.col("tokens").alias("b")), "id")
    j = V.jaccard(F.col("a"), F.col("b"))
    return n.select("id", F.round(j, 6).alias("sim"), V.distance_valid(1 - j).alias("valid"))


@query("SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, xor(xor(xor(xor(v, v >> 1), (xor(v, v >> 1)) >> 2), xor(xor(v, v >> 1), (xor(v, v >> 1)) >> 2) >> 4), xor(xor(xor(v, v >> 1), (xor(v, v >> 1)) >> 2), xor(xor(v, v >> 1), (xor(v, v >> 1)) >> 2) >> 4) >> 8)::BIGINT AS code FROM (SELECT *, l_partkey & 65535 AS v FROM lineitem)")
def gray_to_binary(spark, sf_dir):
    v = F.col("l_partkey").bitwiseAND(F.lit(65535)).cast("int")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), B.gray_to_binary(v).cast("long").alias("code"))


@query("SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, list_sum(list_transform(range(0, 16), lambda i: ((l_partkey >> i) & 1) << (2 * i)))::BIGINT AS m FROM lineitem")
def morton_interleave(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), B.interleave_zero(F.col("l_partkey")).alias("m"))


@query("SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, CASE WHEN x = 0 THEN 24 ELSE 23 - floor(log2(x))::BIGINT END AS p FROM (SELECT *, xor(l_partkey, l_suppkey) AS x FROM lineitem)")
def common_prefix_len(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), B.common_prefix(F.col("l_partkey"), F.col("l_suppkey"), 24).cast("long").alias("p"))


@query("WITH s AS (SELECT o_orderkey AS i, floor(sqrt(o_orderkey))::BIGINT AS r FROM orders) SELECT i, CASE WHEN i - r * r < r THEN i - r * r ELSE r END AS lhs, CASE WHEN i - r * r < r THEN r ELSE i - r * r - r END AS rhs FROM s")
def tensor_index_pairs(spark, sf_dir):
    a, b = B.index_pair(F.col("o_orderkey"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), a.alias("lhs"), b.alias("rhs"))


@query(f"WITH {PTS}, {Q15} SELECT id, i, list_sum(list_transform(list_zip(q, range(0, 64)), lambda t: t[1] * (1 - 2 * (bit_count((i & t[2]::BIGINT)) % 2))))::BIGINT AS y FROM q15, range(0, 64) r(i)")
def fht_transform(spark, sf_dir):
    import numpy as np
    import pyarrow as pa

    def kernel(b):
        m = matrix(b.column(1))
        y = hadamard(np.minimum(np.trunc(m * 32768), 32767).astype(np.int64))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(m)), DIM))), pa.array(np.tile(np.arange(DIM), len(m))), pa.array(y.reshape(-1))], names=["id", "i", "y"])

    return in_batches(points(spark, sf_dir), kernel, "id long, i long, y long")


@query(f"WITH {PTS}, w AS (SELECT id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN vec[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS low, vec[64] > 0 AS top FROM pts) SELECT id, CASE WHEN top THEN low - 9223372036854775807 - 1 ELSE low END AS w0 FROM w")
def bits_pack(spark, sf_dir):
    return D.sign_bits(points(spark, sf_dir)).select("id", B.pack(F.col("bits"), 0, DIM).alias("w0"))


@query(f"WITH {SETS} SELECT id, array_to_string(tokens, ' ') AS line, len(tokens)::BIGINT AS n FROM sets")
def text_point_codec(spark, sf_dir):
    s = baskets(spark, sf_dir).select("id", V.point_to_text(F.col("tokens")).alias("line"))
    return s.select("id", "line", F.size(V.text_to_set(F.col("line"))).cast("long").alias("n"))


@query(f"WITH {PTS}, sq AS (SELECT id, 1.5 * vec[1] AS x, list_dot_product(vec, vec) * 2.25 * (1 + (id % 3)) AS s FROM pts) SELECT id, round(sqrt(greatest((SELECT max(s) FROM sq) - s, 0)), 6) AS extra FROM sq")
def mips_augment(spark, sf_dir):
    p = points(spark, sf_dir).select("id", F.transform(V.doubles(F.col("vec")), lambda x: x * 1.5 * F.sqrt(1 + F.col("id") % 3)).alias("vec"))
    return D.mips_augment(p).select("id", F.round(F.element_at("vec", -1), 6).alias("extra"))


@query("SELECT vec_id AS id FROM embeddings ORDER BY md5('1:' || vec_id), vec_id LIMIT 100")
def train_test_split(spark, sf_dir):
    return D.train_test_split(points(spark, sf_dir), 100)[1].select("id")


# ---- TF-IDF and projection

TERMS = "terms AS (SELECT doc_id AS doc, w AS word, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2)"
TFIDF = f"{TERMS}, idf AS (SELECT word, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM terms GROUP BY 1), raw AS (SELECT doc, word, tf * idf AS w FROM terms JOIN idf USING (word)), len AS (SELECT doc, sqrt(sum(w * w)) AS len FROM raw GROUP BY 1)"


def _tfidf(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    words = docs.select(F.col("doc_id").alias("doc"), F.explode(F.split("text", " ", -1)).alias("word")).where("word <> ''")
    terms = words.groupBy("doc", "word").agg(F.count("*").cast("double").alias("tf"))
    return D.tfidf(terms, docs.count())


@query(f"WITH {TFIDF} SELECT doc, word, round(w / len, 6) AS weight FROM raw JOIN len USING (doc)")
def tfidf_weights(spark, sf_dir):
    return rounded(_tfidf(spark, sf_dir), weight=6)


@query(f"WITH {TFIDF} SELECT doc, axis, round(sum(w / len * (((length(word) * 7919 + axis * 104729 + ascii(word) * 31) % 2001) - 1000) / 1000.0), 5) AS value FROM raw JOIN len USING (doc), range(0, 8) r(axis) GROUP BY 1, 2")
def gaussian_projection(spark, sf_dir):
    w = _tfidf(spark, sf_dir)
    code = F.ascii("word")
    r = ((F.length("word").cast("long") * 7919 + F.col("axis") * 104729 + code.cast("long") * 31) % 2001 - 1000) / 1000.0
    params = w.select("word").distinct().withColumn("axis", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).withColumn("r", r)
    return rounded(D.gaussian_projection(w, params), value=5)


# ---- exact joins

ALL_EDGES = f"edges AS (SELECT a.id AS src, b.id AS dst, {cos('a.vec', 'b.vec')} AS sim FROM pts a JOIN pts b ON a.id <> b.id)"


@query(f"WITH {PTS}, {ALL_EDGES} SELECT src, dst, round(sim, 6) AS sim, rank FROM ({top_sql('edges')})")
def exact_knn_graph(spark, sf_dir):
    return edges_out(knn_graph(points(spark, sf_dir), K))


@query(f"WITH {PTS}, {ALL_EDGES}, t AS ({top_sql('edges')}) SELECT a.src, a.dst FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_knn(spark, sf_dir):
    g = knn_graph(points(spark, sf_dir), K).select("src", "dst")
    return g.join(g.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).where("src < dst")


@query(f"WITH {PTS}, {ALL_EDGES}, t AS ({top_sql('edges')}) SELECT src, string_agg(dst, ' ' ORDER BY rank) AS neighbors FROM t GROUP BY src")
def knn_adjacency(spark, sf_dir):
    return adjacency(knn_graph(points(spark, sf_dir), K)).select("src", V.point_to_text(F.col("neighbors")).alias("neighbors"))


@query(f"WITH {PTS}, {ALL_EDGES}, t AS ({top_sql('edges')}) SELECT id, coalesce(round(sim, 6), 0) AS kth FROM pts LEFT JOIN t ON id = src AND rank = {K}")
def kth_values(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(kth_similarity(knn_graph(p, K), p, K), kth=6)


def _search_sql(sim: str) -> str:
    return f"WITH {PTS}, e AS (SELECT a.id AS src, b.id AS dst, {sim} AS sim FROM (SELECT * FROM pts WHERE id % 20 = 0) a, pts b) SELECT src, dst, round(sim, 6) AS sim, rank FROM ({top_sql('e')})"


def _asked(p: DataFrame) -> DataFrame:
    return p.where(F.col("id") % 20 == 0)


@query(_search_sql(cos("a.vec", "b.vec")))
def exact_knn_search_cosine(spark, sf_dir):
    p = points(spark, sf_dir)
    return edges_out(knn(_asked(p), p, K))


@query(_search_sql("round(1 / (1 + list_sum(list_transform(list_zip(a.vec, b.vec), lambda t: (t[1] - t[2]) * (t[1] - t[2])))), 9)"))
def exact_knn_search_l2(spark, sf_dir):
    p = points(spark, sf_dir)
    return edges_out(knn(_asked(p), p, K, "euclidean"))


@query(_search_sql("round(1 - list_sum(list_transform(list_zip(a.vec, b.vec), lambda t: ((t[1] > 0) <> (t[2] > 0))::INT)) / 64, 9)"))
def exact_knn_search_hamming(spark, sf_dir):
    p = points(spark, sf_dir)
    return edges_out(knn(_asked(p), p, K, "hamming"))


#: Part keys are below it.
UNIVERSE = 1 << 24
PART_SETS = "ps AS (SELECT l_suppkey AS id, list_sort(list(DISTINCT l_partkey)) AS tokens FROM lineitem GROUP BY 1)"


@query(f"WITH {PART_SETS}, j AS (SELECT a.id AS src, b.id AS dst, len(list_intersect(a.tokens, b.tokens)) AS n, len(a.tokens) + len(b.tokens) AS m FROM ps a, ps b WHERE a.id % 20 = 0), e AS (SELECT src, dst, n / (m - n) AS sim FROM j) SELECT src, dst, round(sim, 6) AS sim, rank FROM ({top_sql('e')})")
def exact_knn_search_jaccard(spark, sf_dir):
    s = saved(part_baskets(spark, sf_dir))
    index = Index("jaccard", UNIVERSE).insert(s)
    return edges_out(index._exact(s.where(F.col("id") % 20 == 0), K))


@query(f"WITH {SETS}, j AS (SELECT a.id AS i, b.id AS j, len(list_intersect(a.tokens, b.tokens)) AS n, len(a.tokens) + len(b.tokens) AS m FROM sets a JOIN sets b ON a.id < b.id) SELECT i, j, round(n / (m - n), 6) AS sim FROM j WHERE n / (m - n) >= 0.8")
def set_jaccard_pairs(spark, sf_dir):
    return rounded(jaccard_pairs(baskets(spark, sf_dir), 0.8), sim=6)


# ---- hash families and sources


def simhash_values(family: SimHash, source) -> str:
    """VALUES of (table_id, pos, r) of an independent source."""
    params = family.draw(source.functions(1))
    return ", ".join(f"({i // source.length}, {i % source.length}, {r.tolist()}::DOUBLE[])" for i, r in enumerate(params))


def codes_sql(family: SimHash, source: Independent) -> str:
    return f"hp(table_id, pos, r) AS (VALUES {simhash_values(family, source)}), codes AS (SELECT table_id::BIGINT AS table_id, id, sum(CASE WHEN list_dot_product(q, r) >= 0 THEN 1::BIGINT << ({source.length} - 1 - pos) ELSE 0 END)::BIGINT AS h FROM q15, hp GROUP BY 1, 2)"


FAMILY, SOURCE = SimHash(DIM, 61), Independent(8, 6)
CODES = f"{PTS}, {Q15}, {codes_sql(FAMILY, SOURCE)}"


def codes(spark, sf_dir, family=FAMILY, source=SOURCE) -> DataFrame:
    return hash_codes(points(spark, sf_dir), family, source)


@query(f"WITH {CODES} SELECT table_id, id, h FROM codes")
def simhash_codes(spark, sf_dir):
    return ints(codes(spark, sf_dir), "table_id")


POOL = Pool(6, 8, 40, 62)
POOL_FAMILY = SimHash(DIM, 63)


def _pool_sql() -> str:
    params = POOL_FAMILY.draw(40)
    rows = ", ".join(f"({i}, {r.tolist()}::DOUBLE[])" for i, r in enumerate(params))
    picks = ", ".join(f"({t}, {pos}, {f})" for t, c in enumerate(POOL.choices(1)) for pos, f in enumerate(c))
    return f"WITH {PTS}, {Q15}, fn(f, r) AS (VALUES {rows}), pick(table_id, pos, f) AS (VALUES {picks}), bit AS (SELECT id, f, CASE WHEN list_dot_product(q, r) >= 0 THEN 1 ELSE 0 END AS b FROM q15, fn) SELECT table_id::BIGINT AS table_id, id, sum(b::BIGINT << (7 - pos))::BIGINT AS h FROM pick JOIN bit USING (f) GROUP BY 1, 2"


@query(_pool_sql())
def pool_hash_codes(spark, sf_dir):
    return ints(codes(spark, sf_dir, POOL_FAMILY, POOL), "table_id")


TENSOR = Tensor(7, 8)
TENSOR_FAMILY = SimHash(DIM, 64)


def _tensor_sql() -> str:
    params = TENSOR_FAMILY.draw(TENSOR.functions(1))
    rows = ", ".join(f"({i // 4}, {i % 4}, {r.tolist()}::DOUBLE[])" for i, r in enumerate(params))
    picks = ", ".join(f"({t}, {a}, {TENSOR.halves + b})" for t, (a, b) in enumerate(TENSOR.pairs()))
    return f"WITH {PTS}, {Q15}, fn(half, pos, r) AS (VALUES {rows}), pick(table_id, l, r) AS (VALUES {picks}), bit AS (SELECT id, half, pos, CASE WHEN list_dot_product(q, r) >= 0 THEN 1::BIGINT ELSE 0 END AS b FROM q15, fn) SELECT table_id::BIGINT AS table_id, id, sum(b << (2 * (3 - pos) + CASE WHEN half = l THEN 1 ELSE 0 END))::BIGINT AS h FROM pick JOIN bit ON half = l OR half = pick.r GROUP BY 1, 2"


@query(_tensor_sql())
def tensor_hash_codes(spark, sf_dir):
    return ints(codes(spark, sf_dir, TENSOR_FAMILY, TENSOR), "table_id")


CP = CrossPolytope(DIM, 65)


def _closest_sql(products: str) -> str:
    """From (table_id, id, axis, y): code of the largest absolute y, equal ones by the least axis."""
    return f"SELECT table_id::BIGINT AS table_id, id, (2 * axis + CASE WHEN y < 0 THEN 1 ELSE 0 END)::BIGINT AS h FROM (SELECT *, row_number() OVER (PARTITION BY table_id, id ORDER BY abs(y) DESC, axis) AS n FROM {products}) WHERE n = 1"


def _cp_sql() -> str:
    rows = ", ".join(f"({t}, {a}, {r.tolist()}::DOUBLE[])" for t, p in enumerate(CP.draw(1)) for a, r in enumerate(p))
    return f"WITH {PTS}, {Q15}, fn(table_id, axis, r) AS (VALUES {rows}), y AS (SELECT table_id, id, axis, list_dot_product(q, r) AS y FROM q15, fn) {_closest_sql('y')}"


@query(_cp_sql())
def cp_codes(spark, sf_dir):
    return ints(codes(spark, sf_dir, CP, Independent(1, CP.bits)), "table_id")


CP2, CP_SOURCE = CrossPolytope(DIM, 70), Independent(3, 10)


def _independent_sql() -> str:
    """Two functions of seven bits a table, cut to the leading ten bits."""
    rows = ", ".join(f"({t}, {a}, {r.tolist()}::DOUBLE[])" for t, p in enumerate(CP2.draw(6)) for a, r in enumerate(p))
    return f"WITH {PTS}, {Q15}, fn(table_id, axis, r) AS (VALUES {rows}), y AS (SELECT table_id, id, axis, list_dot_product(q, r) AS y FROM q15, fn), c AS ({_closest_sql('y')}) SELECT table_id // 2 AS table_id, id, (sum(CASE WHEN table_id % 2 = 0 THEN h << 7 ELSE h END)::BIGINT >> 4) AS h FROM c GROUP BY 1, 2"


@query(_independent_sql())
def independent_hash_codes(spark, sf_dir):
    return ints(codes(spark, sf_dir, CP2, CP_SOURCE), "table_id")


FHT = FHTCrossPolytope(DIM, 66)


def _fht_sql() -> str:
    signs = FHT.draw(2)
    rows = ", ".join(f"({t}, {p}, {signs[t][p].tolist()})" for t in range(2) for p in range(3))
    parts = [PTS, Q15, f"sg(table_id, pos, s) AS (VALUES {rows})", "x0 AS (SELECT table_id, id, q AS x FROM q15, range(2) r(table_id))"]
    for r in range(3):
        parts.append(f"x{r + 1} AS (SELECT table_id, id, list(y ORDER BY i) AS x FROM (SELECT table_id, id, i, list_sum(list_transform(list_zip(x, s, range(0, 64)), lambda t: t[1] * t[2] * (1 - 2 * (bit_count(i & t[3]::BIGINT) % 2)))) AS y FROM x{r} JOIN (SELECT table_id, s FROM sg WHERE pos = {r}) USING (table_id), range(0, 64) g(i)) GROUP BY 1, 2)")
    return f"WITH {', '.join(parts)}, y AS (SELECT table_id, id, a - 1 AS axis, x[a] AS y FROM x3, range(1, 65) g(a)) {_closest_sql('y')}"


@query(_fht_sql())
def fht_cp_codes(spark, sf_dir):
    return ints(codes(spark, sf_dir, FHT, Independent(2, FHT.bits)), "table_id")


MIN, MIN1 = MinHash(UNIVERSE, 67), MinHash(UNIVERSE, 67, True)


def _minhash_sql(family: MinHash) -> str:
    rows = ", ".join(f"({t}, {a}::BIGINT, {b}::BIGINT)" for t, (a, b) in enumerate(family.draw(4).tolist()))
    value = "token % 2" if family.one_bit else f"token & {(1 << family.bits) - 1}"
    return f"WITH {PART_SETS}, fn(table_id, a, b) AS (VALUES {rows}), e AS (SELECT id, unnest(tokens) AS token FROM ps), h AS (SELECT table_id, id, token, row_number() OVER (PARTITION BY table_id, id ORDER BY (a * token + b) % 2147483647, token) AS n FROM e, fn) SELECT table_id::BIGINT AS table_id, id, ({value})::BIGINT AS h FROM h WHERE n = 1"


@query(_minhash_sql(MIN))
def minhash_codes(spark, sf_dir):
    return ints(hash_codes(part_baskets(spark, sf_dir), MIN, Independent(4, MIN.bits), True), "table_id")


@query(_minhash_sql(MIN1))
def minhash_1bit(spark, sf_dir):
    return ints(hash_codes(part_baskets(spark, sf_dir), MIN1, Independent(4, 1), True), "table_id")


# ---- probabilities

SIMS = "s AS (SELECT vec_id AS id, (vec_id % 101) / 100.0 AS sim FROM embeddings)"
PSIM = "(1 - acos(2 * {s} - 1) / pi())"


def _sims(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).select("id", ((F.col("id") % 101) / 100.0).alias("sim"))


@query(f"WITH {SIMS} SELECT id, round({PSIM.format(s='sim')}, 6) AS p, round(pow({PSIM.format(s='sim')}, 13), 6) AS p12 FROM s")
def simhash_collision_prob(spark, sf_dir):
    p = P.simhash_p(F.col("sim"))
    return rounded(_sims(spark, sf_dir).select("id", p.alias("p"), P.concatenated_p(p, 12).alias("p12")), p=6, p12=6)


@query(f"WITH {SIMS} SELECT id, round(sim + (1 - sim) * ((100 / 100.0 - 1) / 100), 6) AS p7, round(sim + (1 - sim) * ((100 / 2.0 - 1) / 100), 6) AS p1 FROM s")
def minhash_collision_prob(spark, sf_dir):
    return rounded(_sims(spark, sf_dir).select("id", P.minhash_p(F.col("sim"), 100, 7).alias("p7"), P.minhash_p(F.col("sim"), 100, 1).alias("p1")), p7=6, p1=6)


@query(f"WITH {SIMS} SELECT id, round(pow(1 - pow({PSIM.format(s='sim')}, 13), id % 32) * pow(1 - pow({PSIM.format(s='sim')}, 14), 32 - id % 32), 6) AS f FROM s")
def failure_prob_pool(spark, sf_dir):
    p = P.simhash_p(F.col("sim"))
    done = F.col("id") % 32
    return rounded(_sims(spark, sf_dir).select("id", P.failure_pool(P.concatenated_p(p, 12), P.concatenated_p(p, 13), done, F.lit(32)).alias("f")), f=6)


def _tensor_failure_sql() -> str:
    p = PSIM.format(s="sim")
    up = lambda bits, n: f"(1 - pow(1 - pow({p}, {bits + 1}), {n}))"
    # depth 9: 5 left and 4 right bits; depth 10: 5 and 5
    return f"WITH {SIMS}, t AS (SELECT *, floor(sqrt(id % 36)) AS c, 6 - floor(sqrt(id % 36)) AS m FROM s) SELECT id, round((1 - {up(5, 'c')} * {up(4, 'c')}) * (1 - {up(5, 'c')} * {up(5, 'c')}) * (1 - {up(5, 'm')} * {up(5, 'c')}) * (1 - {up(5, 'm')} * {up(5, 'm')}), 6) AS f FROM t"


@query(_tensor_failure_sql())
def failure_prob_tensor(spark, sf_dir):
    return rounded(_sims(spark, sf_dir).select("id", P.failure_tensor(P.simhash_p(F.col("sim")), 9, F.col("id") % 36, F.lit(36)).alias("f")), f=6)


# ---- sketches

SK = SimHash(DIM, 6)


def _sketch_sql() -> str:
    rows = ", ".join(f"({i // 64}, {i % 64}, {r.tolist()}::DOUBLE[])" for i, r in enumerate(SK.draw(128)))
    return f"{PTS}, {Q15}, fn(sketch_no, bit, r) AS (VALUES {rows}), sk AS (SELECT id, sketch_no, (sum(CASE WHEN list_dot_product(q, r) >= 0 THEN 1::HUGEINT << bit ELSE 0 END)) AS w FROM q15, fn GROUP BY 1, 2)"


@query(f"WITH {_sketch_sql()} SELECT id, sketch_no::BIGINT AS sketch_no, (CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END)::BIGINT AS w0 FROM sk")
def sketch_words(spark, sf_dir):
    return ints(sketches(points(spark, sf_dir), DIM, 2), "sketch_no")


@query(f"WITH {_sketch_sql()}, z AS (SELECT id, w FROM sk WHERE sketch_no = 0), d AS (SELECT a.id AS i, b.id AS j, bit_count(xor(a.w, b.w))::BIGINT AS dist FROM z a JOIN z b ON a.id < b.id) SELECT i, j, dist FROM d WHERE dist <= 15")
def mih_chunk_join(spark, sf_dir):
    codes_ = sketches(points(spark, sf_dir), DIM, 1).drop("sketch_no")
    return ints(C.hamming_pairs(codes_, 15, 1, 16), "dist")


@query(f"WITH {_sketch_sql()}, {codes_sql(FAMILY, SOURCE)}, z AS (SELECT table_id, c.id, h, w, 18 + (c.id % 7) AS thr FROM codes c JOIN sk ON sk.id = c.id AND sk.sketch_no = c.table_id % 2) SELECT DISTINCT a.id AS i, b.id AS j FROM z a JOIN z b ON a.table_id = b.table_id AND a.h = b.h AND a.id < b.id WHERE bit_count(xor(a.w, b.w)) <= greatest(a.thr, b.thr)")
def sketch_hamming_filter(spark, sf_dir):
    sk = sketches(points(spark, sf_dir), DIM, 2).select("id", "sketch_no", F.col("w0").alias("sk"))
    h = codes(spark, sf_dir).withColumn("sketch_no", F.col("table_id") % 2).join(sk, ["id", "sketch_no"]).withColumn("thr", 18 + F.col("id") % 7)
    return C.bucket_pairs(h, sketched=True)


@query(f"WITH {PTS}, {ALL_EDGES}, t AS ({top_sql('edges')}) SELECT id, floor(64 * (1 - {PSIM.format(s='coalesce(sim, 0)')}))::BIGINT AS thr FROM pts LEFT JOIN t ON id = src AND rank = {K}")
def sketch_thresholds(spark, sf_dir):
    p = points(spark, sf_dir)
    return kth_similarity(knn_graph(p, K), p, K).select("id", F.floor(64 * (1 - P.simhash_p(F.col("kth")))).alias("thr"))


# ---- candidate pairs

BUCKET = "bp AS (SELECT DISTINCT a.id AS i, b.id AS j FROM codes a JOIN codes b ON a.table_id = b.table_id AND a.h = b.h AND a.id < b.id)"


@query(f"WITH {CODES}, {BUCKET} SELECT i, j FROM bp")
def lsh_bucket_join(spark, sf_dir):
    return C.bucket_pairs(codes(spark, sf_dir))


@query(f"WITH {CODES}, {BUCKET}, {graph_sql('bp')}")
def lsh_bucket_topk(spark, sf_dir):
    return edges_out(topk(bucket_topk(codes(spark, sf_dir), points(spark, sf_dir), K), K))


@query(f"WITH {CODES} SELECT DISTINCT a.id AS i, b.id AS j FROM codes a JOIN codes b ON a.table_id = b.table_id AND a.h = b.h AND a.id < b.id WHERE NOT (a.id % 3 = 0 AND b.id % 3 = 0)")
def frozen_live_join(spark, sf_dir):
    return C.bucket_pairs(codes(spark, sf_dir).withColumn("frozen", F.col("id") % 3 == 0))


def _blocks_sql(order: str, size: int) -> str:
    """Pairs kp in blocks of consecutive codes."""
    return f"r AS (SELECT *, (row_number() OVER (PARTITION BY table_id ORDER BY {order}, id) - 1) // {size} AS blk, count(*) OVER (PARTITION BY table_id) // {size} AS nb FROM codes), kp AS (SELECT DISTINCT a.id AS i, b.id AS j FROM r a JOIN r b ON a.table_id = b.table_id AND a.blk = b.blk AND a.id < b.id WHERE a.blk < a.nb)"


GRAY = "xor(xor(h, h >> 1), xor(h, h >> 1) >> 2)"
GRAY6 = f"xor({GRAY}, ({GRAY}) >> 4)"


@query(f"WITH {CODES}, {_blocks_sql('h', 8)} SELECT i, j FROM kp")
def fixed_block_join(spark, sf_dir):
    return C.block_pairs(codes(spark, sf_dir), 8, 6)


@query(f"WITH {CODES}, {_blocks_sql(GRAY6, 8)} SELECT i, j FROM kp")
def fixed_block_graycode(spark, sf_dir):
    return C.block_pairs(codes(spark, sf_dir), 8, 6, gray=True)


BOUNDED = "deep AS (SELECT table_id, id, h, d, h >> (6 - d) AS p, count(*) OVER (PARTITION BY table_id, d, h >> (6 - d)) AS c FROM codes, range(0, 7) g(d)), md AS (SELECT table_id, id, h, min(d) AS d FROM deep WHERE c <= {size} OR d = 6 GROUP BY 1, 2, 3), bb AS (SELECT DISTINCT a.id AS i, b.id AS j FROM md a JOIN md b ON a.table_id = b.table_id AND a.d = b.d AND a.h >> (6 - a.d) = b.h >> (6 - b.d) AND a.id < b.id)"


@query(f"WITH {CODES}, {BOUNDED.format(size=20)} SELECT i, j FROM bb")
def bounded_bucket_join(spark, sf_dir):
    return C.bounded_pairs(codes(spark, sf_dir), 20, 6)


@query(f"WITH {CODES}, v AS (SELECT *, 3 + id % 4 AS len FROM codes) SELECT DISTINCT least(a.id, b.id) AS i, greatest(a.id, b.id) AS j FROM v a JOIN v b ON a.table_id = b.table_id AND a.h >> (6 - a.len) = b.h >> (6 - a.len) AND (b.h > a.h OR (b.h = a.h AND b.id > a.id))")
def varying_prefix_join(spark, sf_dir):
    return C.varying_pairs(codes(spark, sf_dir).withColumn("len", (3 + F.col("id") % 4).cast("int")), 6)


WEIGHTS = G.projection_weights(SOURCE.tables, SOURCE.length, 68)
PROJECTION = "list_sum(list_transform(range(0, len(w)), lambda b: CASE WHEN (h >> b) & 1 = 1 THEN w[b + 1] ELSE 0.0 END))"


def _projection_sql() -> str:
    rows = ", ".join(f"({t}, {[float(x) for x in w]}::DOUBLE[])" for t, w in WEIGHTS.items())
    blocks = _blocks_sql("round(o, 9)", 8).replace("FROM codes)", "FROM pr)")
    return f"WITH {CODES}, wt(table_id, w) AS (VALUES {rows}), pr AS (SELECT codes.table_id, id, h, {PROJECTION} AS o FROM codes JOIN wt ON wt.table_id = codes.table_id), {blocks} SELECT i, j FROM kp"


@query(_projection_sql())
def projection_block_join(spark, sf_dir):
    return C.projection_pairs(codes(spark, sf_dir), WEIGHTS, 8)


RANDOM = f"rx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS ix FROM pts), rg AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM rx a, range(1, {K} + 1) g(j), rx b WHERE b.ix = ((a.ix * 48271 + j * 69621 + 9) % 2147483647) % (SELECT count(*) FROM pts) AND a.id <> b.id)"


@query(f"WITH {PTS}, {RANDOM} SELECT src, dst FROM rg")
def random_graph_init(spark, sf_dir):
    return C.random_pairs(points(spark, sf_dir), K)


DESCENT = f"rp AS (SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j FROM rg), s0 AS (SELECT i, j, {cos('a.vec', 'b.vec')} AS sim FROM rp JOIN pts a ON a.id = i JOIN pts b ON b.id = j), e0 AS (SELECT i AS src, j AS dst, sim FROM s0 UNION ALL SELECT j, i, sim FROM s0), g0 AS ({top_sql('e0')}), rv AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM g0), ar AS (SELECT src AS c, dst AS v FROM g0 UNION SELECT dst, src FROM rv WHERE r <= {K}), np AS (SELECT DISTINCT a.v AS i, b.v AS j FROM ar a JOIN ar b ON a.c = b.c AND a.v < b.v)"


@query(f"WITH {PTS}, {RANDOM}, {DESCENT} SELECT i, j FROM np")
def nndescent_one_round(spark, sf_dir):
    p = points(spark, sf_dir)
    start = C.random_pairs(p, K).select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
    return C.descent_pairs(graph_of(score_pairs(start, p), K), K)


# ---- graph builders


def _fixed_sql(seed: int, reps: int, bits: int, pairs: str) -> str:
    source = Independent(reps, bits)
    return f"WITH {PTS}, {Q15}, {codes_sql(SimHash(DIM, seed), source)}, {pairs}"


@query(_fixed_sql(21, 100, 16, f"{_blocks_sql('h', 16)}, {graph_sql('kp')}"))
def graph_fixed_buckets(spark, sf_dir):
    return edges_out(G.build_graph("angular", points(spark, sf_dir), K, "fixed_buckets", use_sketching=False))


@query(_fixed_sql(22, 100, 16, f"{BOUNDED.format(size=32).replace('(6 - ', '(16 - ').replace('range(0, 7)', 'range(0, 17)').replace('d = 6', 'd = 16')}, {graph_sql('bb')}"))
def graph_bounded_buckets(spark, sf_dir):
    return edges_out(G.build_graph("angular", points(spark, sf_dir), K, "bounded_buckets", use_sketching=False))


def _graph_projection_sql() -> str:
    weights = G.projection_weights(100, 16, 24)
    rows = ", ".join(f"({t}, {[float(x) for x in w]}::DOUBLE[])" for t, w in weights.items())
    blocks = _blocks_sql("round(o, 9)", 16).replace("FROM codes)", "FROM pr)")
    return _fixed_sql(23, 100, 16, f"wt(table_id, w) AS (VALUES {rows}), pr AS (SELECT codes.table_id, id, h, {PROJECTION} AS o FROM codes JOIN wt ON wt.table_id = codes.table_id), {blocks}, {graph_sql('kp')}")


@query(_graph_projection_sql())
def graph_projection(spark, sf_dir):
    return edges_out(G.build_graph("angular", points(spark, sf_dir), K, "projection", use_sketching=False))


@query()
def graph_plain(spark, sf_dir):
    return edges_out(G.build_graph("angular", points(spark, sf_dir), K, "plain", hash_length=6))


@query()
def graph_varying_repetitions(spark, sf_dir):
    return edges_out(G.build_graph("angular", points(spark, sf_dir), K, "varying_repetitions", recall=0.5, initial_hash_length=8))


def _round_sql(n: int, pairs: str) -> str:
    """Graph g{n} of g{n - 1} and the pairs (i, j) of a named query."""
    return f"""s{n} AS MATERIALIZED (SELECT i, j, {cos("a.vec", "b.vec")} AS sim FROM {pairs} JOIN pts a ON a.id = i JOIN pts b ON b.id = j),
e{n} AS (SELECT i AS src, j AS dst, sim FROM s{n} UNION ALL SELECT j, i, sim FROM s{n} {f"UNION ALL SELECT src, dst, sim FROM g{n - 1}" if n else ""}), g{n} AS MATERIALIZED ({top_sql(f"e{n}")})"""


def _equal_failure_sql(success: float = 0.1, recall: float = 0.5, bits: int = 24, seed: int = 27) -> str:
    """Each round: a hash of its own, each point's length and sketch threshold from its k-th similarity."""
    sk = ", ".join(f"({bit}, {r.tolist()}::DOUBLE[])" for bit, r in enumerate(SimHash(DIM, seed + 77).draw(16 * 64)[:64]))
    parts = [PTS, Q15, f"skf(bit, r) AS (VALUES {sk})", "sk AS MATERIALIZED (SELECT id, sum(CASE WHEN list_dot_product(q, r) >= 0 THEN 1::HUGEINT << bit ELSE 0 END) AS w FROM q15, skf GROUP BY 1)"]
    for n in range(1 + math.ceil(math.log(1 - recall) / math.log(1 - success))):
        parts.append(codes_sql(SimHash(DIM, seed + n), Independent(1, bits)).replace("hp", f"hp{n}").replace("codes AS", f"c{n} AS MATERIALIZED"))
        if n == 0:
            parts.append(_blocks_sql("h", K + 1).replace("FROM codes)", "FROM c0)"))
            parts.append(_round_sql(0, "kp"))
            continue
        p = PSIM.format(s="coalesce(sim, 0)")
        length = f"greatest(0, least({bits}, CASE WHEN {p} >= 1 THEN {bits} WHEN {p} > 0 THEN round(ln({min(1.0, 2 * success)}) / ln({p}))::INT ELSE 0 END))"
        parts.append(f"v{n} AS MATERIALIZED (SELECT c.id, h, w, {length} AS len, floor(64 * (1 - {p})) AS thr FROM c{n} c JOIN sk ON sk.id = c.id LEFT JOIN g{n - 1} g ON g.src = c.id AND rank = {K})")
        parts.append(f"p{n} AS (SELECT DISTINCT least(a.id, b.id) AS i, greatest(a.id, b.id) AS j FROM v{n} a JOIN v{n} b ON a.h >> ({bits} - a.len) = b.h >> ({bits} - a.len) AND (b.h > a.h OR (b.h = a.h AND b.id > a.id)) WHERE bit_count(xor(a.w, b.w)) <= greatest(a.thr, b.thr))")
        parts.append(_round_sql(n, f"p{n}"))
    return f"WITH {', '.join(parts)} SELECT src, dst, round(sim, 6) AS sim, rank FROM g{n}"


@query(_equal_failure_sql())
def graph_equal_failure(spark, sf_dir):
    return edges_out(G.build_graph("angular", points(spark, sf_dir), K, "equal_failure_prob"))


def _descent_sql(rounds: int = 20) -> str:
    start = RANDOM.replace(" + 9)", " + 26)")
    parts = [PTS, start, "rp AS (SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j FROM rg)", _round_sql(0, "rp")]
    for n in range(1, rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT src AS c, dst AS v FROM g{n - 1} UNION SELECT dst, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM g{n - 1}) WHERE r <= {K})")
        parts.append(f"p{n} AS (SELECT DISTINCT a.v AS i, b.v AS j FROM a{n} a JOIN a{n} b ON a.c = b.c AND a.v < b.v)")
        parts.append(_round_sql(n, f"p{n}"))
    return f"WITH {', '.join(parts)} SELECT src, dst, round(sim, 6) AS sim, rank FROM g{rounds}"


@query(_descent_sql())
def graph_nndescent(spark, sf_dir):
    return edges_out(G.build_graph("angular", points(spark, sf_dir), K, "nndescent"))


# ---- index


@query(f"WITH {PTS}, {Q15}, {codes_sql(SimHash(DIM, 61), Independent(8, 24))} SELECT DISTINCT a.id AS src, b.id AS dst FROM codes a JOIN codes b ON a.table_id = b.table_id AND a.h >> 20 = b.h >> 20 WHERE a.id % 20 = 0")
def lsh_index_depth_candidates(spark, sf_dir):
    p = points(spark, sf_dir)
    index = Index("angular", DIM, 8, "simhash", "independent", 61, "none").fit(p)
    return index.candidates(index.hashed(_asked(p)), 4)


@query(f"WITH {CODES}, m AS (SELECT a.id AS src, b.id AS dst, max(CASE WHEN a.h = b.h THEN 6 ELSE 5 - floor(log2(xor(a.h, b.h)))::BIGINT END) AS depth FROM codes a JOIN codes b ON a.table_id = b.table_id AND a.h >> 5 = b.h >> 5 WHERE a.id % 20 = 0 GROUP BY 1, 2) SELECT src, depth, count(*) AS count, (sum(count(*)) OVER (PARTITION BY src ORDER BY depth DESC))::BIGINT AS deeper FROM m GROUP BY 1, 2")
def index_depth_histogram(spark, sf_dir):
    c = codes(spark, sf_dir)
    return ints(depth_histogram(c.where("id % 20 = 0"), c, 6), "depth")


@query()
def lsh_index_search(spark, sf_dir):
    p = points(spark, sf_dir)
    return edges_out(Index("angular", DIM, tables=32).fit(p).search(_asked(p), K, 0.9))


@query()
def lsh_index_search_sets(spark, sf_dir):
    s = saved(part_baskets(spark, sf_dir))
    universe = (read(spark, sf_dir, "lineitem").agg(F.max("l_partkey")).first()[0] or 0) + 1
    return edges_out(Index("jaccard", universe, tables=16).fit(s).search(s.where("id % 20 = 0"), K, 0.9))


# ---- adapters


@query(f"WITH {_sketch_sql()}, z AS (SELECT id, w FROM sk WHERE sketch_no = 0), e AS (SELECT a.id AS src, b.id AS dst, 1 - bit_count(xor(a.w, b.w)) / 64.0 AS sim FROM z a, z b WHERE a.id % 20 = 0) SELECT src, dst, sim::DOUBLE AS sim, rank FROM ({top_sql('e')})")
def faiss_lsh_style_rank(spark, sf_dir):
    p = points(spark, sf_dir)
    return edges_out(HammingRank(DIM, 64, seed=6).fit(p).query(_asked(p), K))


CENTERS = [[x / 1000 for x in r] for r in SimHash(DIM, 69).draw(16).tolist()]
CENTER_ROWS = ", ".join(f"({i}, {c}::DOUBLE[])" for i, c in enumerate(CENTERS))


@query(f"WITH {PTS}, ce(cell, vec) AS (VALUES {CENTER_ROWS}), dd AS (SELECT p.id, cell, row_number() OVER (PARTITION BY p.id ORDER BY round(list_dot_product(p.vec, p.vec) - 2 * list_dot_product(p.vec, ce.vec) + list_dot_product(ce.vec, ce.vec), 9), cell) AS n FROM pts p, ce), cp AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM dd a JOIN dd b ON a.cell = b.cell WHERE a.id % 20 = 0 AND a.n <= 3 AND b.n = 1), e AS (SELECT src, dst, {cos('a.vec', 'b.vec')} AS sim FROM cp JOIN pts a ON a.id = src JOIN pts b ON b.id = dst) SELECT src, dst, round(sim, 6) AS sim, rank FROM ({top_sql('e')})")
def ivf_probe_search(spark, sf_dir):
    p = points(spark, sf_dir)
    return edges_out(IVF(n_probe=3, centers=CENTERS).fit(p).query(_asked(p), K))


@query(f"WITH {PTS}, {Q15}, {codes_sql(SimHash(DIM, 53), Independent(6, 6))}, {BOUNDED.format(size=40).replace('bb AS (SELECT DISTINCT', 'bb AS (SELECT')} SELECT i, j, count(*) AS votes FROM bb GROUP BY 1, 2 HAVING count(*) >= 2")
def rp_tree_votes(spark, sf_dir):
    return tree_votes(points(spark, sf_dir), DIM, 6, 40, 2, depth=6)


@query(f"WITH {PTS}, {RANDOM.replace(' + 9)', ' + 54)')}, e AS (SELECT src, dst, 0.5::DOUBLE AS sim FROM rg WHERE src % 20 = 0) {top_sql('e')}")
def dummy_answers(spark, sf_dir):
    p = points(spark, sf_dir)
    return edges_out(Dummy().fit(p).query(_asked(p), K))


# ---- evaluation

RUNS = """found AS (SELECT user_id % 5 AS run_id, user_id AS qid, value AS distance FROM events),
truth AS (SELECT qid, rank, distance FROM (SELECT user_id AS qid, value AS distance, row_number() OVER (PARTITION BY user_id ORDER BY value) AS rank FROM events)),
kth AS (SELECT qid, distance AS t FROM truth WHERE rank = 3)"""


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events")
    found = e.select((F.col("user_id") % 5).alias("run_id"), F.col("user_id").alias("qid"), F.col("value").alias("distance"))
    return found, D.windowed_rank(e.select(F.col("user_id").alias("qid"), F.col("value").alias("distance")))


@query(f"WITH {RUNS} SELECT run_id, round(sum((distance <= t + 1e-10)::INT) / (100 * 3), 6) AS recall FROM found JOIN kth USING (qid) GROUP BY 1")
def recall_knn(spark, sf_dir):
    return rounded(E.recall_knn(*_runs(spark, sf_dir), 3, 100), recall=6)


@query(f"WITH {RUNS} SELECT run_id, round(sum((distance <= t * 1.1)::INT) / (100 * 3), 6) AS recall FROM found JOIN kth USING (qid) GROUP BY 1")
def epsilon_recall(spark, sf_dir):
    return rounded(E.epsilon_recall(*_runs(spark, sf_dir), 3, 100, 0.1), recall=6)


@query(f"WITH {RUNS}, n AS (SELECT run_id, qid, least(sum((distance <= t + 1e-10)::INT), 3) AS n FROM found JOIN kth USING (qid) GROUP BY 1, 2), g AS (SELECT run_id, n FROM (SELECT DISTINCT run_id FROM n), range(0, 4) r(n)) SELECT g.run_id, g.n, count(qid) AS queries FROM g LEFT JOIN n ON n.run_id = g.run_id AND n.n = g.n GROUP BY 1, 2")
def recall_distribution(spark, sf_dir):
    return E.recall_distribution(*_runs(spark, sf_dir), 3)


@query(f"WITH {RUNS} SELECT run_id, round(CASE WHEN (SELECT sum(distance) FROM truth) < 0.01 THEN 'Infinity'::DOUBLE ELSE sum(distance) / (SELECT sum(distance) FROM truth) END, 6) AS error FROM found GROUP BY 1")
def relative_error(spark, sf_dir):
    return rounded(E.relative_error(*_runs(spark, sf_dir)), error=6)


@query(f"WITH {CODES}, {BUCKET}, {ALL_EDGES}, x AS ({top_sql('edges')}), sc AS (SELECT i, j, {cos('a.vec', 'b.vec')} AS sim FROM bp JOIN pts a ON a.id = i JOIN pts b ON b.id = j), bw AS (SELECT i AS src, j AS dst, sim FROM sc UNION ALL SELECT j, i, sim FROM sc), y AS ({top_sql('bw')}) SELECT x.src, round(count(y.dst) / {K}, 6) AS recall FROM x LEFT JOIN y ON x.src = y.src AND x.dst = y.dst GROUP BY 1")
def set_recall(spark, sf_dir):
    p = points(spark, sf_dir)
    approx = topk(bucket_topk(codes(spark, sf_dir), p, K), K)
    return rounded(E.set_recall(knn_graph(p, K), approx, K), recall=6)


@query("SELECT algo, id, x, y FROM (SELECT *, max(x) OVER (PARTITION BY algo ORDER BY y DESC, x DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT p_brand AS algo, p_partkey AS id, p_retailprice AS y, p_size::DOUBLE AS x FROM part) WHERE x <> 0 AND y <> 0) WHERE m IS NULL OR x > m")
def pareto_frontier(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("algo"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x"))
    return E.pareto_frontier(p, "algo", "x", "y")


@query("WITH a AS (SELECT user_id AS run_id, event_type AS attempt, avg(value) AS t, avg(event_id % 10) AS c FROM events GROUP BY 1, 2) SELECT run_id, round(min(t), 6) AS best_search_time, round(avg(c), 6) AS candidates, count(*) AS run_count FROM a GROUP BY 1")
def best_of_runs(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("attempt"), F.col("value").alias("time"), (F.col("event_id") % 10).alias("candidates"))
    return rounded(E.best_of(e), best_search_time=6, candidates=6)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_runs_antijoin(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    done = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return E.missing_runs(d, done.select(F.col("o_custkey").alias("id")), ["id"])


@query("SELECT k, length, source FROM (VALUES ('5'), ('10')) a(k), (VALUES ('8'), ('16'), ('24')) b(length), (VALUES ('pool'), ('tensor')) c(source)")
def param_grid(spark, sf_dir):
    return E.parameter_grid(spark, {"k": [5, 10], "length": [8, 16, 24], "source": ["pool", "tensor"]})


@query(f"WITH {PTS}, {ALL_EDGES}, t AS ({top_sql('edges')}) SELECT src, rank - 1 AS pos, dst, round(1 - {COS.format(a='a.vec', b='b.vec')} * 2 + 1, 6) AS distance FROM t JOIN pts a ON a.id = src JOIN pts b ON b.id = dst")
def check_graph(spark, sf_dir):
    p = points(spark, sf_dir)
    return ints(rounded(E.check_graph(adjacency(knn_graph(p, K)), p, V.distance_cosine), distance=6), "pos")


@query("SELECT p_partkey AS run_id, round(1 / (p_retailprice / 1000), 6) AS qps, round(p_size * (p_retailprice / 1000), 6) AS size_per_qps FROM part")
def run_rates(spark, sf_dir):
    runs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), (F.col("p_retailprice") / 1000).alias("best_search_time"), F.col("p_size").alias("index_size"))
    return rounded(E.rates(runs).select("run_id", "qps", "size_per_qps"), qps=6, size_per_qps=6)


@query(f"WITH e AS (SELECT user_id AS src, event_id AS dst, value AS sim FROM events) {top_sql('e', 3)}")
def topk_buffer(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.col("event_id").alias("dst"), F.col("value").alias("sim"))
    return ints(topk(e, 3), "rank")


@query(f"WITH {RUNS}, tot AS (SELECT sum(distance) AS s FROM truth), m AS (SELECT run_id, round(sum((distance <= t + 1e-10)::INT) / 300, 6) AS recall, round(sum((distance <= t * 1.01)::INT) / 300, 6) AS epsilon_001, round(sum((distance <= t * 1.1)::INT) / 300, 6) AS epsilon_01 FROM found JOIN kth USING (qid) GROUP BY 1), er AS (SELECT run_id, round(sum(distance) / (SELECT s FROM tot), 6) AS error FROM found GROUP BY 1) SELECT run_id, recall, epsilon_001, epsilon_01, error, round(1 / (p_retailprice / 1000), 6) AS qps, round(p_size * (p_retailprice / 1000), 6) AS size_per_qps FROM part LEFT JOIN m ON run_id = p_partkey LEFT JOIN er USING (run_id) WHERE run_id IS NOT NULL")
def all_metrics(spark, sf_dir):
    runs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), F.col("p_brand").alias("algo"), (F.col("p_retailprice") / 1000).alias("best_search_time"), F.col("p_size").alias("index_size"))
    m = E.all_metrics(*_runs(spark, sf_dir), runs, 3, 100).where("recall is not null").withColumnsRenamed({"epsilon_0.01": "epsilon_001", "epsilon_0.1": "epsilon_01"})
    return rounded(m.select("run_id", "recall", "epsilon_001", "epsilon_01", "error", "qps", "size_per_qps"), recall=6, epsilon_001=6, epsilon_01=6, error=6, qps=6, size_per_qps=6)


@query("WITH o AS (SELECT p_brand AS algo, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_partkey DESC) AS pos, p_partkey AS run_id FROM part) SELECT algo, pos, run_id FROM o")
def metric_pairs(spark, sf_dir):
    m = read(spark, sf_dir, "part").select(F.col("p_brand").alias("algo"), F.col("p_partkey").alias("run_id"), F.col("p_size").alias("x0"), F.col("p_retailprice").alias("y0"))
    return E.metric_pairs(m, "x0", "y0").select("algo", F.posexplode("points").alias("pos", "p")).select("algo", (F.col("pos") + 1).cast("long").alias("pos"), "p.run_id")


SAMPLE = "sm AS (SELECT id FROM pts ORDER BY md5('10:' || id::VARCHAR), id LIMIT 50)"


@query(f"WITH {CODES}, {BUCKET}, {ALL_EDGES}, {SAMPLE}, x AS (SELECT * FROM ({top_sql('edges')}) WHERE src IN (SELECT id FROM sm)), sc AS (SELECT i, j, {cos('a.vec', 'b.vec')} AS sim FROM bp JOIN pts a ON a.id = i JOIN pts b ON b.id = j), bw AS (SELECT i AS src, j AS dst, sim FROM sc UNION ALL SELECT j, i, sim FROM sc), y AS ({top_sql('bw')}), f AS (SELECT x.src, count(y.dst) AS found FROM x LEFT JOIN y ON x.src = y.src AND x.dst = y.dst GROUP BY 1) SELECT g.found, count(f.src) AS queries FROM range(0, {K} + 1) g(found) LEFT JOIN f USING (found) GROUP BY 1")
def sampled_recall(spark, sf_dir):
    p = points(spark, sf_dir)
    asked = E.sampled(p, 50)
    approx = topk(bucket_topk(codes(spark, sf_dir), p, K, asked), K)
    return ints(E.recall_histogram(knn(asked, p, K, exclude_self=True), approx, K), "found")


@query(f"WITH {CODES}, {BOUNDED.format(size=20)} SELECT d AS length, count(*) AS points, sum(h)::BIGINT AS updates FROM md GROUP BY 1")
def hash_length_counts(spark, sf_dir):
    return ints(E.by_length(C.bounded_depths(codes(spark, sf_dir), 20, 6).select(F.col("d").alias("length"), F.col("h").alias("updates"))), "length")


@query("SELECT p_name AS name, p_partkey AS id FROM (SELECT * FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size <= 40) ORDER BY p_name, p_partkey LIMIT 20")
def restricted_runs(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    first = part.agg(F.min("p_brand")).first()[0]
    d = part.select(F.struct("p_name", "p_partkey").alias("name"), F.col("p_brand").alias("algo"), F.col("p_type").alias("tag"), (F.col("p_size") > 40).alias("disabled"))
    return E.restricted(d, first, most=20).select(F.col("name.p_name").alias("name"), F.col("name.p_partkey").alias("id"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
