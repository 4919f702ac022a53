"""A searchable LSH index with a target recall."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import simhash_p
from ..lineage import saved
from .grouped import depth_counts, jaccard_topk
from .hashing import CrossPolytope, FHTCrossPolytope, Independent, MinHash, Pool, SimHash, Tensor, hash_codes, sketches
from .knn import knn, score_pairs, topk

LENGTH = 24
SMALL = 100
SKETCHES = 32
#: Prefix lengths that a second pass may use.
DEPTHS = (24, 20, 17, 14, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
#: A pair costs about so many times as much in a candidate join as in the blocks of the exact search.
PAIR_COST = 16


def tables_for_memory(memory: int, n: int, dim: int, bytes_per_value: int = 2) -> int:
    """Tables of (hash, id) rows that fit beside the data; an error if none does."""
    tables = (memory - n * dim * bytes_per_value) // (n * 8 + 65536)
    if tables < 1:
        raise ValueError("not enough memory for one table")
    return tables


class Index:
    """Index(metric, dim, ...).fit(points).search(queries, k, recall); metric angular, euclidean or jaccard (dim: universe).

    memory_limit (bytes) sets the number of tables at each rebuild, instead of tables. hash_args: num_rotations,
    estimation_repetitions, estimation_eps; source_args: num_functions (of the pool). Euclidean search uses angular
    hashes and has no recall guarantee.
    """

    def __init__(self, metric: str, dim: int, tables: int = 32, hash_function: str | None = None, hash_source: str = "pool", seed: int = 31, filter_type: str = "filter", memory_limit: int | None = None, hash_args: dict | None = None, source_args: dict | None = None) -> None:
        if metric not in ("angular", "euclidean", "jaccard"):
            raise ValueError(f"unknown metric {metric!r}")
        if filter_type not in ("filter", "simple", "none"):
            raise ValueError(f"unknown filter {filter_type!r}")
        if hash_source not in ("pool", "independent", "tensor"):
            raise ValueError(f"unknown hash source {hash_source!r}")
        self.metric, self.dim, self.filter_type, self.seed, self.memory_limit = metric, dim, filter_type, seed, memory_limit
        self.source_name, self.pool = hash_source, (source_args or {}).get("num_functions", 3000)
        self.family = self._family(hash_function or ("minhash" if metric == "jaccard" else "fht_crosspolytope"), dict(hash_args or {}))
        self._set_tables(tables)
        self.points: DataFrame | None = None
        self.codes: DataFrame | None = None
        self.sk: DataFrame | None = None

    def _family(self, name: str, args: dict):
        estimates = {"samples": args.pop("estimation_repetitions", 4000), "eps": args.pop("estimation_eps", 5e-3)}
        rotations = args.pop("num_rotations", 3)
        if args:
            raise ValueError(f"unknown hash arguments {sorted(args)}")
        if self.metric == "jaccard" and name in ("minhash", "1bit-minhash"):
            return MinHash(self.dim, self.seed, name == "1bit-minhash")
        if self.metric != "jaccard" and name == "simhash":
            return SimHash(self.dim, self.seed)
        if self.metric != "jaccard" and name == "crosspolytope":
            return CrossPolytope(self.dim, self.seed, **estimates)
        if self.metric != "jaccard" and name == "fht_crosspolytope":
            return FHTCrossPolytope(self.dim, self.seed, rotations, **estimates)
        raise ValueError(f"unknown hash function {name!r}")

    def _set_tables(self, tables: int) -> None:
        self.tables = tables
        if self.source_name == "pool":
            self.source = Pool(tables, LENGTH, self.pool, self.seed + 1)
        else:
            self.source = {"independent": Independent, "tensor": Tensor}[self.source_name](tables, LENGTH)

    @property
    def column(self) -> str:
        return "tokens" if self.metric == "jaccard" else "vec"

    def insert(self, points: DataFrame) -> Index:
        """Adds points; they are found after the next rebuild."""
        self.points = points if self.points is None else self.points.unionByName(points)
        return self

    def fit(self, points: DataFrame) -> Index:
        self.points = points
        return self.rebuild()

    def rebuild(self) -> Index:
        rows = self.points.select("id", self.column)
        if self.memory_limit is not None:
            self._set_tables(tables_for_memory(self.memory_limit, self.get_size(), self.dim))
        self.codes = saved(self.hashed(rows))
        self.sk = saved(sketches(rows, self.dim, SKETCHES, 1, self.seed + 3)) if self.metric != "jaccard" and self.filter_type != "none" else None
        return self

    def hashed(self, rows: DataFrame) -> DataFrame:
        """Codes (table_id, id, h) of rows, as the index has them of its points."""
        return hash_codes(rows.select("id", self.column), self.family, self.source, self.metric == "jaccard")

    def get_size(self) -> int:
        return self.points.count()

    def get_dimensions(self) -> int:
        return self.dim

    def candidates(self, codes: DataFrame, depth: int) -> DataFrame:
        """Rows (src, dst): points that share `depth` leading bits with a query in some table."""
        cut = LENGTH - depth
        q = codes.select("table_id", F.col("id").alias("src"), F.shiftright("h", cut).alias("p"))
        x = self.codes.select("table_id", F.col("id").alias("dst"), F.shiftright("h", cut).alias("p"))
        return q.join(x, ["table_id", "p"]).select("src", "dst").distinct()

    def _load(self, codes: DataFrame, depth: int) -> DataFrame:
        """(src, load): how many rows the candidate join gives each query."""
        cut = LENGTH - depth
        sizes = self.codes.groupBy("table_id", F.shiftright("h", cut).alias("p")).agg(F.count("*").alias("n"))
        q = codes.select("table_id", F.col("id").alias("src"), F.shiftright("h", cut).alias("p"))
        return q.join(sizes, ["table_id", "p"], "left").groupBy("src").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("load"))

    def _score(self, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The pairs (src, dst) with their similarities, those that may be among a query's k best at least."""
        if self.metric == "jaccard":
            return jaccard_topk(queries, self.points, k, pairs)
        return score_pairs(pairs.toDF("i", "j"), queries, self.metric, self.points).toDF("src", "dst", "sim")

    def needed_depth(self, kth: Column, recall: float, start: int) -> Column:
        """The longest prefix, `start` bits at most, with which a pair of this similarity is met with the recall; 0 if none."""
        steps = [start, *(d for d in DEPTHS if d < start)]
        met = [F.when((kth > 0) & (self.source.failure(self.family, kth, d) <= 1 - recall), d) for d in steps]
        return F.coalesce(*met, F.lit(0))

    def search(self, queries: DataFrame, k: int, recall: float = 0.9) -> DataFrame:
        """Rows (src, dst, sim, rank): the k nearest points of each query, each of them found with the recall's chance.

        A first pass joins prefixes as long as log2 of the points, which gives each query a k-th similarity and with it
        the prefix length that the recall needs. A second pass joins that length. Queries whose candidates would cost
        more than comparing them with all points, and all queries of an index below SMALL points, are searched exactly.
        """
        spark = queries.sparkSession
        n = self.get_size() if k else 0
        if n == 0:
            return spark.createDataFrame([], "src long, dst long, sim double, rank int")
        if n < SMALL:
            return self._exact(queries, k)
        asked = queries.select("id", self.column)
        codes = saved(self.hashed(asked))
        start = min(LENGTH, max(1, int(math.log2(n))))
        load = saved(self._load(codes, start))
        light = load.where(F.col("load") * PAIR_COST <= n)
        part = codes.join(light.select(F.col("src").alias("id")), "id", "left_semi")
        found = saved(topk(self._score(self.candidates(part, start), asked, k), k))
        kth = light.join(found.where(F.col("rank") == k).select("src", F.col("sim").alias("kth")), "src", "left").na.fill(0.0, ["kth"])
        grown = F.col("load") * F.pow(F.lit(2.0), F.lit(start) - F.col("depth"))
        # what a shorter prefix will cost is estimated by doubling with each bit
        plan = kth.withColumn("depth", self.needed_depth(F.col("kth"), recall, start)).withColumn("exact", (F.col("depth") == 0) | (grown * PAIR_COST > n))
        plan = saved(plan.select("src", "depth", (F.col("exact") & (F.col("depth") < start)).alias("exact")))
        depths = [r["depth"] for r in plan.where(~F.col("exact") & (F.col("depth") < start)).select("depth").distinct().collect()]  # at most len(DEPTHS)
        kept = found.join(plan.where("not exact"), "src", "left_semi").select("src", "dst", "sim")
        q_sk = sketches(asked, self.dim, SKETCHES, 1, self.seed + 3) if depths and self.sk is not None else None
        for d in sorted(depths):
            mine = codes.join(plan.where((F.col("depth") == d) & ~F.col("exact")).select(F.col("src").alias("id")), "id", "left_semi")
            pairs = self.candidates(mine, d).join(found.select("src", "dst"), ["src", "dst"], "left_anti")
            if q_sk is not None:
                pairs = self._sketch_filter(pairs, found, q_sk, k, d)
            kept = kept.unionByName(self._score(pairs, asked, k))
        rest = asked.join(plan.where("not exact").select(F.col("src").alias("id")), "id", "left_anti")
        if not rest.isEmpty():
            kept = kept.unionByName(self._exact(rest, k).select("src", "dst", "sim"))
        return topk(kept, k)

    def _sketch_filter(self, pairs: DataFrame, found: DataFrame, q_sk: DataFrame, k: int, depth: int) -> DataFrame:
        """Keeps pairs whose sketches differ in no more bits than a pair of the query's k-th similarity does, by three standard deviations."""
        no = depth % SKETCHES
        miss = 1 - simhash_p(F.col("sim"))
        kth = found.where(F.col("rank") == k).select("src", F.ceil(64 * miss + 3 * F.sqrt(64 * miss * (1 - miss))).alias("thr"))
        a = q_sk.where(F.col("sketch_no") == no).select(F.col("id").alias("src"), F.col("w0").alias("a"))
        b = self.sk.where(F.col("sketch_no") == no).select(F.col("id").alias("dst"), F.col("w0").alias("b"))
        near = pairs.join(kth, "src", "left").join(a, "src").join(b, "dst")
        return near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= F.coalesce("thr", F.lit(64))).select("src", "dst")

    def _exact(self, queries: DataFrame, k: int) -> DataFrame:
        if self.metric != "jaccard":
            return knn(queries.select("id", "vec"), self.points.select("id", "vec"), k, self.metric)
        # only sets that share a token have a similarity above 0
        return topk(jaccard_topk(queries, self.points, k), k)


def search_ids(found: DataFrame) -> DataFrame:
    """(src, ids): each query's neighbours, best first."""
    return found.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("ids"))


def depth_histogram(codes_q: DataFrame, codes_x: DataFrame, bits: int = LENGTH) -> DataFrame:
    """For each query, the number of points by the longest prefix shared in any table (those that share the first bit)."""
    best = depth_counts(codes_q, codes_x, bits)
    return best.withColumn("deeper", F.sum("count").over(Window.partitionBy("src").orderBy(F.desc("depth"))))
