"""Line dedup by winnowing over line hashes.

A window is the shortest run of lines from a given line on, or back from a given line, that has WORDS words. Of each
window the line of least hash is selected: these minima, and no other lines, become fingerprints. Equal windows select
the same line, so every run of WORDS words that stands twice has a fingerprint in common.

1. Minima are rows: the fingerprint and the extents to both sides (the windows it is the least of, by their hashes).
2. Fingerprints are counted; what stands once is dropped. Unique text leaves here, with a row for each minimum.
3. A match of the others is extended both ways as far as one of its windows stands elsewhere too: windows are joined
   with their first position by (document, line), which also verifies the fingerprint, so a common line in other
   surroundings never hides a match. Lines of later windows are deleted.

Everything is SQL functions. Counts and first positions are aggregated before they are joined, always on a unique side.
Rows of a hot line or passage are not dealt by it: their keys, a bounded number, are broadcast instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, cut, inside, join_counted, load

WORDS = 50
#: Lines that are looked at first; windows of more lines take a second look at WORDS lines.
FEW = 8
#: Words (at most 2 * WORDS) and lines of a window in one number, a window's first line and its lines in another.
STEP, SPAN = 128, 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))


def _grown(part: Column, found) -> Column:
    """found(n, full): n the lines that are needed for WORDS words, full whether the part has so many words."""
    add = lambda a, n: F.when(a % STEP >= WORDS, a).otherwise(a + STEP + n)
    return F.aggregate(part, F.lit(0), add, lambda a: found(F.floor(a / STEP), a % STEP >= WORDS))


def _spans(words: Column) -> Column:
    """All windows as numbers first line * SPAN + lines; words: of each line, at most WORDS."""
    none = F.lit(-1).cast("long")

    def ahead(i: Column) -> Column:
        code = lambda n: (i - 1).cast("long") * SPAN + n
        more = _grown(F.slice(words, i, WORDS), lambda n, full: F.when(full, code(n)).otherwise(none))
        return _grown(F.slice(words, i, FEW), lambda n, full: F.when(full, code(n)).otherwise(more))

    def back(i: Column) -> Column:
        code = lambda n: (i - n).cast("long") * SPAN + n
        part = lambda few: F.reverse(F.slice(words, F.greatest(i - few, F.lit(0)) + 1, F.least(i, F.lit(few))))
        more = _grown(part(WORDS), lambda n, full: F.when(full, code(n)).otherwise(none))
        return _grown(part(FEW), lambda n, full: F.when(full, code(n)).otherwise(more))

    at = F.sequence(F.lit(1), F.size(words))
    found = F.filter(F.array_distinct(F.concat(F.transform(at, ahead), F.transform(at, back))), lambda c: c >= 0)
    return F.when(F.size(words) > 0, found).otherwise(F.array().cast("array<bigint>"))


def minima(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, low, spans): each selected line's hash and its windows (at, len, whole), counted in lines with a word."""
    hashed = F.transform(_lines(F.col(text_col)), lambda s: F.struct(F.xxhash64(s).alias("h"), F.least(F.regexp_count(s, F.lit(SPACE_WORD)), F.lit(WORDS)).alias("n")))
    df = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.filter(hashed, lambda e: e["n"] > 0).alias("e"))
    # not e.h and e.n: the optimizer would put these into the lambdas below, once for each line
    df = df.select("id", F.transform("e", lambda e: e["h"]).alias("hs"), F.transform("e", lambda e: e["n"]).alias("ns"))
    df = df.select("id", "hs", _spans(F.col("ns")).alias("codes"))

    def window(c: Column) -> Column:
        at, n = F.floor(c / SPAN).cast("int"), (c % SPAN).cast("int")
        part = F.slice(F.col("hs"), at + 1, n)
        low = F.array_min(part)
        return F.struct((at + F.array_position(part, low)).alias("pos"), at.alias("at"), n.alias("len"), low.alias("low"), F.xxhash64(part).alias("whole"))

    df = df.select("id", F.sort_array(F.transform("codes", window)).alias("w"))
    w = F.col("w")
    new = lambda j: (j == 0) | (F.get(w, j - 1)["pos"] != F.get(w, j)["pos"])
    heads = F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(0), F.size(w) - 1), new)).otherwise(F.array().cast("array<int>"))
    df = df.select("id", "w", heads.alias("heads"))
    size = lambda j, k: F.coalesce(F.get(F.col("heads"), k + 1), F.size(w)) - j
    spans = lambda j, k: F.transform(F.slice(w, j + 1, size(j, k)), lambda x: F.struct(x["at"], x["len"], x["whole"]))
    return df.select("id", F.explode(F.transform("heads", lambda j, k: F.struct(F.get(w, j)["low"].alias("low"), spans(j, k).alias("spans")))).alias("g")).select("id", "g.low", "g.spans")


def repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, gone): which of each document's lines with a word are in a later repeated run."""
    prints = cut(minima(docs, id_col, text_col))
    shared = cut(prints.groupBy("low").agg(F.count("*").alias("n")).where("n > 1"))
    held = join_counted(prints, shared, ["low"], prints.count())
    held = cut(held.select("id", "low", F.explode("spans").alias("x")).select("id", "low", "x.*"))
    first = cut(held.groupBy("low", "whole").agg(F.min(F.struct("id", "at")).alias("f"), F.count("*").alias("n")).where("n > 1"))
    found = join_counted(held, first, ["low", "whole"], held.count())
    later = found.where((F.col("id") != F.col("f.id")) | (F.col("at") != F.col("f.at")))
    # within one document the first run stays whole
    begin = F.when(F.col("id") == F.col("f.id"), F.greatest(F.col("f.at") + F.col("len"), F.col("at"))).otherwise(F.col("at"))
    runs = later.select("id", F.struct(begin.alias("lo"), (F.col("at") + F.col("len") - 1).alias("hi")).alias("run")).where("run.lo <= run.hi")
    gone = F.array_distinct(F.flatten(F.transform(F.collect_set("run"), lambda r: F.sequence(r["lo"], r["hi"]))))
    return runs.groupBy("id").agg(gone.alias("gone"))


def _without(inner: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns, with shortened texts, and removed; the columns' names must not be id, gone, all, kept or removed."""
    names = inner.columns
    # the documents are not sorted for this join; a partition's runs are far fewer than its texts
    df = inner.join(repeats(inner, id_col, text_col).hint("shuffle_hash"), F.col(id_col) == F.col("id"), "left").select(*names, "gone")
    lines = F.when(F.col("gone").isNotNull(), _lines(F.col(text_col)))
    numbered = F.filter(F.transform(lines, lambda s, i: F.when(_has_word(s), i).otherwise(-1)), lambda i: i >= 0)
    df = df.select(*names, "gone", lines.alias("all"), numbered.alias("numbers"))
    # the second use of numbers keeps the optimizer from putting its expression into the lambda
    drop = F.when(F.size("numbers") > 0, F.transform("gone", lambda k: F.get(F.col("numbers"), k)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), drop)
    text = F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("all"), i)), "\n"))
    removed = F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long")
    return df.select(*(text.alias(n) if n == text_col else F.col(n) for n in names), removed.alias("removed"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their later repeated runs of WORDS words or more, and _removed, the number of deleted lines.

    Earlier is by id, then line. Null and empty texts and rows with a null id stay as they are. Rows of the same id
    count as one document and lose the same lines. Documents may become empty; none is dropped. Further columns are
    passed on, whatever their names; an empty table gives an empty one.
    """
    inner, (i, t) = inside(docs, id_col, text_col)
    return _without(inner, i, t).toDF(*docs.columns, "_removed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed (lines) and the sha256 of what is left."""
    out = dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_removed").alias("n_removed"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their later repeated runs; n_chars is counted anew."""
    names = docs.columns
    inner, (i, t) = inside(docs, "doc_id", "text")
    out = _without(inner, i, t)
    counted = [F.length(t).cast("long").alias(c) if n == "n_chars" else F.col(c) for n, c in zip(names, inner.columns, strict=True)]
    return out.select(*counted).toDF(*names)
