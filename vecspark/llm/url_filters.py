"""URL filters: longest-match rules, then logistic regression on hashed character n-grams of host and path.

Everything that touches the table is SQL functions in one projection: no shuffle, no Python on executors. The
model has BUCKETS + 1 numbers, trained once a process from the small labelled table below.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, load

#: Fixed values: (verdict, host, path). A rule fits its host and all subdomains under its path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words of unwanted and of ordinary hosts. labelled() combines them to the training table.
UNWANTED = """casino poker slots jackpot betting gamble lottery roulette viagra pills pharmacy meds cialis diet-pills payday-loan
cheap-loans crypto-double forex-profit free-money win-prize prize-claim free-gift porn xxx sexy adult cams escort hookup
replica cheap-watches warez crack keygen malware phishing login-verify spam spammy link-farm spam-farm content-farm seo-links
clickbait adserver ads-track ad-tracker popunder tracker banner-ads click-track cheap-pills hot-dating bonus-spins""".split()
ORDINARY = """news library museum university school research science history weather maps recipes cooking garden travel music
film books archive forum wiki docs code project health sport football cycling photos gallery theatre city council police
hospital railway airport harbour market bakery farmers mountain river forest ocean language grammar physics chemistry biology
astronomy philosophy economy parliament journal magazine radio festival orchestra kitchen carpenter printing weaving
reading writing building painting training meeting evening spring nation station translation education collection tradition
exhibition stable notable vegetable capable possible theory method mathematics mother brother leather northern southern
another together thinking anthology healthy earth northwest thesis timber tailor tutor tower handbook standards another-day
sounds landing handmade strand shore shelter fresh english spanish wisdom hours harvest horizon entrance summer winter""".split()
PATHS = ["/", "/index.html", "/en/12", "/about", "/fr/7.html", "/view/3", "/item/881", "/de/41/", "/post/today", "/es/105"]
ENDS = ["com", "org", "info", "co.uk", "io"]
SYLLABLES = "ba ke li mo nu ra se ti vo za den kor mil pas ter".split()

BUCKETS = 1 << 13
GRAM_LENGTHS = (3, 4)
#: Gram numbers: code points weighed by powers of BASE, modulo PRIME.
BASE, PRIME = 131, 1_000_003
PENALTY = 5e-5
THRESHOLD = 0.5


def labelled() -> list[tuple[str, str, int]]:
    """The training table: (host, path, 1 if unwanted), about 1,100 rows. Words of one label are joined in pairs; both
    labels have the same ends and paths. Ordinary names without known words stand for the many hosts of no meaning."""
    out = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for i, w in enumerate(words):
            for j in range(6):
                other = words[(7 * i + 13 * j + 1) % len(words)]
                host = (f"www.{w}", f"{w}-{other}", f"{other}{w}", f"m.{w}-online", f"blog.{other}-{w}", w)[j]
                out.append((f"{host}.{ENDS[(i + j) % len(ENDS)]}", PATHS[(3 * i + j) % len(PATHS)], label))
    n = len(SYLLABLES)
    for i in range(90):
        name = SYLLABLES[i % n] + SYLLABLES[(i * 7 + 3) % n] + (SYLLABLES[(i * 4 + 1) % n] if i % 3 else "")
        out.append((("", "www.", "blog.", "m.")[i % 4] + name + "." + ENDS[i % len(ENDS)], PATHS[i % len(PATHS)], 0))
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, 2147483647)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, 2147483647), r"(?s)^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (null if none), and its verdict."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))

    def chosen(value) -> Column:
        out = F.lit(None).cast("string")
        for verdict, h, p in reversed(ordered):
            fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
            out = F.when(fits, F.lit(value(verdict, h, p))).otherwise(out)
        return out

    return chosen(lambda v, h, p: h + p), chosen(lambda v, h, p: v)


def _marked(host, path, joined):
    """Host and path with marks, so that their grams are different."""
    return joined("^", host, "$"), joined("|", path)


def grams(points: Column) -> Column:
    """Bucket numbers of all character n-grams of an array of code points, which must be a column of its own."""

    def of(n: int) -> Column:
        # the points are used more than once, so the optimizer does not put their expression into the lambda
        number = lambda i: sum((F.get(points, i + k) * F.lit(BASE**k).cast("long") for k in range(n)), F.lit(n).cast("long"))
        at = F.when(F.size(points) >= n, F.sequence(F.lit(0), F.greatest(F.size(points) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: (number(i) % PRIME % BUCKETS).cast("int"))

    return F.concat(*(of(n) for n in GRAM_LENGTHS))


def grams_of(host: str, path: str) -> list[int]:
    """The same for one url of the training table."""
    return [(sum(ord(s[i + k]) * BASE**k for k in range(n)) + n) % PRIME % BUCKETS for s in _marked(host, path, lambda *x: "".join(x)) for n in GRAM_LENGTHS for i in range(len(s) - n + 1)]


def train(rows: Sequence[tuple[str, str, int]]) -> list[float]:
    """Weights of the buckets, then the intercept, of a logistic regression with an L2 penalty, by Newton's method.

    Features are counts over the root of their sum, so that long urls don't outweigh short ones. The table is small, so
    the steps are solved in the space of its rows. Weights are rounded, so they are the same wherever they are trained.
    """
    x = np.zeros((len(rows), BUCKETS + 1))
    for r, (host, path, _) in enumerate(rows):
        g = grams_of(host, path)
        np.add.at(x[r], g, 1 / math.sqrt(max(1, len(g))))
    x[:, BUCKETS] = 1
    y = np.array([float(label) for _, _, label in rows])
    kernel, alpha = x @ x.T, np.zeros(len(rows))
    for _ in range(50):
        f = kernel @ alpha
        p = 1 / (1 + np.exp(-f))
        spread = np.maximum(p * (1 - p), 1e-9)
        new = np.linalg.solve(kernel + np.diag(PENALTY * len(rows) / spread), f + (y - p) / spread)
        done = np.abs(new - alpha).max() < 1e-9
        alpha = new
        if done:
            break
    return [round(float(w), 6) for w in x.T @ alpha]


@lru_cache(maxsize=1)
def weights() -> tuple[float, ...]:
    """Trained once a process: BUCKETS + 1 numbers, whatever the corpus."""
    return tuple(train(labelled()))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges every url: id, host, path, rule, verdict and the model's probability (six digits).

    Null urls and those without :// have an empty host and path; no rule fits them and the model judges the empty
    string. An empty path does not start with "/". Repeated rows are judged each for itself; further columns are
    ignored, whatever their names; an empty table gives an empty one. Time follows the length of an url.
    """
    w = F.lit([float(x) for x in weights()[:-1]])
    host, path = split_url(F.col(url_col))
    df = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    points = lambda s: F.when(F.length(s) > 0, F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long")))
    one, two = (points(s) for s in _marked(F.col("host"), F.col("path"), lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))))
    df = df.select("id", "host", "path", one.alias("one"), two.alias("two"))
    df = df.select("id", "host", "path", F.concat(grams(F.col("one")), grams(F.col("two"))).alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda a, b: a + F.element_at(w, b + 1))
    z = F.lit(weights()[-1]) + F.when(F.size("g") > 0, total / F.sqrt(F.size("g").cast("double"))).otherwise(0.0)
    rule, said = rule_of(F.col("host"), F.col("path"))
    df = df.select("id", "host", "path", rule.alias("rule"), said.alias("said"), F.round(1 / (1 + F.exp(-z)), 6).alias("probability"))
    verdict = F.coalesce("said", F.when(F.col("probability") >= THRESHOLD, "block").otherwise("allow"))
    return df.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "probability")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages"))
