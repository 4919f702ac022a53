"""Quality rules as a bitmask ledger.

Each document's rules are evaluated once: the measurements and one bit for each failed rule are stored. A policy
is a version name and a mask of the bits that reject; applying another policy, or finding what one rule alone
rejects, only needs bitwise operations on the ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

#: Bit numbers of the rules, by name.
RULES = {"too_short": 0, "repeated_words": 1, "symbols": 2, "duplicate_lines": 3, "short_words": 4, "long_words": 5, "no_letters": 6}
BASE = (1 << RULES["too_short"]) | (1 << RULES["repeated_words"])
#: Policies by version: the bits that reject a document.
POLICIES = {"v0": BASE, "v1": BASE | (1 << RULES["symbols"]) | (1 << RULES["duplicate_lines"]) | (1 << RULES["short_words"]) | (1 << RULES["long_words"]) | (1 << RULES["no_letters"])}
CURRENT = "v1"

LEDGER = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, fail_bits long"
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Deletes everything but lead bytes, so that what is left counts code points.
TRAIL = bytes(range(0x80, 0xC0))
ASCII_NON_LETTERS = bytes(c for c in range(0x80) if not chr(c).isalpha()) + TRAIL


def measure(body: bytes) -> tuple[int, ...]:
    """The ledger's columns for one text in UTF-8. Memory follows the text's length."""
    words = body.split()  # on the six ASCII spaces, as the word pattern has them
    n = len(words)
    word_chars = len(body.translate(None, SPACES + TRAIL))
    n_symbols = len(body) - len(body.translate(None, SYMBOLS))
    seen, n_lines, n_dup = set(), 0, 0
    for line in body.split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in seen:
                n_dup += 1
            seen.add(line)
    repeated = 0
    if n >= 4:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            counts = Counter(grams)
            until = 0  # words before it are counted
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeated += i + 3 - max(until, i)
                    until = i + 3
    letters = len(body.translate(None, ASCII_NON_LETTERS))
    fails = {
        "too_short": n < 50,
        "repeated_words": 100 * repeated > 50 * n,
        "symbols": n_symbols > 0.25 * n,
        "duplicate_lines": n_lines >= 4 and n_dup > 0.5 * n_lines,
        "short_words": n > 0 and word_chars < 1.5 * n,
        "long_words": n > 0 and word_chars > 25 * n,
        "no_letters": word_chars > 0 and letters < 0.4 * word_chars,
    }
    bits = sum(1 << RULES[k] for k, v in fails.items() if v)
    return n, word_chars, n_symbols, n_dup, repeated, n_lines, letters, bits


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the ledger's, one row for each input row. Null and empty texts have zeros and fail too_short."""
    names = [f.split()[0] for f in LEDGER.split(", ")]
    given = docs.select(*keep, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*(measure(x.as_py()) for x in b.column(len(keep))), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(x, pa.int64()) for x in got)], names=[*keep, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]) + ", " + LEDGER
    return given.mapInArrow(run, schema)


def verdict(df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept under a policy."""
    bits = F.col("fail_bits")
    return df.withColumns({"base_failed": bits.bitwiseAND(F.lit(BASE)) != 0, "kept": bits.bitwiseAND(F.lit(BASE | POLICIES[policy])) == 0})


def ablation(df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row for each rule of a policy: documents that fail it, and those that only this rule rejects."""
    mask = POLICIES[policy]
    used = [(k, 1 << b) for k, b in RULES.items() if mask >> b & 1]
    held = F.col("fail_bits").bitwiseAND(F.lit(mask))
    sums = df.select(held.alias("m")).groupBy("m").count()  # at most 2 ** rules rows
    rules = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(v).cast("long").alias("bit")) for k, v in used))).alias("r")
    each = sums.select("m", "count", rules)
    hit = F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0))
    alone = F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("count")).otherwise(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(hit.alias("n_failed"), alone.alias("n_only"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdict(ledger(load(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the current policy rejects go."""
    names = docs.columns
    inner = docs.toDF(*(f"_in{i}" for i in range(len(names))))  # the ledger's names may clash with the table's
    kept = verdict(ledger(inner, text_col=f"_in{names.index('text')}", keep=tuple(inner.columns))).where("kept")
    return kept.select(*(F.col(f"_in{i}").alias(n) for i, n in enumerate(names)))
