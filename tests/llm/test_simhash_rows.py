"""The near-dedup stage keeps one row of each group, whatever the ids."""

from vecspark.llm import simhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(n):
    return " ".join(f"w{n}x{i}" for i in range(80))


def test_stage_keeps_one_row_of_each_group(spark):
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (1, text(4)), (1, text(5)), (2, text(4)), (None, text(4)), (3, text(6)), (3, text(6))]
    df = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash_dedup.stage(spark, df, "").collect()))
    assert kept == sorted([(0, text(1)), (0, text(2)), (0, text(3)), (1, text(4)), (1, text(5)), (3, text(6))])
