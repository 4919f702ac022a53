"""Line dedup reaches every line of a repeated run."""

from vecspark.llm import line_dedup


def block(name, lines):
    return "\n".join(" ".join(f"{name}{i}w{j}" for j in range(10)) for i in range(lines))


def test_the_end_of_a_run_goes_where_its_windows_continue_otherwise(spark):
    p, x, q = block("p", 6).replace("\n", " "), block("x", 6), block("q", 4)  # p is one line, so its window ends before q
    df = spark.createDataFrame([(1, p + "\n" + x), (2, p + "\n" + q), (3, p + "\n" + q), (4, "own\n" + p + "\n" + q + "\nend")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert got == {1: p + "\n" + x, 2: q, 3: "", 4: "own\nend"}


def test_within_one_document_the_first_run_stays(spark):
    p, q = block("p", 6), block("q", 4)
    df = spark.createDataFrame([(1, p + "\n" + q + "\nown\n" + p + "\n" + q)], "doc_id long, text string")
    assert line_dedup.dedup(df).first().text == p + "\n" + q + "\nown"
