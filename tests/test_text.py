import pytest
from pyspark.sql import functions as F

from quarrymill.functions import checks
from quarrymill.functions import text as X


@pytest.mark.parametrize(
    "given,expected",
    [
        ("**Bold** _kept_ `code`", "bold _kept_ code"),
        ("[label](http://x.example) and ![alt](y.png)", "label and alt"),
        ("<!-- gone -->a <b>tag</b> &amp; more", "a tag & more"),
        ("# Heading ##\n> quoted\n- item\n1. one", "heading quoted item one"),
        ("```py\nx = 1\n```", "x = 1"),
        ("ＦＵＬＬ width , spaced .", "full width, spaced."),
        ("", ""),
    ],
)
def test_normalized(given, expected):
    assert X.normalized(given) == expected


def test_headings_leave_the_body():
    text = "# One\nbody\n```\n# not a heading\n```\nTwo\n---\nrest\n\n===\nend"
    headings, body = X.headings_and_body(text)
    assert headings == ["one", "two"]
    assert "not a heading" in body and "end" in body and "one" not in body.split()


def test_tokens_keep_compounds(spark):
    df = spark.createDataFrame([("C++ CI/CD naïve SKILL.md a_b x-y c# --",), (None,), ("",)], "t string")
    rows = [r.k for r in df.select(X.tokens(F.col("t")).alias("k")).collect()]
    assert rows == [["c++", "ci/cd", "naïve", "skill.md", "a_b", "x-y", "c#"], None, []]


def test_small_expressions(spark):
    df = spark.createDataFrame([("=1+1", " Read, ", "a\r\nb\x07\tc ", "https://g.example/o/r/blob/" + "a" * 40 + "/p/SKILL.md", "p/SKILL.md")], "f string, t string, p string, u string, path string")
    r = df.select(X.csv_safe(F.col("f")).alias("f"), X.declared_tool(F.col("t")).alias("t"), X.plain_text(F.col("p")).alias("p"), X.pinned_commit(F.col("u"), F.col("path")).alias("u"), X.word_count(F.lit("it's a well-known +x")).alias("w")).first()
    assert (r.f, r.t, r.p, r.u, r.w) == ("'=1+1", "read", "a\nb\tc", "a" * 40, 4)


def test_embedding_text_and_excerpt(spark):
    df = spark.createDataFrame([("n", None, "x" * 2001)], "a string, b string, c string")
    text = df.select(X.embedding_text(F.col("a"), F.col("b"), F.lit("m"), F.lit(""), F.lit("z")).alias("t")).first().t
    assert text == "name: n\ndescription: \nmetadata: m\nheadings: \nbody: z"
    short, longer = X.excerpt(F.col("c"))
    r = df.select(F.length(short).alias("n"), longer.alias("l")).first()
    assert (r.n, r.l) == (2000, True)


def test_identifiers(spark):
    rows = [("a/b", True), ("-a/b", False), ("a--b/c", False), ("a/..", False), ("a/b/c", False), (" a/b", False), (None, False)]
    df = spark.createDataFrame(rows, "v string, ok boolean")
    assert all(bool(r.x) == r.ok for r in df.select("ok", checks.full_name(F.col("v")).alias("x")).collect())
    paths = spark.createDataFrame([("a/b.md", True), ("/a", False), ("a//b", False), ("a/../b", False), ("a%2f", False), ("a\\b", False), ("a/", False)], "v string, ok boolean")
    assert all(r.x == r.ok for r in paths.select("ok", checks.relative_path(F.col("v")).alias("x")).collect())
    refs = spark.createDataFrame([("main", True), ("a..b", False), ("x.lock", False), ("a b", False), ("@", False), ("f/x", True)], "v string, ok boolean")
    assert all(r.x == r.ok for r in refs.select("ok", checks.git_ref(F.col("v")).alias("x")).collect())
    urls = spark.createDataFrame([("https://h.example/a", True), ("http://h.example/a", False), ("https://u@h.example/", False), ("https://h.example/%2e%2e/x", False), ("https://h.example/a#f", False)], "v string, ok boolean")
    assert all(bool(r.x) == r.ok for r in urls.select("ok", checks.https_url(F.col("v"), "h.example").alias("x")).collect())


def test_table_checks(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 3)], "k int, v string, n int")
    assert [r.k for r in checks.duplicates(df, "k").collect()] == [1]
    assert checks.orphans(df, "k", df.where("k = 1"), "k").count() == 1
    assert checks.increasing(df.withColumn("g", F.lit(0)), "n", "g", "v").count() == 1
    with pytest.raises(checks.ContractError):
        checks.require(df, F.col("k") == 1, "k")
