import pytest
from pyspark.sql import functions as F

from stratalode.functions import classify
from stratalode.functions import text as T
from stratalode.operators import search, units

ESCAPES = [
    ("key:value", r"key\:value"), ("a+b", r"a\+b"), ("a-b", r"a\-b"), ("a&&b", r"a\&\&b"), ("a||b", r"a\|\|b"), ("a!b", r"a\!b"), ("(test)", r"\(test\)"), ("{test}", r"\{test\}"),
    ("[test]", r"\[test\]"), ("a^2", r"a\^2"), ('"quoted"', r"\"quoted\""), ("fuzzy~1", r"fuzzy\~1"), ("wild*card", r"wild\*card"), ("sin?le", r"sin\?le"), ("a/b", r"a\/b"),
]


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_escape(spark):
    got = one(spark, ESCAPES, "a string, b string", T.escape_query(F.col("a")), "b")
    assert all(x == y for x, y in got)


def test_build_query(spark):
    rows = [(" red  widget ",), ("",), (None,)]
    assert one(spark, rows, "a string", T.build_query(F.col("a"), 2)) == [("red~2 widget~2",), ("",), (None,)]
    assert one(spark, rows[:1], "a string", T.build_query(F.col("a"), 0)) == [("red widget",)]
    with pytest.raises(ValueError):
        T.build_query(F.col("a"), 3)
    with pytest.raises(ValueError):
        search.check_request(5, 3)
    assert search.check_request(None, None) == (10, 1) and search.check_request(500, 0) == (100, 0)


def test_pairs(spark):
    rows = [("a|b|USE",), ("|x",), ("none",), (None,)]
    assert one(spark, rows, "p string", T.pair_value(F.col("p")), T.pair_usage(F.col("p"))) == [("a|b", "USE"), (None, None), (None, None), (None, None)]


def test_names(spark):
    rows = [("a.B", True), ("/a/B", True), ("a..B", False), ("1a", False), ("a/B-1", True), ("", False)]
    assert all(x == y for x, y in one(spark, rows, "n string, ok boolean", T.valid_unit(F.col("n")), "ok"))
    rows = [("my-proj_1.0", True), ("a b", False), ("", True), (None, True)]
    assert all(x == y for x, y in one(spark, rows, "n string, ok boolean", T.valid_project(F.col("n")), "ok"))


def test_backoff(spark):
    assert [r[0] for r in one(spark, [(0,), (1,), (9,), (60,)], "a int", T.backoff_seconds(F.col("a")))] == [2, 4, 1024, 3600]


def test_config_rules(spark):
    rows = [
        ("https://x", "k", "URL_RESOURCE"), ("/etc/x", "k", "FILE_PATH"), ("text/plain; x", "k", "MIME_TYPE"), ("text/plain", "k", "FILE_PATH"), ("x", "my.Url", "URL_RESOURCE"), ("x", "log-dir", "FILE_PATH"),
        ("x", "a.regex", "REGEX_PATTERN"), ("x", "date-format", "DATE_FORMAT"), ("x", "name", "CONFIGURATION_VALUE"),
    ]
    assert all(x == y for x, y in one(spark, rows, "v string, k string, want string", classify.classify_config(F.col("v"), F.col("k")), "want"))


def test_call_rules_keep_all_and_fall_back(spark):
    rows = [("my.ErrorLogger", "info"), ("java.sql.Statement", "execute"), ("my.Thing", "run")]
    got = classify.classify_calls(spark.createDataFrame(rows, "callee string, method string")).collect()
    assert {(r.callee, r.semantic_type, r.confidence) for r in got} == {("my.ErrorLogger", "LOG_MESSAGE", 0.75), ("java.sql.Statement", "SQL_FRAGMENT", 0.95), ("my.Thing", "UNKNOWN", 0.0)}


def test_transpositions(spark):
    rows = [("form",), ("from",), ("farm",), ("fomr",)]
    got = one(spark, rows, "t string", search.close(F.col("t"), "form", 1), search.close(F.col("t"), "form", 1, True))
    assert got == [(True, True), (False, True), (True, True), (False, True)]


def test_paging(spark):
    df = spark.range(10).orderBy("id")
    assert [r.id for r in units.page(df, 2, 3, 50).collect()] == [6, 7, 8]
    assert units.page(df, None, None, 4).count() == 4
    with pytest.raises(ValueError):
        units.page(df, -1, 3, 50)


def test_log_escaping(spark):
    given = ["plain [x]", 'a"b\'c\\d', "l1\nl2\r\tl3\b\f", "\x01", "\x01" + "7x", "\x1f9", "\x7f", "é", "😀!", "", None]
    want = ["plain [x]", "a\\\"b\\'c\\\\d", "l1\\nl2\\r\\tl3\\b\\f", "\\1", "\\0017x", "\\379", "\\177", "\\u00e9", "\\ud83d\\ude00!", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string")
    got = {r.k: r.told for r in rows.select("k", T.log_escaped(F.col("t")).alias("told")).collect()}
    assert [got[k] for k in range(len(given))] == want
