"""Totals beside groups whose keys are null, empty or look like a total."""

from pyspark.sql import functions as F

from earshot.operators import summary


def test_null_groups_are_not_totals(spark):
    df = spark.createDataFrame([(None, "p", 60.0), ("a", "p", 120.0), ("a", "q", 60.0)], "region string, playlist string, duration double")
    got = {(r.level, r.region): (r.segments, r.minutes, r.playlists) for r in summary.corpus_totals(df, "region", {"playlists": "playlist"}).collect()}
    assert got == {("group", None): (1, 1.0, 1), ("group", "a"): (2, 3.0, 2), ("total", None): (3, 4.0, 2)}
    got = {(r.level, r.region): (r.n, r.ok) for r in summary.coverage(df, "region", {"ok": F.col("duration") > 60}).collect()}
    assert got == {("group", None): (1, 0), ("group", "a"): (2, 1), ("total", None): (3, 1)}
    got = {(r.level, r.region): r.duration for r in summary.run_totals(df, "region", ["duration"]).collect()}
    assert got == {("group", None): 60.0, ("group", "a"): 180.0, ("total", None): 240.0}


def test_crosstab_keeps_null_empty_and_all_apart(spark):
    df = spark.createDataFrame([("All", "x"), (None, "x"), ("", "x"), ("", None)], "a string, b string")
    got = [(r.a, r.b, r.level, r.n) for r in summary.crosstab(df, "a", "b").collect()]
    assert len(got) == len(set(got))
    assert {x for x in got if x[2] == "cell"} == {("All", "x", "cell", 1), (None, "x", "cell", 1), ("", "x", "cell", 1), ("", None, "cell", 1)}
    assert {x for x in got if x[2] == "by_a"} == {("All", "All", "by_a", 1), (None, "All", "by_a", 1), ("", "All", "by_a", 2)}
    assert {x for x in got if x[2] == "by_b"} == {("All", "x", "by_b", 3), ("All", None, "by_b", 1)}
    assert {x for x in got if x[2] == "total"} == {("All", "All", "total", 4)}
