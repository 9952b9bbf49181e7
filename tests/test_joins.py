"""Null-safe joins."""

from dealerflow.operators.joins import left_join_in_parts, null_safe_join


def rows(df, *names):
    return sorted(
        (tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple(str(v) for v in r)
    )


def test_missing_matches_missing(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("c", 30)], "k string, y int")
    assert rows(null_safe_join(left, right, ["k"]), "k", "x", "y") == [
        (None, 1, 10), ("a", 2, 20), ("b", 3, None),
    ]
    assert rows(null_safe_join(left, right, ["k"], "full"), "k", "x", "y") == [
        (None, 1, 10), ("a", 2, 20), ("b", 3, None), ("c", None, 30),
    ]
    assert rows(null_safe_join(left, right, ["k"], "left_anti"), "k", "x") == [("b", 3)]
    assert rows(null_safe_join(left, right, ["k"], "inner"), "k", "x", "y") == [
        (None, 1, 10), ("a", 2, 20),
    ]


def test_two_keys_of_which_one_is_missing(spark):
    left = spark.createDataFrame([(1, None), (1, "n"), (None, None)], "id int, name string")
    right = spark.createDataFrame([(1, None, 5), (None, None, 6), (0, "", 7)], "id int, name string, v int")
    assert rows(null_safe_join(left, right, ["id", "name"]), "id", "name", "v") == [
        (1, None, 5), (1, "n", None), (None, None, 6),
    ]


def test_self_join(spark):
    table = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    other = table.groupBy("k").count()
    assert rows(null_safe_join(table, other, ["k"]), "k", "x", "count") == [(None, 1, 1), ("a", 2, 1)]


def test_left_join_in_parts_equals_left_join(spark):
    left = spark.createDataFrame(
        [(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "k string, x int"
    )
    right = spark.createDataFrame(
        [(None, 10), ("a", 20), ("a", 21), ("c", 30)], "k string, y int"
    )
    expected = rows(null_safe_join(left, right, ["k"]), "k", "x", "y")
    assert rows(left_join_in_parts(left, right, ["k"]), "k", "x", "y") == expected
    assert len(expected) == 7
