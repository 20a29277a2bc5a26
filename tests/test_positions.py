import pytest

from chatloom.operators import positions


@pytest.mark.parametrize("n", [1, 5, 10, 15, 100])
def test_positional_split(spark, n):
    df = spark.range(n).selectExpr("id * 3 AS ord", "'' AS id")
    rows = positions.train_eval_split(df).orderBy("pos").collect()
    train = [r["pos"] for r in rows if r["is_train"]]
    ev = [r["pos"] for r in rows if r["is_eval"]]
    assert train == list(range(int(n * 0.9)))
    assert ev == list(range(n - max(1, int(n * 0.1)), n))


def test_dense_positions_many_buckets(spark):
    df = spark.range(5000).selectExpr("id * 7 + 3 AS ord")
    got = [r["pos"] for r in positions.dense_positions(df, buckets=13).orderBy("ord").collect()]
    assert got == list(range(5000))


def test_assign_ids_keeps_given(spark):
    df = spark.createDataFrame([(5, "keep"), (9, ""), (2, None)], "ord long, id string")
    got = {r["ord"]: r["id"] for r in positions.assign_ids(df).collect()}
    assert got == {2: "sample_0000", 5: "keep", 9: "sample_0002"}


def test_dense_positions_by_multi(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("c", 0)], "k string, j int")
    got = [(r["k"], r["j"], r["ord"]) for r in positions.dense_positions_by(df, ["k", "j"], buckets=3).orderBy("ord").collect()]
    assert got == [("a", 1, 0), ("a", 2, 1), ("b", 1, 2), ("c", 0, 3)]
