import random

from pyspark.sql import functions as F

from parchline.llm.topn import latest_rows, top_n_per_group


def run(spark, rows, n=3, parts=5):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, score double, id int, __seen string, place string")
        got = top_n_per_group(spark, df, "g", [F.col("score").desc(), F.col("id").asc()], n)
        assert got.columns == ["g", "score", "id", "__seen", "place"] if rows else True
        return sorted((r["g"], r["place"], r["id"]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def want(rows, n):
    out, by = [], {}
    for r in rows:
        if r[0]:
            by.setdefault(r[0], []).append(r)
    for g, rs in by.items():
        rs.sort(key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        out += [(g, k + 1, r[2]) for k, r in enumerate(rs[:n])]
    return sorted(out)


def test_hot_group_over_many_partitions(spark):
    rng = random.Random(1)
    for share, n in ((0.9, 3), (0.34, 40), (0.0, 1)):
        rows = [("hot" if rng.random() < share else f"g{rng.randint(0, 30)}", float(rng.randint(0, 9)), i, "x", "y") for i in range(600)]
        rows += [(None, 1.0, 9001, "x", "y"), ("", 1.0, 9002, "x", "y"), ("nul", None, 9003, "x", "y"), ("nul", 1.0, 9004, "x", "y")]
        assert run(spark, rows, n) == want(rows, n)


def test_one_group_in_every_partition(spark):
    rows = [("a", 1.0, i, "x", "y") for i in range(100)]
    assert run(spark, rows, 70, parts=8) == want(rows, 70)


def test_empty(spark):
    assert run(spark, []) == []


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 3, "z"), ("b", None, "w")], "id string, v int, c string")
    assert sorted(map(tuple, latest_rows(df, "id", "v", ["c"]).collect())) == [("a", "y"), ("b", "w")]
