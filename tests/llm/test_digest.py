import numpy as np
from pyspark.sql import functions as F

from parchline.llm import digest as D


def test_rank_error_is_bounded_and_merging_agrees(spark):
    rng = np.random.default_rng(3)
    rows = [("a", int(i % 7), float(x)) for i, x in enumerate(rng.lognormal(0, 2, 6000))] + [("b", 0, 5.0)] * 300 + [("c", 1, 1.5)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(6)
    daily = D.digest(df, ["g", "day"], "v")
    got = D.certified(df, ["g"], "v", D.percentiles(D.merge(daily, ["g"]), ["g"])).collect()
    for r in got:
        x = np.array([v for g, _, v in rows if g == r["g"]])
        lo, hi = (x < r["value"]).mean(), (x <= r["value"]).mean()
        assert abs(max(0, lo - r["q"], r["q"] - hi) - r["rank_error"]) < 1e-9 and r["rank_error"] < 0.01 and r["n"] == len(x)
    assert {r["value"] for r in got if r["g"] == "b"} == {5.0} and {r["value"] for r in got if r["g"] == "c"} == {1.5}
    assert daily.groupBy("g", "day").count().agg(F.max("count")).first()[0] < 250


def test_empty_and_null_groups(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert D.certified(df, ["g"], "v", D.percentiles(D.digest(df, ["g"], "v"), ["g"])).count() == 0
    df = spark.createDataFrame([(None, 1.0), ("", 2.0)], "g string, v double")
    assert D.percentiles(D.digest(df, ["g"], "v"), ["g"], (0.5,)).count() == 2


def test_clusters_stay_small():
    v = np.arange(100_000.0)
    z = np.zeros(len(v), dtype=np.int64)
    g, m, w, lo, hi = D.cluster(z, v, np.ones(len(v)), v, v, 400.0)
    assert w.sum() == len(v) and w.max() <= np.pi / 400 * len(v) + 1 and w[0] < 50 and (lo[1:] > hi[:-1]).all()


def test_merging_in_levels(spark, monkeypatch):
    monkeypatch.setattr(D, "FAN", 2)
    rng = np.random.default_rng(4)
    rows = [("a", int(i % 90), float(x)) for i, x in enumerate(rng.normal(0, 1, 5000))]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(9)
    for made in (D.digest(df, ["g"], "v"), D.merge_over(D.digest(df, ["g", "day"], "v"), ["g"], ["day"])):
        assert made.agg(F.sum("weight")).first()[0] == len(rows) and made.count() < 250
        assert max(r["rank_error"] for r in D.certified(df, ["g"], "v", D.percentiles(made, ["g"])).collect()) <= np.pi / 400
