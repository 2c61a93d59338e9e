import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchline.llm import packing as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.VOCABULARY), reason="no tokenizer file")


def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, "lamp " * rng.randrange(1, 150), "x") for i in range(300)] + [(900, "lamp " * 1000, "x"), (901, None, "x"), (902, "", "x"), (903, "lamp " * 256, "x"), (5, "lamp again", "x")]
    df = spark.createDataFrame(rows, "doc int, t string, container string")
    out = P.pack_documents(spark, df, "doc", "t", capacity=256, shard_items=80, generations=10).persist()
    enc = P.tokenizer(P.VOCABULARY)
    total = sum(len(enc.encode_ordinary(t)) for _, t, _ in rows if t)
    fill = out.groupBy("container").agg(F.sum("tokens").alias("f"), F.count("*").alias("n")).collect()
    assert sum(r["f"] for r in fill) == total and max(r["f"] for r in fill) <= 256
    assert len(fill) <= 1.02 * (total / 256) + 2
    pieces = {}
    for r in out.collect():
        pieces.setdefault(r["doc"], []).append((r["first_token"], r["tokens"]))
    big = len(enc.encode_ordinary("lamp " * 1000))
    assert sorted(pieces[900]) == [(256 * k, min(256, big - 256 * k)) for k in range(4)] and 901 not in pieces and 902 not in pieces
    assert all(len(v) == 1 for k, v in pieces.items() if k not in (900, 903, 5)) and len(pieces[5]) == 2


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc int, t string")
    assert P.pack_documents(spark, df, "doc", "t").count() == 0


def test_crossover_keeps_every_item():
    import numpy as np

    rng = np.random.default_rng(1)
    size = rng.integers(1, 60, 200).tolist()
    a, b = (P.first_packing(size, 100, rng, 0.3) for _ in range(2))
    for _ in range(20):
        c = P.crossover(a, b, size, 100, rng)
        assert sorted(i for x in c.bins for i in x) == list(range(200)) and all(sum(size[i] for i in x) == f <= 100 for x, f in zip(c.bins, c.fill, strict=True))
        a, b = b, c


def test_best_fit_beats_no_one_and_stops_at_the_bound():
    import numpy as np

    size = [60, 40] * 30
    best = P.evolve(size, 100, [], np.random.default_rng(0), 4, 10)
    assert len(best.bins) == 30


def test_crossover_closes_what_best_fit_misses():
    rng = np.random.default_rng(21)
    size = []
    for _ in range(16):  # three documents of about a third of a container each
        a, b = int(rng.integers(340, 480)), int(rng.integers(260, 340))
        size += [a, b, 1000 - int(rng.integers(0, 45)) - a - b]
    g = np.random.default_rng(21)
    fits = [len(P.first_packing(size, 1000, g, 0.15 if k else 0.0).bins) for k in range(6)]
    best = P.evolve(size, 1000, [], np.random.default_rng(21), 6, 60)
    assert min(fits) == 17 and len(best.bins) == 16 == -(-sum(size) // 1000)
    assert sorted(i for b in best.bins for i in b) == list(range(48)) and all(sum(size[i] for i in b) <= 1000 for b in best.bins)
