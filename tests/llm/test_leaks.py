import random

import numpy as np
import pyarrow as pa

from parchline.llm.leaks import Items, Shard, _frequencies, _shards, build_index, fold, held, leaked_items, open_index

ITEM = "Neither the fiddle nor the ornate carpet scraped unit seven so Venmihal filled both monocles although Karcrofen concealed every pillar near Tolos and the faded pebble still refused many pillows"
OTHER = "Between Wynfen and Morba several gloomy harbours were mended because the telescope had stacked and the walnut dagger was sharpened near the ferry by a patient baker"


def find(spark, docs, items=((1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "tiny item")), **k):
    c = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc int, t string, share string")
    e = spark.createDataFrame(list(items), "n bigint, txt string")
    return {(r[0], r[1]) for r in leaked_items(spark, c, "doc", "t", e, "n", "txt", **k).collect()}


def test_forms(spark):
    w = ITEM.split()
    noise = "The replacement kit contains washers and a gasket for the control panel. " * 30
    misread = " ".join(x.replace("l", "1", 1) if i % 6 == 0 else x for i, x in enumerate(w))
    swapped = " ".join("thing" if i % 7 == 3 else x for i, x in enumerate(w))
    docs = [
        noise + ITEM + noise, ITEM.upper(), "\n> ".join(ITEM.replace("o", "ó").split()), misread, swapped, " ".join(w[: len(w) * 2 // 3]), " ".join(w[:10]) + " see the note below " + " ".join(w[10:]), " ".join(w[:8]) + noise,
        " ".join(sorted(w)), None, "", noise, ITEM + " " + OTHER, "so a tiny item here", "tiny", ITEM, noise * 400 + ITEM,
    ]
    assert find(spark, docs) == {(i, 1) for i in (0, 1, 2, 3, 4, 5, 6, 12, 15, 16)} | {(12, 2), (13, 5)}


def test_blocks_of_items_and_empty(spark):
    assert find(spark, [ITEM, OTHER], items_per_pass=1) == {(0, 1), (1, 2)}
    assert find(spark, []) == set() and find(spark, [ITEM], items=[(3, None)]) == set()


def brute_held(item, doc):
    return max((held(item, doc[s : s + 3 * len(item)]) for s in range(0, max(1, len(doc)), 5)), default=0)


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(4)]
    docs = []
    for _ in range(40):
        words = items[rng.randrange(4)][1].split()
        a = rng.randrange(12)
        part = [rng.choice(vocab) if rng.random() < 0.08 else x for x in words[a : a + rng.randrange(6, 30)]]
        docs.append(" ".join(rng.choices(vocab, k=rng.randrange(0, 80)) + part + rng.choices(vocab, k=rng.randrange(0, 80))))
    want = {(d, i) for d, t in enumerate(docs) for i, x in items if brute_held(fold(x).split(), fold(t).split()) >= 15}
    assert find(spark, docs, items) == want and want


def test_index_is_built_once_and_searched_often(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "so " + ITEM), (2, OTHER), (3, None)], "doc int, t string")
    build_index(corpus, "doc", "t", f"file://{tmp_path}/index")
    index = open_index(spark, f"file://{tmp_path}/index")
    assert sum(len(np.frombuffer(r["place"], dtype=np.int32)) for r in index.collect()) == len(ITEM.split()) + 1 + len(OTHER.split())
    for item, want in ((ITEM, {(1, 7)}), (OTHER, {(2, 7)}), ("nothing of this stands there at all in the corpus", set())):
        e = spark.createDataFrame([(7, item)], "n bigint, txt string")
        assert {(r[0], r[1]) for r in leaked_items(spark, None, "doc", "t", e, "n", "txt", index=index).collect()} == want


def shard(docs, items):
    b = next(_shards(1 << 30)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], names=["k", "t"])])))
    it = Items(list(range(len(items))), items)
    df = np.zeros(len(it.terms), dtype=np.int64)
    for t, n in _frequencies(it, b.select(["term", "df"]), 0):
        df[t] += n
    it.choose(df)
    return Shard(b.column(0)[0].values, [b.column(c)[0].as_py() for c in range(1, 6)], it)


def test_both_ways_to_the_phrases_agree():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    docs = [" ".join(rng.choices(vocab, k=rng.randrange(0, 50))) for _ in range(30)]
    items = [" ".join(rng.choices(vocab, k=20)) for _ in range(9)]
    few, many = shard(docs, items[:1]), shard(docs, items)
    assert few.items.first[-1] and many.items.first[-1]
    for s in (few, many):
        words = [fold(d).split() for d in docs]
        at = {(p, int(s.start[d]) + k) for p in range(len(s.items.pairs)) for d, w in enumerate(words) for k in range(len(w) - 1)
              if (s.at[s.start[d] + k], s.at[s.start[d] + k + 1]) == (s.items.left[p], s.items.right[p])}
        assert set(zip(*[x.tolist() for x in s.phrases()])) == at


def test_long_interruptions_and_many_places():
    w = ITEM.split()
    filler = "and then some other words stand here that have nothing to do with it at all but go on for a while yet".split()
    parted = " ".join(w[:8] + filler[:22] + w[8:16])
    assert [x[:2] for x in shard([parted], [ITEM]).found(0.5, 8)] == [(0, 0)]
    assert [x[2] for x in shard([" ".join([ITEM] * 300)], [ITEM]).found(0.5, 8)] == [1.0]
    assert list(shard([" ".join(w[:6] + filler * 3 + w[6:12])], [ITEM]).found(0.5, 8)) == []


def test_work_does_not_grow_with_items_that_are_not_there():
    rng = random.Random(6)
    doc = " ".join(f"w{rng.randrange(3000)}" for _ in range(20_000))
    s = shard([doc], [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(400)])
    assert len(s.phrases()[0]) < 1000 and len(list(s.candidates())) < 5
