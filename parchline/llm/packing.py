"""Documents packed into containers of a fixed number of tokens by a grouping genetic algorithm.

Documents are hashed into shards of about ``shard_items`` items, whatever their source, so no shard grows with the data.
Each shard is packed on several islands: populations of packings that start from best-fit with differently disturbed
orders. A crossover injects whole well-filled containers of one parent into the other, removes the containers that now
hold an item twice, and puts displaced items back best-fit first. After every epoch each island sends its elite to
the next one. An island stops when its packing needs no more containers than the sum of sizes demands. Containers that stay
underfilled are dissolved and their items packed once more across shards.

Only a document that is larger than a container is divided: into full containers and a rest, which is packed like a
document. Sizes are tokens of a public tokenizer, whose file is a parameter. Defined results: null and empty texts
have no tokens and are in no container; equal documents are items each; ties are broken by document id.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchline.session import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how the public byte-level vocabulary cuts text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens) of every row with text. The vocabulary file is read where it lies; executors that do not have it get the driver's."""
    if os.path.exists(vocabulary):
        df.sparkSession.sparkContext.addFile(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        enc = tokenizer(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary)))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["key", "tokens"])

    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("tokens", T.LongType())])).withColumnRenamed("key", key)


class Packing:
    """Containers as lists of item numbers, with their fill."""

    __slots__ = ("bins", "fill")

    def __init__(self, bins: list[list[int]], fill: list[int]):
        self.bins, self.fill = bins, fill

    def fitness(self, capacity: int) -> float:
        """Few containers, and of as many the more unequal: well-filled ones and one with room."""
        return sum((f / capacity) ** 2 for f in self.fill) / len(self.fill) if self.fill else 1.0


def insert(packing: Packing, items: list[int], size: list[int], capacity: int) -> None:
    """Best fit: every item goes where it leaves the least room."""
    room = sorted((capacity - f, k) for k, f in enumerate(packing.fill))
    for i in items:
        at = bisect_left(room, (size[i], -1))
        if at == len(room):
            packing.bins.append([i])
            packing.fill.append(size[i])
            left, k = capacity - size[i], len(packing.bins) - 1
        else:
            left, k = room.pop(at)
            packing.bins[k].append(i)
            packing.fill[k] += size[i]
            left -= size[i]
        insort(room, (left, k))


def first_packing(size: list[int], capacity: int, rng: np.random.Generator, disturb: float) -> Packing:
    weight = np.array(size) * (1 + disturb * rng.standard_normal(len(size)))
    out = Packing([], [])
    insert(out, np.argsort(-weight, kind="stable").tolist(), size, capacity)
    return out


def crossover(a: Packing, b: Packing, size: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Well-filled containers of b injected into a."""
    order = sorted(range(len(b.bins)), key=lambda k: -b.fill[k])
    take = order[: max(1, int(len(order) * rng.uniform(0.1, 0.5)))]
    inside = {i for k in take for i in b.bins[k]}
    keep = [k for k in range(len(a.bins)) if inside.isdisjoint(a.bins[k])]
    # with them go the emptiest containers that are left, or nothing could change place
    keep.sort(key=lambda k: -a.fill[k])
    keep = keep[: len(keep) - max(1, len(keep) // 20)]
    child = Packing([list(b.bins[k]) for k in take] + [list(a.bins[k]) for k in keep], [b.fill[k] for k in take] + [a.fill[k] for k in keep])
    held = set().union(*map(set, child.bins)) if child.bins else set()
    loose = [i for i in range(len(size)) if i not in held]
    loose.sort(key=lambda i: -size[i])
    insert(child, loose, size, capacity)
    return child


def evolve(size: list[int], capacity: int, seeds: list[Packing], rng: np.random.Generator, population: int, generations: int) -> Packing:
    least = -(-sum(size) // capacity)
    group = list(seeds)
    for k in range(population - len(group)):
        group.append(first_packing(size, capacity, rng, 0.0 if not seeds and not k else 0.15))
        if len(group[-1].bins) <= least:
            return group[-1]
    scored = sorted(((len(p.bins), -p.fitness(capacity), n, p) for n, p in enumerate(group)), key=lambda x: x[:3])
    tick = len(scored)
    for _ in range(generations):
        if scored[0][0] <= least:
            break
        # parents from a tournament of two, the child takes the place of the worst
        x, y = (scored[min(rng.integers(len(scored), size=2))][3] for _ in range(2))
        child = crossover(x, y, size, capacity, rng)
        tick += 1
        scored[-1] = (len(child.bins), -child.fitness(capacity), tick, child)
        scored.sort(key=lambda s: s[:3])
    return scored[0][3]


STATE = "shard bigint, island int, item array<bigint>, size array<int>, bin array<int>, bins int, fitness double"


def _island(capacity: int, population: int, generations: int, epoch: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, island = (k.as_py() for k in key)
        rng = np.random.default_rng([int(shard) & 0x7FFFFFFF, int(island), epoch])
        seeds = []
        if "bin" in table.schema.names:
            rows = table.to_pylist()
            item, size = rows[0]["item"], rows[0]["size"]
            for r in rows:
                place = dict(zip(r["item"], r["bin"], strict=True))
                bins: list[list[int]] = [[] for _ in range(r["bins"])]
                for n, i in enumerate(item):
                    bins[place[i]].append(n)
                seeds.append(Packing(bins, [sum(size[n] for n in b) for b in bins]))
        else:
            table = table.sort_by("item")
            item, size = table["item"].to_pylist(), table["size"].to_pylist()
        best = evolve(size, capacity, seeds, rng, max(population, len(seeds)), generations)
        place = [0] * len(item)
        for k, b in enumerate(best.bins):
            for n in b:
                place[n] = k
        row = {"shard": [shard], "island": [island], "item": [item], "size": [size], "bin": [place], "bins": [len(best.bins)], "fitness": [best.fitness(capacity)]}
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.float64()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(row.items(), types, strict=True)})

    return run


def _pack(scratch: Scratch, items: DataFrame, n: int, capacity: int, islands: int, epochs: int, population: int, generations: int, shard_items: int) -> DataFrame:
    """Items (item, size) to (shard, bin, item, size)."""
    shards = max(1, -(-n // shard_items))
    spread = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("bigint")).withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)])))
    state = scratch.save(spread.select("shard", "island", "item", F.col("size").cast("int").alias("size")).groupBy("shard", "island").applyInArrow(_island(capacity, population, generations, 0), STATE), "epoch")
    for epoch in range(1, epochs):
        moved = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        state = scratch.save(state.unionByName(moved).groupBy("shard", "island").applyInArrow(_island(capacity, population, generations, epoch), STATE), "epoch")
    best = state.groupBy("shard").agg(F.max_by(F.struct("item", "size", "bin"), F.struct(-F.col("bins"), "fitness", "island")).alias("b"))
    return best.select("shard", F.explode(F.arrays_zip("b.item", "b.size", "b.bin")).alias("r")).select("shard", "r.bin", "r.item", "r.size")


def pack_documents(
    spark: SparkSession, df: DataFrame, key: str, text: str, capacity: int = 2048, vocabulary: str = VOCABULARY,
    islands: int = 2, epochs: int = 2, population: int = 6, generations: int = 30, shard_items: int = 2000, underfilled: float = 0.99,
) -> DataFrame:
    """(container, key, piece, first_token, tokens): where every document went; ``piece`` counts the parts of a divided one."""
    scratch = Scratch(spark, "packing")
    sizes = scratch.save(token_sizes(df, key, text, vocabulary), "sizes")
    # a document is one item, equal keys are different rows: number the rows
    numbered = scratch.save(sizes.where("tokens > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    whole = numbered.where(F.col("tokens") >= capacity).select("item", key, F.posexplode(F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("tokens") / capacity))).alias("piece", "__n"))
    full = whole.select(F.concat_ws("-", F.lit("full"), "item", "piece").alias("container"), key, "piece", (F.col("piece") * capacity).cast("bigint").alias("first_token"), F.lit(capacity).cast("bigint").alias("tokens"))
    rest = numbered.select("item", key, (F.col("tokens") % capacity).alias("size"), F.floor(F.col("tokens") / capacity).cast("int").alias("piece")).where("size > 0")
    n = rest.count()
    first = scratch.save(_pack(scratch, rest.select("item", "size"), n, capacity, islands, epochs, population, generations, shard_items), "first")
    fill = first.groupBy("shard", "bin").agg(F.sum("size").alias("fill"))
    tight = fill.where(F.col("fill") >= underfilled * capacity).select("shard", "bin")
    done = first.join(tight, ["shard", "bin"], "left_semi").select(F.concat_ws("-", F.lit("a"), "shard", "bin").alias("container"), "item", "size")
    loose = first.join(tight, ["shard", "bin"], "left_anti").select("item", "size")
    m = loose.count()
    if m:
        again = scratch.save(_pack(scratch, loose, m, capacity, islands, epochs, population, generations, shard_items), "second")
        done = done.unionByName(again.select(F.concat_ws("-", F.lit("b"), "shard", "bin").alias("container"), "item", "size"))
    placed = done.join(rest.select("item", key, "piece"), "item")
    placed = placed.select("container", key, "piece", (F.col("piece") * capacity).cast("bigint").alias("first_token"), F.col("size").cast("bigint").alias("tokens"))
    return placed.unionByName(full)
