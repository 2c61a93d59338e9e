"""Percentiles from merging centroid digests, with a certified rank error.

A digest is a set of centroids (mean, weight, least and greatest value). Sorted values are clustered so that no cluster spans more than one
unit of the scale k(q) = delta / (2 pi) * asin(2 q - 1): clusters are small at both ends and never hold more than
about pi / delta of the weight. Digests merge by putting their centroids together and clustering again, so
results of partitions, days or sites combine in any order.

Tasks digest their own rows for all groups at once (no row is shuffled for it), so a group with a third of all rows is many
small digests; these merge per group and day, and days per group. Merging goes in levels, ``FAN`` digests at a time, so no
task sorts more than a few thousand centroids of a group however many tasks or days there are. A second pass over the values counts, for
every estimate, how many values lie below it and at or below it, which gives its exact rank error.

Defined results: nulls, NaN, infinities and values outside the measurement's possible range are not measurements and are
left out; a group without any measurement has no row; a single value is every percentile; repeated rows are the
caller's to remove.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CENTROID = ("mean", "weight", "lo", "hi")
QS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: digests of one group that are merged at once
FAN = 64


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, delta: float) -> tuple[np.ndarray, ...]:
    """Clusters the centroids of many groups at once: (group, mean, weight, lo, hi), sorted by group and mean."""
    if not len(group):
        return group, mean, weight, lo, hi
    order = np.lexsort((mean, group))
    group, mean, weight, lo, hi = group[order], mean[order], weight[order], lo[order], hi[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    total = np.repeat(np.add.reduceat(weight, first), size)
    run = np.cumsum(weight)
    before = run - weight - np.repeat(run[first] - weight[first], size)
    q = (before + weight / 2) / total
    cell = np.floor(delta / (2 * math.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1))).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])])
    w = np.add.reduceat(weight, cut)
    lo, hi = np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
    # equal values stay exactly what they are
    return group[cut], np.clip(np.add.reduceat(mean * weight, cut) / w, lo, hi), w, lo, hi


def quantile(weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: float) -> float:
    """Within the range of the cluster that holds rank q."""
    rank = q * weight.sum()
    end = np.cumsum(weight)
    k = min(int(np.searchsorted(end, rank)), len(weight) - 1)
    return float(lo[k] + (hi[k] - lo[k]) * min(1.0, max(0.0, (rank - end[k] + weight[k]) / weight[k])))


def _digest_rows(delta: float, hold: int = 1 << 18):
    """Rows (key, value) to centroid rows; whatever the number of rows, a task holds ``hold`` of them and its digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        names: dict[str, int] = {}
        parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, dtype=np.int64), *[np.zeros(0)] * 4)]
        waiting = 0

        def tidy() -> tuple[np.ndarray, ...]:
            return cluster(*[np.concatenate(c) for c in zip(*parts, strict=True)], delta)

        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            local = np.array([names.setdefault(k, len(names)) for k in coded.dictionary.to_pylist()], dtype=np.int64)
            v = b.column(1).to_numpy()
            parts.append((local[coded.indices.to_numpy()], v, np.ones(len(v)), v, v))
            waiting += b.num_rows
            if waiting >= hold:
                parts, waiting = [tidy()], 0
        group, *rest = tidy()
        keys = np.array(list(names), dtype=object)
        for at in range(0, len(group), 50_000):
            s = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(group[s]), task, dtype=np.int32)), pa.array(keys[group[s]], pa.string()), *[pa.array(c[s]) for c in rest]], names=["task", "key", *CENTROID])

    return run


def digest(values: DataFrame, keys: list[str], value: str, delta: float = 400.0) -> DataFrame:
    """Centroid rows (keys, mean, weight, lo, hi) of every group: one digest per task that saw the group, then merged."""
    packed = values.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), F.col(value).cast("double").alias("value"))
    own = packed.mapInArrow(_digest_rows(delta), "task int, key string, " + ", ".join(f"{c} double" for c in CENTROID))
    kind = F.from_json("key", values.select(*keys).schema).alias("k")
    rows, tasks = own.select(kind, F.col("task").alias("__of"), *CENTROID).select("k.*", "__of", *CENTROID), packed.rdd.getNumPartitions()
    while tasks > FAN:
        rows, tasks = merge(rows.withColumn("__of", F.floor(F.col("__of") / FAN).cast("int")), [*keys, "__of"], delta), -(-tasks // FAN)
    return merge(rows.drop("__of"), keys, delta)


def merge_over(centroids: DataFrame, keys: list[str], over: list[str], delta: float = 400.0) -> DataFrame:
    """The digests of each group of ``keys``, one of each value of ``over``, as one: first in ``FAN`` parts, then these."""
    part = F.pmod(F.xxhash64(*over), F.lit(FAN)).alias("__of")
    return merge(merge(centroids.select(*keys, part, *CENTROID), [*keys, "__of"], delta).drop("__of"), keys, delta)


def merge(centroids: DataFrame, keys: list[str], delta: float = 400.0) -> DataFrame:
    """Re-clusters the centroids of each group of ``keys``."""
    by = Window.partitionBy(*keys)
    run = by.orderBy("mean", "weight").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = (F.sum("weight").over(run) - F.col("weight") / 2) / F.sum("weight").over(by)
    angle = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * q - 1)))
    cell = F.floor(F.lit(delta / (2 * math.pi)) * angle)
    out = centroids.withColumn("__cell", cell).groupBy(*keys, "__cell")
    out = out.agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("m"), F.sum("weight").alias("weight"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select(*keys, F.least("hi", F.greatest("lo", "m")).alias("mean"), "weight", "lo", "hi")


def percentiles(centroids: DataFrame, keys: list[str], qs: tuple[float, ...] = QS) -> DataFrame:
    """(keys, estimates): the estimates of ``qs`` for each group. A digest is bounded by delta, so it is one small row."""
    rows = centroids.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*CENTROID))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            est = []
            for c in b.column(b.num_columns - 1):
                weight, lo, hi = (c.values.field(k).to_numpy() for k in (1, 2, 3))
                est.append([quantile(weight, lo, hi, q) for q in qs])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(est, pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "estimates"])

    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("estimates", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def certified(values: DataFrame, keys: list[str], value: str, estimates: DataFrame, qs: tuple[float, ...] = QS) -> DataFrame:
    """(keys, q, value, n, rank_error): the counting pass. The rank error is how far q lies outside the ranks that the
    estimate holds among the values, as a share of them; 0 if it is exact."""
    joined = values.join(estimates, keys)
    counts = [F.sum((F.col(value) < F.col("estimates")[i]).cast("bigint")).alias(f"lt{i}") for i in range(len(qs))]
    counts += [F.sum((F.col(value) <= F.col("estimates")[i]).cast("bigint")).alias(f"le{i}") for i in range(len(qs))]
    agg = joined.groupBy(*keys, "estimates").agg(F.count("*").alias("n"), *counts)
    lines = F.array(
        *[
            F.struct(
                F.lit(q).alias("q"), F.col("estimates")[i].alias("value"),
                F.greatest(F.lit(0.0), F.col(f"lt{i}") / F.col("n") - F.lit(q), F.lit(q) - F.col(f"le{i}") / F.col("n")).alias("rank_error"),
            )
            for i, q in enumerate(qs)
        ]
    )
    return agg.select(*keys, "n", F.explode(lines).alias("l")).select(*keys, "l.q", "l.value", "n", "l.rank_error")
