"""Top N items of every group through one global sort.

The rows are range-partitioned on (group, sort keys), so a group with any share of the rows is spread over
as many partitions as it fills. Within its partition every row gets a position in its group; per-partition
group counts are then prefix-summed into exact positions. A row whose position in its own partition
exceeds N cannot be among the first N, so partitions pass on at most N rows of a group and counts up to N,
and only the first and last group of a partition can reach into another: the table of counts has at most
two rows per partition, which bounds what is broadcast.

Defined results: rows of a null or empty group are left out; sort keys order nulls as given; ties are broken by
the caller's last key, which should be unique; wholly equal rows keep one place each; an empty table gives
an empty result; extra columns are carried along, whatever their names (one named as ``place`` is replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchline.session import Scratch

def _own_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have."""
    mark = "__"
    while any(f"{mark}{n}" in df.columns for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def _local_positions(n: int, PART: str, KIND: str, SEEN: str, GROUP: str):
    """Adds position in partition and group to sorted batches; keeps positions up to n. The partition ends with
    marker rows (kind 1) for its first and last group and their counts, cut at n."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, count, first, first_count, schema = None, 0, None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            g = b.column(b.schema.get_field_index(GROUP))
            size = b.num_rows
            new = np.ones(size, dtype=bool)
            if size > 1:
                new[1:] = pc.not_equal(g.slice(1), g.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            new[0] = g[0].as_py() != last
            at = np.arange(size)
            starts = np.maximum.accumulate(np.where(new, at, -1))
            seen = np.where(starts >= 0, at - starts + 1, at + 1 + count)
            if first is None:
                first = g[0].as_py()
            ends = np.flatnonzero(np.append(new[1:], True))
            if g[0].as_py() == first:  # sorted: its run can only open a batch
                first_count = int(seen[ends[0]])
            last, count = g[size - 1].as_py(), int(seen[-1])
            keep = pa.array(seen <= n)
            out = b.filter(keep)
            k = out.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, part, dtype=np.int32)), pa.array(np.zeros(k, dtype=np.int8)), pa.array(seen[seen <= n].astype(np.int64)), *out.columns],
                names=[PART, KIND, SEEN, *out.schema.names],
            )
        if schema is None:
            return
        edges = {first: min(first_count, n)} | {last: min(count, n)}
        k = len(edges)
        cols = [pa.array(list(edges), type=f.type) if f.name == GROUP else pa.nulls(k, f.type) for f in schema]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * k, pa.int32()), pa.array([1] * k, pa.int8()), pa.array(list(edges.values()), pa.int64()), *cols], names=[PART, KIND, SEEN, *schema.names]
        )

    return run


def top_n_per_group(spark: SparkSession, df: DataFrame, group: str, order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows of every non-null ``group`` by ``order``, with their ``place`` from 1."""
    scratch = Scratch(spark, "topn")
    PART, KIND, SEEN, GROUP, BEFORE = _own_names(df, "part", "kind", "seen", "group", "before")
    key = F.col(group).cast("string")
    rows = df.where(key.isNotNull() & (key != "")).withColumn(GROUP, key)
    ordered = rows.repartitionByRange(F.col(GROUP).asc(), *order).sortWithinPartitions(F.col(GROUP).asc(), *order)
    schema = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField(KIND, T.ByteType()), T.StructField(SEEN, T.LongType()), *[T.StructField(f.name, f.dataType, True) for f in ordered.schema]])
    local = scratch.save(ordered.mapInArrow(_local_positions(n, PART, KIND, SEEN, GROUP), schema), "local")
    edges = local.where(F.col(KIND) == 1).select(GROUP, PART, SEEN)
    earlier = F.sum(F.col(SEEN)).over(Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    offsets = edges.select(GROUP, PART, F.coalesce(earlier, F.lit(0)).alias(BEFORE)).where(F.col(BEFORE) > 0)
    # at most two rows per partition of the sort
    out = local.where(F.col(KIND) == 0).join(F.broadcast(offsets), [GROUP, PART], "left")
    at = F.col(SEEN) + F.coalesce(BEFORE, F.lit(0))
    return out.where(at <= n).select(*[F.col(f"`{c}`") for c in df.columns if c != place], at.cast("int").alias(place))


def latest_rows(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """Of each ``key`` one row with the highest ``version`` (of equal versions the greatest row)."""
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, *columns)).alias("__b"))
    return best.select(key, *[F.col(f"__b.{c}").alias(c) for c in columns])
