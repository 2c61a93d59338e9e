"""Ranked lists of several searches as one, nearest vectors, hit rates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reciprocal_rank(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, rrf) of ranked lists (key, rank from 1)."""
    return reduce(DataFrame.unionAll, [x.select(key, "rank") for x in lists]).groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], n: int) -> DataFrame:
    """The ``n`` rows with the greatest cosine to one query vector, exactly: one pass and a top-n."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = lambda v: F.sqrt(dot(v, v))
    cos = dot(F.col(vector), q) / (norm(F.col(vector)) * norm(q))
    return vectors.where(F.col(vector).isNotNull()).select(key, cos.alias("cosine")).orderBy(F.desc("cosine"), key).limit(n)


def recall(found: DataFrame, wanted: DataFrame, query: str, key: str) -> DataFrame:
    """(query, recall): share of the wanted keys of each query that were found."""
    hit = wanted.join(found.select(query, key).distinct().withColumn("hit", F.lit(1)), [query, key], "left")
    return hit.groupBy(query).agg((F.count("hit") / F.count("*")).alias("recall"))


def rolling_share(df: DataFrame, by: str, order: str, good: Column, rows: int = 30) -> DataFrame:
    """Share of good ones among the last ``rows`` of each group."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("share", F.avg(good.cast("double")).over(w))


def nearest_each(vectors: DataFrame, queries: DataFrame, key: str, vector: str, n: int, query: str = "query_id") -> DataFrame:
    """(query, key, cosine): the ``n`` rows with the greatest cosine to each row of ``queries`` (same columns as ``vectors``), exactly.

    Both sides are packed into blocks of an Arrow batch each, and every pair of blocks is one matrix product; a task keeps
    only the ``n`` best rows of each of its queries. Cosines are compared at 12 decimals, so that equal vectors
    tie and the lesser key wins. Keys are unique. Vectors that are null, of length 0 or not finite have no cosine; all have the same dimension."""
    kind = vectors.schema[key].dataType
    packed = lambda k, v: T.StructType([T.StructField(k, T.ArrayType(kind)), T.StructField(v, T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            with np.errstate(all="ignore"):
                m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
            fit = np.isfinite(m).all(axis=1)
            keys = b.column(0).filter(pa.array(fit))
            if len(keys):
                lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([lists, pa.array([m[fit].tobytes()], pa.binary())], names=["k", "v"])

    def best(cosine: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(cosine) > n:
            on = cosine >= np.partition(cosine, len(cosine) - n)[len(cosine) - n]
            cosine, keys = cosine[on], keys[on]
        by = np.lexsort((keys, -cosine))[:n]
        return cosine[by], keys[by]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, raw, top, types = None, None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            for q, (cosine, keys) in zip(own if own is not None else [], top):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(keys), types), pa.array(keys, types), pa.array(cosine)], names=[query, key, "cosine"])

        for b in batches:
            for i in range(b.num_rows):
                qk, qv, vk, vv = (b.column(j)[i] for j in range(4))
                ids = qk.values.to_pylist()
                if own is None or ids != own:
                    yield from done()
                    types, own = qk.values.type, ids
                    raw = np.frombuffer(qv.as_py(), dtype=np.float64).reshape(len(own), -1)
                    top = [(np.zeros(0), vk.values.to_numpy(zero_copy_only=False)[:0])] * len(own)
                keys = vk.values.to_numpy(zero_copy_only=False)
                found = np.round(raw @ np.frombuffer(vv.as_py(), dtype=np.float64).reshape(len(keys), -1).T, 12)
                top = [best(np.append(c, f), np.append(k, keys)) for (c, k), f in zip(top, found)]
        yield from done()

    side = lambda df, k, v: df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector).mapInArrow(pack, packed("k", "v")).toDF(k, v)
    # queries outside: a task meets all its vectors with one block of queries before the next
    pairs = side(queries, "qk", "qv").hint("shuffle_replicate_nl").crossJoin(side(vectors, "vk", "vv"))
    schema = T.StructType([T.StructField(query, kind), T.StructField(key, kind), T.StructField("cosine", T.DoubleType())])
    near = pairs.mapInArrow(search, schema)
    w = Window.partitionBy(query).orderBy(F.desc("cosine"), key)
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")
