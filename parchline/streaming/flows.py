"""The ledgers as streams. Every flow bounds its state by a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def demand(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "2 hours", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts per tumbling window; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def once_per_key(requests: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first request of each idempotency key within the watermark; replays are left out."""
    return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def late_references(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, ts: str = "arrived_at", wait: str = "1 day") -> DataFrame:
    """Stream-stream left join: references with their parents as they arrive; after ``wait`` without one, the reference comes out
    with a null parent time."""
    c = children.withWatermark(ts, wait).withColumnsRenamed({ts: "child_at", child_key: "ref"})
    p = parents.select(F.col(parent_key).alias("parent_id"), F.col(ts).alias("parent_at")).withWatermark("parent_at", wait)
    near = F.expr(f"ref = parent_id AND parent_at BETWEEN child_at - INTERVAL {wait} AND child_at + INTERVAL {wait}")
    return c.join(p, near, "left")


def dispatch(outbox: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, kind: str = "kind") -> StreamingQuery:
    """Hands each micro-batch's rows to the handler of their kind. A batch may be replayed after a failure, so handlers get the batch
    number and must be idempotent; kinds without a handler are skipped; an error in one handler does not keep the others
    from their rows, and fails the batch after they ran."""

    def batch(df: DataFrame, number: int) -> None:
        errors = []
        df.persist()
        try:
            for name, handle in handlers.items():
                try:
                    handle(df.where(F.col(kind) == name), number)
                except Exception as e:  # the batch is retried as a whole
                    errors.append((name, e))
        finally:
            df.unpersist()
        if errors:
            raise RuntimeError(f"handlers failed: {errors}")

    return outbox.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
