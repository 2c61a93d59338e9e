"""References to records that are missing, late or deleted.

Parents and children are brought into one long form of tagged keys and aggregated by (parent table, key);
the aggregate keeps only fixed-size state, so a key that a third of all rows name costs one row per task
after map-side combining. Only keys with a failing reference are then met with the children again, in one scan: references to hot
keys are dealt out over salted parts.

Defined results: a null, empty or blank reference refers to nothing and is never reported; a reference
row without arrival time can only be ``missing`` and has a null period; repeated deliveries of a row count
once, at their earliest arrival; an empty parent table makes every reference ``missing``; an empty child
table reports nothing. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchline.functions.partitions import HOT_SHARE, lookup
from parchline.functions.refs import norm_ref
from parchline.session import Scratch


@dataclass(frozen=True)
class Parent:
    """A table that is referred to. ``key`` holds the id column and any columns that must match as well."""

    name: str
    frame: DataFrame
    key: tuple[str, ...] = ("id",)
    arrived: str = "arrived_at"
    deleted: str = "deleted_at"


@dataclass(frozen=True)
class Child:
    """A table of references. The first of ``key`` is the reference itself."""

    name: str
    frame: DataFrame
    parent: str
    key: tuple[str, ...]
    row_id: str = "id"
    arrived: str = "arrived_at"


def _key(columns: tuple[str, ...]):
    first, *rest = columns
    return F.concat_ws("\x1f", norm_ref(first), *[F.coalesce(norm_ref(c), F.lit("")) for c in rest])


def _children(children: list[Child]) -> DataFrame:
    parts = [
        c.frame.where(norm_ref(c.key[0]).isNotNull()).select(
            F.lit(c.name).alias("ref_table"), F.lit(c.parent).alias("parent_table"), F.col(c.row_id).alias("row_id"),
            _key(c.key).alias("key"), F.col(c.arrived).alias("arrived"),
        )
        for c in children
    ]
    return reduce(DataFrame.unionAll, parts)


def key_status(parents: list[Parent], children: list[Child]) -> DataFrame:
    """One row per (parent_table, key) that is referred to and has, or may have, a failing reference."""
    kids = _children(children)
    kind = kids.schema["arrived"].dataType.simpleString()
    own = [
        p.frame.where(F.col(p.key[0]).isNotNull()).select(
            F.lit(p.name).alias("parent_table"), _key(p.key).alias("key"), F.lit(1).alias("is_parent"),
            F.col(p.arrived).cast(kind).alias("arrived"), F.col(p.deleted).cast(kind).alias("deleted"),
        )
        for p in parents
    ]
    tagged = kids.select("parent_table", "key", F.lit(0).alias("is_parent"), "arrived", F.lit(None).cast(kind).alias("deleted"))
    is_parent = F.col("is_parent") == 1
    return (
        reduce(DataFrame.unionAll, [*own, tagged])
        .groupBy("parent_table", "key")
        .agg(
            F.max("is_parent").alias("has_parent"),
            F.min(F.when(is_parent, F.col("arrived"))).alias("first_arrived"),
            F.max("deleted").alias("deleted"),
            F.min(F.when(~is_parent, F.col("arrived"))).alias("ref_min"),
            F.max(F.when(~is_parent, F.col("arrived"))).alias("ref_max"),
            F.sum(1 - F.col("is_parent")).alias("refs"),
        )
        .where("refs > 0 AND (has_parent = 0 OR ref_min < first_arrived OR ref_max >= deleted)")
        .select("parent_table", "key", "has_parent", "first_arrived", "deleted", "refs")
    )


def orphan_references(spark: SparkSession, parents: list[Parent], children: list[Child]) -> DataFrame:
    """(ref_table, row_id, period, reason): one row per reference row that fails."""
    scratch = Scratch(spark, "orphans")
    failing = scratch.save(key_status(parents, children), "failing")
    total = failing.agg(F.sum("refs")).first()[0] or 0
    # fewer than 1 / HOT_SHARE keys, as their shares sum to at most 1
    hot = failing.where(F.col("refs") > max(total * HOT_SHARE, 1))
    met = lookup(_children(children), failing, ["parent_table", "key"], hot)
    once = met.groupBy("ref_table", "row_id", "has_parent", "first_arrived", "deleted").agg(F.min("arrived").alias("arrived"))
    reason = (
        F.when(F.col("has_parent") == 0, "missing")
        .when(F.col("first_arrived") > F.col("arrived"), "late")
        .when(F.col("deleted") <= F.col("arrived"), "deleted")
    )
    return (
        once.select("ref_table", "row_id", F.date_format("arrived", "yyyy-MM").alias("period"), reason.alias("reason"))
        .where("reason IS NOT NULL")
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """(ref_table, period, reason, n_rows): failing references per table and month."""
    return found.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_rows"))
