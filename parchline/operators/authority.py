"""Which of many records about an object holds.

A record that another one about the same object supersedes is out. Of the rest the best-ranked principals count (owners first, then the given
order). If they are one principal, its latest statement wins; if several, the latest recorded one wins only if no
other takes effect later, else there is a conflict and no winner. An object whose records are all superseded has neither winner nor conflict. One aggregate per object: no window sorts an
object's records, so an object with very many records is reduced before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchline.functions.refs import norm_ref


def principal_rank(principal: Column, owners: list[str], precedence: list[str]) -> Column:
    """(0 for owners, else 1; place in the precedence) as one number."""
    place = F.lit(1_000_000)
    for i, p in reversed(list(enumerate(precedence))):
        place = F.when(principal == p, F.lit(i)).otherwise(place)
    return F.when(principal.isin(owners), F.lit(0)).otherwise(F.lit(10_000_000)) + place


KEYS = ["object_kind", "object_id"]


def active_records(records: DataFrame) -> DataFrame:
    """Records, once each, that no record about the same object supersedes."""
    once = records.distinct()
    named = once.select(*KEYS, norm_ref("supersedes").alias("id")).where("id IS NOT NULL").distinct()
    return once.join(named, [*KEYS, "id"], "left_anti")


def resolve(records: DataFrame, owners: list[str], precedence: list[str]) -> DataFrame:
    """(object_kind, object_id, winner, status, conflict, n_top): the record that holds for each object that has any."""
    keys = KEYS
    live = active_records(records).withColumn("rank", principal_rank(F.col("principal"), owners, precedence))
    best = live.groupBy(*keys).agg(F.min("rank").alias("rank"))
    top = live.join(best, [*keys, "rank"])
    effective = F.coalesce("effective_date", F.lit(""))
    body = F.struct("id", "status", effective.alias("effective"))
    agg = top.groupBy(*keys).agg(
        F.count("*").alias("n_top"), F.count_distinct("principal").alias("principals"), F.max(effective).alias("latest"),
        F.max_by(body, F.struct(effective, "recorded_at", "arrival")).alias("own"), F.max_by(body, F.struct("recorded_at", "arrival")).alias("last"),
    )
    chosen = F.when(F.col("principals") == 1, F.col("own")).when(F.col("last.effective") >= F.col("latest"), F.col("last"))
    won = agg.withColumn("c", chosen).select(*keys, F.col("c.id").alias("winner"), F.col("c.status").alias("status"), F.col("c").isNull().alias("conflict"), "n_top")
    none = records.select(*keys).distinct().join(won.select(*keys), keys, "left_anti")
    return won.unionByName(none.select(*keys, *[F.lit(None).cast("string").alias(x) for x in ("winner", "status")], F.lit(False).alias("conflict"), F.lit(0).cast("bigint").alias("n_top")))


def pinned_revisions(resolved: DataFrame, revisions: DataFrame, approved: str = "approved-for-use") -> DataFrame:
    """(document_id, revision_id, conflict): the approved revision with the highest ordinal, and whether any revision of the
    document is in conflict."""
    r = resolved.where("object_kind = 'revision'").select(F.col("object_id").alias("id"), "status", "conflict")
    own = revisions.groupBy("id").agg(F.min("document_id").alias("document_id"), F.max("ordinal").alias("ordinal"))
    joined = own.join(r, "id")
    ok = F.col("status") == approved
    return joined.groupBy("document_id").agg(F.max_by(F.when(ok, F.col("id")), F.when(ok, F.struct(F.coalesce("ordinal", F.lit(-1)), "id"))).alias("revision_id"), F.bool_or("conflict").alias("conflict"))
