"""Catalogue views: details, samples, citations, metadata, ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchline.functions.refs import norm_ref


def text_sample(pages: DataFrame, pages_per_copy: int = 3, chars: int = 20_000) -> DataFrame:
    """(copy_id, sample): the first pages with text of each copy, joined by blanks and cut. Only the pages in question are kept
    before they are gathered, so a copy of very many pages gathers no more than the others."""
    text = pages.where("extracted_text IS NOT NULL AND extracted_text <> ''").groupBy("id").agg(F.min(F.struct("copy_id", "pdf_index", "extracted_text")).alias("p")).select("id", "p.*")
    w = Window.partitionBy("copy_id").orderBy("pdf_index", "id")
    first = text.withColumn("k", F.row_number().over(w)).where(F.col("k") <= pages_per_copy)
    joined = first.groupBy("copy_id").agg(F.array_sort(F.collect_list(F.struct("k", "extracted_text"))).alias("p"))
    return joined.select("copy_id", F.substring(F.array_join(F.transform("p", lambda x: x["extracted_text"]), " "), 1, chars).alias("sample"))


def citation(document: str, revision: str, representation: str, page: str) -> Column:
    return F.struct(F.col(document).alias("document"), F.col(revision).alias("revision"), F.col(representation).alias("representation"), F.struct(F.lit("page").alias("type"), F.col(page).alias("page")).alias("locator"))


def document_details(documents: DataFrame, revisions: DataFrame, copies: DataFrame) -> DataFrame:
    """(document_id, title, n_revisions, n_copies, latest_label): documents with what hangs on them; both sides are reduced to a
    row per document before they meet."""
    rev = revisions.select(F.lower("id").alias("rev"), "document_id", "ordinal", "label").distinct()
    own = copies.select("id", norm_ref("revision_id").alias("rev")).distinct()
    per_rev = own.groupBy("rev").agg(F.count_distinct("id").alias("copies"))
    last = F.max_by("label", F.when(F.col("label").isNotNull(), F.struct(F.coalesce("ordinal", F.lit(-1)), "rev")))
    agg = rev.join(per_rev, "rev", "left").groupBy("document_id").agg(F.count_distinct("rev").alias("n_revisions"), F.coalesce(F.sum("copies"), F.lit(0)).alias("n_copies"), last.alias("latest_label"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.select("document_id", "title").join(agg, "document_id", "left").select("document_id", "title", zero("n_revisions"), zero("n_copies"), "latest_label")


def next_ordinal(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("document_id").agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("next_ordinal"))


def provisional_defaults(copies: DataFrame, revisions: DataFrame) -> DataFrame:
    """(document_id, copy_id): the first copy of every document that has no default."""
    rev = revisions.select(F.lower("id").alias("rev"), "document_id").distinct()
    c = copies.select("id", norm_ref("revision_id").alias("rev"), "is_document_default", "created_at").join(rev, "rev")
    agg = c.groupBy("document_id").agg(F.max("is_document_default").alias("has"), F.min_by("id", F.struct("created_at", "id")).alias("copy_id"))
    return agg.where("coalesce(has, 0) = 0").select("document_id", "copy_id")


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """(id, text_origin, superseded) out of the JSON column; null where it is no JSON or lacks the key."""
    m = F.from_json("metadata", "text_origin string, superseded int")
    return chunks.select("id", m["text_origin"].alias("text_origin"), m["superseded"].alias("superseded"))


def merge_keys(old: Column, new: Column, prefix: str = "ext.") -> Column:
    """A map with the entries of ``new`` put over those of ``old``; a null value removes its key. Null if a key lacks the prefix."""
    allowed = F.forall(F.map_keys(new), lambda k: F.startswith(k, F.lit(prefix)))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(allowed, F.map_concat(kept, F.map_filter(new, lambda k, v: v.isNotNull())))


def beyond_retention(snapshots: DataFrame, by: list[str], at: str, keep: int = 14) -> DataFrame:
    """Snapshots older than the newest ``keep`` of their group; ``at`` is unique in a group. Only the newest of each task are sorted, to
    find the oldest that stays."""
    w = Window.partitionBy(*by).orderBy(F.desc(at))
    newest = snapshots.select(*by, at).withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)
    cut = newest.groupBy(*by).agg(F.min(at).alias("__cut"))
    return snapshots.join(cut, by).where(F.col(at) < F.col("__cut")).drop("__cut")


def object_documents(objects: DataFrame, documents: DataFrame, revisions: DataFrame, copies: DataFrame) -> DataFrame:
    """(object_kind, object_id, document_id): documents, revisions and copies resolved to the document that they belong to."""
    rev = revisions.select(F.lower("id").alias("rev"), "document_id").distinct()
    own = documents.select(F.lit("document").alias("object_kind"), F.col("document_id").alias("object_id"), "document_id")
    mine = rev.select(F.lit("revision").alias("object_kind"), F.col("rev").alias("object_id"), "document_id")
    theirs = copies.select(F.col("id").alias("object_id"), norm_ref("revision_id").alias("rev")).join(rev, "rev").select(F.lit("copy").alias("object_kind"), "object_id", "document_id")
    return objects.select("object_kind", "object_id").distinct().join(own.unionByName(mine).unionByName(theirs), ["object_kind", "object_id"])


def primary_assets(links: DataFrame, assets: DataFrame) -> DataFrame:
    """(copy_id, asset_id, media_type): of every copy the asset of its first ``primary`` link that leads to one."""
    own = assets.groupBy(F.col("id").alias("asset_id")).agg(F.min("media_type").alias("media_type"))
    told = links.where("relation = 'primary'").select("id", norm_ref("copy_id").alias("copy_id"), norm_ref("asset_id").alias("asset_id"), "arrived_at").where("copy_id IS NOT NULL")
    return told.join(own, "asset_id").groupBy("copy_id").agg(F.min_by(F.struct("asset_id", "media_type"), F.struct("arrived_at", "id")).alias("a")).select("copy_id", "a.*")


def document_records(documents: DataFrame, revisions: DataFrame, copies: DataFrame, authority: DataFrame, most: int = 1000) -> DataFrame:
    """(document_id, title, revisions, authority): revisions by ordinal, each with its copies by age, and the document's authority records by
    arrival. A record is read by a person: of one revision's copies and one document's records the first ``most`` are listed."""
    c = copies.select(norm_ref("revision_id").alias("rev"), F.struct("created_at", "id", "source_class").alias("c"))
    w = Window.partitionBy("rev").orderBy("c")
    c = c.where("rev IS NOT NULL").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).groupBy("rev").agg(F.array_sort(F.collect_list("c")).alias("copies"))
    rev = revisions.groupBy(F.lower("id").alias("rev")).agg(F.min("document_id").alias("document_id"), F.min("ordinal").alias("ordinal"), F.min("label").alias("label"))
    none = F.array().cast(c.schema["copies"].dataType)
    r = rev.join(c, "rev", "left").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), F.col("rev").alias("id"), "label", F.coalesce("copies", none).alias("copies")))).alias("revisions"))
    a = authority.where("object_kind = 'document'").select(norm_ref("object_id").alias("document_id"), F.struct("arrival", "id", "principal", "status").alias("a")).distinct()
    a = a.withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy("a"))).where(F.col("k") <= most).groupBy("document_id").agg(F.array_sort(F.collect_list("a")).alias("authority"))
    out = documents.select("document_id", "title").join(r, "document_id", "left").join(a, "document_id", "left")
    return out.withColumns({x: F.coalesce(x, F.array().cast(out.schema[x].dataType)) for x in ("revisions", "authority")})
