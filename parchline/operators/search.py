"""Search over the chunks of active generations: the ranked hits that a caller may see, with what a reader has to know about each.

Hits of the chunk index meet their generation pointer, copy, revision and document; a hit that lacks any of them is out. Access is filtered
before the limit, so a caller with few grants gets full pages of hits; ``overfetch`` cuts the ranked list first, which is what a
store does that fetches some multiple of the limit and filters afterwards. Pinned revisions and documents
without a pin come first, other revisions of pinned documents after them, then the score decides.

Defined results: references are compared trimmed and in lower case; a document with conflicting records carries a badge and keeps its
place; ties of the score go by chunk id; an empty result for a query without terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchline.functions.refs import norm_ref
from parchline.operators import access
from parchline.operators.catalogue import citation
from parchline.operators.fulltext import Index, Term, parse, snippet
from parchline.session import Scratch


def badges(mode: Column, provisional: Column, superseded: Column, image_ok: Column, text_ok: Column, flags: Column, labels: Column) -> Column:
    """What is wrong with a copy, in a fixed order: its state, its adequacy, risk flags, and labels that are not there yet."""
    when = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    own = F.array_compact(F.array(when((mode == "screening") | provisional, "provisional"), when(superseded, "superseded"), when(~image_ok, "image-inadequate"), when(~text_ok, "text-inadequate")))
    none = F.array().cast("array<string>")
    own = F.concat(own, F.coalesce(flags, none))
    return F.concat(own, F.array_except(F.coalesce(labels, none), own))


def pin_badges(own: Column, revision: Column, pinned: Column, conflict: Column) -> Column:
    """Badges of a copy and those of its document's pin: ``pinned`` first, ``authority-conflict`` and ``superseded-revision`` last."""
    here = F.coalesce(revision == pinned, F.lit(False))
    out = F.when(F.coalesce(conflict, F.lit(False)), F.array_union(own, F.array(F.lit("authority-conflict")))).otherwise(own)
    return F.when(pinned.isNull(), out).when(here, F.concat(F.array(F.lit("pinned")), out)).otherwise(F.concat(out, F.array(F.lit("superseded-revision"))))


def query_terms(query: str) -> list[str]:
    """The whole words of a query, as a snippet marks them."""
    out: list[str] = []

    def walk(t) -> None:
        for part in getattr(t, "parts", ()):
            walk(part)
        if isinstance(t, Term) and not t.prefix:
            out.append(t.text)
        out.extend(getattr(t, "terms", ()) if not isinstance(t, Term) else ())

    walk(parse(query))
    return list(dict.fromkeys(out))


def search_chunks(
    index: Index, query: str, chunks: DataFrame, pointers: DataFrame, copies: DataFrame, revisions: DataFrame, documents: DataFrame, pins: DataFrame,
    grants: dict[str, str], verbs: list[str], limit: int = 20, overfetch: bool = False, text: str = "text", active: bool = True,
) -> DataFrame:
    """(chunk_id, document_id, title, revision_id, revision_label, copy_id, page_id, page_number, score, tier, snippet, badges, citation).
    ``copies``, ``revisions`` and ``documents`` have a row per id, ``copies`` with ``badges``; ``chunks`` may repeat rows; ``pins`` are (document_id,
    pinned, conflict). Only hits meet the other tables, and only the texts of those that are left are read on."""
    access.require_verb(verbs if active else [], "search")
    hits = index.scored(query).withColumnRenamed(index.key, "chunk_id").withColumn("score", F.round("score", 6))
    meta = chunks.select(F.col("id").alias("chunk_id"), "document_id", norm_ref("revision_id").alias("revision_id"), norm_ref("copy_id").alias("copy_id"), "page_id", "page_number", "generation")
    met = (
        hits.join(meta, "chunk_id").join(pointers.select("document_id", F.col("active_generation").alias("generation")), ["document_id", "generation"])
        .join(copies.select(F.lower("id").alias("copy_id"), "badges"), "copy_id").join(revisions.select(F.lower("id").alias("revision_id"), F.col("label").alias("revision_label")), "revision_id")
        .join(documents.select("document_id", "title", "primary_domain", "additional_domains", "sensitivity"), "document_id")
    )
    met = met.dropDuplicates(["chunk_id"])
    if overfetch:
        met = met.orderBy("score", "chunk_id").limit(max(5 * limit, 50))
    seen = access.filter_visible(met, grants, active).join(pins.select("document_id", "pinned", "conflict"), "document_id", "left")
    here = F.coalesce(F.col("revision_id") == F.lower("pinned"), F.lit(False))
    tier = F.when(F.col("pinned").isNull() | here, 0).otherwise(1)
    best = seen.withColumns({"tier": tier, "badges": pin_badges(F.col("badges"), F.col("revision_id"), F.lower("pinned"), F.col("conflict"))}).orderBy("tier", "score", "chunk_id").limit(min(limit, 100))
    # at most a hundred hits, written as they are met twice
    best = Scratch(best.sparkSession, "hits").save(best, "best")
    words = chunks.select(F.col("id").alias("chunk_id"), text).join(F.broadcast(best.select("chunk_id")), "chunk_id").groupBy("chunk_id").agg(F.min(text).alias("__text"))
    words = words.select("chunk_id", snippet(F.col("__text"), query_terms(query)).alias("snippet"))
    cited = citation("document_id", "revision_id", "copy_id", "page_number").alias("citation")
    return best.join(words, "chunk_id").select("chunk_id", "document_id", "title", "revision_id", "revision_label", "copy_id", "page_id", "page_number", "score", "tier", "snippet", "badges", cited)


def neighbour_pages(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, page_id, offset): the pages before and after each hit's page in its copy, by position in the file."""
    near = hits.select("chunk_id", "copy_id", F.explode(F.array(F.lit(-1), F.lit(1))).alias("offset"), "page_number")
    near = near.withColumn("at", F.col("page_number") + F.col("offset"))
    own = pages.select("copy_id", (F.col("pdf_index") + 1).alias("at"), F.col("id").alias("page_id")).distinct()
    return near.join(own, ["copy_id", "at"]).select("chunk_id", "page_id", "offset")


