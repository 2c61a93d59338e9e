"""Index generations: chunks are built per document from the default copy of each revision, verified, then activated by a
pointer; a generation is never changed, only replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchline.functions.refs import norm_ref
from parchline.functions.text import chunk_windows


def default_copies(copies: DataFrame) -> DataFrame:
    """(revision_id, copy_id): of each revision the copy that the index takes. One aggregate: the best row is kept while
    combining, so a revision with very many copies needs no sort."""
    fit = F.coalesce(F.nanvl("fitness_text", F.lit(None).cast("double")), F.lit(-1.0))
    created = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0))
    order = F.struct(-F.col("is_document_default"), "superseded", -fit, created, "id")
    return copies.withColumn("revision_id", norm_ref("revision_id")).where("revision_id IS NOT NULL").groupBy("revision_id").agg(F.min_by("id", order).alias("copy_id"))


def build_chunks(pages: DataFrame, copies: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """(revision_id, copy_id, page_id, page_number, seq, text): chunk windows of the pages of every revision's default copy."""
    best = default_copies(copies)
    text = pages.where("extracted_text IS NOT NULL AND extracted_text <> ''").select("id", "copy_id", "pdf_index", "extracted_text").join(best, "copy_id")
    # only pages of chosen copies are met by id, where their repeats go
    rows = text.groupBy("id").agg(F.min(F.struct("revision_id", "copy_id", "pdf_index", "extracted_text")).alias("p")).select("id", "p.*")
    return rows.select("revision_id", "copy_id", F.col("id").alias("page_id"), (F.col("pdf_index") + 1).alias("page_number"), F.posexplode(chunk_windows(F.col("extracted_text"), size, overlap)).alias("seq", "text"))


def active_only(chunks: DataFrame, pointers: DataFrame) -> DataFrame:
    """Chunks of each document's active generation; pointers are (document_id, active_generation)."""
    return chunks.join(pointers.select("document_id", F.col("active_generation").alias("generation")), ["document_id", "generation"])


def collectable(chunks: DataFrame, pointers: DataFrame) -> DataFrame:
    """Chunks of generations before the active one."""
    p = pointers.select("document_id", "active_generation")
    return chunks.join(p, "document_id").where(F.col("generation") < F.col("active_generation")).drop("active_generation")


def verify(chunks: DataFrame, revisions: DataFrame, text_pages: DataFrame) -> DataFrame:
    """(document_id, generation, n_chunks, n_orphans, ok): a generation with text pages must have chunks, and none may name a
    revision that its document does not have."""
    own = revisions.select(F.lower("id").alias("rev"), "document_id").distinct().withColumn("there", F.lit(1))
    c = chunks.withColumn("rev", norm_ref("revision_id")).join(own, ["rev", "document_id"], "left")
    agg = c.groupBy("document_id", "generation").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("there").isNull()).alias("n_orphans"))
    out = agg.join(text_pages.select("document_id", "n_text_pages"), "document_id", "left")
    return out.withColumn("ok", ((F.col("n_chunks") > 0) | (F.coalesce("n_text_pages", F.lit(0)) == 0)) & (F.col("n_orphans") == 0)).drop("n_text_pages")


def activate(pointers: DataFrame, requests: DataFrame) -> DataFrame:
    """(document_id, generation, outcome, active_generation, collect_below): requests (document_id, generation) to activate a built
    generation. Only the one after the pointer may: ``activated`` moves the pointer and asks for the removal of chunks below; any other
    worker built against a pointer that has moved since, or is ahead of it: ``stale``. A document without pointer is at 0."""
    r = requests.select("document_id", "generation").distinct().join(pointers.select("document_id", F.col("active_generation").alias("now")), "document_id", "left")
    now = F.coalesce("now", F.lit(0))
    done = F.col("generation") == now + 1
    return r.select("document_id", "generation", F.when(done, "activated").otherwise("stale").alias("outcome"), F.when(done, F.col("generation")).otherwise(now).alias("active_generation"), F.when(done, F.col("generation")).alias("collect_below"))


def moved_pointers(pointers: DataFrame, activated: DataFrame) -> DataFrame:
    """Pointers after the activations that went through."""
    new = activated.where("outcome = 'activated'").select("document_id", F.col("generation").alias("new"))
    return pointers.join(new, "document_id", "full").select("document_id", F.coalesce("new", "active_generation").alias("active_generation"))


def spot_check(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """(document_id, generation, token, spot_retrieval): the first token of four or more letters and digits of each generation's first
    chunk, and whether the postings (id, term) lead from it to a chunk of that generation. True where no token qualifies."""
    first = chunks.groupBy("document_id", "generation").agg(F.min_by("text", "id").alias("text"))
    token = F.get(F.filter(F.split("text", r"\s+"), lambda x: x.rlike(r"^[A-Za-z0-9]{4,}$")), F.lit(0))
    asked = first.select("document_id", "generation", token.alias("token"))
    hit = chunks.select("id", "document_id", "generation").join(asked, ["document_id", "generation"]).join(postings, (postings["id"] == chunks["id"]) & (F.col("term") == F.lower("token"))).select("document_id", "generation").distinct().withColumn("hit", F.lit(True))
    out = asked.join(hit, ["document_id", "generation"], "left")
    return out.select("document_id", "generation", "token", (F.col("hit").isNotNull() | F.col("token").isNull()).alias("spot_retrieval"))
