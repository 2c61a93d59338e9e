"""Queries of the document-analytics operators over whole tables, and the SQL they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchline.functions import text as X
from parchline.functions.refs import norm_ref
from parchline.model import constants as K
from parchline.functions.partitions import spread
from parchline.plans.index import stored
from parchline.operators import access, authority, catalogue, dedup, fulltext, fusion, generations, html, ledger, quality

SHOP = {"archive": "internal"}
PRINCIPALS = {
    "owner": {d: "restricted" for d in ("archive", "paradise", "starcade", "retrolodge", "personal")},
    "shop": SHOP,
    "floor": {"starcade": "confidential", "paradise": "open"},
}
OWNERS, PRECEDENCE = ["owner"], ["svc-review", "svc-intake"]


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text, over all cores."""
    return spread(t(spark, d, "documents").where("text IS NOT NULL"))


# access


def access_filter_shop(spark, d):
    return access.filter_visible(t(spark, d, "documents"), SHOP).select("doc_id", "primary_domain", "sensitivity")


def access_matrix_counts(spark, d):
    docs = t(spark, d, "documents")
    cols = [F.col("primary_domain"), F.col("additional_domains"), F.col("sensitivity")]
    seen = F.array_compact(F.array(*[F.when(access.visible(g, *cols), F.lit(p)) for p, g in PRINCIPALS.items()]))
    return docs.select(F.explode(seen).alias("principal"), "sensitivity").groupBy("principal", "sensitivity").agg(F.count("*").alias("n"))


def widening_audit(spark, d):
    """Documents of one title that differ: which of them would widen access against the first."""
    docs = t(spark, d, "documents").select("title", "doc_id", "sensitivity", access.domains(F.col("primary_domain"), F.col("additional_domains")).alias("domains"))
    first = docs.groupBy("title").agg(F.min_by(F.struct("doc_id", "sensitivity", "domains"), "doc_id").alias("f"))
    pairs = docs.join(first, "title").where("doc_id <> f.doc_id")
    return pairs.select("doc_id", access.widening(F.col("f.sensitivity"), F.col("sensitivity"), F.col("f.domains"), F.col("domains")).alias("widens"))


# content and text


def dedup_assets(spark, d):
    return dedup.by_content(t(spark, d, "documents"), "doc_id", "text").select("sha256", "first_key", "n")


def dedup_context(spark, d):
    return dedup.by_content(t(spark, d, "documents"), "doc_id", "text", ["primary_domain"]).where("n > 1").select("sha256", "primary_domain", "first_key", "n")


def source_merge(spark, d):
    return dedup.merged_values(t(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), "source"), "sha256", "source").select("sha256", F.array_join("values", "|").alias("sources"), "n_values")


def chunk_windows(spark, d):
    docs = documents(spark, d).select("doc_id", F.posexplode(X.chunk_windows(F.col("text"))).alias("seq", "chunk"))
    return docs.select("doc_id", "seq", F.size(X.tokens(F.col("chunk"))).alias("n_tokens"), F.md5("chunk").alias("md5"))


def tokenize_df(spark, d):
    p = fulltext.postings(documents(spark, d), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def postings(spark, d):
    return fulltext.postings(documents(spark, d), "doc_id", "text").select("term", "doc_id", "tf", F.col("positions")[0].alias("first_position"))


def language_vote(spark, d):
    docs = documents(spark, d).select("doc_id", X.language_votes(F.col("text")).alias("v"))
    return docs.select("doc_id", *[F.col(f"v.{k}").alias(f"votes_{k}") for k in [*K.STOP_WORDS, "n"]], X.vote_winner(F.col("v")).alias("language"))


def letter_mix(spark, d):
    counts = X.letter_counts(F.col("text"))
    return documents(spark, d).select("doc_id", *[counts[k].alias(k) for k in counts])


def language_detect(spark, d):
    c, votes = X.letter_counts(F.col("text")), X.language_votes(F.col("text"))
    docs = documents(spark, d).select("doc_id", votes.alias("v"), *[c[k].alias(k) for k in c])
    return docs.select("doc_id", X.text_language(F.col("kana"), F.col("han"), F.col("latin"), X.vote_winner(F.col("v"))).alias("language"))


def garble_fraction(spark, d):
    g = X.garble_fraction(F.col("text"))
    docs = documents(spark, d).select("doc_id", g.alias("g"))
    return docs.select("doc_id", F.round("g", 6).alias("garble"), F.coalesce(F.col("g") >= K.GARBLE_SUSPECT, F.lit(False)).alias("suspect"))


def phi_screen(spark, d):
    # a test of the operator's parameters, with terms that occur here; ``phi_fixed_terms`` has the fixed ones
    verdict = X.phi_verdict(F.col("text"), strong=["description of the symptom", "monitor chassis"], weak=["technician", "isopropyl", "symptom"])
    return documents(spark, d).select("doc_id", verdict.alias("verdict"))


def phi_fixed_terms(spark, d):
    return documents(spark, d).select("doc_id", X.phi_verdict(F.col("text")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def html_links(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(html.hrefs(F.col("text"))).alias("n", "href"))


def directory_entries(spark, d):
    links = t(spark, d, "documents").select(F.explode(html.anchors(F.col("text"))).alias("a"))
    # as it stands, and as a listing of the same host would have it
    bare = links.withColumn("href", F.regexp_replace("a.href", "^http://[^/]*", ""))
    e = F.explode(F.array(html.directory_entry(F.col("a.href"), F.col("a.text")), html.directory_entry(F.col("href"), F.col("a.text")))).alias("e")
    return bare.select(e).where("e IS NOT NULL").groupBy("e.name", "e.is_dir").agg(F.count("*").alias("n"))


# search


def _index(spark, d):
    return stored(spark, f"documents of {d}", lambda: documents(spark, d), "doc_id", "text")


def index_build(spark, d):
    """Builds the index of all documents anew; what the searches of this application open from then on."""
    index = stored(spark, f"documents of {d}", lambda: documents(spark, d), "doc_id", "text", fresh=True)
    return index.postings.agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"), F.sum("tf").alias("tokens")).withColumn("documents", F.lit(index.n_docs))


def _bm25(query):
    def run(spark, d):
        return _index(spark, d).scored(query).select("doc_id", F.round("score", 6).alias("score"))

    return run


def search_topk_secure(spark, d, query="transformer OR potentiometer", limit=20):
    """Ranked hits that a principal may see; the filter comes before the limit."""
    docs = access.filter_visible(t(spark, d, "documents"), SHOP).select("doc_id", "document_id")
    hits = _index(spark, d).scored(query).join(docs, "doc_id").withColumn("score", F.round("score", 6))
    return fulltext.top_hits(hits, "doc_id", limit).select("doc_id", "document_id", "score")


def search_pinned_tier(spark, d, query="capacitor", limit=50):
    """Hits of documents whose approved revision is pinned first, then by score."""
    docs = t(spark, d, "documents").select("doc_id", "document_id")
    pins = authority.pinned_revisions(_resolved(spark, d), t(spark, d, "revisions")).select("document_id", F.col("revision_id").isNotNull().alias("pinned"), "conflict")
    hits = _index(spark, d).scored(query).join(docs, "doc_id").join(pins, "document_id", "left")
    tier = F.when(F.coalesce("pinned", F.lit(False)), 0).otherwise(1)
    ranked = hits.select("doc_id", tier.alias("tier"), F.coalesce("conflict", F.lit(False)).alias("conflict"), F.round("score", 6).alias("score"))
    return ranked.orderBy("tier", "score", "doc_id").limit(limit)


def search_badges(spark, d):
    """Badges of every hit as the log has them, without repeats, against the state of the copy."""
    hits = t(spark, d, "search_hits").groupBy("id").agg(F.min(norm_ref("copy_id")).alias("copy_id"), F.min(F.array_join(F.sort_array("badges"), ",")).alias("logged"))
    state = t(spark, d, "copies").groupBy("id").agg(F.max_by(F.struct("assessment_mode", "superseded"), F.struct("row_version", "arrived_at")).alias("c"))
    made = F.array_compact(F.array(F.when(F.col("c.assessment_mode") == "screening", "provisional"), F.when(F.col("c.superseded") == 1, "superseded")))
    return hits.join(state.withColumnRenamed("id", "copy_id"), "copy_id").select("id", "copy_id", "logged", F.array_join(made, ",").alias("made"))


# measurements


def _scored_pages(spark, d):
    p = t(spark, d, "page_results").select("id", "content_class", "effective_dpi", "sharpness", "speckle_index", "skew_deg", "is_1bit").distinct()
    cls = norm_ref("content_class")
    ded = quality.image_deductions(F.col("effective_dpi"), F.col("sharpness"), F.col("speckle_index"), F.col("skew_deg"), F.coalesce("is_1bit", F.lit(False)), F.coalesce(cls, F.lit("unknown")))
    return p.withColumns({"content_class": F.coalesce(cls, F.lit("unknown")), "deductions": ded, "image_score": quality.score(ded)})


def if_score(spark, d):
    return _scored_pages(spark, d).select("id", "content_class", F.round("image_score", 6).alias("score"), F.size("deductions").alias("n_deductions"))


def deduction_totals(spark, d):
    return _scored_pages(spark, d).select(F.explode("deductions").alias("x")).groupBy("x.code").agg(F.count("*").alias("n"), F.round(F.sum("x.points"), 2).alias("points"))


def grade_distribution(spark, d):
    return _scored_pages(spark, d).groupBy("content_class", quality.grade(F.col("image_score")).alias("grade")).agg(F.count("*").alias("n"))


def _page_metrics(spark, d):
    li = t(spark, d, "lineitem")
    null = F.lit(None).cast("double")
    return li.select(
        "l_orderkey", F.col("l_partkey").alias("k"), F.when(F.col("l_partkey") % 7 != 0, 30 + 1.4 * F.col("l_quantity")).alias("mean_conf"), F.when(F.col("l_partkey") % 7 != 0, (F.col("l_suppkey") % 60) / F.lit(100.0)).alias("low_fraction"),
        F.when(F.col("l_partkey") % 5 != 0, 40 + F.col("l_quantity")).otherwise(null).alias("small_conf"), F.when(F.col("l_partkey") % 3 != 0, 50 + F.col("l_quantity")).alias("refdes_conf"),
    )


def tq_score(spark, d):
    m = _page_metrics(spark, d)
    ded = quality.text_deductions(F.col("mean_conf"), F.col("low_fraction"), F.col("small_conf"), F.col("refdes_conf"), F.lit(None).cast("double"))
    return m.where("mean_conf IS NOT NULL").select("k", F.round(quality.score(ded), 4).alias("score"), F.size(ded).alias("n_deductions")).groupBy("k", "n_deductions").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


def _assessed(spark, d):
    p = t(spark, d, "page_results").select("id", "copy_id", "pdf_index", "content_class", "assessed", "if_score", "tq_score", "tq_is_null", "skew_deg", "effective_dpi").distinct()
    return p.withColumns({"content_class": F.coalesce(norm_ref("content_class"), F.lit("unknown")), "assessed": F.coalesce("assessed", F.lit(False))})


def doc_rollup(spark, d):
    r = quality.roll_up(_assessed(spark, d), "copy_id")
    rounded = ["if_text", "tq_text", "if_schem", "tq_schem", "fitness_text", "fitness_schem"]
    return r.select("copy_id", *[F.round(c, 4).alias(c) for c in rounded], "text_pages", "schem_pages", "image_below", "text_below", "image_adequate", "text_adequate")


def page_gates(spark, d):
    g = quality.page_gates(_assessed(spark, d), F.col("content_class") == "schematic")
    return g.where("image_gate IS NOT NULL OR text_gate IS NOT NULL").select("id", "copy_id", "pdf_index", "image_gate", "text_gate")


def worst_pages(spark, d):
    w = quality.worst_pages(_assessed(spark, d), "copy_id", [F.col("if_score"), F.col("pdf_index"), F.col("id")])
    return w.select("copy_id", "id", "place")


def ocr_word_stats(spark, d):
    words = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    token = F.concat(F.substr(F.lit("RCLQDJKWFY"), (F.col("l_partkey") % 10 + 1).cast("int"), F.lit(1)), F.col("l_suppkey").cast("string"))
    words = words.select("l_orderkey", (2 * F.col("l_quantity")).alias("conf"), F.col("p_size").alias("height"), token.alias("token"))
    s = quality.ocr_word_statistics(words, "l_orderkey", X.is_refdes(F.col("token")))
    return s.select("l_orderkey", "word_count", *[F.round(c, 6).alias(c) for c in ("mean_conf", "low_conf_fraction", "small_text_conf", "refdes_conf")])


def screening_sample(spark, d):
    c = t(spark, d, "copies").select("id", "page_count").distinct()
    return c.where("page_count IS NOT NULL").select("id", "page_count", F.array_join(quality.screening_sample(F.col("page_count")).cast("array<string>"), ",").alias("pages"))


def skew_weighted_median(spark, d):
    """Median skew of each class, weighted by page resolution."""
    p = _assessed(spark, d).where("skew_deg IS NOT NULL AND NOT isnan(skew_deg) AND abs(skew_deg) < 90 AND effective_dpi BETWEEN 1 AND 10000")
    return quality.weighted_median(p.select("content_class", F.abs("skew_deg").alias("skew"), F.round("effective_dpi").cast("bigint").alias("w")), "content_class", "skew", "w")


# catalogue


def default_copy_top1(spark, d):
    return generations.default_copies(_latest_copies(spark, d, *_CHOICE))


def _latest_copies(spark, d, *columns):
    """Of each copy the row with the highest version, its ``columns`` only."""
    c = t(spark, d, "copies").select("id", F.struct("row_version", *columns).alias("v"))
    return c.groupBy("id").agg(F.max("v").alias("v")).select("id", *[f"v.{x}" for x in columns])


_CHOICE = ("revision_id", "is_document_default", "superseded", "fitness_text", "created_at")


def generation_build(spark, d):
    chunks = generations.build_chunks(t(spark, d, "page_results"), _latest_copies(spark, d, *_CHOICE))
    return chunks.select("revision_id", "copy_id", "page_id", "page_number", "seq", F.md5("text").alias("md5"))


def _pointers(spark, d):
    return t(spark, d, "chunks").groupBy("document_id").agg(F.max("generation").alias("active_generation"))


def _chunks(spark, d):
    return t(spark, d, "chunks").drop("arrived_at", "text").distinct()


def generation_visible(spark, d):
    return generations.active_only(_chunks(spark, d), _pointers(spark, d)).select("id", "document_id", "generation")


def generation_gc(spark, d):
    return generations.collectable(_chunks(spark, d), _pointers(spark, d)).select("id", "document_id", "generation")


def generation_verify(spark, d):
    pages = _chunks(spark, d).groupBy("document_id").agg(F.count_distinct("page_id").alias("n_text_pages"))
    return generations.verify(_chunks(spark, d), t(spark, d, "revisions"), pages)


def orphan_chunks(spark, d):
    own = t(spark, d, "revisions").select(F.lower("id").alias("rev"), "document_id").distinct()
    c = _chunks(spark, d).withColumn("rev", F.coalesce(norm_ref("revision_id"), F.lit("")))
    return c.join(own, ["rev", "document_id"], "left_anti").select("id", "document_id")


def copy_documents(spark, d):
    """Copies with the title and issuer of their document."""
    rev = t(spark, d, "revisions").select(F.lower("id").alias("revision_id"), "document_id", "ordinal", "label").distinct()
    c = _latest_copies(spark, d, "revision_id", "source_class").withColumn("revision_id", norm_ref("revision_id")).select(F.col("id").alias("copy_id"), "revision_id", "source_class")
    return c.join(rev, "revision_id").join(t(spark, d, "documents").select("document_id", "title", "issuer"), "document_id").select("copy_id", "revision_id", "document_id", "ordinal", "label", "title", "issuer", "source_class")


def grouping_band(spark, d):
    """Copies of one revision whose page counts lie within two per cent, as runs of the sorted counts rather than as pairs."""
    from pyspark.sql import Window

    c = _latest_copies(spark, d, "revision_id", "page_count").withColumn("revision_id", norm_ref("revision_id")).where("revision_id IS NOT NULL AND page_count > 0").groupBy("revision_id", "page_count").agg(F.count("*").alias("n"))
    w = Window.partitionBy("revision_id").orderBy("page_count")
    gap = F.col("page_count") - F.lag("page_count").over(w)
    c = c.withColumn("fresh", F.when(gap.isNull() | (gap > 0.02 * F.col("page_count")), 1).otherwise(0))
    return c.withColumn("run", F.sum("fresh").over(w)).groupBy("revision_id", "run").agg(F.min("page_count").alias("least"), F.max("page_count").alias("most"), F.sum("n").alias("n"))


def text_sample(spark, d):
    return catalogue.text_sample(t(spark, d, "page_results")).select("copy_id", F.length("sample").alias("n_chars"), F.md5("sample").alias("md5"))


def document_details(spark, d):
    return catalogue.document_details(t(spark, d, "documents"), t(spark, d, "revisions"), t(spark, d, "copies"))


def next_ordinal(spark, d):
    return catalogue.next_ordinal(t(spark, d, "revisions"))


def provisional_default(spark, d):
    return catalogue.provisional_defaults(_latest_copies(spark, d, "revision_id", "is_document_default", "created_at"), t(spark, d, "revisions"))


def chunk_metadata(spark, d):
    return catalogue.chunk_metadata(t(spark, d, "chunks").select("id", "metadata").distinct())


def hit_citations(spark, d):
    """Citations of logged hits, as flat columns."""
    h = t(spark, d, "search_hits").select("id", "document_id", norm_ref("revision_id").alias("rev"), norm_ref("copy_id").alias("copy"), "page_number").distinct()
    c = h.select("id", catalogue.citation("document_id", "rev", "copy", "page_number").alias("c"))
    return c.select("id", "c.document", "c.revision", "c.representation", F.col("c.locator.type").alias("locator"), F.col("c.locator.page").alias("page"))


def text_page_counts(spark, d):
    """Pages with text per document."""
    p = t(spark, d, "page_results").where("extracted_text <> ''").select("id", "copy_id").distinct()
    rev = t(spark, d, "revisions").select(F.lower("id").alias("rev"), "document_id").distinct()
    c = _latest_copies(spark, d, "revision_id").select(F.col("id").alias("copy_id"), norm_ref("revision_id").alias("rev")).join(rev, "rev")
    return p.join(c, "copy_id").groupBy("document_id").agg(F.count("*").alias("n_text_pages"))


def recall_at_k(spark, d):
    """Of the documents that hold a phrase, the share that the ranked word search finds among its first hundred."""
    index = _index(spark, d)
    wanted = index.matching(fulltext.parse('"isopropyl alcohol"')).select(F.lit("isopropyl").alias("query"), "doc_id")
    found = fulltext.top_hits(index.scored("isopropyl").withColumn("score", F.round("score", 6)), "doc_id", 100).select(F.lit("isopropyl").alias("query"), "doc_id")
    return fusion.recall(found, wanted, "query", "doc_id").select("query", F.round("recall", 6).alias("recall"))


def snapshot_retention(spark, d):
    return catalogue.beyond_retention(_outbox(spark, d).select("queue", "id", "created_at"), ["queue"], "id", 14).groupBy("queue").agg(F.count("*").alias("n"), F.max("id").alias("newest"))


# authority and ledgers


def _records(spark, d):
    return t(spark, d, "authority_records").withColumns({"status": F.lower("status"), "object_id": norm_ref("object_id")})


def _resolved(spark, d):
    return authority.resolve(_records(spark, d), OWNERS, PRECEDENCE)


def authority_resolve(spark, d):
    return _resolved(spark, d)


def authority_conflicts(spark, d):
    return _resolved(spark, d).groupBy("object_kind").agg(F.count("*").alias("objects"), F.count_if("conflict").alias("conflicts"))


def pinned_revision(spark, d):
    return authority.pinned_revisions(_resolved(spark, d), t(spark, d, "revisions"))


def stale_propagation(spark, d):
    """Everything that depends, over any number of steps, on a deleted file."""
    files = t(spark, d, "file_assets")
    links = t(spark, d, "copy_assets")
    edges = reduce(
        DataFrame.unionAll,
        [
            files.select(norm_ref("parent_asset_id").alias("source"), F.col("id").alias("dependent")),
            links.select(norm_ref("asset_id").alias("source"), norm_ref("copy_id").alias("dependent")),
            t(spark, d, "chunks").select(norm_ref("copy_id").alias("source"), F.col("id").alias("dependent")),
        ],
    )
    return ledger.stale(edges, files.where("deleted_at IS NOT NULL").select(F.col("id").alias("node")))


def request_replay(spark, d):
    r = t(spark, d, "authority_records").distinct()
    return ledger.first_by_key(r.select("idempotency_key", "id", "arrival"), "idempotency_key", ["arrival", "id"]).select("idempotency_key", "id", "replays")


def mutation_fold(spark, d):
    e = t(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("object_id"), F.when(F.col("event_id") % 3 == 0, F.floor("value")).cast("bigint").alias("expected_version"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("k"), (F.col("event_id") % 400).cast("string"))).alias("idempotency_key"),
    )
    return ledger.fold_versions(e)


def _outbox(spark, d):
    o = t(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("applied_at"), (F.col("o_custkey") % 4).cast("int").alias("attempts"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").otherwise("queued").alias("state"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("lease_until"), (F.col("o_custkey") % 10).cast("int").alias("queue"),
    )


def outbox_status(spark, d):
    return ledger.outbox_status(_outbox(spark, d), ["kind"])


def outbox_next(spark, d):
    return ledger.pending(_outbox(spark, d)).select("id", "kind")


def job_claim_order(spark, d):
    return ledger.next_jobs(_outbox(spark, d), "1997-01-01", ["queue"], 3).select("queue", "id", "priority", "place")


def audit_chain(spark, d):
    e = t(spark, d, "events").select((F.col("event_id") + 1).alias("line_no"), F.to_json(F.struct("event_type", "user_id", "props")).alias("body"))
    return ledger.chain_hashes(e, ["line_no"], "body")


def audit_chain_verify(spark, d):
    """Finds the lines that were altered: every 997th body, and nothing else."""
    lines = audit_chain(spark, d).withColumn("body", F.when(F.col("line_no") % 997 == 0, F.concat("body", F.lit("x"))).otherwise(F.col("body")))
    return ledger.verify_chain(lines)


def access_demand_tumbling(spark, d):
    e = t(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def access_sessions(spark, d):
    e = t(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


# fusion


def rrf_fusion(spark, d):
    from pyspark.sql import Window

    index = _index(spark, d)
    w = Window.orderBy("score", "doc_id")
    lists = [index.scored(q).withColumn("score", F.round("score", 6)).orderBy("score", "doc_id").limit(100).withColumn("rank", F.row_number().over(w)) for q in ("transformer", "potentiometer")]
    return fusion.reciprocal_rank(lists, "doc_id").select("doc_id", F.round("rrf", 8).alias("rrf"))


def cosine_topk(spark, d):
    v = t(spark, d, "embeddings")
    q = v.where("vec_id = 0").select("embedding").first()[0]
    return fusion.nearest(v, "vec_id", "embedding", list(q), 20).select("vec_id", F.round("cosine", 6).alias("cosine"))


def cosine_topk_each(spark, d):
    v = t(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0")
    q = q.coalesce(max(1, q.rdd.getNumPartitions() // 20))
    found = fusion.nearest_each(v, q, "vec_id", "embedding", 20)
    return found.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


def trust_rolling30(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("good"))
    return fusion.rolling_share(e, "user_id", "event_id", F.col("good")).select("event_id", F.round("share", 6).alias("share"))


BM25_QUERIES = {
    "bm25_single": "potentiometer", "bm25_and": "washers gasket", "bm25_or": "gasket OR isopropyl", "bm25_not": "potentiometer NOT washers", "bm25_phrase": '"loose contact between"',
    "bm25_prefix": "potentio*", "bm25_near": "NEAR(washers gasket, 5)",
}

_NAMES = """access_filter_shop access_matrix_counts widening_audit index_build dedup_assets dedup_context source_merge chunk_windows tokenize_df postings
language_vote letter_mix language_detect garble_fraction phi_screen phi_fixed_terms html_links directory_entries search_topk_secure search_pinned_tier
search_badges if_score deduction_totals grade_distribution tq_score doc_rollup page_gates worst_pages ocr_word_stats screening_sample
skew_weighted_median default_copy_top1 generation_build generation_visible generation_gc generation_verify orphan_chunks copy_documents grouping_band
text_sample document_details next_ordinal provisional_default chunk_metadata hit_citations text_page_counts recall_at_k snapshot_retention
authority_resolve authority_conflicts pinned_revision stale_propagation request_replay mutation_fold outbox_status outbox_next job_claim_order
audit_chain audit_chain_verify access_demand_tumbling access_sessions rrf_fusion cosine_topk cosine_topk_each trust_rolling30""".split()
QUERIES = {n: globals()[n] for n in _NAMES} | {n: _bm25(q) for n, q in BM25_QUERIES.items()}

from parchline.oracle_core import ORACLE  # noqa: E402, F401
