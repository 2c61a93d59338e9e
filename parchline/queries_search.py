"""Queries of the search over chunks and of index generations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchline.functions.refs import norm_ref
from parchline.operators import access, authority, catalogue, generations, search
from parchline.operators.quality import adequate
from parchline.oracle_core import _FROM, _PINS, _RESOLVE, _SHOP, _TO
from parchline.plans.index import stored
from parchline.queries_core import SHOP, _chunks, _latest_copies, _pointers, _resolved, t

VERBS = ["search", "read"]


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks once each."""
    cols = ["document_id", "revision_id", "copy_id", "page_id", "page_number", "generation", "seq", "text"]
    return t(spark, d, "chunks").groupBy("id").agg(F.min(F.struct(*cols)).alias("c")).select("id", "c.*")


def chunk_index(spark, d):
    return stored(spark, f"chunks of {d}", lambda: chunk_rows(spark, d), "id", "text")


def badged_copies(spark, d):
    """Copies with their badges: screening, superseded, adequacy of means, and the label of known gaps."""
    c = _latest_copies(spark, d, "assessment_mode", "superseded", "completeness_status", "if_text", "if_schem", "tq_text", "tq_schem")
    image, text = adequate()
    labels = F.when(F.col("completeness_status") == "known-incomplete", F.array(F.lit("INCOMPLETE")))
    return c.select("id", search.badges(F.col("assessment_mode"), F.lit(False), F.col("superseded") == 1, image, text, F.lit(None).cast("array<string>"), labels).alias("badges"))


def _revisions(spark, d):
    return t(spark, d, "revisions").groupBy("id").agg(F.min("label").alias("label"))


def _search(query: str, limit: int = 20, grants: dict | None = None, overfetch: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        pins = authority.pinned_revisions(_resolved(spark, d), t(spark, d, "revisions")).withColumnRenamed("revision_id", "pinned")
        docs = t(spark, d, "documents").select("document_id", "title", "primary_domain", "additional_domains", "sensitivity")
        hits = search.search_chunks(chunk_index(spark, d), query, t(spark, d, "chunks"), _pointers(spark, d), badged_copies(spark, d), _revisions(spark, d), docs, pins, grants or SHOP, VERBS, limit, overfetch)
        flat = ["chunk_id", "document_id", "title", "revision_id", "revision_label", "copy_id", "page_id", "page_number", "score", "tier"]
        return hits.select(*flat, F.array_join("badges", ",").alias("badges"), (F.col("citation.locator.page") == F.col("page_number")).alias("cited"))

    return run


def chunk_snippets(spark, d):
    """The snippets of all chunks that hold a word: how many hits are marked and whether the ends are cut."""
    found = chunk_index(spark, d).matching(search.parse("potentiometer")).join(t(spark, d, "chunks").groupBy("id").agg(F.min("text").alias("text")), "id")
    s = found.select("id", search.snippet(F.col("text"), ["potentiometer"]).alias("s"))
    return s.select("id", F.regexp_count("s", F.lit(r"\[")).cast("bigint").alias("marked"), F.startswith("s", F.lit("... ")).alias("cut"))


def search_neighbours(spark, d):
    """The pages beside the pages of a search's hits."""
    hits = _search("transformer OR capacitor", 100)(spark, d)
    return search.neighbour_pages(hits, t(spark, d, "page_results").select("id", "copy_id", "pdf_index")).select("chunk_id", "page_id", "offset")


def document_check(spark, d):
    """Fetch-time checks: of all asked documents those that are there and visible; absent and forbidden ones are alike."""
    asked = t(spark, d, "search_hits").select("document_id").distinct().unionByName(spark.createDataFrame([("doc_of_nobody",)], "document_id string"))
    return access.check_documents(asked, t(spark, d, "documents"), SHOP, VERBS, "read").select("document_id", "sensitivity")


def access_facts_json(spark, d):
    """Domains that came as JSON text decode to the same facts."""
    docs = t(spark, d, "documents").select("doc_id", "primary_domain", F.to_json("additional_domains").alias("additional_domains"), "sensitivity")
    decoded = docs.withColumn("additional_domains", access.decode_domains(F.col("additional_domains")))
    return access.filter_visible(decoded, SHOP).select("doc_id")


def generation_activate(spark, d):
    """Requests to activate a built generation, against the pointers: only the next one may; what is activated moves the pointer and asks
    for the removal of what lies before."""
    built = _chunks(spark, d).groupBy("document_id").agg(F.min("generation").alias("active_generation"))
    asked = _chunks(spark, d).select("document_id", "generation").distinct()
    return generations.activate(built, asked).select("document_id", "generation", "outcome", "active_generation", "collect_below")


def generation_spot(spark, d):
    """Whether a word of a chunk of each generation is found again by the index in that generation."""
    spot = generations.spot_check(chunk_rows(spark, d), chunk_index(spark, d).postings.select("id", "term"))
    return spot.select("document_id", "generation", "token", "spot_retrieval")


def object_documents(spark, d):
    """The documents that the objects of authority records belong to."""
    objects = t(spark, d, "authority_records").select("object_kind", norm_ref("object_id").alias("object_id")).distinct()
    return catalogue.object_documents(objects, t(spark, d, "documents").select("document_id"), t(spark, d, "revisions"), _latest_copies(spark, d, "revision_id"))


def primary_assets(spark, d):
    """Of every copy the primary asset, the one that was linked first."""
    return catalogue.primary_assets(t(spark, d, "copy_assets"), t(spark, d, "file_assets")).select("copy_id", "asset_id", "media_type")


def page_image_lookup(spark, d):
    """What a request for a page image needs: pages of visible documents with the asset to render and the resolution."""
    visible = access.filter_visible(t(spark, d, "documents"), SHOP).select("document_id")
    rev = t(spark, d, "revisions").select(F.lower("id").alias("revision_id"), "document_id").distinct().join(visible, "document_id", "left_semi")
    copies = _latest_copies(spark, d, "revision_id").withColumn("revision_id", norm_ref("revision_id")).join(rev, "revision_id").select(F.col("id").alias("copy_id"))
    assets = catalogue.primary_assets(t(spark, d, "copy_assets"), t(spark, d, "file_assets"))
    pages = t(spark, d, "page_results").select("id", "copy_id", "pdf_index").distinct().join(copies.distinct(), "copy_id")
    return pages.join(assets, "copy_id").select(F.col("id").alias("page_id"), "copy_id", (F.col("pdf_index") + 1).alias("page_number"), "asset_id")


def document_record(spark, d):
    """The nested record of every document: revisions in order, their copies by age, and authority records by arrival, as JSON sizes."""
    rec = catalogue.document_records(t(spark, d, "documents"), t(spark, d, "revisions"), _latest_copies(spark, d, "revision_id", "created_at", "source_class"), t(spark, d, "authority_records"))
    first = F.get("revisions", F.lit(0))
    return rec.select("document_id", F.size("revisions").cast("bigint").alias("n_revisions"), first["id"].alias("first_revision"), F.aggregate("revisions", F.lit(0).cast("bigint"), lambda a, r: a + F.size(r["copies"])).alias("n_copies"),
                      F.get(first["copies"], F.lit(0))["id"].alias("first_copy"), F.size("authority").cast("bigint").alias("n_records"))


_NAMES = """chunk_snippets search_neighbours document_check access_facts_json generation_activate generation_spot object_documents primary_assets page_image_lookup
document_record""".split()
QUERIES = {n: globals()[n] for n in _NAMES} | {
    "chunk_search": _search("transformer OR capacitor"), "chunk_search_and": _search("text:voltage NOT socket", 50), "chunk_search_phrase": _search('"coin door"', 30), "chunk_search_overfetch": _search("transformer OR capacitor", overfetch=True),
    "chunk_search_unparsed": _search("power supply)", 10),
}

_CH = "ch AS (SELECT id, min(document_id) AS document_id, min(lower(trim(revision_id))) AS revision_id, min(lower(trim(copy_id))) AS copy_id, min(page_id) AS page_id, min(page_number) AS page_number, min(generation) AS generation, min(text) AS text FROM chunks GROUP BY id)"
_TERMS = f"regexp_extract_all(lower(translate(text, '{_FROM}', '{_TO}')), '[\\p{{L}}\\p{{N}}\\p{{Co}}\\-/.]+')"
_TABLES = f"""{_CH}, terms AS (SELECT id, unnest({_TERMS}) AS term, generate_subscripts({_TERMS}, 1) AS pos FROM ch), lens AS (SELECT id, count(*) AS n FROM terms GROUP BY id), stats AS (SELECT (SELECT count(*) FROM ch WHERE text IS NOT NULL) AS n_docs, (SELECT avg(n) FROM lens) AS avg_len)"""
_LAST = "last AS (SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_version DESC) = 1)"
_OK = lambda a, b, least: f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL ELSE coalesce({a} >= {least}, true) AND coalesce({b} >= {least}, true) END"
_N = lambda c: f"(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)"
_BADGED = f"""{_LAST}, badged AS (SELECT lower(id) AS copy_id, list_filter([CASE WHEN assessment_mode = 'screening' THEN 'provisional' END, CASE WHEN superseded = 1 THEN 'superseded' END,
  CASE WHEN NOT ({_OK(_N('if_text'), _N('if_schem'), 75)}) THEN 'image-inadequate' END, CASE WHEN NOT ({_OK(_N('tq_text'), _N('tq_schem'), 70)}) THEN 'text-inadequate' END,
  CASE WHEN completeness_status = 'known-incomplete' THEN 'INCOMPLETE' END], lambda x: x IS NOT NULL) AS badges FROM last)"""


def _leaf(n: int, term: str) -> str:
    return f"SELECT {n} AS leaf, id, count(*) AS tf FROM terms WHERE term = '{term}' GROUP BY id"


def _pair(a: str, b: str) -> str:
    return f"SELECT 0 AS leaf, a.id, count(*) AS tf FROM terms a JOIN terms b ON b.id = a.id AND b.pos = a.pos + 1 WHERE a.term = '{a}' AND b.term = '{b}' GROUP BY a.id"


def _sql(hits: str, limit: int, without: str = "", overfetch: bool = False) -> str:
    cut = f"ORDER BY score, chunk_id LIMIT {max(5 * limit, 50)}" if overfetch else ""
    return (
        _RESOLVE
        + _PINS
        + f""", {_TABLES}, {_BADGED}, hits AS ({hits}), dfs AS (SELECT leaf, count(*) AS df FROM hits GROUP BY leaf),
    scored AS (SELECT id AS chunk_id, round(sum(-(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))), 6) AS score
      FROM hits JOIN dfs USING (leaf) JOIN lens USING (id), stats {f"WHERE id NOT IN (SELECT id FROM terms WHERE term = '{without}')" if without else ""} GROUP BY id),
    pointer AS (SELECT document_id, max(generation) AS generation FROM chunks GROUP BY 1), labels AS (SELECT lower(id) AS revision_id, min(label) AS revision_label FROM revisions GROUP BY 1),
    met AS (SELECT s.*, ch.document_id, d.title, ch.revision_id, revision_label, ch.copy_id, page_id, page_number, b.badges, primary_domain, additional_domains, sensitivity FROM scored s JOIN ch ON ch.id = chunk_id JOIN pointer p ON p.document_id = ch.document_id AND p.generation = ch.generation
      JOIN badged b ON b.copy_id = ch.copy_id JOIN labels USING (revision_id) JOIN documents d ON d.document_id = ch.document_id {cut}),
    seen AS (SELECT met.*, lower(pins.revision_id) AS pinned, coalesce(pins.conflict, false) AS conflict FROM met LEFT JOIN pins ON pins.document_id = met.document_id WHERE {_SHOP})
    SELECT chunk_id, document_id, title, revision_id, revision_label, copy_id, page_id, page_number, score, CAST(CASE WHEN pinned IS NULL OR pinned = revision_id THEN 0 ELSE 1 END AS INTEGER) AS tier,
      array_to_string(list_concat(list_concat(CASE WHEN pinned = revision_id THEN ['pinned'] ELSE [] END, badges), list_concat(CASE WHEN conflict THEN ['authority-conflict'] ELSE [] END, CASE WHEN pinned <> revision_id THEN ['superseded-revision'] ELSE [] END)), ',') AS badges, page_number = page_number AS cited
    FROM seen ORDER BY tier, score, chunk_id LIMIT {limit}"""
    )


_EITHER = f"{_leaf(0, 'transformer')} UNION ALL {_leaf(1, 'capacitor')}"
_R = "revs AS (SELECT DISTINCT lower(id) AS rev, document_id FROM revisions)"
_PRIMARY = """primary_assets AS (SELECT copy_id, asset_id, media_type FROM (SELECT lower(trim(ca.copy_id)) AS copy_id, fa.id AS asset_id, fa.media_type, row_number() OVER (PARTITION BY lower(trim(ca.copy_id)) ORDER BY ca.arrived_at, ca.id) AS k
  FROM copy_assets ca JOIN (SELECT id, min(media_type) AS media_type FROM file_assets GROUP BY id) fa ON fa.id = lower(trim(ca.asset_id)) WHERE ca.relation = 'primary' AND ca.copy_id IS NOT NULL) WHERE k = 1)"""
ORACLE = {
    "chunk_search": _sql(_EITHER, 20),
    "chunk_search_overfetch": _sql(_EITHER, 20, overfetch=True),
    "chunk_search_and": _sql(_leaf(0, "voltage"), 50, without="socket"),
    "chunk_search_phrase": _sql(_pair("coin", "door"), 30),
    "chunk_search_unparsed": _sql(_pair("power", "supply"), 10),
    "chunk_snippets": f"""WITH {_TABLES}, k AS (SELECT id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS tk FROM ch WHERE id IN (SELECT id FROM terms WHERE term = 'potentiometer')),
        h AS (SELECT id, list_transform(tk, lambda x: list_contains({_TERMS.replace('(text,', '(x,')}, 'potentiometer')) AS hit FROM k), s AS (SELECT id, hit, greatest(1, list_position(hit, true) - 6) AS st FROM h)
        SELECT id, len(list_filter(hit[st : st + 11], lambda x: x)) AS marked, st > 1 AS cut FROM s""",
    "search_neighbours": f"WITH h AS ({_sql(_EITHER, 100)}) SELECT DISTINCT chunk_id, p.id AS page_id, CAST(p.pdf_index + 1 - page_number AS INTEGER) AS \"offset\" FROM h JOIN (SELECT DISTINCT id, copy_id, pdf_index FROM page_results) p ON p.copy_id = h.copy_id AND p.pdf_index + 1 - page_number IN (-1, 1)",
    "document_check": f"SELECT document_id, sensitivity FROM documents WHERE document_id IN (SELECT document_id FROM search_hits) AND {_SHOP}",
    "access_facts_json": f"SELECT doc_id FROM documents WHERE {_SHOP}",
    "generation_activate": """WITH c AS (SELECT DISTINCT id, document_id, generation FROM chunks), p AS (SELECT document_id, min(generation) AS active FROM c GROUP BY 1)
        SELECT DISTINCT document_id, generation, CASE WHEN generation = active + 1 THEN 'activated' ELSE 'stale' END AS outcome, CAST(CASE WHEN generation = active + 1 THEN generation ELSE active END AS INTEGER) AS active_generation, CAST(CASE WHEN generation = active + 1 THEN generation END AS INTEGER) AS collect_below FROM c JOIN p USING (document_id)""",
    "generation_spot": f"""WITH {_CH}, s AS (SELECT document_id, generation, arg_min(text, id) AS text FROM ch GROUP BY 1, 2),
        k AS (SELECT document_id, generation, list_filter(string_split_regex(text, '\\s+'), lambda x: regexp_full_match(x, '[A-Za-z0-9]{{4,}}'))[1] AS token FROM s)
        SELECT document_id, generation, token, true AS spot_retrieval FROM k""",
    "object_documents": f"""WITH o AS (SELECT DISTINCT object_kind, lower(trim(object_id)) AS object_id FROM authority_records), {_LAST}, {_R}
        SELECT object_kind, object_id, document_id FROM o JOIN documents ON object_kind = 'document' AND document_id = object_id UNION ALL SELECT object_kind, object_id, document_id FROM o JOIN revs ON object_kind = 'revision' AND rev = object_id
        UNION ALL SELECT object_kind, object_id, document_id FROM o JOIN last ON object_kind = 'copy' AND last.id = object_id JOIN revs ON rev = lower(trim(last.revision_id))""",
    "primary_assets": f"WITH {_PRIMARY} SELECT * FROM primary_assets",
    "page_image_lookup": f"""WITH {_PRIMARY}, {_LAST}, {_R}, v AS (SELECT document_id FROM documents WHERE {_SHOP}), c AS (SELECT DISTINCT last.id AS copy_id FROM last JOIN revs ON rev = lower(trim(revision_id)) WHERE document_id IN (SELECT document_id FROM v))
        SELECT p.id AS page_id, p.copy_id, CAST(pdf_index + 1 AS INTEGER) AS page_number, asset_id FROM (SELECT DISTINCT id, copy_id, pdf_index FROM page_results) p JOIN c USING (copy_id) JOIN primary_assets USING (copy_id)""",
    "document_record": f"""WITH {_LAST}, r AS (SELECT lower(id) AS rev, min(document_id) AS document_id, min(ordinal) AS ordinal FROM revisions GROUP BY 1), c AS (SELECT id, lower(trim(revision_id)) AS rev, created_at FROM last),
        rr AS (SELECT document_id, count(*) AS n_revisions, arg_min(rev, (coalesce(ordinal, -1), rev)) AS first_revision FROM r GROUP BY 1), cc AS (SELECT rev, count(*) AS n, arg_min(id, (created_at, id)) AS first_copy FROM c GROUP BY 1),
        nc AS (SELECT document_id, sum(n) AS n_copies FROM r JOIN cc USING (rev) GROUP BY 1), na AS (SELECT lower(trim(object_id)) AS document_id, count(DISTINCT id) AS n_records FROM authority_records WHERE object_kind = 'document' GROUP BY 1)
        SELECT d.document_id, coalesce(n_revisions, 0) AS n_revisions, first_revision, CAST(coalesce(n_copies, 0) AS BIGINT) AS n_copies, first_copy, coalesce(n_records, 0) AS n_records
        FROM documents d LEFT JOIN rr USING (document_id) LEFT JOIN cc ON cc.rev = first_revision LEFT JOIN nc USING (document_id) LEFT JOIN na USING (document_id)""",
}
