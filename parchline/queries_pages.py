"""Queries of page and document analysis over rows of parts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchline.functions import text as X
from parchline.functions.refs import norm_ref
from parchline.operators import pages, quality
from parchline.oracle_core import _BAD, _IMAGE, _NN, _PAGES, _VOTES, _WORDS
from parchline.queries_core import _assessed, _page_metrics, _scored_pages, documents, t

AVAILABLE, INSTALLED = ["eng", "fra", "deu", "spa", "jpn", "por"], ["eng", "fra", "deu", "ita", "jpn", "nld"]


def _parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, spans and images of files: an order is a page, its lines are spans and images."""
    li = t(spark, d, "lineitem")
    sheets = t(spark, d, "orders").select(F.col("o_orderkey").alias("page"), (400 + F.col("o_custkey") % 300).cast("double").alias("width_pt"), F.when(F.col("o_custkey") % 50 > 0, 700.0).otherwise(0.0).alias("height_pt"))
    spans = li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 4).alias("render_type"), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_discount")).alias("opacity"), F.col("l_quantity").cast("int").alias("n_chars"))
    x0, y0 = (F.col("l_partkey") % 200).cast("double"), (F.col("l_suppkey") % 300).cast("double")
    images = li.where("l_linenumber >= 4").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber").cast("bigint") * 10**9 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("seq"), (F.col("l_suppkey") * 13 % 3000).alias("width_px"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 9 - 9).alias("x1"), (y0 + F.col("l_quantity") * 8).alias("y1"))
    return sheets, spans, images


def page_scan(spark, d):
    s = pages.page_scan(*_parts(spark, d), "page")
    return s.select("page", "visible_chars", "invisible_chars", "n_images", F.round("image_cover", 6).alias("image_cover"), F.round("dominant_dpi", 4).alias("dominant_dpi"), "page_type", "text_source")


def render_limits(spark, d):
    """The resolution that a page can be rendered in below the pixel limit."""
    s, _, _ = _parts(spark, d)
    dpi = quality.render_dpi(F.col("width_pt") * 6 / 72.0, (F.col("height_pt") + 1) * 6 / 72.0)
    return s.select("page", F.round(dpi, 6).alias("dpi"))


def structural_scan(spark, d):
    f = F.when(F.col("l_returnflag") == "A", "/JBIG2Decode").when(F.col("l_returnflag") == "N", F.concat(F.lit("[/FlateDecode/"), F.when(F.col("l_suppkey") % 2 == 0, "DCTDecode").otherwise("CCITTFaxDecode"), F.lit("]"))).otherwise("")
    s = pages.structure(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), f.alias("filter")), "document")
    return s.select("document", F.array_join("filters", ",").alias("filters"), "jbig2_streams", F.array_join("risk_flags", ",").alias("risk_flags"))


def word_cover(spark, d):
    x0, y0 = (F.col("l_partkey") * 7 % 1700).cast("double"), (F.col("l_suppkey") * 11 % 2200).cast("double")
    b = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 4).alias("x1"), (y0 + 20).alias("y1"), F.lit(1700.0).alias("width"), F.lit(2200.0).alias("height"))
    return pages.text_cover(b, "page").select("page", F.round("text_cover", 8).alias("text_cover"))


def content_classes(spark, d):
    """Classes of pages by ink, long lines and word cover, and the blank ones among them."""
    li = t(spark, d, "lineitem")
    ink, lines, cover = F.col("l_discount") / 10, F.col("l_quantity") / 10, F.col("l_tax") * 2.5
    return li.select(quality.content_class(ink, lines, cover).alias("content_class")).groupBy("content_class").agg(F.count("*").alias("n"))


def document_languages(spark, d):
    """What decides every document's language, and whether it can be used."""
    c = X.letter_counts(F.col("text"))
    docs = documents(spark, d).select("doc_id", "text", *[c[k].alias(k) for k in c], X.language_votes(F.col("text")).alias("v"))
    docs = docs.select("doc_id", "text", *c, X.vote_winner(F.col("v")).alias("vote"))
    told = (F.col("doc_id") % 3 > 0) & (F.col("text") != "")
    docs = docs.select("doc_id", "kana", "latin", "vote", F.when(told, X.text_language(F.col("kana"), F.col("han"), F.col("latin"), F.col("vote"))).alias("own"))
    script = F.when(F.col("kana") > 0, "Japanese").when(F.col("latin") > 20, "Latin").when(F.col("doc_id") % 2 == 0, "Cyrillic")
    votes = F.array(F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.col("vote")))
    scripts = F.array(script, F.when(F.col("doc_id") % 5 == 0, F.lit("Hangul")), script)
    override, identity = F.when(F.col("doc_id") % 13 == 0, "por"), F.when(F.col("doc_id") % 4 == 0, F.lit("nld"))
    return docs.select("doc_id", pages.document_language(override, F.col("own"), F.col("vote"), votes, scripts, identity, AVAILABLE, INSTALLED).alias("l")).select("doc_id", "l.*")


def embedded_quality(spark, d):
    """Quality of the text layers of pages: garble where the language is English, suspect layers of recognised pages."""
    p = t(spark, d, "page_results").where("extracted_text IS NOT NULL").select("id", "text_origin", "extracted_text").distinct()
    c, votes = X.letter_counts(F.col("extracted_text")), X.language_votes(F.col("extracted_text"))
    lang = X.text_language(c["kana"], c["han"], c["latin"], X.vote_winner(votes))
    source = F.when(norm_ref("text_origin") == "native-text", "native-text").otherwise("embedded-ocr-layer")
    q = p.select("id", pages.embedded_quality(F.col("extracted_text"), lang, source).alias("q"))
    return q.select("id", F.round("q.garble", 6).alias("garble"), "q.suspect", "q.known")


def required_gates(spark, d):
    """Gates on required pages: the first page of every copy, and pure schematics where a copy has them."""
    p = pages.required_pages(_assessed(spark, d), F.col("pdf_index") == 0)
    g = quality.page_gates(p, F.col("required"))
    return g.where("required").select("id", "copy_id", "pdf_index", "image_gate", "text_gate")


def completeness(spark, d):
    p = _assessed(spark, d).withColumn("schematic_implied", F.col("pdf_index") % 10 == 9)
    return pages.schematic_pages(p, "copy_id").select("copy_id", "implied", "schematic_pages", "completeness")


def deduction_reasons(spark, d):
    return _scored_pages(spark, d).select("id", F.array_join(pages.reasons(F.col("deductions")), "; ").alias("reasons"))


def copy_reports(spark, d):
    """The JSON report of every copy, read back: its scores to one decimal and its summary."""
    r = pages.report(quality.roll_up(_assessed(spark, d), "copy_id"), "copy_id")
    read = lambda path: F.get_json_object("report", path)
    return r.select("copy_id", read("$.version").alias("version"), read("$.scores.if_text").cast("double").alias("if_text"), read("$.scores.tq_schem").cast("double").alias("tq_schem"), read("$.pages.text_pages").cast("bigint").alias("text_pages"), "summary")


def page_analysis(spark, d):
    """Pages from their measurements to scores: type of fidelity, text quality of the layer, what is unknown; blank pages have no score."""
    p = _scored_pages(spark, d).join(t(spark, d, "page_results").groupBy("id").agg(F.min("extracted_text").alias("text"), F.min("text_origin").alias("origin")), "id")
    c, votes = X.letter_counts(F.col("text")), X.language_votes(F.col("text"))
    lang = X.text_language(c["kana"], c["han"], c["latin"], X.vote_winner(votes))
    q = pages.embedded_quality(F.col("text"), lang, F.when(norm_ref("origin") == "native-text", "native-text").otherwise("embedded-ocr-layer"))
    null = F.lit(None).cast("double")
    a = p.select("id", "content_class", F.when(F.col("content_class") != "blank", F.col("image_score")).alias("image_score"), q.alias("q"))
    text_score = F.when(F.col("q.known"), quality.score(quality.text_deductions(null, null, null, null, F.col("q.garble"))))
    return a.select("id", "content_class", F.round("image_score", 6).alias("image_score"), F.round(text_score, 4).alias("text_score"), "q.suspect", (~F.col("q.known")).alias("text_unknown"))


def text_scores(spark, d):
    """Text scores with all five deductions, garble among them."""
    m = _page_metrics(spark, d).where("mean_conf IS NOT NULL").withColumn("garble", F.when(F.col("k") % 4 > 0, (F.col("k") % 50) / F.lit(60.0)))
    ded = quality.text_deductions(F.col("mean_conf"), F.col("low_fraction"), F.col("small_conf"), F.col("refdes_conf"), F.col("garble"))
    return m.select("k", F.round(quality.score(ded), 4).alias("score"), F.size(ded).alias("n_deductions")).groupBy("k", "n_deductions").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


_NAMES = """page_scan render_limits structural_scan word_cover content_classes document_languages embedded_quality required_gates completeness deduction_reasons
copy_reports page_analysis text_scores""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_FOR_PAGES = lambda sql: sql.replace("doc_id", "id").replace("documents WHERE text IS NOT NULL", "layer")
_LAYER = "layer AS (SELECT id, min(extracted_text) AS text, min(lower(trim(text_origin))) AS origin FROM page_results WHERE extracted_text IS NOT NULL GROUP BY id)"
_LANG = """lang AS (SELECT id, CASE WHEN kana + han + latin < 10 THEN NULL WHEN kana / (kana + han + latin) > 0.05 THEN 'jpn' WHEN han / (kana + han + latin) > 0.5 THEN NULL
  WHEN latin / (kana + han + latin) > 0.8 THEN coalesce(language, 'eng') END AS lang FROM mix)"""
_EMBEDDED = f"""WITH {_LAYER}, {_FOR_PAGES(_VOTES.strip()[5:])}, {_LANG}, w AS (SELECT id, {_WORDS} AS w FROM layer),
g AS (SELECT id, CASE WHEN len(w) >= 5 THEN len(list_filter(w, lambda x: {_BAD})) / len(w) END AS g FROM w),
quality AS (SELECT layer.id, CASE WHEN lang = 'eng' THEN g END AS garble, coalesce(lang = 'eng' AND g >= 0.3 AND coalesce(origin, '') <> 'native-text', false) AS suspect FROM layer JOIN lang USING (id) JOIN g USING (id))"""
_SHEETS = """sheets AS (SELECT o_orderkey AS page, 400 + o_custkey % 300 AS w, CASE WHEN o_custkey % 50 > 0 THEN 700 ELSE 0 END AS h FROM orders)"""
_HERE = f"WITH {_PAGES}"

ORACLE = {
    "page_scan": f"""WITH {_SHEETS}, sp AS (SELECT l_orderkey AS page, CAST(l_quantity AS INTEGER) AS n, l_partkey % 4 = 3 OR (CASE WHEN l_suppkey % 9 > 0 THEN l_discount ELSE 1 END) = 0 AS hidden FROM lineitem WHERE l_linenumber <= 3),
        c AS (SELECT page, coalesce(sum(n) FILTER (NOT hidden), 0) AS vis, coalesce(sum(n) FILTER (hidden), 0) AS inv FROM sp GROUP BY 1),
        im AS (SELECT l_orderkey AS page, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS seq, abs(l_quantity * 9 - 9) * abs(l_quantity * 8) AS area, CASE WHEN abs(l_quantity * 9 - 9) / 72.0::DOUBLE > 1e-6 AND l_suppkey * 13 % 3000 > 0 THEN (l_suppkey * 13 % 3000) / (abs(l_quantity * 9 - 9) / 72.0::DOUBLE) END AS dpi FROM lineitem WHERE l_linenumber >= 4),
        i AS (SELECT page, sum(area) AS area, count(*) AS n FROM im GROUP BY 1), top AS (SELECT page, dpi FROM im QUALIFY row_number() OVER (PARTITION BY page ORDER BY area DESC, seq) = 1),
        x AS (SELECT page, coalesce(vis, 0) AS vis, coalesce(inv, 0) AS inv, coalesce(i.n, 0) AS n, CASE WHEN w * h > 0 THEN least(1.0::DOUBLE, coalesce(i.area, 0) / (w * h)::DOUBLE) ELSE 0 END AS cover, top.dpi AS dpi FROM sheets LEFT JOIN c USING (page) LEFT JOIN i USING (page) LEFT JOIN top USING (page))
        SELECT page, CAST(vis AS BIGINT) AS visible_chars, CAST(inv AS BIGINT) AS invisible_chars, n AS n_images, round(cover, 6) AS image_cover, round(dpi, 4) AS dominant_dpi,
          CASE WHEN vis + inv < 10 THEN CASE WHEN cover >= 0.1 THEN 'image-only' ELSE 'native-text' END WHEN inv / (vis + inv) >= 0.8 AND cover >= 0.5 THEN 'ocr-layer' WHEN cover >= 0.1 THEN 'mixed' ELSE 'native-text' END AS page_type,
          CASE WHEN vis + inv > 0 AND inv / (vis + inv) >= 0.8 THEN 'embedded-ocr-layer' ELSE 'native-text' END AS text_source FROM x""",
    "render_limits": f"WITH {_SHEETS} SELECT page, round(least(300.0::DOUBLE, sqrt(45000000.0::DOUBLE / ((w * 6 / 72.0::DOUBLE) * ((h + 1) * 6 / 72.0::DOUBLE)))), 6) AS dpi FROM sheets",
    "structural_scan": """WITH f AS (SELECT l_orderkey AS document, unnest(CASE l_returnflag WHEN 'A' THEN ['JBIG2Decode'] WHEN 'N' THEN ['FlateDecode', CASE WHEN l_suppkey % 2 = 0 THEN 'DCTDecode' ELSE 'CCITTFaxDecode' END] END) AS f FROM lineitem),
        a AS (SELECT document, string_agg(DISTINCT f, ',' ORDER BY f) AS filters, count(*) FILTER (f = 'JBIG2Decode') AS n FROM f GROUP BY 1)
        SELECT document, coalesce(filters, '') AS filters, coalesce(n, 0) AS jbig2_streams, CASE WHEN n > 0 THEN 'jbig2_unknown_history' ELSE '' END AS risk_flags FROM (SELECT DISTINCT l_orderkey AS document FROM lineitem) LEFT JOIN a USING (document)""",
    "word_cover": """WITH b AS (SELECT l_orderkey AS page, l_partkey * 7 % 1700 AS x0, l_suppkey * 11 % 2200 AS y0, l_partkey * 7 % 1700 + l_quantity * 4 AS x1, l_suppkey * 11 % 2200 + 20 AS y1 FROM lineitem),
        g AS (SELECT page, CAST(least(63, trunc(x0 / 1700.0::DOUBLE * 64)) AS BIGINT) AS a, CAST(least(63, trunc(x1 / 1700.0::DOUBLE * 64)) AS BIGINT) AS b, CAST(least(63, trunc(y0 / 2200.0::DOUBLE * 64)) AS BIGINT) AS c, CAST(least(63, trunc(y1 / 2200.0::DOUBLE * 64)) AS BIGINT) AS d FROM b),
        x AS (SELECT page, unnest(range(a, b + 1)) AS gx, c, d FROM g), y AS (SELECT DISTINCT page, gx, unnest(range(c, d + 1)) AS gy FROM x) SELECT page, round(count(*) / 4096.0::DOUBLE, 8) AS text_cover FROM y GROUP BY 1""",
    "content_classes": """SELECT CASE WHEN l_discount / 10 < 0.005 THEN 'blank' WHEN l_quantity / 10 >= 3 AND l_tax * 2.5 < 0.1 THEN 'schematic' WHEN l_quantity / 10 >= 3 THEN 'mixed' ELSE 'text' END AS content_class, count(*) AS n FROM lineitem GROUP BY 1""",
    "document_languages": _VOTES
    + """, own AS (SELECT doc_id, kana, latin, language AS vote, CASE WHEN kana + han + latin < 10 THEN NULL WHEN kana / (kana + han + latin) > 0.05 THEN 'jpn' WHEN han / (kana + han + latin) > 0.5 THEN NULL WHEN latin / (kana + han + latin) > 0.8 THEN coalesce(language, 'eng') END AS lang FROM mix),
        a AS (SELECT o.*, doc_id % 3 > 0 AND text <> '' AS has, coalesce(doc_id % 3 > 0 AND text <> '' AND o.lang = 'eng' AND vote IS NULL, false) AS amb,
          CASE WHEN kana > 0 THEN 'Japanese' WHEN latin > 20 THEN 'Latin' WHEN doc_id % 2 = 0 THEN 'Cyrillic' WHEN doc_id % 5 = 0 THEN 'Hangul' END AS script FROM own o JOIN documents USING (doc_id)),
        b AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'por' END AS ov, CASE WHEN has AND NOT amb THEN lang END AS found, CASE WHEN NOT amb AND doc_id % 2 = 0 THEN vote END AS voted,
          CASE WHEN NOT amb THEN CASE script WHEN 'Japanese' THEN 'jpn' WHEN 'Cyrillic' THEN 'rus' WHEN 'Hangul' THEN 'kor' END END AS mapped, CASE WHEN doc_id % 4 = 0 THEN 'nld' END AS ident, amb OR coalesce(script = 'Latin', false) AS latin FROM a),
        c AS (SELECT doc_id, coalesce(ov, found, voted, mapped, ident, CASE WHEN latin THEN 'eng' END) AS detected, CASE WHEN ov IS NOT NULL THEN 'operator override' WHEN found IS NOT NULL THEN 'embedded text' WHEN voted IS NOT NULL THEN 'wordlist vote'
          WHEN mapped IS NOT NULL THEN 'script majority' WHEN ident IS NOT NULL THEN 'identity field' WHEN latin THEN 'ambiguous latin' ELSE 'unknown' END AS reason FROM b)
        SELECT doc_id, detected, CASE WHEN detected IN ('eng', 'fra', 'deu', 'jpn') THEN detected END AS used, coalesce(detected IN ('eng', 'fra', 'deu', 'jpn'), false) AS supported, reason FROM c""",
    "embedded_quality": _EMBEDDED + " SELECT id, round(garble, 6) AS garble, suspect, garble IS NOT NULL AS known FROM quality",
    "required_gates": f"""{_HERE}, r AS (SELECT *, coalesce(pdf_index = 0 OR (assessed AND content_class = 'schematic'), false) AS need FROM pages)
        SELECT id, copy_id, pdf_index, CASE WHEN assessed THEN CASE WHEN {_NN('if_score')} < 50 THEN 'blocking' WHEN {_NN('if_score')} < 75 THEN 'degraded' END END AS image_gate,
        CASE WHEN assessed AND NOT coalesce(tq_is_null, false) THEN CASE WHEN {_NN('tq_score')} < 50 THEN 'blocking' WHEN {_NN('tq_score')} < 70 THEN 'degraded' END END AS text_gate FROM r WHERE need""",
    "completeness": f"""{_HERE}, a AS (SELECT copy_id, bool_or(content_class = 'schematic' OR coalesce(pdf_index % 10 = 9, false)) AS implied, count(*) FILTER (content_class IN ('schematic', 'mixed')) AS n FROM pages WHERE assessed GROUP BY 1)
        SELECT copy_id, implied, n AS schematic_pages, CASE WHEN implied AND n = 0 THEN 'known-incomplete' ELSE 'unknown' END AS completeness FROM a""",
    "deduction_reasons": _IMAGE + "SELECT id, coalesce(string_agg(p.code || ': -' || printf('%.1f', p.points), '; ' ORDER BY list_position(['dpi_below_target', 'dpi_very_low', 'low_sharpness', 'speckle', 'skew', 'onebit_schematic'], p.code)) FILTER (p.points IS NOT NULL), '') AS reasons FROM points GROUP BY id",
    "copy_reports": f"""{_HERE}, v AS (SELECT copy_id, assessed, {_NN('if_score')} AS i, {_NN('tq_score')} AS q, content_class IN ('text', 'mixed') AS tx, content_class IN ('schematic', 'mixed') AS sc FROM pages),
        a AS (SELECT copy_id, avg(i) FILTER (assessed AND tx) AS if_text, avg(q) FILTER (assessed AND tx) AS tq_text, avg(i) FILTER (assessed AND sc) AS if_schem, avg(q) FILTER (assessed AND sc) AS tq_schem, count(*) FILTER (assessed AND tx) AS text_pages FROM v GROUP BY 1),
        s AS (SELECT *, CASE WHEN if_text IS NULL AND if_schem IS NULL THEN 'unknown' WHEN coalesce(if_text >= 75, true) AND coalesce(if_schem >= 75, true) THEN 'adequate' ELSE 'inadequate' END AS im,
          CASE WHEN tq_text IS NULL AND tq_schem IS NULL THEN 'unknown' WHEN coalesce(tq_text >= 70, true) AND coalesce(tq_schem >= 70, true) THEN 'adequate' ELSE 'inadequate' END AS te FROM a)
        SELECT copy_id, '1' AS version, round_even(if_text, 1) AS if_text, round_even(tq_schem, 1) AS tq_schem, text_pages, 'image ' || im || ', text ' || te AS summary FROM s""",
    "page_analysis": _EMBEDDED
    + f""", m2 AS ({_IMAGE} SELECT id, content_class, score FROM scores)
        SELECT m2.id, content_class, round(CASE WHEN content_class <> 'blank' THEN score END, 6) AS image_score, round(CASE WHEN garble IS NOT NULL THEN greatest(0, 100 - CASE WHEN garble > 0 AND 40 * least(1.0::DOUBLE, garble / 0.8::DOUBLE) >= 1 THEN 40 * least(1.0::DOUBLE, garble / 0.8::DOUBLE) ELSE 0 END) END, 4) AS text_score,
          coalesce(suspect, false) AS suspect, garble IS NULL AS text_unknown FROM m2 LEFT JOIN quality USING (id)""",
    "text_scores": """WITH m AS (SELECT l_partkey AS k, 30 + 1.4::DOUBLE * l_quantity AS mean_conf, (l_suppkey % 60) / 100.0::DOUBLE AS low, CASE WHEN l_partkey % 5 <> 0 THEN 40 + l_quantity END AS small, CASE WHEN l_partkey % 3 <> 0 THEN 50 + l_quantity END AS refdes,
          CASE WHEN l_partkey % 4 > 0 THEN 40 * least(1.0::DOUBLE, (l_partkey % 50) / 60.0::DOUBLE / 0.8::DOUBLE) END AS g FROM lineitem WHERE l_partkey % 7 <> 0),
        p AS (SELECT k, CASE WHEN mean_conf < 80 THEN 30.0::DOUBLE * (80.0::DOUBLE - mean_conf) / 80.0::DOUBLE END AS a, CASE WHEN low > 0.15::DOUBLE THEN 15.0::DOUBLE * least(1.0::DOUBLE, (low - 0.15::DOUBLE) / 0.35::DOUBLE) END AS b,
          CASE WHEN small < 70 THEN 10.0::DOUBLE END AS c, CASE WHEN refdes < 75 THEN 12.0::DOUBLE END AS d, CASE WHEN g >= 1 THEN g END AS e FROM m),
        s AS (SELECT k, round(greatest(0.0::DOUBLE, 100.0::DOUBLE - (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0) + coalesce(e, 0))), 4) AS score, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT + (e IS NOT NULL)::INT AS INTEGER) AS n_deductions FROM p)
        SELECT k, n_deductions, count(*) AS n, round(sum(score), 4) AS total FROM s GROUP BY 1, 2""",
}
