"""SQL for the queries of ``queries_core``, written for DuckDB from the rules rather than from the DataFrame code."""

from __future__ import annotations

from parchline.functions.text import folding
from parchline.model.constants import COMMON_WORDS, PHI_STRONG, PHI_WEAK, STOP_WORDS

_FROM, _TO = folding()
_TERMS = f"regexp_extract_all(lower(translate(text, '{_FROM}', '{_TO}')), '[\\p{{L}}\\p{{N}}\\p{{Co}}\\-/.]+')"
_BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TOKENS = f"list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda x: x <> '')"
_LEVEL = "CASE {0} WHEN 'open' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 WHEN 'restricted' THEN 3 END"
_DOMAINS = "list_distinct(list_filter(list_concat([primary_domain], coalesce(additional_domains, []::VARCHAR[])), lambda x: x IS NOT NULL))"
_SHOP = f"(list_contains({_DOMAINS}, 'archive') AND coalesce({_LEVEL.format('sensitivity')} <= 1, false))"

_ALL5 = ["archive", "paradise", "starcade", "retrolodge", "personal"]
_OWNER = f"(len(list_intersect({_DOMAINS}, {_ALL5!r})) > 0 AND {_LEVEL.format('sensitivity')} IS NOT NULL)"
_FLOOR = f"((list_contains({_DOMAINS}, 'starcade') AND coalesce({_LEVEL.format('sensitivity')} <= 2, false)) OR (list_contains({_DOMAINS}, 'paradise') AND coalesce({_LEVEL.format('sensitivity')} <= 0, false)))"

_INDEX = f"""
WITH terms AS (SELECT doc_id, unnest({_TERMS}) AS term, generate_subscripts({_TERMS}, 1) AS pos FROM documents WHERE text IS NOT NULL),
lens AS (SELECT doc_id, len({_TERMS}) AS n FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM lens),
"""
_SCORE = """
df AS (SELECT leaf, count(*) AS df FROM hits GROUP BY leaf),
scored AS (
  SELECT doc_id, sum(-(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) AS score
  FROM hits JOIN df USING (leaf) JOIN lens USING (doc_id), stats WHERE doc_id IN (SELECT doc_id FROM found) GROUP BY doc_id)
"""


def _bm25(hits: str, found: str) -> str:
    return _INDEX + f"hits AS ({hits}), found AS ({found})," + _SCORE + "SELECT doc_id, round(score, 6) AS score FROM scored"


def _leaf(n: int, term: str) -> str:
    return f"SELECT {n} AS leaf, doc_id, count(*) AS tf FROM terms WHERE term = '{term}' GROUP BY doc_id"


_ANY = "SELECT DISTINCT doc_id FROM hits"
_BOTH = "SELECT doc_id FROM hits GROUP BY doc_id HAVING count(DISTINCT leaf) = 2"

_PAGES = """pages AS (SELECT DISTINCT * EXCLUDE (arrived_at, content_class, assessed), coalesce(nullif(lower(trim(content_class)), ''), 'unknown') AS content_class, coalesce(assessed, false) AS assessed FROM page_results)"""
_NN = lambda c: f"(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)"
_IMAGE = f"""
WITH {_PAGES},
m AS (SELECT id, content_class, {_NN('effective_dpi')} AS dpi, {_NN('sharpness')} AS sharp, {_NN('speckle_index')} AS speckle, {_NN('skew_deg')} AS skew, coalesce(is_1bit, false) AS one_bit,
  content_class IN ('schematic', 'mixed') AS schem, CASE WHEN content_class IN ('schematic', 'mixed') THEN 300.0::DOUBLE ELSE 220.0::DOUBLE END AS target FROM pages),
points AS (SELECT id, content_class, unnest([
  {{'code': 'dpi_below_target', 'points': CASE WHEN dpi < target THEN 40.0::DOUBLE * (target - dpi) / target END}},
  {{'code': 'dpi_very_low', 'points': CASE WHEN dpi < target AND dpi < 150 THEN 10.0::DOUBLE END}},
  {{'code': 'low_sharpness', 'points': CASE WHEN sharp < 120 THEN 15.0::DOUBLE END}},
  {{'code': 'speckle', 'points': CASE WHEN speckle > 6 THEN 8.0::DOUBLE END}},
  {{'code': 'skew', 'points': CASE WHEN skew > 1.5 THEN 6.0::DOUBLE END}},
  {{'code': 'onebit_schematic', 'points': CASE WHEN one_bit AND schem THEN 12.0::DOUBLE END}}]) AS p FROM m),
scores AS (SELECT id, content_class, greatest(0.0::DOUBLE, 100.0::DOUBLE - coalesce(sum(p.points), 0)) AS score, count(p.points) AS n_deductions FROM points GROUP BY ALL)
"""

_LATEST = """latest AS (SELECT DISTINCT * EXCLUDE (arrived_at) FROM copies c WHERE row_version = (SELECT max(row_version) FROM copies x WHERE x.id = c.id))"""
_BEST = """best AS (SELECT revision_id, copy_id FROM (SELECT lower(trim(revision_id)) AS revision_id, id AS copy_id, row_number() OVER (PARTITION BY lower(trim(revision_id)) ORDER BY
  is_document_default DESC, superseded, CASE WHEN fitness_text IS NULL OR isnan(fitness_text) THEN -1 ELSE fitness_text END DESC, created_at, id) AS place FROM latest) WHERE place = 1 AND revision_id <> '')"""
_WINDOWS = "CASE WHEN len(tok) = 0 THEN [] WHEN len(tok) <= 800 THEN [0] ELSE range(0, len(tok) - 100, 700) END"
_CHUNKS = "c AS (SELECT DISTINCT * EXCLUDE (arrived_at, text) FROM chunks), pointer AS (SELECT document_id, max(generation) AS active_generation FROM chunks GROUP BY 1)"
_REVS = "revs AS (SELECT DISTINCT lower(id) AS rev, document_id FROM revisions)"

_RESOLVE = """
WITH rec AS (SELECT DISTINCT * REPLACE (lower(status) AS status, lower(trim(object_id)) AS object_id) FROM authority_records),
live AS (SELECT *, CASE WHEN principal = 'owner' THEN 0 ELSE 10000000 END + CASE principal WHEN 'svc-review' THEN 0 WHEN 'svc-intake' THEN 1 ELSE 1000000 END AS rnk, coalesce(effective_date, '') AS eff
  FROM rec WHERE NOT EXISTS (SELECT 1 FROM rec o WHERE o.object_kind = rec.object_kind AND o.object_id = rec.object_id AND lower(trim(o.supersedes)) = rec.id)),
tops AS (SELECT * FROM (SELECT *, min(rnk) OVER (PARTITION BY object_kind, object_id) AS best FROM live) WHERE rnk = best),
ranked AS (SELECT *, row_number() OVER (PARTITION BY object_kind, object_id ORDER BY eff DESC, recorded_at DESC, arrival DESC) AS by_eff,
  row_number() OVER (PARTITION BY object_kind, object_id ORDER BY recorded_at DESC, arrival DESC) AS by_rec FROM tops),
agg AS (SELECT object_kind, object_id, count(*) AS n_top, count(DISTINCT principal) AS k, max(eff) AS latest, max(CASE WHEN by_eff = 1 THEN id END) AS own, max(CASE WHEN by_eff = 1 THEN status END) AS own_status,
  max(CASE WHEN by_rec = 1 THEN id END) AS last_id, max(CASE WHEN by_rec = 1 THEN status END) AS last_status, max(CASE WHEN by_rec = 1 THEN eff END) AS last_eff FROM ranked GROUP BY 1, 2),
resolved AS (SELECT object_kind, object_id, CASE WHEN k = 1 THEN own WHEN last_eff >= latest THEN last_id END AS winner, CASE WHEN k = 1 THEN own_status WHEN last_eff >= latest THEN last_status END AS status,
  NOT (k = 1 OR last_eff >= latest) AS conflict, n_top FROM agg
  UNION ALL SELECT object_kind, object_id, NULL, NULL, false, 0 FROM (SELECT DISTINCT object_kind, object_id FROM rec) WHERE (object_kind, object_id) NOT IN (SELECT (object_kind, object_id) FROM live))
"""
_PINS = """, revs AS (SELECT id, min(document_id) AS document_id, max(ordinal) AS ordinal FROM revisions GROUP BY id),
pins AS (SELECT document_id, arg_max(CASE WHEN status = 'approved-for-use' THEN id END, CASE WHEN status = 'approved-for-use' THEN lpad(CAST(coalesce(ordinal, -1) + 1 AS VARCHAR), 12, '0') || id END) AS revision_id, bool_or(conflict) AS conflict
  FROM revs JOIN resolved ON object_kind = 'revision' AND object_id = id GROUP BY document_id)
"""


def _boundary(term: str) -> str:
    plain = "".join("\\" + c if not c.isalnum() and c != " " else c for c in term)
    return f"regexp_matches(lower(text), '(^|[^a-z]){plain}($|[^a-z])')"


def _phi(strong: list[str], weak: list[str]) -> str:
    cases = " ".join(f"WHEN {_boundary(x)} THEN 'phi-strong-indicator:{x.replace(' ', '-')}'" for x in strong)
    hits = "list_filter([" + ", ".join(f"CASE WHEN {_boundary(x)} THEN '{x}' END" for x in weak) + "], lambda x: x IS NOT NULL)"
    return f"CASE {cases} WHEN len({hits}) >= 2 THEN 'phi-multiple-weak-indicators' WHEN len({hits}) = 1 THEN 'phi-uncertain:' || {hits}[1] END"


_BARE = rf"list_filter(list_transform({_TOKENS}, lambda x: lower(trim(x, '.,;:()[]\"''!?®™'))), lambda x: x <> '')"
_VOTES = f"""
WITH bare AS (SELECT doc_id, text, {_BARE} AS w FROM documents WHERE text IS NOT NULL),
votes AS (SELECT doc_id, text, len(w) AS votes_n, {', '.join(f"len(list_filter(w, lambda x: list_contains({v!r}, x))) AS votes_{k}" for k, v in STOP_WORDS.items())} FROM bare),
won AS (SELECT *, list_reverse_sort([{', '.join('votes_' + k for k in STOP_WORDS)}]) AS s FROM votes),
named AS (SELECT *, CASE WHEN votes_n >= 10 AND s[1] >= 3 AND s[1] >= 1.5 * s[2] THEN CASE s[1] {' '.join(f"WHEN votes_{k} THEN '{k}'" for k in STOP_WORDS)} END END AS language FROM won),
mix AS (SELECT doc_id, language, len(regexp_extract_all(text, '[\\x{{3040}}-\\x{{30ff}}]')) AS kana, len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) AS han, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM named)
"""
_WORDS = rf"list_filter(list_transform({_TOKENS}, lambda x: lower(trim(x, '.,;:()[]\"''!?'))), lambda x: regexp_full_match(x, '[a-z]+'))"
_BAD = f"NOT list_contains({COMMON_WORDS!r}, x) AND len(x) > 2 AND (len(x) > 20 OR NOT regexp_matches(x, '[aeiouy]') OR regexp_matches(x, '[^aeiouy]{{5,}}'))"
_A1, _A2 = (r"""regexp_extract_all(text, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', """ + f"{k})" for k in (1, 2))
_HREF = r"""regexp_extract_all(text, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>', 1)"""

_CHAIN = """WITH RECURSIVE b AS MATERIALIZED (SELECT event_id + 1 AS line_no, CAST(to_json({'event_type': event_type, 'user_id': user_id, 'props': props}) AS VARCHAR) AS body FROM events),
chain AS (SELECT 0::BIGINT AS line_no, '' AS body, '' AS prev, '' AS hash UNION ALL SELECT b.line_no, b.body, c.hash, sha256(c.hash || b.body) FROM chain c JOIN b ON b.line_no = c.line_no + 1)"""
_OUTBOX = """outbox AS (SELECT o_orderkey AS id, o_orderpriority AS kind, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS applied_at, o_custkey % 4 AS attempts,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'queued' END AS state, CAST(o_orderpriority[1] AS INTEGER) AS priority, o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS lease_until, CAST(o_custkey % 10 AS INTEGER) AS queue FROM orders)"""

ORACLE = {
    "access_filter_shop": f"SELECT doc_id, primary_domain, sensitivity FROM documents WHERE {_SHOP}",
    "access_matrix_counts": f"""SELECT principal, sensitivity, count(*) AS n FROM (
        SELECT 'owner' AS principal, sensitivity FROM documents WHERE {_OWNER} UNION ALL SELECT 'shop', sensitivity FROM documents WHERE {_SHOP} UNION ALL SELECT 'floor', sensitivity FROM documents WHERE {_FLOOR}) GROUP BY ALL""",
    "widening_audit": f"""WITH x AS (SELECT title, doc_id, {_LEVEL.format('sensitivity')} AS lv, {_DOMAINS} AS dom FROM documents WHERE title IS NOT NULL),
        f AS (SELECT * FROM x WHERE doc_id = (SELECT min(doc_id) FROM x y WHERE y.title = x.title))
        SELECT x.doc_id, coalesce(x.lv < f.lv, false) OR len(list_filter(x.dom, lambda z: NOT list_contains(f.dom, z))) > 0 AS widens FROM x JOIN f USING (title) WHERE x.doc_id <> f.doc_id""",
    "dedup_assets": "SELECT sha256(text) AS sha256, min(doc_id) AS first_key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "dedup_context": "SELECT sha256(text) AS sha256, primary_domain, min(doc_id) AS first_key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "source_merge": "SELECT sha256(text) AS sha256, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(DISTINCT source) AS n_values FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "chunk_windows": f"""WITH a AS (SELECT doc_id, {_TOKENS} AS tok FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, tok, unnest({_WINDOWS}) AS s FROM a)
        SELECT doc_id, CAST(s // 700 AS INTEGER) AS seq, CAST(len(tok[s + 1 : s + 800]) AS INTEGER) AS n_tokens, md5(array_to_string(tok[s + 1 : s + 800], ' ')) AS md5 FROM b""",
    "tokenize_df": _INDEX.rstrip().rstrip(",") + " SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM terms GROUP BY term",
    "postings": _INDEX.rstrip().rstrip(",") + " SELECT term, doc_id, count(*) AS tf, CAST(min(pos) - 1 AS INTEGER) AS first_position FROM terms GROUP BY 1, 2",
    "language_vote": _VOTES + f"SELECT doc_id, {', '.join(f'CAST(votes_{k} AS INTEGER) AS votes_{k}' for k in [*STOP_WORDS, 'n'])}, language FROM named",
    "letter_mix": _VOTES + "SELECT doc_id, CAST(kana AS INTEGER) AS kana, CAST(han AS INTEGER) AS han, CAST(latin AS INTEGER) AS latin FROM mix",
    "language_detect": _VOTES
    + """SELECT doc_id, CASE WHEN kana + han + latin < 10 THEN NULL WHEN kana / (kana + han + latin) > 0.05 THEN 'jpn' WHEN han / (kana + han + latin) > 0.5 THEN NULL
        WHEN latin / (kana + han + latin) > 0.8 THEN coalesce(language, 'eng') END AS language FROM mix""",
    "garble_fraction": f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN len(list_filter(w, lambda x: {_BAD})) / len(w) END AS g FROM w)
        SELECT doc_id, round(g, 6) AS garble, coalesce(g >= 0.3, false) AS suspect FROM g""",
    "phi_screen": f"SELECT doc_id, {_phi(['description of the symptom', 'monitor chassis'], ['technician', 'isopropyl', 'symptom'])} AS verdict FROM documents WHERE text IS NOT NULL",
    "phi_fixed_terms": f"SELECT {_phi(PHI_STRONG, PHI_WEAK)} AS verdict, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "html_links": f"SELECT doc_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS n, unnest(h) AS href FROM (SELECT doc_id, {_HREF} AS h FROM documents)",
    "directory_entries": f"""WITH a AS (SELECT unnest(list_zip({_A1}, {_A2})) AS x FROM documents), b AS (SELECT struct_extract(x, 1) AS href, trim(regexp_replace(struct_extract(x, 2), '<[^>]*>', '', 'g')) AS t FROM a),
        h AS (SELECT href, t FROM b UNION ALL SELECT regexp_replace(href, '^http://[^/]*', ''), t FROM b)
        SELECT url_decode(string_split(regexp_replace(href, '/+$', ''), '/')[-1]) AS name, suffix(href, '/') AS is_dir, count(*) AS n FROM h WHERE href <> '' AND href[1] NOT IN ('?', '#') AND NOT starts_with(href, 'http://') AND NOT starts_with(href, 'https://')
          AND href NOT IN ('../', '..', '/') AND lower(t) NOT IN ('parent directory', '..') GROUP BY ALL""",
    "index_build": _INDEX.rstrip().rstrip(",") + " SELECT (SELECT count(*) FROM (SELECT DISTINCT term, doc_id FROM terms)) AS postings, (SELECT count(DISTINCT term) FROM terms) AS terms, (SELECT count(*) FROM terms) AS tokens, (SELECT n_docs FROM stats) AS documents",
    "bm25_single": _bm25(_leaf(0, "potentiometer"), _ANY),
    "bm25_and": _bm25(_leaf(0, "washers") + " UNION ALL " + _leaf(1, "gasket"), _BOTH),
    "bm25_or": _bm25(_leaf(0, "gasket") + " UNION ALL " + _leaf(1, "isopropyl"), _ANY),
    "bm25_not": _bm25(_leaf(0, "potentiometer"), _ANY + " WHERE doc_id NOT IN (SELECT doc_id FROM terms WHERE term = 'washers')"),
    "bm25_phrase": _bm25(
        "SELECT 0 AS leaf, a.doc_id, count(*) AS tf FROM terms a JOIN terms b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.term = 'contact' JOIN terms c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 AND c.term = 'between' WHERE a.term = 'loose' GROUP BY 2", _ANY
    ),
    "bm25_prefix": _bm25("SELECT 0 AS leaf, doc_id, count(*) AS tf FROM terms WHERE starts_with(term, 'potentio') GROUP BY doc_id", _ANY),
    "bm25_near": _bm25(
        """SELECT 0 AS leaf, doc_id, count(*) AS tf FROM (SELECT doc_id, pos, max(CASE WHEN term = 'washers' THEN pos END) OVER w AS p1, max(CASE WHEN term = 'gasket' THEN pos END) OVER w AS p2 FROM terms WHERE term IN ('washers', 'gasket')
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND pos - least(p1, p2) - 1 <= 5 GROUP BY doc_id""",
        _ANY,
    ),
    "search_topk_secure": _INDEX
    + f"hits AS ({_leaf(0, 'transformer')} UNION ALL {_leaf(1, 'potentiometer')}), found AS ({_ANY}),"
    + _SCORE
    + f"SELECT doc_id, document_id, round(score, 6) AS score FROM scored JOIN documents USING (doc_id) WHERE {_SHOP} ORDER BY 3, 1 LIMIT 20",
    "search_pinned_tier": _RESOLVE
    + _PINS
    + f""", terms AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents WHERE text IS NOT NULL), lens AS (SELECT doc_id, len({_TERMS}) AS n FROM documents WHERE text IS NOT NULL),
    stats AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM lens), hits AS ({_leaf(0, 'capacitor')}), found AS ({_ANY}),"""
    + _SCORE
    + """SELECT doc_id, CAST(CASE WHEN revision_id IS NOT NULL THEN 0 ELSE 1 END AS INTEGER) AS tier, coalesce(conflict, false) AS conflict, round(score, 6) AS score
    FROM scored JOIN documents USING (doc_id) LEFT JOIN pins USING (document_id) ORDER BY 2, 4, 1 LIMIT 50""",
    "search_badges": """WITH h AS (SELECT id, min(nullif(lower(trim(copy_id)), '')) AS copy_id, min(array_to_string(list_sort(badges), ',')) AS logged FROM search_hits GROUP BY id),
        s AS (SELECT id AS copy_id, arg_max(coalesce(assessment_mode, ''), (row_version, arrived_at)) AS mode, arg_max(superseded, (row_version, arrived_at)) AS sup FROM copies GROUP BY id)
        SELECT h.id, copy_id, logged, array_to_string(list_filter([CASE WHEN mode = 'screening' THEN 'provisional' END, CASE WHEN sup = 1 THEN 'superseded' END], lambda x: x IS NOT NULL), ',') AS made FROM h JOIN s USING (copy_id)""",
    "if_score": _IMAGE + "SELECT id, content_class, round(score, 6) AS score, CAST(n_deductions AS INTEGER) AS n_deductions FROM scores",
    "deduction_totals": _IMAGE + "SELECT p.code AS code, count(*) AS n, round(sum(p.points), 2) AS points FROM points WHERE p.points IS NOT NULL GROUP BY 1",
    "grade_distribution": _IMAGE + "SELECT content_class, CASE WHEN score >= 88 THEN 'A' WHEN score >= 78 THEN 'B' WHEN score >= 68 THEN 'C' WHEN score >= 55 THEN 'D' ELSE 'F' END AS grade, count(*) AS n FROM scores GROUP BY ALL",
    "tq_score": """WITH m AS (SELECT l_partkey AS k, 30 + 1.4::DOUBLE * l_quantity AS mean_conf, (l_suppkey % 60) / 100.0::DOUBLE AS low, CASE WHEN l_partkey % 5 <> 0 THEN 40 + l_quantity END AS small, CASE WHEN l_partkey % 3 <> 0 THEN 50 + l_quantity END AS refdes FROM lineitem WHERE l_partkey % 7 <> 0),
        p AS (SELECT k, CASE WHEN mean_conf < 80 THEN 30.0::DOUBLE * (80.0::DOUBLE - mean_conf) / 80.0::DOUBLE END AS a, CASE WHEN low > 0.15::DOUBLE THEN 15.0::DOUBLE * least(1.0::DOUBLE, (low - 0.15::DOUBLE) / 0.35::DOUBLE) END AS b,
          CASE WHEN small < 70 THEN 10.0::DOUBLE END AS c, CASE WHEN refdes < 75 THEN 12.0::DOUBLE END AS d FROM m),
        s AS (SELECT k, round(greatest(0.0::DOUBLE, 100.0::DOUBLE - (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0))), 4) AS score, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT AS INTEGER) AS n_deductions FROM p)
        SELECT k, n_deductions, count(*) AS n, round(sum(score), 4) AS total FROM s GROUP BY 1, 2""",
    "doc_rollup": f"""WITH {_PAGES}, v AS (SELECT copy_id, content_class, assessed, {_NN('if_score')} AS i, {_NN('tq_score')} AS q, content_class IN ('text', 'mixed') AS tx, content_class IN ('schematic', 'mixed') AS sc FROM pages),
        a AS (SELECT copy_id, avg(i) FILTER (assessed AND tx) AS if_text, avg(q) FILTER (assessed AND tx) AS tq_text, avg(i) FILTER (assessed AND sc) AS if_schem, avg(q) FILTER (assessed AND sc) AS tq_schem,
          count(*) FILTER (assessed AND tx) AS text_pages, count(*) FILTER (assessed AND sc) AS schem_pages, count(*) FILTER (assessed AND i < 75) AS image_below, count(*) FILTER (assessed AND q < 70) AS text_below FROM v GROUP BY 1)
        SELECT copy_id, round(if_text, 4) AS if_text, round(tq_text, 4) AS tq_text, round(if_schem, 4) AS if_schem, round(tq_schem, 4) AS tq_schem, round(0.5::DOUBLE * if_text + 0.5::DOUBLE * tq_text, 4) AS fitness_text, round(0.7::DOUBLE * if_schem + 0.3::DOUBLE * tq_schem, 4) AS fitness_schem,
          text_pages, schem_pages, image_below, text_below, CASE WHEN if_text IS NULL AND if_schem IS NULL THEN NULL ELSE coalesce(if_text >= 75, true) AND coalesce(if_schem >= 75, true) END AS image_adequate,
          CASE WHEN tq_text IS NULL AND tq_schem IS NULL THEN NULL ELSE coalesce(tq_text >= 70, true) AND coalesce(tq_schem >= 70, true) END AS text_adequate FROM a""",
    "page_gates": f"""WITH {_PAGES}, g AS (SELECT id, copy_id, pdf_index, CASE WHEN {_NN('if_score')} < 50 THEN 'blocking' WHEN {_NN('if_score')} < 75 THEN 'degraded' END AS image_gate,
        CASE WHEN coalesce(tq_is_null, false) THEN NULL WHEN {_NN('tq_score')} < 50 THEN 'blocking' WHEN {_NN('tq_score')} < 70 THEN 'degraded' END AS text_gate FROM pages WHERE assessed AND content_class = 'schematic')
        SELECT * FROM g WHERE image_gate IS NOT NULL OR text_gate IS NOT NULL""",
    "worst_pages": f"""WITH {_PAGES} SELECT copy_id, id, place FROM (SELECT copy_id, id, CAST(row_number() OVER (PARTITION BY copy_id ORDER BY if_score, pdf_index, id) AS INTEGER) AS place FROM pages WHERE if_score IS NOT NULL AND NOT isnan(if_score)) WHERE place <= 5""",
    "ocr_word_stats": r"""WITH w AS (SELECT l_orderkey, 2 * l_quantity AS conf, p_size AS height, 'RCLQDJKWFY'[l_partkey % 10 + 1] || l_suppkey AS tok FROM lineitem JOIN part ON p_partkey = l_partkey),
        r AS (SELECT *, regexp_matches(tok, '^(?:[RCLQDJKWFY]|CR|IC|U|VR|TP|XT)\d{1,4}[A-Za-z]?$') OR regexp_matches(tok, '^[A-Z0-9][A-Z0-9-]{3,}$') AS ref FROM w)
        SELECT l_orderkey, count(*) AS word_count, CASE WHEN count(*) >= 5 THEN round(avg(conf), 6) END AS mean_conf, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (conf < 60) / count(*), 6) END AS low_conf_fraction,
          CASE WHEN count(*) >= 5 THEN round(avg(conf) FILTER (height <= 18), 6) END AS small_text_conf, CASE WHEN count(*) >= 5 THEN round(avg(conf) FILTER (ref), 6) END AS refdes_conf FROM r GROUP BY 1""",
    "screening_sample": """SELECT id, page_count, array_to_string(CASE WHEN page_count <= 0 THEN [] WHEN page_count <= 16 THEN range(0, page_count) ELSE list_sort(list_distinct(list_transform(range(0, 16), lambda i: CAST(round_even(i * ((page_count - 1) / 15.0::DOUBLE), 0) AS BIGINT)))) END, ',') AS pages
        FROM (SELECT DISTINCT id, page_count FROM copies) WHERE page_count IS NOT NULL""",
    "skew_weighted_median": f"""WITH {_PAGES}, v AS (SELECT content_class, abs(skew_deg) AS skew, CAST(round(effective_dpi) AS BIGINT) AS w FROM pages WHERE skew_deg IS NOT NULL AND NOT isnan(skew_deg) AND abs(skew_deg) < 90 AND effective_dpi BETWEEN 1 AND 10000),
        r AS (SELECT content_class, skew, sum(w) OVER (PARTITION BY content_class ORDER BY skew, w ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY content_class) AS total FROM v)
        SELECT content_class, min(skew) AS skew FROM r WHERE 2 * run >= total GROUP BY 1""",
    "default_copy_top1": f"WITH {_LATEST}, {_BEST} SELECT * FROM best",
    "generation_build": f"""WITH {_LATEST}, {_BEST}, p AS (SELECT DISTINCT id, copy_id, pdf_index, extracted_text AS text FROM page_results WHERE extracted_text <> ''), k AS (SELECT revision_id, copy_id, p.id AS page_id, pdf_index, {_TOKENS} AS tok FROM p JOIN best USING (copy_id)),
        w AS (SELECT *, unnest({_WINDOWS}) AS s FROM k)
        SELECT revision_id, copy_id, page_id, CAST(pdf_index + 1 AS INTEGER) AS page_number, CAST(s // 700 AS INTEGER) AS seq, md5(array_to_string(tok[s + 1 : s + 800], ' ')) AS md5 FROM w""",
    "generation_visible": f"WITH {_CHUNKS} SELECT id, document_id, generation FROM c JOIN pointer USING (document_id) WHERE generation = active_generation",
    "generation_gc": f"WITH {_CHUNKS} SELECT id, document_id, generation FROM c JOIN pointer USING (document_id) WHERE generation < active_generation",
    "generation_verify": f"""WITH {_CHUNKS}, {_REVS} SELECT c.document_id, generation, count(*) AS n_chunks, count(*) FILTER (rev IS NULL) AS n_orphans, count(*) FILTER (rev IS NULL) = 0 AS ok
        FROM c LEFT JOIN revs ON rev = lower(trim(revision_id)) AND revs.document_id = c.document_id GROUP BY 1, 2""",
    "orphan_chunks": f"WITH {_CHUNKS}, {_REVS} SELECT id, document_id FROM c WHERE NOT EXISTS (SELECT 1 FROM revs WHERE rev = lower(trim(revision_id)) AND revs.document_id = c.document_id)",
    "copy_documents": f"""WITH {_LATEST}, r AS (SELECT DISTINCT lower(id) AS revision_id, document_id, ordinal, label FROM revisions)
        SELECT c.id AS copy_id, r.revision_id, d.document_id, ordinal, label, title, issuer, source_class FROM latest c JOIN r ON r.revision_id = lower(trim(c.revision_id)) JOIN documents d ON d.document_id = r.document_id""",
    "grouping_band": f"""WITH {_LATEST}, c AS (SELECT lower(trim(revision_id)) AS revision_id, page_count, count(*) AS n FROM latest WHERE revision_id IS NOT NULL AND trim(revision_id) <> '' AND page_count > 0 GROUP BY 1, 2),
        g AS (SELECT *, lag(page_count) OVER (PARTITION BY revision_id ORDER BY page_count) AS before FROM c),
        r AS (SELECT *, sum(CASE WHEN before IS NULL OR page_count - before > 0.02 * page_count THEN 1 ELSE 0 END) OVER (PARTITION BY revision_id ORDER BY page_count) AS run FROM g)
        SELECT revision_id, CAST(run AS BIGINT) AS run, min(page_count) AS least, max(page_count) AS most, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""",
    "text_sample": """WITH p AS (SELECT DISTINCT id, copy_id, pdf_index, extracted_text FROM page_results WHERE extracted_text <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY copy_id ORDER BY pdf_index, id) AS k FROM p),
        s AS (SELECT copy_id, substring(string_agg(extracted_text, ' ' ORDER BY k), 1, 20000) AS x FROM r WHERE k <= 3 GROUP BY 1) SELECT copy_id, CAST(length(x) AS INTEGER) AS n_chars, md5(x) AS md5 FROM s""",
    "document_details": """WITH r AS (SELECT DISTINCT lower(id) AS rev, document_id, ordinal, label FROM revisions), c AS (SELECT lower(trim(revision_id)) AS rev, count(DISTINCT id) AS n FROM copies GROUP BY 1),
        l AS (SELECT document_id, label FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(ordinal, -1) DESC, rev DESC) AS k FROM r WHERE label IS NOT NULL) WHERE k = 1),
        a AS (SELECT document_id, count(DISTINCT rev) AS n_revisions, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_copies FROM r LEFT JOIN c USING (rev) GROUP BY 1)
        SELECT d.document_id, title, coalesce(n_revisions, 0) AS n_revisions, coalesce(n_copies, 0) AS n_copies, l.label AS latest_label FROM documents d LEFT JOIN a USING (document_id) LEFT JOIN l USING (document_id)""",
    "next_ordinal": "SELECT document_id, coalesce(max(ordinal), -1) + 1 AS next_ordinal FROM revisions GROUP BY 1",
    "provisional_default": f"""WITH {_LATEST}, {_REVS}, c AS (SELECT l.id, revs.document_id, is_document_default, created_at FROM latest l JOIN revs ON rev = lower(trim(revision_id)))
        SELECT document_id, copy_id FROM (SELECT document_id, id AS copy_id, max(coalesce(is_document_default, 0)) OVER (PARTITION BY document_id) AS has, row_number() OVER (PARTITION BY document_id ORDER BY created_at, id) AS k FROM c) WHERE has = 0 AND k = 1""",
    "chunk_metadata": "SELECT id, json_extract_string(metadata, '$.text_origin') AS text_origin, CAST(json_extract(metadata, '$.superseded') AS INTEGER) AS superseded FROM (SELECT DISTINCT id, metadata FROM chunks)",
    "hit_citations": """SELECT DISTINCT id, document_id AS document, nullif(lower(trim(revision_id)), '') AS revision, nullif(lower(trim(copy_id)), '') AS representation, 'page' AS locator, page_number AS page FROM search_hits""",
    "text_page_counts": f"""WITH {_LATEST}, {_REVS} SELECT revs.document_id, count(DISTINCT p.id) AS n_text_pages FROM page_results p JOIN latest l ON l.id = p.copy_id JOIN revs ON rev = lower(trim(l.revision_id)) WHERE extracted_text <> '' GROUP BY 1""",
    "recall_at_k": _INDEX
    + f"""hits AS ({_leaf(0, 'isopropyl')}), found AS ({_ANY}),"""
    + _SCORE
    + """, top AS (SELECT doc_id FROM scored ORDER BY round(score, 6), doc_id LIMIT 100), wanted AS (SELECT DISTINCT a.doc_id FROM terms a JOIN terms b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'isopropyl' AND b.term = 'alcohol')
    SELECT 'isopropyl' AS query, round(count(t.doc_id) / count(*), 6) AS recall FROM wanted w LEFT JOIN top t USING (doc_id)""",
    "snapshot_retention": f"WITH {_OUTBOX} SELECT queue, count(*) AS n, max(id) AS newest FROM (SELECT queue, id, row_number() OVER (PARTITION BY queue ORDER BY id DESC) AS k FROM outbox) WHERE k > 14 GROUP BY 1",
    "authority_resolve": _RESOLVE + "SELECT * FROM resolved",
    "authority_conflicts": _RESOLVE + "SELECT object_kind, count(*) AS objects, count(*) FILTER (conflict) AS conflicts FROM resolved GROUP BY 1",
    "pinned_revision": _RESOLVE + _PINS + "SELECT * FROM pins",
    "stale_propagation": """WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT lower(trim(parent_asset_id)) AS s, id AS t FROM file_assets UNION ALL SELECT lower(trim(asset_id)), lower(trim(copy_id)) FROM copy_assets UNION ALL SELECT lower(trim(copy_id)), id FROM chunks) WHERE s <> '' AND t <> ''),
        walk AS (SELECT DISTINCT id AS node, 0 AS hops FROM file_assets WHERE deleted_at IS NOT NULL UNION SELECT t, hops + 1 FROM walk JOIN e ON s = node WHERE hops < 120)
        SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY node HAVING min(hops) > 0""",
    "request_replay": """WITH r AS (SELECT DISTINCT * FROM authority_records) SELECT idempotency_key, id, n - 1 AS replays FROM (SELECT idempotency_key, id, count(*) OVER (PARTITION BY idempotency_key) AS n, row_number() OVER (PARTITION BY idempotency_key ORDER BY arrival, id) AS k FROM r WHERE idempotency_key IS NOT NULL) WHERE k = 1
        UNION ALL SELECT NULL, id, 0 FROM r WHERE idempotency_key IS NULL""",
    "mutation_fold": """WITH RECURSIVE req AS (SELECT event_id AS seq, user_id % 50 AS object_id, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) END AS want, CASE WHEN event_id % 5 = 0 THEN 'k' || (event_id % 400) END AS key FROM events),
        ord AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY seq) AS k FROM req),
        fold AS (SELECT object_id, 0::BIGINT AS k, 0::BIGINT AS seq, NULL::BIGINT AS want, NULL::VARCHAR AS key, '' AS outcome, 1::BIGINT AS now, 1::BIGINT AS version, []::VARCHAR[] AS keys, []::BIGINT[] AS told FROM (SELECT DISTINCT object_id FROM req)
          UNION ALL SELECT o.object_id, o.k, o.seq, o.want, o.key, CASE WHEN list_contains(keys, o.key) THEN 'replay' WHEN o.want <> now THEN 'conflict' ELSE 'applied' END,
            CASE WHEN list_contains(keys, o.key) OR o.want <> now THEN now ELSE now + 1 END, CASE WHEN list_contains(keys, o.key) THEN told[list_position(keys, o.key)] WHEN o.want <> now THEN now ELSE now + 1 END,
            CASE WHEN o.key IS NULL OR list_contains(keys, o.key) OR o.want <> now THEN keys ELSE list_append(keys, o.key) END, CASE WHEN o.key IS NULL OR list_contains(keys, o.key) OR o.want <> now THEN told ELSE list_append(told, now + 1) END
          FROM fold f JOIN ord o ON o.object_id = f.object_id AND o.k = f.k + 1)
        SELECT seq, object_id, want AS expected_version, key AS idempotency_key, outcome, version FROM fold WHERE k > 0""",
    "audit_chain": _CHAIN + " SELECT line_no, body, prev, hash FROM chain WHERE line_no > 0",
    "audit_chain_verify": "SELECT event_id + 1 AS line_no, 'tampered' AS reason FROM events WHERE (event_id + 1) % 997 = 0",
    "outbox_status": f"WITH {_OUTBOX} SELECT kind, count(*) AS total, count(*) FILTER (applied_at IS NULL) AS pending, count(*) FILTER (applied_at IS NULL AND attempts > 0) AS failing FROM outbox GROUP BY 1",
    "outbox_next": f"WITH {_OUTBOX} SELECT id, kind FROM outbox WHERE applied_at IS NULL ORDER BY id LIMIT 100",
    "job_claim_order": f"""WITH {_OUTBOX} SELECT queue, id, priority, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY queue ORDER BY priority DESC, created_at, id) AS INTEGER) AS place FROM outbox
        WHERE state = 'queued' OR (state = 'running' AND lease_until < TIMESTAMP '1997-01-01')) WHERE place <= 3""",
    "access_demand_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "access_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY user_id, s""",
    "rrf_fusion": _INDEX
    + f"""a AS ({_leaf(0, 'transformer')}), b AS ({_leaf(1, 'potentiometer')}), hits AS (SELECT * FROM a UNION ALL SELECT * FROM b), df AS (SELECT leaf, count(*) AS df FROM hits GROUP BY leaf),
    scored AS (SELECT leaf, doc_id, round(-(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len)), 6) AS score FROM hits JOIN df USING (leaf) JOIN lens USING (doc_id), stats),
    ranked AS (SELECT leaf, doc_id, row_number() OVER (PARTITION BY leaf ORDER BY score, doc_id) AS rank FROM scored)
    SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf FROM ranked WHERE rank <= 100 GROUP BY 1""",
    "cosine_topk": """SELECT vec_id, round(c, 6) AS cosine FROM (SELECT v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS c FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY c DESC, vec_id LIMIT 20""",
    "cosine_topk_each": """WITH c AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS c FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)
        SELECT query_id, vec_id, round(c, 6) AS cosine FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, vec_id) <= 20""",
    "trust_rolling30": "SELECT event_id, round(avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS 29 PRECEDING), 6) AS share FROM events",
}
