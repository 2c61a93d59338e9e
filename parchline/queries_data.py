"""Queries of the general training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchline.operators.hierarchy import Hierarchy
from parchline.operators.orphans import Child, Parent, orphan_references, orphan_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    parents = [Parent("revisions", t("revisions"), ("id", "document_id")), Parent("file_assets", t("file_assets")), Parent("copies", t("copies"))]
    children = [
        Child("chunks", t("chunks"), "revisions", ("revision_id", "document_id")),
        Child("copy_assets", t("copy_assets"), "file_assets", ("asset_id",)),
        Child("search_hits", t("search_hits"), "copies", ("copy_id",)),
    ]
    return orphan_references(spark, parents, children)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p2_found(spark, d))


def _forest(spark: SparkSession, d: str, keep_segments: bool) -> Hierarchy:
    a = table(spark, d, "file_assets").select(F.lit("file_assets").alias("tree"), "id", F.col("parent_asset_id").alias("parent"))
    b = table(spark, d, "authority_records").select(F.lit("authority_records").alias("tree"), "id", F.col("supersedes").alias("parent"))
    return Hierarchy(spark, a.unionAll(b), keep_segments=keep_segments)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d, False).nodes()


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d, True).paths()


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The descendants of every node as chain intervals: of v those with a row of v's chain and ``upto`` >= v's position, which is
    ``upto`` + 1 in v's own row."""
    return _forest(spark, d, True).intervals()


def asset_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every file below those that came from a scanning station and have no parent, from chain intervals."""
    h = _forest(spark, d, True)
    of = table(spark, d, "file_assets").where("producer_tool = 'scan-station' AND coalesce(trim(parent_asset_id), '') = ''").select(F.lit("file_assets").alias("tree"), F.col("id").alias("node_id")).distinct()
    return h.descendants(of).select("node_id", "descendant_id")


QUERIES = {"asset_descendants": asset_descendants, "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants}

_P2 = """
WITH refs AS (
  SELECT 'chunks' AS ref_table, id AS row_id, lower(trim(revision_id)) AS k, coalesce(lower(trim(document_id)), '') AS k2, min(arrived_at) AS seen_at FROM chunks GROUP BY ALL
  UNION ALL SELECT 'copy_assets', id, lower(trim(asset_id)), '', min(arrived_at) FROM copy_assets GROUP BY ALL
  UNION ALL SELECT 'search_hits', id, lower(trim(copy_id)), '', min(arrived_at) FROM search_hits GROUP BY ALL),
targets AS (
  SELECT 'chunks' AS ref_table, lower(trim(id)) AS k, lower(trim(document_id)) AS k2, min(arrived_at) AS first_at, max(deleted_at) AS gone FROM revisions GROUP BY ALL
  UNION ALL SELECT 'copy_assets', lower(trim(id)), '', min(arrived_at), max(deleted_at) FROM file_assets GROUP BY ALL
  UNION ALL SELECT 'search_hits', lower(trim(id)), '', min(arrived_at), max(deleted_at) FROM copies GROUP BY ALL),
found AS (
  SELECT ref_table, row_id, strftime(seen_at, '%Y-%m') AS period,
    CASE WHEN t.k IS NULL THEN 'missing' WHEN first_at > seen_at THEN 'late' WHEN gone <= seen_at THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN targets t USING (ref_table, k, k2) WHERE r.k <> '')
"""

_P3 = """
WITH RECURSIVE raw AS (
  SELECT 'file_assets' AS tree, id, min(nullif(lower(trim(parent_asset_id)), '')) AS parent FROM file_assets GROUP BY ALL
  UNION ALL SELECT 'authority_records', id, min(nullif(lower(trim(supersedes)), '')) FROM authority_records GROUP BY ALL),
linked AS (SELECT r.tree, r.id, p.id AS parent FROM raw r LEFT JOIN raw p ON p.tree = r.tree AND p.id = r.parent),
walk AS (
  SELECT tree, id, id AS root_id, 0 AS depth, id AS path FROM linked WHERE parent IS NULL
  UNION ALL SELECT l.tree, l.id, w.root_id, w.depth + 1, w.path || '/' || l.id FROM linked l JOIN walk w ON l.tree = w.tree AND l.parent = w.id)
"""

ORACLE = {
    "asset_descendants": _P3
    + """, tops AS (SELECT DISTINCT id FROM file_assets WHERE producer_tool = 'scan-station' AND coalesce(trim(parent_asset_id), '') = ''), low AS (SELECT id, unnest(string_split(path, '/')) AS up FROM walk WHERE tree = 'file_assets')
    SELECT tops.id AS node_id, low.id AS descendant_id FROM tops JOIN low ON low.up = tops.id AND low.id <> tops.id""",
    "p2_found": _P2 + "SELECT * FROM found WHERE reason IS NOT NULL",
    "p2_report": _P2 + "SELECT ref_table, period, reason, count(*) AS n_rows FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_found": _P3 + "SELECT l.tree, l.id AS node_id, coalesce(w.root_id, '') AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth FROM linked l LEFT JOIN walk w USING (tree, id)",
    "p3_paths": _P3
    + """, pairs AS (SELECT tree, unnest(string_split(path, '/')) AS id FROM walk), below AS (SELECT tree, id, count(*) - 1 AS n FROM pairs GROUP BY ALL)
    SELECT l.tree, l.id AS node_id, w.path, b.n AS n_descendants FROM linked l LEFT JOIN walk w USING (tree, id) LEFT JOIN below b USING (tree, id)""",
}
