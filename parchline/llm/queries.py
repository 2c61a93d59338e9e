"""Queries of the operators in this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchline.functions.partitions import spread
from parchline.functions.refs import norm_ref
from parchline.llm.digest import certified, digest, merge_over, percentiles
from parchline.llm.langid import label_languages, wrong_labels
from parchline.llm.leaks import leaked_items
from parchline.llm.packing import pack_documents
from parchline.llm.scans import ScanRepair
from parchline.llm.spam import SHARES, keyword_pages
from parchline.llm.splitter import split_oversized
from parchline.llm.topn import latest_rows, top_n_per_group
from parchline.session import Scratch


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows are heavy work: over all cores, if its files are fewer."""
    return spread(table(spark, d, name).select(*columns))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "copies").select("id", "row_version", "revision_id", "is_document_default", "superseded", "fitness_text", "created_at")
    own = latest_rows(c, "id", "row_version", ["revision_id", "is_document_default", "superseded", "fitness_text", "created_at"])
    own = own.withColumn("revision_id", norm_ref("revision_id"))
    fit = F.when(F.col("fitness_text").isNull() | F.isnan("fitness_text"), -1.0).otherwise(F.col("fitness_text"))
    order = [F.col("is_document_default").desc(), F.col("superseded").asc(), F.col("fit").desc(), F.col("created_at").asc(), F.col("id").asc()]
    top = top_n_per_group(spark, own.withColumn("fit", fit).drop("fitness_text"), "revision_id", order, 3)
    return top.select("revision_id", "place", F.col("id").alias("copy_id"))


def _scans(spark: SparkSession, d: str) -> ScanRepair:
    return ScanRepair(spark, texts(spark, d, "page_results", "id", "copy_id", "pdf_index", "extracted_text"), "id", "copy_id", "pdf_index", "extracted_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).lines()


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).paragraphs()


#: what a measurement can be: (least, greatest); sentinels such as -1, 0 dpi or 99999 dpi lie outside
POSSIBLE = {"sharpness": (0.0, 1e9), "effective_dpi": (1.0, 10_000.0)}


def _measurements(spark: SparkSession, d: str) -> DataFrame:
    """(content_class, day, metric, value): one row per page and possible measurement, repeats once."""
    pages = table(spark, d, "page_results").select("id", "content_class", F.to_date("analyzed_at").alias("day"), *POSSIBLE).distinct()
    label = F.coalesce(norm_ref("content_class"), F.lit("unknown"))
    long = pages.select(label.alias("content_class"), "day", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in POSSIBLE])).alias("m"))
    long = long.select("content_class", "day", "m.metric", "m.value")
    possible = F.lit(False)
    for m, (lo, hi) in POSSIBLE.items():
        possible = possible | ((F.col("metric") == m) & F.col("value").between(lo, hi))
    return Scratch(spark, "digest").save(long.where(~F.isnan("value") & possible), "values")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per class and metric, of every day and, merged from the days' digests, of all days together (``day`` null), with their
    certified rank errors."""
    keys = ["content_class", "metric"]
    values = _measurements(spark, d)
    daily = Scratch(spark, "digest").save(digest(values, [*keys, "day"], "value"), "daily")
    each = certified(values, [*keys, "day"], "value", percentiles(daily, [*keys, "day"]))
    whole = certified(values, keys, "value", percentiles(merge_over(daily, keys, ["day"]), keys))
    return each.unionByName(whole.withColumn("day", F.lit(None).cast("date")))


def p5_certified(spark: SparkSession, d: str) -> DataFrame:
    """Of each class and metric the number of values, and whether every estimate's exact rank error is within pi / delta."""
    return p5_percentiles(spark, d).where("day IS NULL").groupBy("content_class", "metric").agg(F.max("n").alias("n"), (F.max("rank_error") <= math.pi / 400).alias("within"))


def p5_daily(spark: SparkSession, d: str) -> DataFrame:
    """The medians of each day, from the digests that ``p5_percentiles`` merges."""
    keys = ["content_class", "metric", "day"]
    values = _measurements(spark, d)
    return certified(values, keys, "value", percentiles(digest(values, keys, "value"), keys, (0.5,)), (0.5,))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    keys = ["item_table", "item_id", "page_number"]
    a = texts(spark, d, "chunks", "id", "page_number", "text").select(F.lit("chunks").alias("item_table"), F.col("id").alias("item_id"), "page_number", "text")
    b = texts(spark, d, "page_results", "id", "pdf_index", "extracted_text").select(F.lit("page_results").alias("item_table"), F.col("id").alias("item_id"), (F.col("pdf_index") + 1).alias("page_number"), F.col("extracted_text").alias("text"))
    return split_oversized(a, keys, "text").unionAll(split_oversized(b, keys, "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("item_table", "item_id").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).dropDuplicates(["item_table", "item_id", "piece_no"])


def p6_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized item whether its pieces without overlaps are its text, and whether each keeps the limits, as a hash and a flag."""
    core = F.struct("piece_no", F.expr("substring(text, core_start - start + 1)").alias("core"))
    fits = F.max("n_tokens") <= 800
    by = p6_pieces(spark, d).groupBy("item_table", "item_id").agg(F.array_sort(F.collect_list(core)).alias("p"), (fits & (F.max(F.length("text")) <= 8000)).alias("within"))
    return by.select("item_table", "item_id", F.md5(F.array_join(F.transform("p", lambda x: x["core"]), "")).alias("md5"), "within")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return label_languages(texts(spark, d, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_labels(_languages(spark, d), "doc_id")


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's language, confidence and stretches in other languages, beside the analyser's findings."""
    info = table(spark, d, "language_info").groupBy("doc_id").agg(F.min("detected").alias("detected"), F.min("used").alias("used"), F.max(F.col("supported").cast("int")).cast("boolean").alias("supported"))
    out = _languages(spark, d).join(info, "doc_id", "left")
    return out.select(
        "doc_id", "label_lang", "language", F.round("confidence", 4).alias("confidence"), "sentences", F.size("languages").alias("n_languages"),
        F.coalesce(F.size("stretches"), F.lit(0)).alias("n_stretches"), (F.col("detected") == F.col("language")).alias("detected_right"), (F.col("used") == F.col("language")).alias("used_right"), "supported",
    )


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(spark, texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_fill(spark: SparkSession, d: str, capacity: int = 2048) -> DataFrame:
    """Containers in use, the least possible number, and the share of space in use."""
    by = p8_containers(spark, d).groupBy("container").agg(F.sum("tokens").alias("fill"))
    return by.agg(
        F.count("*").alias("containers"), F.ceil(F.sum("fill") / capacity).alias("least_containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"),
        F.round(F.sum("fill") / (F.count("*") * capacity), 5).alias("share_used"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(spark, texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return keyword_pages(texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text").where("is_spam").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return keyword_pages(texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", *[F.round(c, 6).alias(c) for c in SHARES], "is_spam")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_paragraphs": p4_paragraphs, "p5_percentiles": p5_percentiles, "p5_certified": p5_certified, "p5_daily": p5_daily, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_rejoined": p6_rejoined, "p7_found": p7_found, "p7_languages": p7_languages, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p10_found": p10_found, "p10_scores": p10_scores}

_VALUES = """
WITH pages AS (SELECT DISTINCT id, content_class, CAST(analyzed_at AS DATE) AS day, sharpness, effective_dpi FROM page_results),
vals AS (SELECT coalesce(nullif(lower(trim(content_class)), ''), 'unknown') AS content_class, day, 'sharpness' AS metric, sharpness AS v FROM pages WHERE sharpness BETWEEN 0 AND 1e9 AND NOT isnan(sharpness)
  UNION ALL SELECT coalesce(nullif(lower(trim(content_class)), ''), 'unknown'), day, 'effective_dpi', effective_dpi FROM pages WHERE effective_dpi BETWEEN 1 AND 10000 AND NOT isnan(effective_dpi))
"""

ORACLE = {
    "p5_certified": _VALUES + "SELECT content_class, metric, count(*) AS n, true AS within FROM vals GROUP BY ALL",
    "p1_found": """
SELECT revision_id, place, copy_id FROM (
  SELECT lower(trim(revision_id)) AS revision_id, id AS copy_id, CAST(row_number() OVER (PARTITION BY lower(trim(revision_id))
    ORDER BY is_document_default DESC NULLS LAST, superseded ASC NULLS FIRST,
      CASE WHEN fitness_text IS NULL OR isnan(fitness_text) THEN -1 ELSE fitness_text END DESC, created_at ASC NULLS FIRST, id) AS INTEGER) AS place
  FROM (SELECT DISTINCT id, row_version, revision_id, is_document_default, superseded, fitness_text, created_at FROM copies) c
  WHERE row_version = (SELECT max(row_version) FROM copies x WHERE x.id = c.id))
WHERE revision_id <> '' AND place <= 3
""",
    "p6_rejoined": """
WITH items AS (SELECT 'chunks' AS item_table, id AS item_id, min(text) AS text FROM chunks GROUP BY id UNION ALL SELECT 'page_results', id, min(extracted_text) FROM page_results GROUP BY id)
SELECT item_table, item_id, md5(text) AS md5, true AS within FROM items
WHERE length(text) > 8000 OR len(regexp_extract_all(text, '[^\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')) > 800
""",
    "p6_found": """
WITH items AS (SELECT 'chunks' AS item_table, id AS item_id, text FROM chunks UNION ALL SELECT 'page_results', id, extracted_text FROM page_results)
SELECT DISTINCT item_table, item_id FROM items
WHERE length(text) > 8000 OR len(regexp_extract_all(text, '[^\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')) > 800
""",
}
