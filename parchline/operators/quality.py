"""Measurements of pages to scores, roll-ups and findings; all of it is column arithmetic and one grouped aggregate.

A missing measurement (null or NaN) takes no points. A page whose text quality is unknown has no text score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchline.model import constants as K
from parchline.session import Scratch

SCHEMATIC = ["schematic", "mixed"]
TEXTUAL = ["text", "mixed"]


def known(c: Column) -> Column:
    """NaN is no measurement."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _points(cases: list[tuple[str, Column, Column]]) -> Column:
    """Deductions that apply, as an array of (code, points)."""
    made = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), pts.cast("double").alias("points"))) for code, cond, pts in cases]
    return F.array_compact(F.array(*made))


def image_deductions(dpi: Column, sharpness: Column, speckle: Column, skew: Column, one_bit: Column, content_class: Column, forced: Column | None = None) -> Column:
    dpi, sharpness, speckle, skew = map(known, (dpi, sharpness, speckle, skew))
    schematic = content_class.isin(SCHEMATIC)
    fine = schematic | forced if forced is not None else schematic
    target = F.when(fine, K.DPI_TARGET_SCHEMATIC).otherwise(K.DPI_TARGET_TEXT)
    return _points(
        [
            ("dpi_below_target", dpi < target, F.lit(K.DPI_MAX_POINTS) * (target - dpi) / target),
            ("dpi_very_low", (dpi < target) & (dpi < K.DPI_LOW), F.lit(K.DPI_LOW_POINTS)),
            ("low_sharpness", sharpness < K.SHARPNESS_MIN, F.lit(K.SHARPNESS_POINTS)),
            ("speckle", speckle > K.SPECKLE_MAX, F.lit(K.SPECKLE_POINTS)),
            ("skew", skew > K.SKEW_MAX, F.lit(K.SKEW_POINTS)),
            ("onebit_schematic", one_bit & schematic, F.lit(K.ONE_BIT_POINTS)),
        ]
    )


def text_deductions(mean_conf: Column, low_fraction: Column, small_conf: Column, refdes_conf: Column, garble: Column) -> Column:
    mean_conf, low_fraction, small_conf, refdes_conf, garble = map(known, (mean_conf, low_fraction, small_conf, refdes_conf, garble))
    spread = K.LOW_FRACTION_FULL - K.LOW_FRACTION_TARGET
    garbled = F.lit(K.GARBLE_MAX_POINTS) * F.least(F.lit(1.0), garble / K.GARBLE_FULL)
    return _points(
        [
            ("low_mean_confidence", mean_conf < K.CONF_TARGET, F.lit(K.CONF_MAX_POINTS) * (F.lit(K.CONF_TARGET) - mean_conf) / K.CONF_TARGET),
            ("low_confidence_fraction", low_fraction > K.LOW_FRACTION_TARGET, F.lit(K.LOW_FRACTION_POINTS) * F.least(F.lit(1.0), (low_fraction - K.LOW_FRACTION_TARGET) / spread)),
            ("small_text", small_conf < K.SMALL_CONF_MIN, F.lit(K.SMALL_POINTS)),
            ("refdes_tokens", refdes_conf < K.REFDES_CONF_MIN, F.lit(K.REFDES_POINTS)),
            ("extraction_garble", (garble > 0) & (garbled >= 1.0), garbled),
        ]
    )


def score(deductions: Column) -> Column:
    """100 less all points, not below 0."""
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.aggregate(deductions, F.lit(0.0), lambda a, d: a + d["points"]))


def grade(value: Column) -> Column:
    out = F.lit("F")
    for name, least in reversed(K.GRADES):
        out = F.when(value >= least, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def roll_up(pages: DataFrame, by: str) -> DataFrame:
    """Means of assessed pages by dimension (mixed pages count in both), adequacy of each dimension and overall, blends.
    Expects content_class, assessed, if_score, tq_score."""
    c = F.col("content_class")
    mean = lambda col, classes: F.avg(F.when(F.col("assessed") & c.isin(classes), known(F.col(col))))
    agg = pages.groupBy(by).agg(
        mean("if_score", TEXTUAL).alias("if_text"), mean("tq_score", TEXTUAL).alias("tq_text"), mean("if_score", SCHEMATIC).alias("if_schem"), mean("tq_score", SCHEMATIC).alias("tq_schem"),
        F.count_if(F.col("assessed") & c.isin(TEXTUAL)).alias("text_pages"), F.count_if(F.col("assessed") & c.isin(SCHEMATIC)).alias("schem_pages"),
        F.count_if(F.col("assessed") & (known(F.col("if_score")) < K.IMAGE_ADEQUATE)).alias("image_below"), F.count_if(F.col("assessed") & (known(F.col("tq_score")) < K.TEXT_ADEQUATE)).alias("text_below"),
    )
    return agg.withColumns(
        {
            "image_adequate": all_known(F.col("if_text") >= K.IMAGE_ADEQUATE, F.col("if_schem") >= K.IMAGE_ADEQUATE),
            "text_adequate": all_known(F.col("tq_text") >= K.TEXT_ADEQUATE, F.col("tq_schem") >= K.TEXT_ADEQUATE),
            "fitness_text": F.lit(0.5) * F.col("if_text") + F.lit(0.5) * F.col("tq_text"),
            "fitness_schem": F.lit(0.7) * F.col("if_schem") + F.lit(0.3) * F.col("tq_schem"),
        }
    )


def adequate() -> tuple[Column, Column]:
    """Adequacy of images and of texts from the means of a copy: if_text, if_schem, tq_text, tq_schem."""
    at_least = lambda c, least: known(F.col(c)) >= least
    return all_known(at_least("if_text", K.IMAGE_ADEQUATE), at_least("if_schem", K.IMAGE_ADEQUATE)), all_known(at_least("tq_text", K.TEXT_ADEQUATE), at_least("tq_schem", K.TEXT_ADEQUATE))


def all_known(a: Column, b: Column) -> Column:
    """Conjunction over what is known; null if nothing is."""
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(a, F.lit(True)) & F.coalesce(b, F.lit(True)))


def page_gates(pages: DataFrame, required: Column) -> DataFrame:
    """Per page and dimension ``blocking`` or ``degraded`` on required, assessed pages. Text is skipped where unknown."""

    def gate(value: Column, fine: float) -> Column:
        return F.when(value < K.GATE_BLOCK, "blocking").when(value < fine, "degraded")

    must = required & F.col("assessed")
    return pages.withColumns(
        {
            "image_gate": F.when(must, gate(known(F.col("if_score")), K.IMAGE_ADEQUATE)),
            "text_gate": F.when(must & ~F.coalesce(F.col("tq_is_null"), F.lit(False)), gate(known(F.col("tq_score")), K.TEXT_ADEQUATE)),
        }
    )


def worst_pages(pages: DataFrame, by: str, order: list[Column], n: int = 5) -> DataFrame:
    """The ``n`` pages with the lowest image score of each group; pages without a score do not count."""
    w = Window.partitionBy(by).orderBy(*order)
    return pages.where(known(F.col("if_score")).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def ocr_word_statistics(words: DataFrame, by: str, refdes: Column) -> DataFrame:
    """Of recognised words (conf, height): count, mean confidence, share below 60, means of small text and designators;
    all but the count null with fewer than five words."""
    enough = F.count("*") >= 5
    conf = F.col("conf").cast("double")
    return words.groupBy(by).agg(
        F.count("*").alias("word_count"), F.when(enough, F.avg(conf)).alias("mean_conf"), F.when(enough, F.count_if(conf < K.LOW_CONF) / F.count("*")).alias("low_conf_fraction"),
        F.when(enough, F.avg(F.when(F.col("height") <= K.SMALL_TEXT_PX, conf))).alias("small_text_conf"), F.when(enough, F.avg(F.when(refdes, conf))).alias("refdes_conf"),
    )


def page_type(chars: Column, invisible: Column, image_cover: Column) -> Column:
    """From visible and invisible characters and the share of the page under images."""
    hidden = F.when(chars > 0, invisible / chars).otherwise(0.0)
    return (
        F.when((chars < 10) & (image_cover >= 0.10), "image-only").when(chars < 10, "native-text")
        .when((hidden >= 0.80) & (image_cover >= 0.50), "ocr-layer").when(image_cover >= 0.10, "mixed").otherwise("native-text")
    )


def content_class(ink: Column, line_score: Column, text_cover: Column) -> Column:
    return F.when(ink < 0.005, "blank").when((line_score >= 3.0) & (text_cover < 0.10), "schematic").when(line_score >= 3.0, "mixed").otherwise("text")


def image_dpi(width_px: Column, placed_width_pt: Column) -> Column:
    """Pixels per placed inch; null without width."""
    inches = placed_width_pt / 72.0
    return F.when((inches > 1e-6) & (width_px > 0), width_px / inches)


def render_dpi(width_in: Column, height_in: Column, wanted: float = K.RENDER_DPI, megapixels: float = K.RENDER_MEGAPIXELS) -> Column:
    """The wanted resolution, or what keeps the page under the pixel cap."""
    return F.least(F.lit(wanted), F.sqrt(F.lit(megapixels * 1e6) / (width_in * height_in)))


def screening_sample(n: Column, most: int = K.SCREENING_PAGES) -> Column:
    """Page numbers from 0: all, or ``most`` of them evenly spread, rounded half to even."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * ((n - 1) / F.lit(float(max(most - 1, 1))))).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= most, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).when(F.lit(most == 1), F.array(F.lit(0))).otherwise(F.array_distinct(spread))


def weighted_median(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Of each group the first value at which the running weight reaches half of the total; null values have no place, a null group is one.
    Rows are range-partitioned by (group, value), so a group may fill many partitions; the weights per group and partition say
    where the half lies, and only the rows of that partition are summed up one by one."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(by, value).agg(F.sum(weight).alias("__w"))
    placed = Scratch(df.sparkSession, "median").save(rows.repartitionByRange(by, value).withColumn("__at", F.spark_partition_id()), "placed")
    part = placed.groupBy(by, "__at").agg(F.sum("__w").alias("__sum"))
    # as many rows as partitions that a group fills
    w = Window.partitionBy(by)
    before = F.sum("__sum").over(w.orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__sum")
    half = part.select(by, "__at", "__sum", before.alias("__before"), F.sum("__sum").over(w).alias("__total")).where("2 * __before < __total AND 2 * (__before + __sum) >= __total")
    here = placed.alias("a").join(half.alias("h"), F.col(f"a.{by}").eqNullSafe(F.col(f"h.{by}")) & (F.col("a.__at") == F.col("h.__at"))).select(f"a.{by}", f"a.{value}", "a.__w", "h.__before", "h.__total")
    run = F.col("__before") + F.sum("__w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return here.withColumn("__half", 2 * run >= F.col("__total")).where("__half").groupBy(by).agg(F.min(value).alias(value))
