"""What a page and a document are, from rows of their parts: text spans, placed images, image streams, word boxes, probes.

A renderer or recogniser delivers the rows; every rule here is column arithmetic and one grouped aggregate per kind of row.

Defined results: a page without spans has no characters, one without images no cover; a page of no area is not covered; unknown opacity
is full; an image without width or placement has no resolution; ties of the largest image go to the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchline.functions import text as X
from parchline.model import constants as K
from parchline.operators.quality import SCHEMATIC, image_dpi, page_type


def visibility(spans: DataFrame, page: str) -> DataFrame:
    """(page, visible_chars, invisible_chars): characters of spans (render_type, opacity, n_chars); type 3 or no opacity is invisible."""
    hidden = (F.col("render_type") == 3) | (F.coalesce("opacity", F.lit(1.0)) == 0)
    n = F.coalesce("n_chars", F.lit(0)).cast("bigint")
    return spans.groupBy(page).agg(F.sum(F.when(F.coalesce(hidden, F.lit(False)), F.lit(0)).otherwise(n)).alias("visible_chars"), F.sum(F.when(F.coalesce(hidden, F.lit(False)), n).otherwise(F.lit(0))).alias("invisible_chars"))


def placed_images(images: DataFrame, page: str) -> DataFrame:
    """(page, image_area, dominant_dpi, n_images) of images (seq, width_px, x0, y0, x1, y1 in points): summed area, and the resolution of the one
    with the largest placement."""
    wide, high = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    i = images.select(page, "seq", (wide * high).alias("area"), image_dpi(F.col("width_px").cast("double"), wide).alias("dpi"))
    return i.groupBy(page).agg(F.sum("area").alias("image_area"), F.max_by("dpi", F.struct("area", F.negative("seq"))).alias("dominant_dpi"), F.count("*").alias("n_images"))


def page_scan(pages: DataFrame, spans: DataFrame, images: DataFrame, page: str) -> DataFrame:
    """Pages (width_pt, height_pt) with characters, image cover, dominant resolution, type, and where their text comes from: an invisible
    layer over images if most characters are hidden."""
    rows = pages.join(visibility(spans, page), page, "left").join(placed_images(images, page), page, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.withColumns({"visible_chars": zero("visible_chars"), "invisible_chars": zero("invisible_chars"), "n_images": zero("n_images")})
    area = F.col("width_pt") * F.col("height_pt")
    cover = F.when(area > 0, F.least(F.lit(1.0), F.coalesce("image_area", F.lit(0.0)) / area)).otherwise(0.0)
    chars = F.col("visible_chars") + F.col("invisible_chars")
    rows = rows.withColumn("image_cover", cover)
    return rows.withColumns({"page_type": page_type(chars, F.col("invisible_chars"), F.col("image_cover")), "text_source": embedded_source(chars, F.col("invisible_chars"))})


def embedded_source(chars: Column, invisible: Column) -> Column:
    return F.when((chars > 0) & (invisible / chars >= 0.80), "embedded-ocr-layer").otherwise("native-text")


def filters(value: Column) -> Column:
    """Names of a stream's filters as the file has them: one name or a list of names."""
    return F.filter(F.transform(F.split(F.translate(value, "[]", "  "), "/"), lambda x: F.trim(x)), lambda x: x != "")


def structure(streams: DataFrame, document: str) -> DataFrame:
    """(document, filters, jbig2_streams, risk_flags): filters seen in image streams (filter), in order, and the flag of a compression that
    may have replaced glyphs."""
    named = streams.select(document, filters(F.col("filter")).alias("f"))
    one = named.groupBy(document).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("f")))).alias("filters"), F.count_if(F.array_contains("f", "JBIG2Decode")).alias("jbig2_streams"))
    return one.withColumn("risk_flags", F.when(F.col("jbig2_streams") > 0, F.array(F.lit("jbig2_unknown_history"))).otherwise(F.array().cast("array<string>")))


def text_cover(boxes: DataFrame, page: str, cells: int = 64) -> DataFrame:
    """(page, text_cover): share of a page's grid under word boxes (x0, y0, x1, y1, width, height in pixels), overlaps once."""
    cell = lambda v, of: F.least(F.lit(cells - 1), F.greatest(F.lit(0), (F.col(v) / F.col(of) * cells).cast("int")))
    fit = boxes.where("width > 0 AND height > 0")
    x = F.sequence(cell("x0", "width"), cell("x1", "width"))
    y = F.sequence(cell("y0", "height"), cell("y1", "height"))
    fit = fit.select(page, x.alias("xs"), y.alias("ys")).select(page, F.explode("xs").alias("x"), "ys").select(page, "x", F.explode("ys").alias("y")).select(page, (F.col("x") * cells + F.col("y")).alias("cell"))
    return fit.groupBy(page).agg((F.count_distinct("cell") / F.lit(float(cells * cells))).alias("text_cover"))


# fixed values: scripts and the language that recognition takes for them
SCRIPT_LANGUAGES = {"Latin": "eng", "Japanese": "jpn", "Japanese_vert": "jpn_vert", "Han": "chi_sim", "Hangul": "kor", "Cyrillic": "rus"}


def script_language(script: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lang in SCRIPT_LANGUAGES.items():
        out = F.when(script == name, lang).otherwise(out)
    return out


def majority(values: Column) -> Column:
    """The most frequent value of an array, the least of several; null without any."""
    known = F.filter(values, lambda v: v.isNotNull())
    counted = F.transform(F.array_distinct(known), lambda v: F.struct((-F.size(F.filter(known, lambda w: w == v))).alias("n"), v.alias("v")))
    return F.get(F.array_sort(counted), F.lit(0))["v"]


def document_language(override: Column, own: Column, vote: Column, probe_votes: Column, scripts: Column, identity: Column, available: list[str], installed: list[str]) -> Column:
    """(detected, used, supported, reason): what decides a document's language, in order: an override; its own text on the first pages,
    unless that is only Latin by default; the first confident vote on recognised probe pages; the majority of their scripts other than Latin; an
    identity field; English for Latin script that is ambiguous; nothing. A language is used only if it is available and installed.

    ``own`` is the language of the document's text and ``vote`` that of its words alone (``text_language``, ``vote_winner``), null without
    text; ``probe_votes`` and ``scripts`` are arrays with an entry per probe page, null where a page gave none."""
    ambiguous = F.coalesce((own == "eng") & vote.isNull(), F.lit(False))
    found = F.when(~ambiguous, own)
    voted = F.when(~ambiguous, F.get(F.filter(probe_votes, lambda v: v.isNotNull()), F.lit(0)))
    script = F.when(~ambiguous, majority(scripts))
    mapped = F.when(script != "Latin", script_language(script))
    latin = ambiguous | F.coalesce(script == "Latin", F.lit(False))
    lang = F.coalesce(override, found, voted, mapped, identity, F.when(latin, "eng"))
    reason = (
        F.when(override.isNotNull(), "operator override").when(found.isNotNull(), "embedded text").when(voted.isNotNull(), "wordlist vote").when(mapped.isNotNull(), "script majority")
        .when(identity.isNotNull(), "identity field").when(latin, "ambiguous latin").otherwise("unknown")
    )
    fits = F.coalesce(lang.isin(available) & lang.isin(installed), F.lit(False))
    return F.struct(lang.alias("detected"), F.when(fits, lang).alias("used"), fits.alias("supported"), reason.alias("reason"))


def embedded_quality(text: Column, language: Column, source: Column) -> Column:
    """(garble, suspect, known) of an embedded text layer: unknown for languages but English and for too little text; suspect only where
    the layer comes from recognition."""
    g = F.when(language == "eng", X.garble_fraction(text))
    return F.struct(g.alias("garble"), F.coalesce((g >= K.GARBLE_SUSPECT) & (source == "embedded-ocr-layer"), F.lit(False)).alias("suspect"), g.isNotNull().alias("known"))


def required_pages(pages: DataFrame, critical: Column) -> DataFrame:
    """Pages with ``required``: critical ones, and assessed pages of pure schematics, which themselves imply that the document has them."""
    own = F.coalesce(F.col("assessed"), F.lit(False)) & (F.col("content_class") == "schematic")
    return pages.withColumn("required", F.coalesce(critical | own, F.lit(False)))


def completeness(implied: Column, schematic_pages: Column) -> Column:
    """Of a single representation nothing is known, unless it should have schematics and has no such page, mixed ones included."""
    return F.when(F.coalesce(implied, F.lit(False)) & (schematic_pages == 0), "known-incomplete").otherwise("unknown")


def schematic_pages(pages: DataFrame, document: str) -> DataFrame:
    """(document, implied, schematic_pages, completeness) of assessed pages; ``schematic_implied`` may say so for the document."""
    a = pages.where("coalesce(assessed, false)")
    out = a.groupBy(document).agg(F.bool_or((F.col("content_class") == "schematic") | F.coalesce("schematic_implied", F.lit(False))).alias("implied"), F.count_if(F.col("content_class").isin(SCHEMATIC)).alias("schematic_pages"))
    return out.withColumn("completeness", completeness(F.col("implied"), F.col("schematic_pages")))


def reasons(deductions: Column) -> Column:
    """A line of text for each deduction."""
    return F.transform(deductions, lambda d: F.format_string("%s: -%.1f", d["code"], d["points"]))


def report(rolled: DataFrame, document: str, version: str = "1") -> DataFrame:
    """(document, report): the versioned JSON report of each document, numbers rounded half to even to one decimal, and a line of summary."""
    r = lambda c: F.bround(F.col(c), 1).alias(c)
    scores = ["if_text", "tq_text", "if_schem", "tq_schem", "fitness_text", "fitness_schem"]
    body = F.struct(F.lit(version).alias("version"), F.col(document).alias("document"), F.struct(*[r(c) for c in scores]).alias("scores"), F.struct("text_pages", "schem_pages", "image_below", "text_below").alias("pages"), "image_adequate", "text_adequate")
    word = lambda c: F.when(F.col(c).isNull(), "unknown").when(F.col(c), "adequate").otherwise("inadequate")
    return rolled.select(document, F.to_json(body, {"ignoreNullFields": "false"}).alias("report"), F.concat(F.lit("image "), word("image_adequate"), F.lit(", text "), word("text_adequate")).alias("summary"))


def settings(defaults: dict, overrides: str | None) -> dict:
    """Defaults with the entries of a JSON object over them; unknown names are refused, lists become tuples where the default is one."""
    import json

    given = json.loads(overrides) if overrides else {}
    if unknown := sorted(set(given) - set(defaults)):
        raise KeyError(", ".join(unknown))
    return {k: tuple(given[k]) if k in given and isinstance(v, tuple) else given.get(k, v) for k, v in defaults.items()}


