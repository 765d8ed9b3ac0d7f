"""Page geometry: reading order, columns, kinds and heading levels of raw extracted blocks.

Rows are (doc_id, page, n, text, bbox, font_mode, font_max, bold_ratio, page_width...), as any PDF
extractor yields them; every rule is a built-in expression or a window per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL_SHARE, STRADDLE = 0.68, 0.035
MATH = r"[=+×÷±∑∫∂√∞≈≠≤≥<>^_{}\\|∝∇Δ∈→α-ωΑ-Ω]"


def page_window():  # noqa: ANN201
    """The window of a page (made late: a window needs a session)."""
    return Window.partitionBy("doc_id", "page")


def two_columns(raw: DataFrame) -> DataFrame:
    """``raw`` with ``two_column``: at least four blocks, two on each side, and no overlap between the sides."""
    left, right = F.min("bbox.x0").over(page_window()), F.max("bbox.x1").over(page_window())
    middle = (left + right) / 2
    on_left = (F.col("bbox.x0") + F.col("bbox.x1")) / 2 < F.col("mid")
    narrow = (F.col("bbox.x1") - F.col("bbox.x0")) < FULL_SHARE * (F.col("hi") - F.col("lo"))
    rows = raw.withColumns({"mid": middle, "lo": left, "hi": right}).withColumn("on_left", on_left).withColumn("narrow", narrow)
    count = lambda c: F.sum(c.cast("int")).over(page_window())
    sides = (count(F.col("narrow")) >= 4) & (count(F.col("narrow") & F.col("on_left")) >= 2) & (count(F.col("narrow") & ~F.col("on_left")) >= 2)
    apart = F.max(F.when(F.col("narrow") & F.col("on_left"), F.col("bbox.x1"))).over(page_window()) <= F.min(F.when(F.col("narrow") & ~F.col("on_left"), F.col("bbox.x0"))).over(page_window()) + 2
    return rows.withColumn("two_column", F.coalesce(sides & apart, F.lit(False)))


def reading_order(raw: DataFrame) -> DataFrame:
    """``raw`` with ``ord``: full-width blocks cut a page into bands, columns are read within a band."""
    rows = two_columns(raw)
    width = F.col("hi") - F.col("lo")
    full = ~F.col("two_column") | ((F.col("bbox.x1") - F.col("bbox.x0")) >= FULL_SHARE * width) | ((F.col("bbox.x0") < F.col("mid") - STRADDLE * width) & (F.col("bbox.x1") > F.col("mid") + STRADDLE * width))
    down = Window.partitionBy("doc_id", "page").orderBy(F.round("bbox.y0", 1), "bbox.x0", "n")
    rows = rows.withColumn("full", full).withColumn("band", F.sum(F.col("full").cast("int")).over(down) * 2 + F.when(F.col("full"), 0).otherwise(1))
    column = F.when(F.col("full") | F.col("on_left"), 0).otherwise(1)
    order = Window.partitionBy("doc_id").orderBy("page", "band", "col", "bbox.y0", "bbox.x0", "n")
    return rows.withColumn("col", column).withColumn("ord", (F.row_number().over(order) - 1).cast("int")).drop("mid", "lo", "hi", "on_left", "narrow", "full")


def body_font_size(raw: DataFrame) -> DataFrame:
    return raw.groupBy("doc_id").agg(F.coalesce(F.percentile("font_mode", F.lit(0.5)), F.lit(10.0)).alias("body_font_size"))


def weighted_mode(spans: DataFrame, keys: list[str], size: str = "size", weight: str = "chars") -> DataFrame:
    """The size that most characters have; of equals the larger."""
    totals = spans.groupBy(*keys, size).agg(F.sum(weight).alias("w"))
    return totals.groupBy(*keys).agg(F.max_by(size, F.struct("w", size)).alias("mode"))


def looks_like_equation(text: Column) -> Column:
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    maths, letters = F.regexp_count(text, F.lit(MATH)), F.regexp_count(text, F.lit(r"\p{L}"))
    return (F.length(text) <= 200) & (maths >= 2) & (F.size(F.split(F.trim(text), r"\s+")) <= 20) & (maths >= 0.10 * solid) & (letters < 0.75 * solid)


def heading_level(text: Column, font_max: Column, body: Column, bold_ratio: Column) -> Column:
    """1 to 6, or null for prose: numbering first, then size, then boldness."""
    t = F.trim(text)
    lines, words = F.size(F.split(t, "\n")), F.size(F.split(t, r"\s+"))
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)[.)]?\s+\S", 1)
    numbered = (number != "") & (words <= 16)
    prose = (words > 20) | t.rlike(r"[.;,]$")
    bigger = font_max - body
    return (
        F.when(lines > 3, F.lit(None).cast("int"))
        .when(numbered & ~t.rlike(r"[.;,]$"), F.least(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1, F.lit(6)))
        .when(prose, F.lit(None).cast("int"))
        .when(bigger >= 3.0, F.lit(1))
        .when(bigger >= 1.5, F.lit(2))
        .when((bold_ratio >= 0.8) & (words <= 10) & (lines == 1), F.lit(3))
    )


def classify(raw: DataFrame) -> DataFrame:
    """``raw`` with ``kind`` and ``level`` by the first rule that applies."""
    rows = raw.join(body_font_size(raw), "doc_id")
    level = heading_level(F.col("text"), F.col("font_max"), F.col("body_font_size"), F.col("bold_ratio"))
    t = F.trim("text")
    kind = (
        F.when(t.rlike(r"^\d{1,4}$"), F.lit("page_artifact"))
        .when(t.rlike(r"(?i)^(figure|fig\.|table|scheme)\s*\d+"), F.lit("caption"))
        .when(looks_like_equation(t), F.lit("equation"))
        .when(level.isNotNull(), F.lit("heading"))
        .when(t.rlike(r"^[•▪●◦*-]\s+\S"), F.lit("list_item"))
        .otherwise(F.lit("paragraph"))
    )
    return rows.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", level))


def find_doi(blocks: DataFrame) -> DataFrame:
    """(doc_id, doi) from the first 40 blocks."""
    doi = F.regexp_replace(F.regexp_extract("text", r"\b(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;]+$", "")
    return blocks.filter("ord < 40").withColumn("doi", doi).filter("doi <> ''").groupBy("doc_id").agg(F.min_by("doi", "ord").alias("doi"))


def split_authors(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\s*(?:[;,]|\band\b|&)\s*"), lambda a: F.trim(a)), lambda a: a != "")


def clip_region(region: Column, page: Column, padding: float = 4.0) -> Column:
    """A figure's crop: its box padded and kept inside the page's box."""
    return F.struct(F.greatest(region["x0"] - padding, page["x0"]).alias("x0"), F.greatest(region["y0"] - padding, page["y0"]).alias("y0"), F.least(region["x1"] + padding, page["x1"]).alias("x1"), F.least(region["y1"] + padding, page["y1"]).alias("y1"))


def crop_dpi(region: Column, dpi: float = 100.0, longest: float = 1400.0) -> Column:
    """The resolution that keeps a crop's longest edge within ``longest`` pixels."""
    edge = F.greatest(region["x1"] - region["x0"], region["y1"] - region["y0"])
    return F.when(edge <= 0, F.lit(dpi)).otherwise(F.least(F.lit(dpi), F.lit(longest * 72) / edge))
