"""Scoring of pages by their images. images: doc_id, doc, image_index, width, height; data where images are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T


def measured(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Each image with its area, its share of the page and whether that is over a fifth."""
    size = pages.select("doc_id", "page_number", (F.col("width") * F.col("height")).alias("page_area"))
    area = F.coalesce("width", F.lit(0.0)) * F.coalesce("height", F.lit(0.0))
    ratio = F.when(F.col("page_area") > 0, F.col("area") / F.col("page_area")).otherwise(0.0)
    return images.join(size, "doc_id").withColumn("area", area).withColumn("ratio", ratio).withColumn("is_large", F.col("ratio") > 0.2)


def found_keywords(text: Column, keywords: list[str] = rules.IMAGE_KEYWORDS) -> Column:
    return T.let(F.lower(text), lambda low: F.array_join(T.contained(low, keywords), ", "))


def analyzed(images: DataFrame, pages: DataFrame, numbers: DataFrame | None = None, keywords: list[str] = rules.IMAGE_KEYWORDS) -> DataFrame:
    """Pages with images, their images in order, confidence and reasons. Points are added in one fixed order, as doubles.

    Text is read where it lies; `numbers` (doc_id, page_number, width, height) are those of pages that come without them."""
    low = pages.withColumn("_low", F.lower(T.text_or_empty(F.col("text"))))
    worded = low.withColumns({"keywords": F.array_join(T.contained(F.col("_low"), keywords), ", "), "figure": F.col("_low").rlike(rules.FIGURE_PATTERN)}).drop("text", "_low")
    if numbers is not None:
        worded = worded.join(numbers.select("doc_id", "page_number", "width", "height"), "doc_id")
    per_page = measured(images, numbers if numbers is not None else pages).groupBy("doc_id").agg(
        F.count("*").cast("int").alias("n_images"),
        F.max("is_large").alias("any_large"),
        F.array_sort(F.collect_list(F.struct("image_index", "width", "height", "area", "is_large"))).alias("images"),
    )
    joined = per_page.join(worded.select("doc_id", "doc", "page_number", "keywords", "figure"), "doc_id")
    many = F.col("n_images") > 1
    points = F.when(F.col("any_large"), 0.5).otherwise(0.0)
    points = F.when(many, points + F.lit(0.2) * (F.col("n_images") - 1)).otherwise(points)
    points = F.when(F.col("keywords") != "", points + 0.3).otherwise(points)
    points = F.when(F.col("figure"), points + 0.2).otherwise(points)
    reasons = F.filter(
        F.array(
            F.when(F.col("any_large"), F.lit("large image")),
            F.when(many, F.concat(F.lit("images: "), F.col("n_images").cast("string"))),
            F.when(F.col("keywords") != "", F.concat(F.lit("keywords: "), "keywords")),
            F.when(F.col("figure"), F.lit("figure number")),
        ),
        lambda r: r.isNotNull(),
    )
    return joined.withColumns({"confidence": points, "reasons": reasons})


def image_pages(analysis: DataFrame, min_confidence: float = 0.3, require_large: bool = True) -> DataFrame:
    """Pages worth reading as images, best first, ties by page; rank within the document."""
    from pyspark.sql import Window

    keep = F.col("confidence") >= min_confidence
    if require_large:
        keep = keep & F.col("any_large")
    order = Window.partitionBy("doc").orderBy(F.desc("confidence"), "page_number")
    return analysis.where(keep).withColumn("rank", F.row_number().over(order))


def of_pages(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, page_number, image_index, data) of wanted pages (doc, page_number) in their order and as often as asked;
    pages that don't exist and images without data are left out."""
    return wanted.join(images, ["doc", "page_number"]).where(F.col("data").isNotNull()).select("doc", "page_number", "image_index", "data")


def file_names() -> Column:
    """Names for images with page_number and image_index."""
    return F.concat(F.lit("page_"), F.col("page_number").cast("string"), F.lit("_img_"), F.col("image_index").cast("string"), F.lit(".png"))


def base64(data: Column) -> Column:
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")  # in one line
