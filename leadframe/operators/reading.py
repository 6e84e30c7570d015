"""Text from positioned words: bands, columns, lines, reading order.

words: doc_id (a page), word_id, x0, y0, x1, y1 (y grows downwards), text, and optionally rotation (the degrees, 0, 90, 180 or
270, by which the page is turned clockwise) with width and height of the upright page.

A page is cut where nothing lies: first into bands by gaps in y, each band into columns by gaps in x, each column into lines by
steps of the baseline. Gaps and tolerances are parts of the words' size, their height. All are windows over sorted words
(gaps and islands), and all need the words of a page together, so they share one shuffle by page.

Defined cases: words without a position or text, or with an empty text, are left out. Ties are broken by position, then by
word_id, so the order is total wherever word ids differ. A page without words has no row. A turned page reads as if upright.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A new line begins where the baseline steps by more than this part of the size, a new column at an empty strip, and a new
#: band at an empty stretch, of more than so many sizes.
LINE, COLUMN, BAND = 0.5, 1.5, 1.2
BOX = ["x0", "y0", "x1", "y1"]


def upright(boxes: DataFrame) -> DataFrame:
    """Boxes in the frame of the upright page, with x0 <= x1 and y0 <= y1."""

    def corner(x: Column, y: Column) -> tuple[Column, Column]:
        if "rotation" not in boxes.columns:
            return x, y
        w, h, by = F.col("width"), F.col("height"), F.col("rotation")
        return F.when(by == 90, y).when(by == 180, w - x).when(by == 270, w - y).otherwise(x), F.when(by == 90, h - x).when(by == 180, h - y).when(by == 270, x).otherwise(y)

    (xa, ya), (xb, yb) = corner(F.col("x0"), F.col("y0")), corner(F.col("x1"), F.col("y1"))
    return boxes.withColumns({"x0": F.least(xa, xb), "y0": F.least(ya, yb), "x1": F.greatest(xa, xb), "y1": F.greatest(ya, yb)})


def islands(rows: DataFrame, keys: list[str], low: str, high: str, gap: Column | float, name: str, order: list[str] | None = None) -> DataFrame:
    """`rows` with `name`, the number of their island within the keys: intervals that overlap, or are at most `gap` apart."""
    within = Window.partitionBy(*keys).orderBy(low, high, *(order or []))
    reach = F.max(high).over(within.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(low) - reach <= gap, 0).otherwise(1)
    return rows.withColumn(name, fresh).withColumn(name, F.sum(name).over(within.rowsBetween(Window.unboundedPreceding, 0)))


def with_lines(words: DataFrame, keys: list[str], tolerance: float = LINE) -> DataFrame:
    """Words with `line`, numbered from the top within the keys."""
    within = Window.partitionBy(*keys).orderBy("y1", "x0", "x1", "y0", "word_id")
    step = F.col("y1") - F.lag("y1").over(within)
    size = F.greatest(F.col("y1") - F.col("y0"), F.lag(F.col("y1") - F.col("y0")).over(within))
    return words.withColumn("line", F.when(step <= F.lit(tolerance) * size, 0).otherwise(1)).withColumn("line", F.sum("line").over(within.rowsBetween(Window.unboundedPreceding, 0)))


def text_of(words: DataFrame, keys: list[str], cut: list[str]) -> DataFrame:
    """(keys, text): words with lines, parted by spaces within a line and by line breaks between lines of each `cut`."""
    rank = [*cut, "line"]
    ordered = F.array_sort(F.collect_list(F.struct(*rank, "x0", "x1", "y0", "y1", "word_id", "text")))
    pages = words.groupBy(*keys).agg(ordered.alias("said"))
    # One list for each page: lines are short, and a list for each of them costs more than their words.
    place = lambda w: F.struct(*(w[c] for c in rank))
    before = lambda w, i: F.when(i == 0, "").when(place(w) == place(F.get(F.col("said"), i - 1)), " ").otherwise("\n")
    return pages.select(*keys, F.array_join(F.transform("said", lambda w, i: F.concat(before(w, i), w["text"])), "").alias("text"))


def usable(words: DataFrame) -> DataFrame:
    placed = F.lit(True)
    for c in BOX:
        placed = placed & F.col(c).isNotNull()
    return upright(words.where(placed & F.col("text").isNotNull() & (F.col("text") != ""))).select("doc_id", "word_id", *BOX, "text")


def in_reading_order(words: DataFrame, line: float = LINE, column: float = COLUMN, band: float = BAND) -> DataFrame:
    """Words with band, column and line. The size that gaps are measured by is the page's median."""
    found = usable(words)
    size = F.percentile(F.col("y1") - F.col("y0"), 0.5).over(Window.partitionBy("doc_id"))
    found = found.withColumn("size", size)
    found = islands(found, ["doc_id"], "y0", "y1", F.lit(band) * F.col("size"), "band", ["x0", "x1", "word_id"])
    found = islands(found, ["doc_id", "band"], "x0", "x1", F.lit(column) * F.col("size"), "column", ["y0", "y1", "word_id"])
    return with_lines(found, ["doc_id", "band", "column"], line).drop("size")


def page_text(words: DataFrame, line: float = LINE, column: float = COLUMN, band: float = BAND) -> DataFrame:
    """(doc_id, text) of every page that has words."""
    return text_of(in_reading_order(words, line, column, band), ["doc_id"], ["band", "column"])
