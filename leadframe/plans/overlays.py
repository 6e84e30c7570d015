"""Positioned words and ruled lines laid over the plain tables, so that reading and table building have pages to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT = 10_000.0, 1_000_000.0


def _turned(boxes: DataFrame) -> DataFrame:
    """Each fifth page is turned by 90 degrees, each other seventh by 180, each other eleventh by 270."""
    by = F.when(F.col("doc_id") % 5 == 0, 90).when(F.col("doc_id") % 7 == 0, 180).when(F.col("doc_id") % 11 == 0, 270).otherwise(0)

    def corner(x: Column, y: Column) -> tuple[Column, Column]:
        w, h, turn = F.lit(WIDTH), F.lit(HEIGHT), F.col("rotation")
        return F.when(turn == 90, h - y).when(turn == 180, w - x).when(turn == 270, y).otherwise(x), F.when(turn == 90, x).when(turn == 180, h - y).when(turn == 270, w - x).otherwise(y)

    (xa, ya), (xb, yb) = corner(F.col("x0"), F.col("y0")), corner(F.col("x1"), F.col("y1"))
    boxes = boxes.withColumn("rotation", by)
    rest = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    # Through a generator, or the optimiser would put the formulas of these four into each other's place wherever they are used.
    whole = F.struct(F.least(xa, xb).alias("x0"), F.least(ya, yb).alias("y0"), F.greatest(xa, xb).alias("x1"), F.greatest(ya, yb).alias("y1"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    return boxes.select(*rest, F.explode(F.array(whole)).alias("b")).select(*rest, "b.*")


def page_words(documents: DataFrame) -> DataFrame:
    """Every word of every document, five to a line. Pages with odd ids have two columns, each third page begins with a title
    of five words over both; baselines waver a little."""
    from pyspark.sql import Window

    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), "[\\x20\\x09-\\x0D]+")
    third = F.col("doc_id") % 3 == 0
    # Texts meet by id before they are cut into words, so they are what is shuffled; words stay where their text is.
    last = F.max("last").over(Window.partitionBy("doc_id"))
    whole = documents.where(F.get(words, F.lit(0)) != "").select("doc_id", "text", F.when(third, F.size(words) - 6).otherwise(F.size(words) - 1).alias("last"))
    whole = whole.withColumn("lines", F.floor((last + 5) / 5))
    rows = whole.select("doc_id", "lines", F.posexplode(words).alias("i", "text"))
    title = third & (F.col("i") < 5)
    k = F.when(third, F.col("i") - 5).otherwise(F.col("i"))
    half = F.when(F.col("doc_id") % 2 == 1, F.ceil(F.col("lines") / 2)).otherwise(F.col("lines"))
    line = F.floor(k / 5)
    rows = rows.withColumns({"title": title, "k": k, "half": half, "line": line})
    column = F.when(F.col("line") >= F.col("half"), 1).otherwise(0)
    x0 = F.when(F.col("title"), 40 + 110 * F.col("i")).otherwise(40 + 50 * (F.col("k") % 5) + 300 * column).cast("double")
    y1 = F.when(F.col("title"), 20).otherwise(60 + 12 * (F.col("line") - column * F.col("half"))) + (F.col("i") % 3) * 0.8
    width = F.when(F.col("title"), 105.0).otherwise(45.0)
    boxes = rows.select("doc_id", F.col("i").alias("word_id"), x0.alias("x0"), (y1 - 10).alias("y0"), (x0 + width).alias("x1"), y1.alias("y1"), "text")
    return _turned(boxes)


def table_lines(page_tables: DataFrame) -> DataFrame:
    """Ruled lines around the cells of each page's table (doc_id, n_rows, header): rows of 20, columns of 100 points. In each
    third page the first two cells of the second row are one; each fourth page has a second table beside, of one column."""
    m = F.size(F.split("header", r"\|"))
    level = F.transform(F.sequence(F.lit(0), F.col("n_rows")), lambda i: F.struct(F.lit(50.0).alias("x0"), (100.0 + 20 * i).alias("y0"), (50.0 + 100 * m).alias("x1"), (100.5 + 20 * i).alias("y1")))
    joined = (F.col("doc_id") % 3 == 0) & (F.col("n_rows") > 1) & (m > 1)

    def standing(j: Column) -> Column:
        line = lambda a, b: F.struct((49.8 + 100 * j).alias("x0"), (100.0 + 20 * a).alias("y0"), (50.2 + 100 * j).alias("x1"), (100.0 + 20 * b).alias("y1"))
        return F.when(joined & (j == 1), F.array(line(F.lit(0), F.lit(1)), line(F.lit(2), F.col("n_rows")))).otherwise(F.array(line(F.lit(0), F.col("n_rows"))))

    right = 50.0 + 100 * m + 60
    box = lambda xa, ya, xb, yb: F.struct(xa.alias("x0"), ya.alias("y0"), xb.alias("x1"), yb.alias("y1"))
    bottom = 100.0 + 20 * F.col("n_rows")
    beside = F.array(box(right, F.lit(100.0), right + 80, F.lit(100.0)), box(right, bottom, right + 80, bottom), box(right, F.lit(100.0), right, bottom), box(right + 80, F.lit(100.0), right + 80, bottom))
    more = F.when(F.col("doc_id") % 4 == 0, beside).otherwise(F.slice(beside, 1, 0))
    lines = F.concat(level, F.flatten(F.transform(F.sequence(F.lit(0), m), standing)), more)
    return _turned(page_tables.select("doc_id", F.explode(lines).alias("b")).select("doc_id", "b.*"))


def table_words(page_tables: DataFrame, cells: Column) -> DataFrame:
    """The words of the cells, row after row; a cell's words are a line each. A cell of which (row + column) % 7 is 6 is empty.
    The second table holds the word "beside"."""
    rows = page_tables.select("doc_id", "n_rows", F.size(F.split("header", r"\|")).alias("m"), F.posexplode(cells).alias("i", "row"))
    rows = rows.select("doc_id", "n_rows", "m", "i", F.posexplode("row").alias("j", "cell")).where("cell is not null and (i + j) % 7 <> 6")
    rows = rows.where("not (doc_id % 3 = 0 and n_rows > 1 and m > 1 and i = 1 and j = 1)")
    words = rows.select("doc_id", "i", "j", F.posexplode(F.split("cell", " ")).alias("k", "text"))
    x0, y0 = 55.0 + 100 * F.col("j") + 3 * F.col("k"), 101.0 + 20 * F.col("i") + 6 * F.col("k")
    own = words.select("doc_id", (1000 * F.col("i") + 10 * F.col("j") + F.col("k")).alias("word_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 30).alias("x1"), (y0 + 6).alias("y1"), "text")
    at = 50.0 + 100 * F.size(F.split("header", r"\|")) + 70
    beside = page_tables.where("doc_id % 4 = 0").select("doc_id", F.lit(-1).alias("word_id"), at.alias("x0"), F.lit(102.0).alias("y0"), (at + 30).alias("x1"), F.lit(108.0).alias("y1"), F.lit("beside").alias("text"))
    return _turned(own.unionByName(beside))
