"""Tables from ruled lines and positioned words.

lines: doc_id (a page), x0, y0, x1, y1; words as in `reading`. Both may have rotation, width and height.

1. Lines that are level or upright within `SNAP` become rows and columns of the page: positions closer than that are one
   (gaps and islands). Pieces on one row or column that are at most `JOIN` apart are one line.
2. Between two neighbouring rows of the page, a band, upright lines are walls. From each wall to the next is a stretch; it has a
   lid, and a floor, if one level line covers it on that side.
3. Stretches between the same walls in bands below each other are one cell until there is a lid: so cells may span rows and
   columns. A cell without a lid or floor of its own is none.
4. Cells are cut into tables along empty bands, then empty columns, then empty bands again.
5. A word belongs to the cell that its centre is in, found by the last row above and the last wall left of it.

A position is looked up by sorting it among the others in a window, never by an inequality join, so no pair of a word and a
cell, or of two lines, is tried. Everything is by page. Lines and cells, which are used several times and are few beside the
words, are written down. A table is as many rows and columns as
there are places where its cells begin; a cell's text stands where it begins, the other places that it spans are null, and a
cell without words is the empty text.

Defined cases: lines without a position, slanted ones and dots are left out; so are words as in `reading`. Lines that repeat or
overlap are one. Pages without a closed cell have no table. Tables are numbered from the top, then from the left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .reading import BOX, islands, text_of, upright, usable, with_lines

#: In points: positions of lines that count as one, gaps in a line that are closed.
SNAP, JOIN = 3.0, 3.0


def rulings(lines: DataFrame, snap: float = SNAP, join: float = JOIN) -> tuple[DataFrame, DataFrame]:
    """Level and upright lines: (doc_id, n, at, low, high), with n the row's or column's number on the page, from 0."""
    placed = F.lit(True)
    for c in BOX:
        placed = placed & F.col(c).isNotNull()
    found = upright(lines.where(placed))

    def along(low: str, high: str, side: str, other: str) -> DataFrame:
        thin = found.where((F.col(other) - F.col(side) <= snap) & (F.col(high) - F.col(low) > snap))
        own = thin.select("doc_id", ((F.col(side) + F.col(other)) / 2).alias("at"), F.col(low).alias("low"), F.col(high).alias("high"))
        own = islands(own.withColumn("to", F.col("at")), ["doc_id"], "at", "to", snap, "n").withColumn("n", F.col("n") - 1)
        own = own.withColumn("at", F.min("at").over(Window.partitionBy("doc_id", "n")))
        pieces = islands(own, ["doc_id", "n"], "low", "high", join, "piece")
        return pieces.groupBy("doc_id", "n", "at", "piece").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("piece")

    return along("x0", "x1", "y0", "y1"), along("y0", "y1", "x0", "x1")


def last_before(marks: DataFrame, places: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`places` (keys, at, ...) with `value` of the last of `marks` (keys, at, value) that isn't after them; null if none is."""
    both = marks.select(*keys, "at", value, F.lit(0).alias("_kind")).unionByName(places.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    within = Window.partitionBy(*keys).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(within)).where("_kind = 1").drop("_kind")


def walls(level: DataFrame, standing: DataFrame, snap: float = SNAP) -> DataFrame:
    """(doc_id, band, c, x): which columns of the page have a wall in which band; band b lies between rows b and b + 1."""
    rows = level.select("doc_id", "at", F.col("n").alias("row")).distinct()
    # Row numbers go up by one, so that of the last row before a line's upper end tells the first one on it.
    ends = standing.select("doc_id", F.col("n").alias("c"), F.col("at").alias("x"), F.explode(F.array(F.struct((F.col("low") - snap).alias("at"), F.lit(True).alias("upper")), F.struct((F.col("high") + snap).alias("at"), F.lit(False).alias("upper")))).alias("e"), "low")
    ends = last_before(rows, ends.select("doc_id", "c", "x", "low", "e.at", "e.upper"), ["doc_id"], "row")
    span = ends.groupBy("doc_id", "c", "x", "low").agg(
        (F.coalesce(F.max(F.when(F.col("upper"), F.col("row"))), F.lit(-1)) + 1).alias("first"), F.coalesce(F.max(F.when(~F.col("upper"), F.col("row"))), F.lit(-1)).alias("last")
    )
    bands = span.where("last > first").select("doc_id", "c", "x", F.explode(F.sequence("first", F.col("last") - 1)).alias("band"))
    return bands.groupBy("doc_id", "band", "c").agg(F.min("x").alias("x"))


def cells(level: DataFrame, standing: DataFrame, snap: float = SNAP) -> tuple[DataFrame, DataFrame]:
    """(doc_id, r0, r1, c0, c1) of closed cells, from row r0 to r1 and column c0 to c1, and the walls they were found by."""
    own = walls(level, standing, snap)
    right = Window.partitionBy("doc_id", "band").orderBy("c")
    stretch = own.select("doc_id", "band", F.col("c").alias("c0"), F.col("x").alias("xa"), F.lead("c").over(right).alias("c1"), F.lead("x").over(right).alias("xb")).where("c1 is not null")
    sides = F.explode(F.array(F.struct(F.col("band").alias("n"), F.lit(True).alias("above")), F.struct((F.col("band") + 1).alias("n"), F.lit(False).alias("above")))).alias("s")
    asked = stretch.select("*", sides).select("doc_id", "band", "c0", "c1", "xb", F.col("xa").alias("at"), "s.n", "s.above")
    # Pieces of one row don't overlap, so only the last that begins before a stretch can cover it.
    covered = last_before(level.select("doc_id", "n", (F.col("low") - snap).alias("at"), "high"), asked, ["doc_id", "n"], "high")
    closed = F.coalesce(F.col("high") + snap >= F.col("xb"), F.lit(False))
    marked = covered.groupBy("doc_id", "band", "c0", "c1").agg(F.bool_or(F.col("above") & closed).alias("lid"), F.bool_or(~F.col("above") & closed).alias("floor"))
    down = Window.partitionBy("doc_id", "c0", "c1").orderBy("band")
    fresh = F.when((F.lag("band").over(down) == F.col("band") - 1) & ~F.col("lid"), 0).otherwise(1)
    runs = marked.withColumn("k", fresh).withColumn("k", F.sum("k").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("doc_id", "c0", "c1", "k").agg(F.min("band").alias("r0"), (F.max("band") + 1).alias("r1"), F.min_by("lid", "band").alias("lid"), F.max_by("floor", "band").alias("floor"))
    return found.where("lid and floor").select("doc_id", "r0", "r1", "c0", "c1"), own


def numbered_tables(found: DataFrame) -> DataFrame:
    """Cells with table_index, and `row` and `column` within the table."""
    cut = islands(found, ["doc_id"], "r0", "r1", 0, "t1", ["c0"])
    cut = islands(cut, ["doc_id", "t1"], "c0", "c1", 0, "t2", ["r0"])
    cut = islands(cut, ["doc_id", "t1", "t2"], "r0", "r1", 0, "t3", ["c0"])
    number = lambda keys, order: F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    cut = cut.withColumn("table_index", number(["doc_id"], ["t1", "t2", "t3"]))
    return cut.withColumns({"row": number(["doc_id", "table_index"], ["r0"]), "column": number(["doc_id", "table_index"], ["c0"])}).drop("t1", "t2", "t3")


def tables(lines: DataFrame, words: DataFrame, snap: float = SNAP, join: float = JOIN) -> DataFrame:
    """(doc_id, table_index, cells): each table's rows of cells."""
    level, standing = map(durable, rulings(lines, snap, join))
    found, own = cells(level, standing, snap)
    numbered = durable(numbered_tables(found))

    placed = usable(words).withColumns({"at": (F.col("y0") + F.col("y1")) / 2, "x": (F.col("x0") + F.col("x1")) / 2})
    placed = last_before(level.select("doc_id", "at", F.col("n").alias("band")).distinct(), placed, ["doc_id"], "band").where("band is not null")
    placed = last_before(own.select("doc_id", "band", F.col("x").alias("at"), F.col("c").alias("c0")), placed.withColumn("at", F.col("x")).drop("x"), ["doc_id", "band"], "c0").where("c0 is not null")
    parts = numbered.select("doc_id", "table_index", "row", "column", "c0", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("band"))
    inside = placed.join(parts, ["doc_id", "band", "c0"]).drop("at", "band", "c0")
    place = ["doc_id", "table_index", "row", "column"]
    said = text_of(with_lines(inside, place), place, [])

    whole = numbered.select(*place).join(said, place, "left").withColumn("text", F.coalesce("text", F.lit("")))
    whole = whole.withColumn("columns", F.max("column").over(Window.partitionBy("doc_id", "table_index")))
    in_row = F.map_from_entries(F.collect_list(F.struct("column", "text")))
    rows = whole.groupBy("doc_id", "table_index", "row", "columns").agg(in_row.alias("m"))
    rows = rows.select("doc_id", "table_index", "row", F.transform(F.sequence(F.lit(0), F.col("columns")), lambda j: F.try_element_at("m", j)).alias("line"))
    return rows.groupBy("doc_id", "table_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]).alias("cells"))
