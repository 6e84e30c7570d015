"""Text and tables from positions, on small pages made by hand."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leadframe.operators import content, grids, pages, reading
from leadframe.plans import overlays

WORDS = "doc_id long, word_id int, x0 double, y0 double, x1 double, y1 double, text string"
LINES = "doc_id long, x0 double, y0 double, x1 double, y1 double"


def words(spark, rows):
    return spark.createDataFrame([(d, i, float(x), float(y), float(x + w), float(y + h), t) for i, (d, x, y, w, h, t) in enumerate(rows)], WORDS)


def text(spark, rows):
    return {r.doc_id: r.text for r in reading.page_text(words(spark, rows)).collect()}


def test_lines_columns_and_bands(spark):
    rows = [(1, 10, 0, 180, 12, "Title over both")]
    rows += [(1, 10 + 25 * (i % 3), 40 + 12 * (i // 3), 20, 10, f"a{i}") for i in range(6)]
    rows += [(1, 110 + 25 * (i % 3), 40 + 12 * (i // 3), 20, 10, f"b{i}") for i in range(6)]
    rows += [(1, 10, 90, 100, 10, "foot"), (2, 50, 50, 10, 10, "alone"), (3, 0, 0, 5, 10, ""), (3, 0, 0, 5, 10, None)]
    random.Random(1).shuffle(rows)
    assert text(spark, rows) == {1: "Title over both\na0 a1 a2\na3 a4 a5\nb0 b1 b2\nb3 b4 b5\nfoot", 2: "alone"}


def test_the_tolerance_follows_the_size(spark):
    small = [(1, 20 * i, 10 + 3 * (i % 2), 10, 10, f"s{i}") for i in range(4)]  # steps of 3 points are one line of size 10
    tiny = [(2, 4 * i, 10 + 3 * (i % 2), 3, 4, f"t{i}") for i in range(4)]  # and two of size 4
    assert text(spark, small + tiny) == {1: "s0 s1 s2 s3", 2: "t0 t2\nt1 t3"}


def test_the_order_is_total_under_ties(spark):
    rows = [(1, 10, 10, 20, 10, t) for t in "cab"] + [(1, 10, 10, 20, 10, "c")]
    frame = words(spark, rows)
    assert {reading.page_text(frame.repartition(n)).first().text for n in (1, 3, 4)} == {"c a b c"}


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_turned_pages_read_as_if_upright(spark, turn):
    w, h = 600.0, 800.0
    move = {0: lambda x, y: (x, y), 90: lambda x, y: (h - y, x), 180: lambda x, y: (w - x, h - y), 270: lambda x, y: (y, w - x)}[turn]
    boxes = [(10, 10, 40, 20, "one"), (50, 10, 90, 20, "two"), (10, 30, 40, 40, "three")]
    rows = [(1, i, *move(a, b), *move(c, d), t, turn, w, h) for i, (a, b, c, d, t) in enumerate(boxes)]
    frame = spark.createDataFrame([tuple(float(v) if k in (2, 3, 4, 5) else v for k, v in enumerate(r)) for r in rows], WORDS + ", rotation int, width double, height double")
    assert reading.page_text(frame).first().text == "one two\nthree"


def built(spark, lines, rows):
    frame = spark.createDataFrame([tuple(map(float, r[1:])) and (r[0], *map(float, r[1:])) for r in lines], LINES)
    got = grids.tables(frame, words(spark, rows)).orderBy("doc_id", "table_index").collect()
    return [(r.doc_id, r.table_index, [list(x) for x in r.cells]) for r in got]


def grid(doc, xs, ys):
    return [(doc, xs[0], y, xs[-1], y) for y in ys] + [(doc, x, ys[0], x, ys[-1]) for x in xs]


def test_a_grid_with_empty_cells_and_words_outside(spark):
    rows = [(1, 2, 2, 6, 4, "a"), (1, 9, 2, 3, 4, "b"), (1, 2, 7, 6, 3, "c"), (1, 32, 2, 6, 4, "x"), (1, 99, 2, 6, 4, "out"), (1, 2, 99, 6, 4, "out")]
    assert built(spark, grid(1, [0, 30, 60], [0, 15, 30]), rows) == [(1, 0, [["a b\nc", "x"], ["", ""]])]


def test_merged_cells_keep_their_place(spark):
    # over two columns, and over two rows
    lines = [(1, 0, 0, 60, 0), (1, 0, 10, 60, 10), (1, 20, 20, 60, 20), (1, 0, 30, 60, 30), (1, 0, 0, 0, 30), (1, 20, 10, 20, 30), (1, 40, 0, 40, 30), (1, 60, 0, 60, 30)]
    rows = [(1, 1, 2, 30, 5, "wide"), (1, 45, 2, 5, 5, "h"), (1, 2, 18, 9, 4, "tall"), (1, 22, 12, 5, 5, "p"), (1, 42, 12, 5, 5, "q"), (1, 22, 22, 5, 5, "r")]
    assert built(spark, lines, rows) == [(1, 0, [["wide", None, "h"], ["tall", "p", "q"], [None, "r", ""]])]


def test_broken_doubled_and_shaky_lines_are_one(spark):
    lines = [(1, 0, y, 29, y + 0.6) for y in (0, 20, 40)] + [(1, 31, y + 1, 60, y + 1) for y in (0, 20, 40)] + [(1, 10, y, 50, y) for y in (0, 20)]
    lines += [(1, x, 0, x + 1, 40) for x in (0, 30, 60)] + [(1, 30, 0, 30, 40), (1, 5, 5, 25, 15), (1, 7, 7, 7.5, 7.5), (1, 0, 0, 30, 40)]
    assert built(spark, lines, [(1, 5, 5, 10, 8, "a"), (1, 35, 25, 10, 8, "d")]) == [(1, 0, [["a", ""], ["", "d"]])]


def test_tables_are_parted_and_open_boxes_are_none(spark):
    lines = grid(1, [0, 50], [0, 20, 40]) + grid(1, [80, 120, 160], [0, 30]) + grid(1, [0, 160], [60, 90])
    lines += [(1, 200, 0, 200, 50), (1, 240, 0, 240, 50), (1, 200, 0, 240, 0)]  # without a floor
    lines += grid(2, [0, 9], [0, 9])
    rows = [(1, 5, 5, 9, 9, "a"), (1, 85, 9, 9, 9, "b"), (1, 125, 9, 9, 9, "c"), (1, 5, 70, 9, 9, "d"), (1, 205, 9, 9, 9, "open")]
    assert built(spark, lines, rows) == [(1, 0, [["a"], [""]]), (1, 1, [["b", "c"]]), (1, 2, [["d"]]), (2, 0, [[""]])]


def test_a_page_of_a_hundred_thousand_words(spark):
    n, m = 1000, 20
    lines = spark.range(n + 1).selectExpr("1L as doc_id", "0D as x0", "10D * id as y0", f"{m * 50}D as x1", "10D * id as y1").unionByName(spark.range(m + 1).selectExpr("1L as doc_id", "50D * id as x0", "0D as y0", "50D * id as x1", f"{n * 10}D as y1"))
    every = spark.range(n * m * 5).selectExpr("1L as doc_id", "cast(id as int) as word_id", "50D * (id div 5 % 20) + 9 * (id % 5) + 1 as x0", "10D * (id div 100) + 1 as y0", "50D * (id div 5 % 20) + 9 * (id % 5) + 8 as x1", "10D * (id div 100) + 8 as y1", "cast(id as string) as text")
    began = time.time()
    got = grids.tables(lines, every).select(F.size("cells").alias("rows"), F.expr("cells[999][19]").alias("last"), F.expr("size(filter(flatten(cells), c -> size(split(c, ' ')) = 5))").alias("full")).collect()
    assert [tuple(r) for r in got] == [(n, "99995 99996 99997 99998 99999", n * m)]
    assert reading.page_text(every).select(F.size(F.split("text", "[ \n]"))).first()[0] == n * m * 5
    assert time.time() - began < 120


def test_nothing_is_joined_by_inequality(spark):
    lines, rows = spark.createDataFrame([], LINES), spark.createDataFrame([], WORDS)
    frame = grids.tables(lines, rows)
    plan = frame._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert frame.count() == 0 and reading.page_text(rows).count() == 0


def test_rebuilt_tables_score_pages(spark):
    rows = [(7, 2, 2, 6, 4, "Pin"), (7, 10, 2, 6, 4, "No."), (7, 32, 2, 9, 4, "Symbol"), (7, 62, 2, 9, 4, "Function"), (7, 2, 18, 6, 4, "1")]
    frame = spark.createDataFrame([(r[0], *map(float, r[1:])) for r in grid(7, [0, 30, 60, 90], [0, 15, 30])], LINES)
    found = grids.tables(frame, words(spark, rows))
    assert pages.table_scores(found).count() == 1 and found.where(content.is_pin_table(F.col("cells"))).count() == 1


def test_page_words_shuffles_texts_and_no_words(spark):
    """One exchange for the whole query, below the generator that cuts texts into words; a line needs no group of its own."""
    documents = spark.createDataFrame([(1, "a b c d e f g"), (1, "x"), (2, ""), (3, " a  b c\td e\nf "), (None, "p q"), (4, None)], "doc_id long, text string")
    read = reading.page_text(overlays.page_words(documents))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.rindex("Generate posexplode")
    assert plan.count("ObjectHashAggregate") + plan.count("SortAggregate") == 2
    assert {r.doc_id: r.text for r in read.collect() if r.doc_id != 1} == {3: "a b c d e\nf", None: "p q"}
