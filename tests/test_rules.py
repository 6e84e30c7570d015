"""Hand-computed values, quirks that are kept on purpose, and properties."""

import pytest
from pyspark.sql import functions as F

from leadframe.functions import rules
from leadframe.functions import text as T
from leadframe.operators import content, images, layout, packages, pages, render, responses


def one(spark, column, **values):
    frame = spark.range(1)
    for k, v in values.items():
        frame = frame.withColumn(k, F.lit(v))
    return frame.select(column.alias("x")).first().x


def pins(spark, package, count):
    frame = spark.createDataFrame([(1, "X", package, count)], "comp_id int, component_name string, pkg string, pins int")
    sized = layout.parameters(frame, "pkg", "pins")
    return sized.first(), {r.pin_number: r for r in layout.positions(sized).collect()}


def test_dip_8(spark):
    sized, got = pins(spark, "DIP-8", 8)
    assert (sized.body_width, sized.body_height, sized.pitch) == (20.0, 27.5, 2.5)
    assert [(got[str(i)].x, got[str(i)].y) for i in range(1, 9)] == [(-10, 8.75), (-10, 6.25), (-10, 3.75), (-10, 1.25), (10, 1.25), (10, 3.75), (10, 6.25), (10, 8.75)]
    assert (got["1"].text_x, got["1"].num_x, got["1"].rotation, got["1"].text_halign) == (-22.0, -12.0, 180.0, "left")
    assert (got["5"].text_x, got["5"].num_x, got["5"].rotation, got["5"].text_halign) == (22.0, 12.0, 0.0, "right")


def test_tqfp_44(spark):
    sized, got = pins(spark, "TQFP-44", 44)
    assert (sized.body_width, sized.body_height) == (13.5, 13.5) and len(got) == 44
    want = {1: (-6.75, 2.75, "left"), 12: (-2.75, -6.75, "bottom"), 23: (6.75, 2.25, "right"), 33: (6.75, -2.75, "right"), 34: (-2.25, 6.75, "top"), 44: (2.75, 6.75, "top")}
    assert {i: (got[str(i)].x, got[str(i)].y, got[str(i)].side) for i in want} == want
    assert got["1"].text_x == -2.75 and got["12"].text_y == -10.75 and got["44"].num_y == 8.75


@pytest.mark.parametrize(("package", "count", "places", "width", "height"), [("SOIC-16", 16, 16, 5.0, 16.89), ("BGA", 100, 52, 13.0, 13.0), ("QFN-38", 38, 36, 10.5, 10.5), ("LQFP64", 64, 64, 16.0, 16.0), ("DIP", 1, 0, 20.0, 17.5), ("BGA", 1, 1, 4.0, 4.0), ("DIP", 7, 6, 20.0, 25.0)])
def test_bodies_and_numbers_of_places(spark, package, count, places, width, height):
    sized, got = pins(spark, package, count)
    assert len(got) == places and sized.body_width == width and sized.body_height == pytest.approx(height)


def test_quad_sides_as_meant(spark):
    frame = spark.createDataFrame([(1, "QFN", 16)], "comp_id int, pkg string, pins int")
    got = {r.pin_number: r for r in layout.positions(layout.parameters(frame, "pkg", "pins"), counter_clockwise=True).collect()}
    assert got["9"].y < got["12"].y and got["13"].x > got["16"].x


def test_custom_sections_start_anew_and_last_position_wins(spark):
    frame = spark.createDataFrame([(1, "DIP", 8)], "comp_id int, pkg string, pins int")
    sections = F.array(F.struct(F.lit("Left_Side").alias("section"), F.array(F.lit(1), F.lit(2)).alias("pins")), F.struct(F.lit("upper left").alias("section"), F.array(F.lit(2)).alias("pins")))
    places = layout.laid_out(layout.parameters(frame, "pkg", "pins").withColumn("sections", sections))
    rows = {(r.pin_index, r.pin_number): r.y for r in places.collect()}
    assert set(rows) == {(0, "1"), (1, "2"), (2, "2")} and rows[0, "1"] == rows[2, "2"]
    pins_ = spark.createDataFrame([(1, 2, "A"), (1, 2, "B"), (1, 9, "C")], "comp_id int, number long, name string")
    placed = layout.placed_pins(pins_, places, repeated=True).collect()
    assert sorted((r.name, r.pin_index) for r in placed) == [("A", 2), ("B", 2)]
    assert [r.name for r in layout.unplaced_pins(pins_, places).collect()] == ["C"]


def test_package_names(spark):
    names = {"DIP-8": "DIP", "soic-16": "SOIC", "QFN-24": "QFN", "VQFN": "QFN", "DIL": "DIP", "SOT-23": "SOT-23", "TQFP-44": "QFP", "TSSOP-20": "SOIC"}
    frame = spark.createDataFrame(list(names.items()), "name string, want string")
    assert frame.where(packages.normalized(F.col("name")) != F.col("want")).count() == 0
    kinds = {"DIP8": "DIP", "LQFP-64": "LQFP", "QFN": "QFN", " bga ": "BGA", "odd": "DIP", "": "DIP"}
    frame = spark.createDataFrame(list(kinds.items()), "name string, want string")
    assert frame.where(packages.parsed(F.col("name")) != F.col("want")).count() == 0
    assert one(spark, packages.from_text(F.lit("a TSSOP case"))) == "SOIC"
    assert one(spark, packages.from_text(F.lit("thin shrink small outline"))) == "TSSOP"
    assert one(spark, packages.from_text(F.lit("thin quad flat pack"))) == "TQFP"


def test_squares_and_defaults(spark):
    for w, h, want in ((5.0, 6.0, True), (5.0, 8.0, False), (0.0, 5.0, False)):
        assert one(spark, packages.quasi_square(F.lit(w), F.lit(h))) is want
    for count, want in ((8, "SOIC"), (24, "DIP"), (25, "SOIC"), (32, "QFN"), (64, "QFN")):
        assert one(spark, packages.default(F.lit(count))) == want
    assert one(spark, packages.valid(F.lit("LGA"), F.lit(8), F.lit(1.0), F.lit(1.0))) is True


def test_keywords_count_as_plain_text(spark):
    assert one(spark, pages.keyword_count(F.lit("no connect"))) == 0  # that keyword is no pattern
    assert one(spark, pages.keyword_count(F.lit("no\\s*connect"))) == 1
    assert one(spark, pages.keyword_count(F.lit("pinpin rx"))) == 3


def test_keyword_count_equals_python(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", "Pin VCC  vdd\tGND\n"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = frame.select("i", pages.keyword_count(F.col("text")).alias("k"), T.word_count(F.col("text")).alias("w")).collect()
    for r in got:
        low = texts[r.i].lower()
        assert (r.k, r.w) == (sum(low.count(k) for k in rules.DENSITY_KEYWORDS), len(low.split()))


def test_headings_do_not_reach_over_a_line(spark):
    assert one(spark, pages.heading_pattern(F.lit("the pin\nout"))) is None
    assert one(spark, pages.heading_pattern(F.lit("x\nPin  Configuration"))) == rules.HEADING_PATTERNS[0]
    assert one(spark, pages.heading_pattern(F.lit("\n" * 10 + "pinout"))) is None


def test_scores_stay_in_bounds(spark):
    from leadframe.plans.queries import Data

    low, high = Data(spark, "/root/testdata/sf0.001").scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low and high <= 12


def test_pages_without_text_area_or_neighbours(spark):
    page = spark.createDataFrame([("d", 1, 1, 0, 0.0, 0.0, None)], "doc string, doc_id int, page_number int, total_pages int, width double, height double, text string")
    tables = spark.createDataFrame([], "doc_id int, table_index int, cells array<array<string>>")
    pictures = spark.createDataFrame([(1, 0, 5.0, None)], "doc_id int, image_index int, width double, height double")
    row = pages.score(page, tables, pictures).first()
    assert (row.score, row.reasons, row.unusual) == (0, [], False)


def test_table_keywords_count_with_multiplicity(spark):
    table = F.array(F.array(F.lit("Function")))
    assert one(spark, content.is_pin_table(table)) is True  # "function" and "io" in it
    assert one(spark, content.is_pin_table(F.array(F.array(F.lit("xtal"))))) is True  # stands twice in the list
    assert one(spark, content.is_pin_table(F.array().cast("array<array<string>>"))) is False


def test_sections_and_exclusions(spark):
    for text, want in (("", False), ("Pin list\nfoo", True), ("pin list ordering information", False), ("pin list\nordering information\nx", True), ("pinout - ordering information", True), ("(a/b/c/t1) pb0 pa0 (", True)):
        assert one(spark, content.is_pin_section(F.lit(text))) is want, text


def test_blocks(spark):
    text = "junk\n--- Page 3 ---\na\n\n  --- Page x ---\nlost\n--- Page 4 ---\n--- Page 5\nb"
    got = one(spark, content.blocks(F.lit(text)))
    assert [(b.page, b.text) for b in got] == [(3, "a\n"), (5, "b")]
    assert one(spark, content.blocks(F.lit("no marker"))) == [] and one(spark, content.blocks(F.lit(None).cast("string"))) == []


def test_filter_keeps_the_list_of_pages(spark):
    row = spark.createDataFrame([("d", [2, 1], "--- Page 1 ---\nnothing\n\n", [], [])], f"doc string, pages array<int>, text_content string, tables {content.TABLE_TYPE}, images {content.IMAGE_TYPE}")
    assert content.filtered(row).first().text_content == "" and content.filtered(row).first().pages == [2, 1]
    assert content.filtered_or_all(row).first().text_content == "--- Page 1 ---\nnothing\n\n"


ANSWERS = [
    ('```json\n{"pins": [{"number": "A1"}, {"number": 2.9, "name": null}]}\n```', [(1, ""), (2, None)], None),
    ('{"pins": [{"number": "none"}, {"number": true}]}', [(0, ""), (1, "")], None),
    ('{"pins": [{"name": "x"}]}', None, "pins"),
    ('{"pins": null}', None, "pins"),
    ('{"package": null}', None, "package"),
    ('{"package": {"width": "7.5"}}', [], None),
    ('{"package": {"width": "wide"}}', None, "dimensions"),
    ("[1]", None, "not an object"),
    ("{", None, "not JSON"),
    (None, None, "not JSON"),
]


@pytest.mark.parametrize(("answer", "want", "error"), ANSWERS)
def test_parsed_answers(spark, answer, want, error):
    row = responses.parsed_pins(spark.createDataFrame([(1, answer)], "id int, response string")).first()
    assert row.error == error and (None if row.pins is None else [(p.number, p.name) for p in row.pins]) == want
    if error is None:
        assert row.component_name == "Unknown" and row.package.type == "Unknown"


VISION = [
    ('{"description": {"component_name": "A"}}', "A"),
    ('{"description": "x ```json\\n{\\"component_name\\": \\"B\\"}\\n``` y"}', "B"),
    ('{"description": "see {\\"component_name\\": \\"C\\"} there"}', "C"),
    ('{"description": "no braces", "component_name": "D"}', ""),
    ('{"description": "{bad}", "component_name": "E"}', "E"),
    ('{"raw_text": "{\\"component_name\\": \\"F\\"}"}', "F"),
    ('{"raw_text": "none", "component_name": "G"}', ""),
    ('{"description": 5, "package_type": "H"}', ""),
    ("not json", ""),
]


@pytest.mark.parametrize(("answer", "name"), VISION)
def test_vision_answers(spark, answer, name):
    row = responses.vision_results(spark.createDataFrame([(1, answer)], "id int, response string")).first()
    assert row.component_name == name and (row.package_type == "H") == ("package_type" in answer)


def test_best_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, "a"), (1, 2, 0.9, "b"), (1, 3, 0.9, "c"), (2, 1, 0.0, "z"), (3, 1, None, "y")], "doc int, ord int, confidence double, component_name string")
    got = {r.doc: (r.ord, r.confidence, r.component_name) for r in responses.best_of(rows).collect()}
    assert got == {1: (2, 0.9, "b"), 2: (None, 0.0, ""), 3: (None, 0.0, "")}


def test_yes_and_no(spark):
    for answer, want in (("yes", True), (" NO.", False), ("not sure", False), ("None", False), ("maybe", True), (None, True)):
        assert one(spark, responses.says_yes(F.lit(answer).cast("string"))) is want


def test_layout_texts(spark):
    text = "QFN\nPin Count: 38\nLeft Side: 1-3, 5, 3\n"
    coded, meant = one(spark, responses.layout_as_coded(F.lit(text))), one(spark, responses.layout_intended(F.lit(text)))
    assert (coded.package_type, coded.pin_count, coded.sections) == ("Unknown", 0, [])
    assert (meant.package_type, meant.pin_count) == ("QFN", 38) and [(s.section, s.pins) for s in meant.sections] == [("Left Side", [1, 2, 3, 5])]


def test_part_numbers(spark):
    for name, want in (("STM32F103RBT7.PDF", "STM32F103RBT7"), ("NE555 sheet.pdf", "NE555"), ("lower.pdf", None), (".pdf", None)):
        assert one(spark, T.part_number(F.lit(name))) == want


def test_image_thresholds_differ(spark):
    frame = spark.createDataFrame([(1, "d", 1, 10.0, 10.0, "Figure 1-1 pinout")], "doc_id int, doc string, page_number int, width double, height double, text string")
    pictures = spark.createDataFrame([(1, 0, 4.0, 5.0)], "doc_id int, image_index int, width double, height double")
    assert images.measured(pictures, frame).first().is_large is False  # exactly a fifth is not large here
    tables = spark.createDataFrame([], "doc_id int, table_index int, cells array<array<string>>")
    assert pages.score(frame.withColumn("total_pages", F.lit(1)), tables, pictures).first().has_diagram is True  # but enough there


def test_report(spark):
    package = F.struct(F.lit("DIP").alias("type"), F.lit(2).alias("pin_count"), F.lit(7.5).alias("width"), F.lit(None).cast("double").alias("height"), F.lit(2.54).alias("pitch"))
    listed = F.array(F.struct(F.lit(1).alias("number"), F.lit("VCC").alias("name"), F.lit("power").alias("function")), F.struct(F.lit(2).alias("number"), F.lit("NC").alias("name"), F.lit("").alias("function")))
    got = one(spark, render.report(F.lit("X"), package, listed)).split("\n")
    assert got[:6] == ["=" * 70, "Component: X", "Package: DIP-2", "Dimensions: 7.5mm x Nonemm", "Pitch: 2.54", "=" * 70] and got[7:] == ["Total Pins: 2", "", "Pin 1: VCC (power)", "Pin 2: NC"]


def test_pin_numbers_are_never_replaced_by_others(spark):
    """Whole numbers that a bigint can't hold make the record's pins unusable; they don't become the largest bigint."""
    numbers = {"12": 12, "-3": -3, "7.9": 7, "-7.9": -7, "1e2": 100, '"A17b3"': 17, '"none"': 0, "true": 1, "12345678901234567.5": 12345678901234567, "9223372036854775807": 2**63 - 1}
    lost = ["1e300", "99999999999999999999", '"99999999999999999999"', "null", "[1]", "{}"]
    rows = [(i, '{"pins": [{"number": %s}]}' % n) for i, n in enumerate([*numbers, *lost])]
    got = {r.i: r for r in responses.parsed_pins(spark.createDataFrame(rows, "i int, response string")).collect()}
    assert [got[i].pins[0].number for i in range(len(numbers))] == list(numbers.values())
    assert [got[len(numbers) + k].error for k in range(len(lost))] == ["pins"] * len(lost)


def test_layouts_with_absurd_numbers_stop_nobody(spark):
    texts = ["Left: 99999999999, 3", "Top: 1-2000000000, 5-7, 9", "Right: 3-1", "Bottom: 10000, 9999", "x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r.l for r in frame.select("i", responses.layout_intended(F.col("text")).alias("l")).orderBy("i").collect()]
    assert [[list(s.pins) for s in l.sections] for l in got] == [[[3]], [[5, 6, 7, 9]], [[3, 2, 1]], [[9999]], []]
    assert [l.left_out for l in got] == [1, 1, 0, 1, 0]


def test_rules_of_the_caller(spark):
    page = [(1, "d", 1, 2, 612.0, 792.0, "Anschlussbelegung\nStift eins Stift zwei")]
    frame = spark.createDataFrame(page, "doc_id int, doc string, page_number int, total_pages int, width double, height double, text string")
    tables = spark.createDataFrame([(1, 0, [["Stift", "Zweck"], ["1", "x"]])], "doc_id int, table_index int, cells array<array<string>>")
    none = spark.createDataFrame([], "doc_id int, image_index int, width double, height double")
    own = rules.PageRules(headings=["anschlussbelegung"], tables=["stift", "zweck"], keywords=["stift"])
    row = pages.score(frame, tables, none, rule_set=own).first()
    assert (row.heading_score, row.table_score, row.keyword_score) == (3, 4, 2)
    assert pages.score(frame, tables, none).first().score == 1


def test_pins_in_place_are_those_of_the_join(spark):
    """Places reckoned from numbers are those that a join with all positions finds, sections that repeat pins among them."""
    kinds = ["DIP", "SOIC-16", "LQFP64", "QFN", "BGA", "odd"]
    parts = spark.createDataFrame([(i, kinds[i % 6], n, i % 4) for i, n in enumerate([0, 1, 2, 7, 8, 9, 16, 38, 40, 64, 100, 3] * 2)], "comp_id int, pkg string, count int, k int")
    section = lambda name, *pins: F.struct(F.lit(name).alias("section"), F.array(*map(F.lit, pins)).cast("array<int>").alias("pins"))
    some = F.when(F.col("k") == 1, F.array(section("left", 1, 2, 2), section("Top", 2, 9), section("right"), section("bottom", 5, 2, 7))).when(F.col("k") == 2, F.array().cast("array<struct<section:string,pins:array<int>>>"))
    sized = layout.parameters(parts, "pkg", "count").withColumn("sections", some)
    numbers = spark.createDataFrame([(n,) for n in [*range(-1, 70), 101, 2**63 - 1, -(2**63), 1, 2]], "number long")
    pins_ = parts.select("comp_id").crossJoin(numbers).withColumn("name", F.concat(F.lit("P"), "number"))
    columns = ["comp_id", "pin_number", "name", "pin_index", "kind", "x", "y", "side", "rotation", "text_x", "text_y", "text_halign", "num_x", "num_y", "num_halign"]
    key = lambda frame: sorted(map(tuple, frame.select(*columns).collect()))
    got = key(layout.pins_of(pins_, sized.drop("sections")))
    assert got and got == key(layout.placed_pins(pins_, layout.positions(sized)))
    beside = layout.in_place(pins_.join(sized, "comp_id"), "sections")
    assert key(beside) == key(layout.placed_pins(pins_, layout.laid_out(sized), repeated=True))


def test_words_that_are_not_there_are_not_replaced(spark):
    texts = spark.createDataFrame([("aüaü üü",), ("",), (None,), ("aaa",)], "t string")
    assert [r.n for r in texts.select(T.occurrences(F.col("t"), "ü").alias("n")).collect()] == [4, 0, None, 0]
    assert [r.n for r in texts.select(T.occurrences(F.col("t"), "aa").alias("n")).collect()] == [0, 0, None, 1]
    assert "case when not contains" in texts.select(T.occurrences(F.col("t"), "ü"))._jdf.queryExecution().analyzed().toString().lower()
