"""Geometry of packages and positions of pins.

Components come with comp_id, a package name and a pin count; positions are a row per component and pin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .packages import parsed


def geometry(df: DataFrame) -> DataFrame:
    schema = "type string, " + ", ".join(f"{c} double" for c in rules.GEOMETRY_COLUMNS)
    return df.sparkSession.createDataFrame(rules.GEOMETRY, schema)


def parameters(components: DataFrame, package: str, pins: str) -> DataFrame:
    """Components with their type and geometry. The joined side is the fixed table of five types."""
    kind = parsed(F.col(package))
    typed = components.withColumn("type", F.when(kind == "LQFP", "TQFP").otherwise(kind)).withColumn("n", F.col(pins).cast("int"))
    n = F.col("n")
    share = F.when(F.col("type").isin("DIP", "SOIC"), F.floor(n / 2)).when(F.col("type") == "BGA", F.floor(F.sqrt(n.cast("double")))).otherwise(F.floor(n / 4)).cast("int")
    sized = typed.join(F.broadcast(geometry(typed)), "type").withColumn("per_side", share)
    k, pitch = F.col("per_side"), F.col("pitch")
    width = F.when(F.col("type") == "DIP", F.lit(20.0)).when(F.col("type") == "SOIC", F.lit(5.0)).when(F.col("type") == "TQFP", 8.0 + k * pitch).when(F.col("type") == "QFN", 6.0 + k * pitch).otherwise((k - 1) * pitch + 4.0)
    sized = sized.withColumn("body_width", width)
    height = F.when(F.col("type") == "DIP", (k - 1) * pitch + 20.0).when(F.col("type") == "SOIC", (k - 1) * pitch + 8.0).otherwise(F.col("body_width"))
    return sized.withColumn("body_height", height)


def simple_position(index: Column) -> Column:
    """Struct (x, y, side) of a pin by its index alone, from a component's parameters; only DIP and TQFP have one."""
    w, h, top, pitch, k = (F.col(c) for c in ("body_width", "body_height", "top_margin", "pitch", "per_side"))
    at = lambda x, y, side: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(side).alias("side"))
    down = lambda i: (h / 2) - top - (i * pitch)
    up = lambda i: -(h / 2) + top + (i * pitch)
    dip = F.when(index < k, at(-w / 2, down(index), "left")).otherwise(at(w / 2, up(index - k), "right"))
    quad = (
        F.when(index < k, at(-w / 2, down(index), "left"))
        .when(index < k * 2, at(-(w / 2) + top + ((index - k) * pitch), -h / 2, "bottom"))
        .when(index < k * 3, at(w / 2, up(index - k * 2), "right"))
        .otherwise(at((w / 2) - top - ((index - k * 3) * pitch), h / 2, "top"))
    )
    return F.when(F.col("type") == "DIP", dip).when(F.col("type") == "TQFP", quad).otherwise(at(F.lit(0.0), F.lit(0.0), "left"))


def _at(x: Column, y: Column, side: str) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))


def _dressed(rows: DataFrame, inside: Column) -> DataFrame:
    """Rows with `at` (x, y, side) and the places of name and number, which lie along the pin's direction: inside of the
    body where `inside` holds, else outside."""
    return _with_places(rows, inside).select("comp_id", "kind", "pin_index", "pin_number", *PLACE)


#: What a position holds beside its component, kind, index and number.
PLACE = ["x", "y", "side", "rotation", "text_x", "text_y", "text_halign", "num_x", "num_y", "num_halign"]


def _with_places(rows: DataFrame, inside: Column) -> DataFrame:
    """`rows` with the columns of PLACE in the place of `at`."""
    x, y, side = F.col("at.x"), F.col("at.y"), F.col("at.side")
    outward = F.when(side.isin("left", "bottom"), -1.0).otherwise(1.0)
    ways = rows.select("*", x.alias("x"), y.alias("y"), side.alias("side"), F.when(inside, -outward).otherwise(outward).alias("way"), side.isin("left", "right").alias("across"))
    moved = lambda axis, offset, along: F.when(along, F.col(axis) + F.col("way") * F.col(offset)).otherwise(F.col(axis))
    halign = F.when(F.col("across"), F.col("side")).otherwise("center")
    rotation = F.when(F.col("side") == "left", 180.0).when(F.col("side") == "right", 0.0).when(F.col("side") == "top", 90.0).otherwise(270.0)
    across = F.col("across")
    values = {"rotation": rotation, "text_x": moved("x", "name_offset", across), "text_y": moved("y", "name_offset", ~across), "text_halign": halign, "num_x": moved("x", "num_offset", across), "num_y": moved("y", "num_offset", ~across), "num_halign": halign}
    return ways.withColumns(values).drop("at", "way", "across")


def _dip(i: Column) -> Column:
    w, h, top, pitch, k = (F.col(c) for c in ("body_width", "body_height", "top_margin", "pitch", "per_side"))
    y = lambda step: (h / 2) - top - (step * pitch)
    return F.when(i < k, _at(-w / 2, y(i), "left")).otherwise(_at(w / 2, y(k - 1 - (i - k)), "right"))


def _quad(i: Column, counter_clockwise: bool) -> Column:
    """Right and top run top to bottom and left to right as is customary here; counter-clockwise turns them round."""
    w, h, top, pitch, k = (F.col(c) for c in ("body_width", "body_height", "top_margin", "pitch", "per_side"))
    step = (lambda j: j) if counter_clockwise else (lambda j: k - 1 - j)
    return (
        F.when(i < k, _at(-w / 2, (h / 2) - top - (i * pitch), "left"))
        .when(i < 2 * k, _at(-(w / 2) + top + ((i - k) * pitch), -h / 2, "bottom"))
        .when(i < 3 * k, _at(w / 2, -(h / 2) + top + (step(i - 2 * k) * pitch), "right"))
        .otherwise(_at((w / 2) - top - (step(i - 3 * k) * pitch), h / 2, "top"))
    )


def _balls() -> Column:
    return F.least(F.col("n"), F.floor(F.col("body_width") + F.col("body_height")).cast("int") * 2)


def _bga(i: Column) -> Column:
    """Balls spread evenly round the edge, clockwise from the top left."""
    w, h = F.col("body_width"), F.col("body_height")
    way = F.try_divide(i * (2 * (w + h)), F.col("places").cast("double"))
    return (
        F.when(way < w, _at(-w / 2 + way, h / 2, "top"))
        .when(way < w + h, _at(w / 2, h / 2 - (way - w), "right"))
        .when(way < 2 * w + h, _at(w / 2 - (way - (w + h)), -h / 2, "bottom"))
        .otherwise(_at(-w / 2, -h / 2 + (way - (2 * w + h)), "left"))
    )


def layout_kind(kind: Column) -> Column:
    return F.when(kind.isin("TQFP", "QFN"), "quad").when(kind == "BGA", "bga").otherwise("dip")


def positions(components: DataFrame, counter_clockwise: bool = False) -> DataFrame:
    """Positions of all pins of components with parameters: comp_id, kind, pin_index, pin_number and the position.

    Pins beyond an even share of the sides have none."""
    rows = _laid(components).where("places > 0").withColumn("pin_index", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    rows = rows.withColumn("at", _place(F.col("pin_index"), counter_clockwise)).withColumn("pin_number", (F.col("pin_index") + 1).cast("string"))
    return _dressed(rows, _inside())


def _laid(components: DataFrame) -> DataFrame:
    """Components with their kind of layout and how many places it has."""
    kind = F.col("kind")
    n = F.when(kind == "dip", 2 * F.col("per_side")).when(kind == "quad", 4 * F.col("per_side")).otherwise(_balls())
    return components.withColumn("kind", layout_kind(F.col("type"))).withColumn("places", n)


def _place(i: Column, counter_clockwise: bool = False) -> Column:
    kind = F.col("kind")
    return F.when(kind == "dip", _dip(i)).when(kind == "quad", _quad(i, counter_clockwise)).otherwise(_bga(i))


def _inside() -> Column:
    return (F.col("kind") != "dip") & F.col("at.side").isin("left", "right")


def in_place(rows: DataFrame, sections: str | None = None, bare: Column | None = None) -> DataFrame:
    """`placed_pins` of rows that hold a pin (number, name) beside its component's parameters: a projection, without a join.

    The place is reckoned from the pin's number, so no positions are made that no pin has. Rows whose pin has no position go, but
    for those that are `bare` of a pin. With `sections`, the name of their column, components that have some are laid out by
    these: the last place that names the pin."""
    bare, number = F.lit(False) if bare is None else bare, F.col("number")
    rows = _laid(rows)
    of_package = (number >= 1) & (number <= F.col("places"))
    if sections is None:
        found = rows.where(of_package | bare).withColumn("pin_index", (number - 1).cast("int")).withColumn("at", _place(F.col("pin_index")))
        return _with_places(found.withColumn("pin_number", number.cast("string")), _inside())
    own = F.coalesce(F.size(sections) > 0, F.lit(False))
    whole = lambda pins: F.transform(pins, lambda p: p.cast("bigint"))
    last = lambda array, value: F.size(array) - F.array_position(F.reverse(array), value)  # noqa: E731, the size itself where there is none
    named = F.transform(sections, lambda s: F.coalesce(F.array_contains(whole(s["pins"]), number), F.lit(False)))
    rows = rows.withColumn("section_at", F.when(own, last(named, F.lit(True)).cast("int")))
    rows = rows.where(F.when(own, F.col("section_at") < F.size(sections)).otherwise(of_package) | bare)
    rows = rows.withColumn("s", F.get(sections, F.col("section_at")))
    rows = rows.withColumn("i", last(whole("s.pins"), number).cast("int"))
    custom = F.col("section_at").isNotNull()
    rows = rows.withColumns({"kind": F.when(custom, F.lit("custom")).otherwise(F.col("kind")), "pin_index": F.when(custom, _before(sections) + F.col("i")).otherwise((number - 1).cast("int"))})
    found = rows.withColumn("at", F.when(custom, _in_section(F.col("i"))).otherwise(_place(F.col("pin_index")))).withColumn("pin_number", number.cast("string"))
    return _with_places(found, _inside() & (F.col("kind") != "custom")).drop("section_at", "s", "i")


def section_side(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in rules.SIDE_WORDS), F.lit("left"))


def custom_positions(components: DataFrame, sections: str = "sections") -> DataFrame:
    """Positions from sections: array of (section, pins) in the order that matters. Each section starts its side anew."""
    rows = components.select("*", F.posexplode(sections).alias("section_at", "s")).select("*", F.posexplode("s.pins").alias("i", "pin"))
    return _dressed(rows.withColumns({"kind": F.lit("custom"), "pin_index": _before(sections) + F.col("i"), "pin_number": F.col("pin").cast("string"), "at": _in_section(F.col("i"))}), F.lit(False))


def _before(sections: str) -> Column:
    """How many pins lie in the sections before the one at `section_at`."""
    return F.aggregate(F.transform(F.slice(F.col(sections), F.lit(1), F.col("section_at")), lambda s: F.size(s["pins"])), F.lit(0), lambda a, b: a + b)


def _in_section(i: Column) -> Column:
    """The place of the pin `i` of the section `s`."""
    w, h, top, pitch = (F.col(c) for c in ("body_width", "body_height", "top_margin", "pitch"))
    side = section_side(F.col("s.section"))
    down, along = (h / 2) - top - (i * pitch), -(w / 2) + top + (i * pitch)
    return (
        F.when(side == "left", _at(-w / 2, down, "left"))
        .when(side == "right", _at(w / 2, down, "right"))
        .when(side == "bottom", _at(along, -h / 2, "bottom"))
        .otherwise(_at(along, h / 2, "top"))
    )


def laid_out(components: DataFrame, sections: str = "sections") -> DataFrame:
    """Custom positions where a component has sections, else those of its package."""
    own = F.coalesce(F.size(sections) > 0, F.lit(False))
    return custom_positions(components.where(own), sections).unionByName(positions(components.where(~own)))


def last_positions(places: DataFrame) -> DataFrame:
    """One position for each number of a component: the last, if sections name a pin twice."""
    rest = [c for c in places.columns if c not in ("comp_id", "pin_number")]
    newest = F.max_by(F.struct(*rest), "pin_index").alias("p")
    return places.groupBy("comp_id", "pin_number").agg(newest).select("comp_id", "pin_number", "p.*")


def builder_pins(pins: DataFrame) -> DataFrame:
    return pins.select("comp_id", F.col("number").cast("string").alias("pin_number"), "name")


def placed_pins(pins: DataFrame, places: DataFrame, repeated: bool = False) -> DataFrame:
    """Inner join of pins with positions by number; repeated pins stay, pins without a position go.

    Positions of packages have each number once. Custom sections may repeat one: `repeated` then keeps the last."""
    return builder_pins(pins).join(last_positions(places) if repeated else places, ["comp_id", "pin_number"])


def unplaced_pins(pins: DataFrame, places: DataFrame) -> DataFrame:
    return builder_pins(pins).join(places, ["comp_id", "pin_number"], "left_anti")


def pins_of(pins: DataFrame, components: DataFrame) -> DataFrame:
    """`placed_pins` with the parameters of the pins' components, from pins (comp_id, number, name): one shuffle of narrow pins,
    and their places are reckoned behind it. A task holds the components of its share, not the pins; pins aren't sorted."""
    own = components.drop(*(c for c in components.columns if c in ("number", "name")))
    return in_place(pins.select("comp_id", "number", "name").join(own.hint("shuffle_hash"), "comp_id"))
