"""Drawing primitives of placed components, and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = ["comp_id", "part", "name", "shape", "x", "y", "width", "height", "depth", "label", "size", "halign"]
NAME_LENGTH = 30


def _entry(part: str, name: Column | str, shape: str, x, y, width=None, height=None, depth=None, label=None, size=None, halign=None) -> Column:
    number = lambda v: (F.lit(v) if not isinstance(v, Column) else v).cast("double")
    words = lambda v: (F.lit(v) if not isinstance(v, Column) else v).cast("string")
    values = [words(part), words(name), words(shape), number(x), number(y), number(width), number(height), number(depth), words(label), number(size), words(halign)]
    return F.struct(*(v.alias(n) for v, n in zip(values, ROW[1:])))


def _rows(df: DataFrame, entries: Column) -> DataFrame:
    return df.select("comp_id", F.explode(entries).alias("e")).select("comp_id", "e.*")


def _borders() -> Column:
    w, h, thick, depth = (F.col(c) for c in ("body_width", "body_height", "border_thickness", "border_height"))
    side = lambda name, x, y, dx, dy: _entry("BodyLine", f"BodyLine_{name}", "box", x, y, dx, dy, depth)
    zero = F.lit(0.0)
    return F.array(side("Top", zero, h / 2, w, thick), side("Bottom", zero, -h / 2, w, thick), side("Left", -w / 2, zero, thick, h), side("Right", w / 2, zero, thick, h))


def borders(components: DataFrame) -> DataFrame:
    return _rows(components, _borders())


SIZES = ["leg_length", "leg_width", "leg_thickness", "name_size", "name_height", "num_size", "num_height"]


def pin_primitives(placed: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """A leg, the name if there is one, and the number of each placed pin: two or three rows. Pins that don't carry the sizes
    of their component (see `layout.pins_of`) get them from `components`."""
    if components is not None:
        placed = placed.join(components.select("comp_id", *SIZES), "comp_id")
    return _rows(placed, _pin_entries())


def _pin_entries() -> Column:
    number, name = F.col("pin_number"), F.col("name")
    leg = _entry("Legs", F.concat(number, F.lit("_leg")), "box", F.col("x"), F.col("y"), F.col("leg_length"), F.col("leg_width"), F.col("leg_thickness"))
    text = F.when(F.coalesce(name, F.lit("")) != "", _entry("Legs", F.concat(number, F.lit("_text")), "text", F.col("text_x"), F.col("text_y"), depth=F.col("name_height"), label=F.substring(name, 1, NAME_LENGTH), size=F.col("name_size"), halign=F.col("text_halign")))
    num = _entry("Legs", F.concat(number, F.lit("_num")), "text", F.col("num_x"), F.col("num_y"), depth=F.col("num_height"), label=number, size=F.col("num_size"), halign=F.col("num_halign"))
    return F.filter(F.array(leg, text, num), lambda e: e.isNotNull())


def _labels(name: str) -> Column:
    above = lambda offset: F.col("body_height") / 2 + F.col(offset)
    designator = _entry("DesignatorName", "DesignatorName", "text", F.lit(0.0), above("designator_offset"), depth=F.lit(0.5), label="U", size=F.col("designator_size"))
    value = _entry("PackageValue", "PackageValue", "text", F.lit(0.0), above("value_offset"), depth=F.lit(0.5), label=F.substring(name, 1, NAME_LENGTH), size=F.col("value_size"))
    return F.array(designator, value)


def labels(components: DataFrame, name: str = "component_name") -> DataFrame:
    return _rows(components, _labels(name))


def own_primitives(components: DataFrame) -> DataFrame:
    """The primitives of each component that aren't its pins': borders and labels."""
    return _rows(components, F.concat(_borders(), _labels("component_name")))


def assembly(components: DataFrame, placed: DataFrame) -> DataFrame:
    """All primitives of each component: those of its own, and those of its pins."""
    return own_primitives(components).unionByName(pin_primitives(placed, None if SIZES[0] in placed.columns else components))


def drawn(rows: DataFrame, bare: Column) -> DataFrame:
    """`assembly` of placed pins beside their component's parameters, and a row that is `bare` of a pin for each component."""
    own = F.concat(_borders(), _labels("component_name"))
    return _rows(rows, F.when(bare, own).otherwise(_pin_entries()))


def report(component: Column, package: Column, pins: Column) -> Column:
    """Text of a component: a head between rules, then a line for each pin."""
    shown = lambda c, missing: F.coalesce(c.cast("string"), F.lit(missing))
    rule = F.lit("=" * 70)
    head = [
        rule,
        F.concat(F.lit("Component: "), shown(component, "None")),
        F.concat(F.lit("Package: "), shown(package["type"], "None"), F.lit("-"), shown(package["pin_count"], "None")),
        F.concat(F.lit("Dimensions: "), shown(package["width"], "None"), F.lit("mm x "), shown(package["height"], "None"), F.lit("mm")),
        F.concat(F.lit("Pitch: "), shown(package["pitch"], "None")),
        rule,
        F.lit(""),
        F.concat(F.lit("Total Pins: "), F.size(pins).cast("string")),
        F.lit(""),
    ]
    function = lambda p: F.when(F.coalesce(p["function"], F.lit("")) != "", F.concat(F.lit(" ("), p["function"], F.lit(")"))).otherwise("")
    lines = F.transform(pins, lambda p: F.concat(F.lit("Pin "), shown(p["number"], "None"), F.lit(": "), shown(p["name"], "None"), function(p)))
    return F.array_join(F.concat(F.array(*head), lines), "\n")
