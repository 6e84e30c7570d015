"""Prompts to models, and parsing of what they answer. Answers are JSON of any shape, read as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T

PIN_TYPE = "struct<number:bigint,name:string,function:string>"
FENCED = r"(?s)```(?:json)?\s*\n?(\{.*?\})\n?```"
OUTERMOST = r"(?s)\{.*\}"


PIN_SYSTEM, PIN_ASK = "You read pin tables of component datasheets.", "List the component's name, its package and every pin as JSON.\n"
PART_BEFORE, PART_AFTER = "Only the variant of part ", " counts.\n"
VERIFY_SYSTEM, VERIFY_ASK = "You judge pages of component datasheets.", "Does this page list or draw a component's pins? Answer YES or NO first.\n\n"
VISION_ASK, TARGET = "Read the pin diagram and return its pins as JSON.", "\n\nTarget component: "
LAYOUT_ASK = (
    "Describe how the pins lie in this drawing.\nBegin with two lines, `Package Type: <type>` and `Pin Count: <number>`. "
    "Then write a line for each side, in the order in which its pins follow each other: `Left Side: 1, 2, 3`, `Bottom Edge: 4-6`, and so on. "
    "Write nothing else, and leave out sides without pins."
)

#: Layouts name no pin beyond this number; larger numbers and ranges up to them are left out and counted.
MOST_PINS = 9999


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def pin_prompt(content: Column, part: Column | None = None) -> Column:
    """Two messages that ask for a component's pins as JSON."""
    ask = F.concat(F.lit(PIN_ASK), F.coalesce(F.concat(F.lit(PART_BEFORE), part, F.lit(PART_AFTER)), F.lit("")) if part is not None else F.lit(""), F.lit("\n"), content)
    return F.array(message("system", F.lit(PIN_SYSTEM)), message("user", ask))


def verification_prompt(content: Column) -> Column:
    return F.array(message("system", F.lit(VERIFY_SYSTEM)), message("user", F.concat(F.lit(VERIFY_ASK), content)))


def sample_prompt(numbers: Column, contents: Column) -> Column:
    """One prompt over sample pages; the longer of the two lists is cut to the shorter."""
    n = F.least(F.size(numbers), F.size(contents))
    pairs = F.arrays_zip(F.slice(numbers, F.lit(1), n).alias("number"), F.slice(contents, F.lit(1), n).alias("content"))
    samples = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("--- Page "), p["number"].cast("string"), F.lit(" ---\n"), p["content"])), "\n\n")
    return F.array(message("system", F.lit("You look for where datasheets list pins.")), message("user", F.concat(F.lit("Sample pages:\n"), samples)))


def sample_analysis(answer: Column) -> Column:
    """The answer as it is, null if the call failed; the recommendation never changes."""
    return F.struct(answer.alias("analysis"), F.lit("use_all_candidates").alias("recommendation"))


def vision_prompt(part: Column, custom: Column | None = None) -> Column:
    """The request beside an image; a caller's own wording, where it isn't null, takes the place of all of it."""
    own = F.concat(F.lit(VISION_ASK), F.coalesce(F.concat(F.lit(TARGET), F.nullif(part, F.lit(""))), F.lit("")))
    return own if custom is None else F.coalesce(custom, own)


def layout_prompt(custom: Column | None = None) -> Column:
    """The request beside a picture of a page, whose answer `layout_intended` can read; a caller's own wording, where it isn't
    null, takes its place."""
    own = F.lit(LAYOUT_ASK)
    return own if custom is None else F.coalesce(custom, own)


def says_yes(answer: Column) -> Column:
    """Yes unless the answer begins with NO; a failed call (null) counts as yes."""
    up = T.strip(F.upper(answer))
    return F.coalesce(F.startswith(up, F.lit("YES")) | ~F.startswith(up, F.lit("NO")), F.lit(True))


def _kind(v: Column) -> Column:
    """Variant's type; null where the path is missing, VOID where it is null."""
    return F.schema_of_variant(v)


def _at(v: Column, path: str, as_: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", as_)


def pin_number(v: Column) -> Column:
    """A string's first digits, or 0 without any; numbers are cut to whole ones. Null, which makes the record's pins
    unusable, for anything else and for numbers that a bigint can't hold: none is replaced by another."""
    kind = _kind(v)
    digits = F.regexp_extract(F.try_variant_get(v, "$", "string"), r"\d+", 0)
    from_text = F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint"))
    double = F.try_variant_get(v, "$", "double")
    from_double = F.when(F.abs(double) < 2.0**63, (F.floor(F.abs(double)) * F.signum(double)).try_cast("bigint"))
    decimal = F.try_variant_get(v, "$", "decimal(38,9)")
    from_decimal = F.when(decimal < 0, -F.floor(-decimal)).otherwise(F.floor(decimal)).try_cast("bigint")
    return (
        F.when(kind == "STRING", from_text)
        .when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when(kind.rlike("^DECIMAL"), from_decimal)
        .when(kind.isin("DOUBLE", "FLOAT"), from_double)
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
    )


def parsed_pins(responses: DataFrame, response: str = "response") -> DataFrame:
    """Responses with component_name, package, pins, extraction_method and error.

    Defaults stand in for missing keys; a key that is null stays null. Whatever makes a record unusable sets `error`, and
    the other columns are null then."""
    data = responses.withColumn("_d", F.try_parse_json(T.unfenced(F.col(response))))
    d = F.col("_d")
    data = data.withColumns({"_p": _at(d, "package"), "_pins": F.when(_kind(_at(d, "pins")).rlike("^ARRAY"), _at(d, "pins", "array<variant>"))})
    p, pins = F.col("_p"), F.col("_pins")
    missing = lambda v, given, default: F.when(_kind(v).isNull(), default).otherwise(given)
    size = lambda side: F.when(_kind(_at(p, side)).isNull() | (_kind(_at(p, side)) == "VOID"), F.lit(0.0)).otherwise(_at(p, side, "double"))
    pin = F.transform(pins, lambda x: F.struct(pin_number(_at(x, "number")).alias("number"), missing(_at(x, "name"), _at(x, "name", "string"), F.lit("")).alias("name"), _at(x, "function", "string").alias("function")))
    pin = F.when(_kind(_at(d, "pins")).isNull(), F.array().cast(f"array<{PIN_TYPE}>")).otherwise(pin)
    data = data.withColumns({"_w": size("width"), "_h": size("height"), "_list": pin})
    error = (
        F.when(d.isNull(), "not JSON")
        .when(~_kind(d).rlike("^OBJECT"), "not an object")
        .when(_kind(p).isNotNull() & ~_kind(p).rlike("^OBJECT"), "package")
        .when(F.col("_w").isNull() | F.col("_h").isNull(), "dimensions")
        .when(F.col("_list").isNull() | F.exists("_list", lambda x: x["number"].isNull()), "pins")
    )
    data = data.withColumn("error", error)
    ok = lambda c: F.when(F.col("error").isNull(), c)
    package = F.struct(
        missing(_at(p, "type"), _at(p, "type", "string"), F.lit("Unknown")).alias("type"),
        missing(_at(p, "pin_count"), _at(p, "pin_count", "int"), F.lit(0)).alias("pin_count"),
        F.col("_w").alias("width"),
        F.col("_h").alias("height"),
        _at(p, "pitch", "double").alias("pitch"),
        _at(p, "thickness", "double").alias("thickness"),
    )
    named = lambda key: ok(missing(_at(d, key), _at(d, key, "string"), F.lit("Unknown")))
    record = {"component_name": named("component_name"), "package": ok(package), "pins": ok(F.col("_list")), "extraction_method": named("extraction_method"), "error": F.col("error")}
    # Exploding one record keeps the optimizer from copying the parser into every use of a field.
    once = F.explode(F.array(F.struct(*(c.alias(k) for k, c in record.items())))).alias("_r")
    return data.select(*(F.col(f"`{c}`") for c in responses.columns if c not in record), once).select("*", "_r.*").drop("_r")


def _json_in(text: Column) -> Column:
    """A fenced object, else what lies between the first and the last brace; null without either."""
    return F.coalesce(F.nullif(F.regexp_extract(text, FENCED, 1), F.lit("")), F.nullif(F.regexp_extract(text, OUTERMOST, 0), F.lit("")))


def vision_answer(response: Column) -> Column:
    """The variant that holds the result, or null if nothing usable is there.

    An object under `description`; JSON in its text; JSON in `raw_text`; the response itself. A text without any braces
    ends the search, as does one of another type under raw_text."""
    r = F.try_parse_json(response)
    described, raw = _at(r, "description"), _at(r, "raw_text")
    text = F.when(_kind(described) == "STRING", _json_in(_at(r, "description", "string")))
    raw_text = F.when(_kind(raw) == "STRING", F.coalesce(_json_in(_at(r, "raw_text", "string")), text))
    itself = F.when(_kind(_at(r, "component_name")).isNotNull() | _kind(_at(r, "package_type")).isNotNull(), r)
    none = F.lit(None).cast("variant")
    from_raw = F.when(_kind(raw).isNull(), itself).when(raw_text.isNull(), none).otherwise(F.coalesce(F.try_parse_json(raw_text), itself))
    return F.when(_kind(described).rlike("^OBJECT"), described).when((_kind(described) == "STRING") & text.isNull(), none).when(F.try_parse_json(text).isNotNull(), F.try_parse_json(text)).otherwise(from_raw)


def vision_results(responses: DataFrame, response: str = "response") -> DataFrame:
    """Responses with component_name, package_type, pin_count, pins (JSON text), confidence and notes; what can't be
    read gives an empty result with confidence 0 and a note."""
    found = responses.withColumn("_v", vision_answer(F.col(response)))
    v = F.col("_v")
    get = lambda key, as_, default: F.when(_kind(_at(v, key)).isNull(), F.lit(default)).otherwise(_at(v, key, as_))
    note = F.when(v.isNull(), "no usable data in the response").otherwise(get("notes", "string", ""))
    pins = F.coalesce(F.to_json(_at(v, "pins")), F.lit("[]"))
    return found.withColumns({"component_name": get("component_name", "string", ""), "package_type": get("package_type", "string", ""), "pin_count": get("pin_count", "int", 0), "pins": pins, "confidence": get("extraction_confidence", "double", 0.0), "notes": note}).drop("_v")


def best_of(results: DataFrame, by: str = "doc", order: str = "ord", default_note: str = "no usable data in the response") -> DataFrame:
    """The most confident result of each document, the first of equals; none over zero gives the empty result.

    A minimum of structs finds it with partial aggregation, where a window would gather the document's rows."""
    rest = [c for c in results.columns if c not in (by, order, "confidence")]
    best = F.min(F.when(F.col("confidence") > 0, F.struct((-F.col("confidence")).alias("c"), order, *rest))).alias("b")
    picked = results.groupBy(by).agg(best)
    values = [F.coalesce(F.col(f"b.{c}"), F.lit("")).alias(c) if dict(results.dtypes)[c] == "string" else F.col(f"b.{c}").alias(c) for c in rest]
    return picked.select(by, F.col(f"b.{order}").alias(order), F.coalesce(-F.col("b.c"), F.lit(0.0)).alias("confidence"), *values, F.when(F.col("b").isNull(), default_note).otherwise("").alias("note"))


def layout_as_coded(text: Column) -> Column:
    """Struct (package_type, pin_count, sections) as the established parser finds them: its package words never match
    lower-cased text, its count knows no colon, and its section patterns leave no pins."""
    count = F.nullif(F.regexp_extract(F.lower(text), r"pin count\s*(\d+)", 1), F.lit("")).try_cast("int")
    return F.struct(F.lit("Unknown").alias("package_type"), F.coalesce(count, F.lit(0)).alias("pin_count"), F.array().cast("array<struct<section:string,pins:array<int>>>").alias("sections"))


def layout_intended(text: Column) -> Column:
    """The same as it is meant: package words in any case, a colon before the count, sections "name: numbers" with ranges.

    Numbers over MOST_PINS are no pins; they are left out, with the ranges they begin or end, and counted in `left_out`."""
    low = F.lower(text)
    package = F.coalesce(*(F.when(F.contains(low, F.lit(word.lower())), F.lit(kind)) for kind, words in rules.LAYOUT_PACKAGES for word in words), F.lit("Unknown"))
    count = F.nullif(F.regexp_extract(low, r"pin count\s*:?\s*(\d+)", 1), F.lit("")).try_cast("int")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[A-Za-z][A-Za-z _-]*:.*\d") & ~F.lower(x).rlike(r"^\s*(package type|pin count)\s*:"))

    as_pin = lambda digits: F.when(F.length(digits) <= 9, digits.try_cast("int"))
    sane = lambda n: n.isNotNull() & (n <= MOST_PINS)
    ends = lambda piece: [as_pin(F.regexp_extract(piece, r"(\d+)\s*-\s*(\d+)", k)) for k in (1, 2)]
    is_range = lambda piece: piece.rlike(r"\d+\s*-\s*\d+")
    nothing = F.array().cast("array<int>")

    def numbers(listed: Column) -> Column:
        span = lambda piece: F.when(sane(ends(piece)[0]) & sane(ends(piece)[1]), F.sequence(*ends(piece))).otherwise(nothing)
        single = lambda piece: F.filter(F.transform(F.regexp_extract_all(piece, F.lit(r"\d+"), F.lit(0)), as_pin), sane)
        return F.array_distinct(F.flatten(F.transform(F.split(listed, ","), lambda piece: F.when(is_range(piece), span(piece)).otherwise(single(piece)))))

    def beyond(listed: Column) -> Column:
        every = F.transform(F.regexp_extract_all(listed, F.lit(r"\d+"), F.lit(0)), as_pin)
        return F.size(F.filter(every, lambda n: ~sane(n)))

    rest = lambda line: F.regexp_replace(line, r"^[^:]*:", "")
    section = F.transform(lines, lambda x: F.struct(T.strip(F.substring_index(x, ":", 1)).alias("section"), numbers(rest(x)).alias("pins")))
    left_out = F.aggregate(F.transform(lines, lambda x: beyond(rest(x))), F.lit(0), lambda a, b: a + b)
    return F.struct(package.alias("package_type"), F.coalesce(count, F.lit(0)).alias("pin_count"), section.alias("sections"), left_out.alias("left_out"))


def known_pinouts(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(rules.KNOWN_PINOUTS)], "known_at int, known string, known_pins int, names array<string>")


def checked(components: DataFrame, pins: DataFrame) -> DataFrame:
    """(comp_id, known, valid, issues): components against known pinouts; valid is null where none is known.

    The joined side is the fixed table of known parts; names are compared by anti-join."""
    known = F.broadcast(known_pinouts(components))
    match = components.join(known, F.contains(F.lower("component_name"), F.lower("known")), "left")
    first = match.groupBy("comp_id", "pin_count").agg(F.min(F.struct("known_at", "known", "known_pins", "names")).alias("k")).select("comp_id", "pin_count", F.when(F.col("k.known_at").isNotNull(), F.col("k")).alias("k"))
    wanted = first.where("k is not null").select("comp_id", F.posexplode("k.names").alias("at", "name"))
    missing = wanted.join(pins.select("comp_id", "name"), ["comp_id", "name"], "left_anti").groupBy("comp_id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("missing"))
    joined = first.join(missing, "comp_id", "left")
    count = F.when(F.col("pin_count") != F.col("k.known_pins"), F.concat(F.lit("pins "), F.col("pin_count").cast("string"), F.lit(" not "), F.col("k.known_pins").cast("string")))
    lacks = F.transform(F.coalesce("missing", F.array().cast("array<struct<at:int,name:string>>")), lambda m: F.concat(F.lit("missing "), m["name"]))
    issues = F.when(F.col("k").isNull(), F.array(F.lit("not known"))).otherwise(F.concat(F.filter(F.array(count), lambda x: x.isNotNull()), lacks))
    return joined.select("comp_id", F.col("k.known").alias("known"), F.when(F.col("k").isNotNull(), F.size(issues) == 0).alias("valid"), F.array_join(issues, "; ").alias("issues"))


def cache_misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests that the cache has no answer for."""
    return requests.join(cache, key, "left_anti")
