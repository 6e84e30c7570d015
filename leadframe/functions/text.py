"""Column functions for ordered rules over text. All run in the JVM; patterns are meant for lower-cased text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first pattern of the list that occurs in the text, or null."""
    return F.coalesce(F.lit(None).cast("string"), *(F.when(text.rlike(p), F.lit(p)) for p in patterns))


def first_contained(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The value beside the first key that the text contains, or null."""
    return F.coalesce(F.lit(None).cast("string"), *(F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in pairs))


def any_contained(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def contained(text: Column, words: list[str]) -> Column:
    """Array of the words that the text contains, in the order of the list."""
    return F.filter(F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words)), lambda x: x.isNotNull())


def count_contained(text: Column, words: list[str]) -> Column:
    """How many entries of the list occur in the text; entries that repeat count each time."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words))


def count_matches(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in patterns))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word as plain text."""
    found = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))) / len(word.encode())
    return F.when(~F.contains(text, F.lit(word)), 0).otherwise(found.cast("int"))  # most words aren't there, and looking is cheap


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def first_lines(text: Column, n: int) -> Column:
    """The first lines in one string, parted by a character that is no white space, so no pattern reaches over a line."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\x01")


def cells_text(row: Column, null: str) -> Column:
    """Cells of a table's row joined by spaces."""
    return F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(null))), " ")


def unfenced(text: Column) -> Column:
    """Without a leading ```json, then a leading ```, then a trailing ```, and stripped."""
    out = F.regexp_replace(strip(text), r"^```json", "")
    return strip(F.regexp_replace(F.regexp_replace(out, r"^```", ""), r"```\z", ""))


def unfenced_text(text: str) -> str:
    """`unfenced` of a Python string."""
    text = text.strip(BLANKS).removeprefix("```json").removeprefix("```")
    return text.removesuffix("```").strip(BLANKS)


def layout_text(response: Column) -> Column:
    """What a layout model described: the text under `description` without fences, or the response as it is if it isn't
    JSON with such a text; null for a failed call."""
    described = F.try_variant_get(F.try_parse_json(response), "$.description", "variant")
    text = F.when(F.schema_of_variant(described) == "STRING", F.try_variant_get(described, "$", "string"))
    return F.coalesce(unfenced(text), response)


def part_number(file_name: Column) -> Column:
    """The leading capitals, digits and hyphens of a file name without its extension, or null."""
    base = F.regexp_replace(file_name, r"(?<=[^.])\.[^.]*\z", "")
    return F.nullif(F.regexp_extract(base, r"\A[A-Z0-9-]+", 0), F.lit(""))
