"""Assembling and filtering the content of relevant pages.

Content is a row per document: doc, pages (best first), text_content, tables (array of page and cells), images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..session import durable

# The wording of content as prompt text.
PAGES_LINE, INFORMATION_LINE, TABLES_LINE, NOTE_LINE = "Relevant pages: ", "--- Pinout Information ---\n", "--- Pinout Tables ---\n", "--- Note ---\n"
TABLE_TITLE, TRUNCATED = "\nTable from page ", "| ... (truncated)"
IMAGES_BEFORE, IMAGES_AFTER = "This content includes ", " diagram image(s). Use these for visual reference of pinout diagrams."

TABLE_TYPE = "array<struct<page:int,table_index:int,cells:array<array<string>>>>"
IMAGE_TYPE = "array<struct<page:int,image_index:int>>"


def marked(page: Column, text: Column) -> Column:
    return F.concat(F.lit("--- Page "), page.cast("string"), F.lit(" ---\n"), T.text_or_empty(text))


def single_page(pages: DataFrame, page_number: int) -> DataFrame:
    """The text of one page of each document; pages are numbered from 1."""
    return pages.where(F.col("page_number") == page_number).select("doc", "page_number", T.text_or_empty(F.col("text")).alias("text"))


def kept_tables(tables: DataFrame) -> DataFrame:
    """Tables with a header and a row at least."""
    return tables.where(F.size("cells") >= 2)


def _page_order(candidates: DataFrame) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "page_number"))), lambda p: p["page_number"])


def _joined_pages() -> Column:
    """A document's text from its pages (page_number, text), in an aggregate."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: F.concat(marked(p["page_number"], p["text"]), F.lit("\n\n"))), "")


def extracted(candidates: DataFrame, texts: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """Raw content of candidates (doc, doc_id, page_number, score, has_table, has_diagram) from the pages' texts (doc_id, text).

    Candidates are used several times, so they are best written down. Tables and images are taken of pages with those flags
    only, and are grouped apart from the text."""
    said = candidates.select("doc", "doc_id", "page_number", "score").join(texts.select("doc_id", "text"), "doc_id")
    content = said.groupBy("doc").agg(_page_order(said).alias("pages"), _joined_pages().alias("text_content"))

    own_tables, own_images = _gated(candidates, tables, images)
    return _complete(content.join(own_tables, "doc", "left").join(own_images, "doc", "left"))


def _gated(candidates: DataFrame, tables: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, tables) and (doc, images) of the candidates with the flags for them."""

    def of(side: DataFrame, flag: str, entry: Column, name: str) -> DataFrame:
        flagged = candidates.where(flag).select("doc", "doc_id", "page_number")
        return side.drop("doc", "page_number").join(flagged, "doc_id").groupBy("doc").agg(F.array_sort(F.collect_list(entry)).alias(name))

    own_tables = of(kept_tables(tables), "has_table", F.struct(F.col("page_number").alias("page"), "table_index", "cells"), "tables")
    return own_tables, of(images, "has_diagram", F.struct(F.col("page_number").alias("page"), "image_index"), "images")


def _complete(content: DataFrame) -> DataFrame:
    return content.withColumns({"tables": F.coalesce("tables", F.array().cast(TABLE_TYPE)), "images": F.coalesce("images", F.array().cast(IMAGE_TYPE))})


def is_pin_table(cells: Column) -> Column:
    """Two or more entries of the keyword list in the header; a null cell reads as "None"."""
    header = F.lower(T.cells_text(cells[0], "None"))
    return F.coalesce((F.size(cells) > 0) & (T.count_contained(header, rules.TABLE_KEYWORDS) >= 2), F.lit(False))


def is_candidate_table(cells: Column) -> Column:
    header = F.lower(T.cells_text(cells[0], "None"))
    return F.coalesce((F.size(cells) > 0) & T.any_contained(header, rules.CANDIDATE_TABLE_WORDS), F.lit(False))


def is_pin_section(text: Column) -> Column:
    return F.coalesce((text != "") & T.let(F.lower(text), _about_pins), F.lit(False))


def _about_pins(low: Column) -> Column:
    excluded = F.lit(False)
    for phrase in rules.EXCLUSIONS:
        excluded = excluded | F.contains(low, F.lit(f" {phrase} ")) | F.endswith(low, F.lit(phrase))
    return T.any_contained(low, rules.STRONG_PHRASES) | (T.any_contained(low, rules.SECTION_KEYWORDS) & ~excluded) | low.rlike(rules.DIAGRAM_LINE)


def has_strong_heading(text: Column) -> Column:
    return F.coalesce(T.let(F.lower(text), lambda low: T.any_contained(low, rules.STRONG_HEADINGS)), F.lit(False))


def pin_tables(tables: Column) -> Column:
    return F.filter(tables, lambda t: is_pin_table(t["cells"]))


def blocks(text: Column) -> Column:
    """Array of (page, text) between page markers. Text before the first marker, blocks without a line and blocks whose
    marker has no number are left out. The whole text is in one row, so no shuffle is needed."""
    is_marker = lambda line: F.startswith(T.strip(line), F.lit("--- Page"))
    number = lambda line: T.strip(F.replace(F.replace(T.strip(line), F.lit("--- Page"), F.lit("")), F.lit("---"), F.lit("")))

    def between(lines: Column, markers: Column) -> Column:
        ends = F.concat(F.slice(F.transform(markers, lambda x: x["at"]), 2, F.greatest(F.size(markers), F.lit(1))), F.array(F.size(lines) + 1))
        spans = F.zip_with(markers, F.when(F.size(markers) > 0, ends).otherwise(F.array().cast("array<int>")), lambda m, e: F.struct(number(m["line"]).try_cast("int").alias("page"), m["at"].alias("from_"), e.alias("to_")))
        return F.transform(
            F.filter(spans, lambda s: s["page"].isNotNull() & (s["to_"] - s["from_"] > 1)),
            lambda s: F.struct(s["page"].alias("page"), F.array_join(F.slice(lines, s["from_"] + 1, s["to_"] - s["from_"] - 1), "\n").alias("text")),
        )

    def marks(lines: Column) -> Column:
        numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), (i + 1).alias("at")))
        return F.filter(numbered, lambda x: is_marker(x["line"]))

    cut = T.let(F.split(text, "\n"), lambda lines: T.let(marks(lines), lambda markers: between(lines, markers)))
    return F.coalesce(cut, F.array().cast("array<struct<page:int,text:string>>"))


def kept_blocks(text_blocks: Column, table_pages: Column) -> Column:
    """Blocks of pages with a pin table, of pin sections, and with strong headings."""
    return F.filter(text_blocks, lambda b: F.array_contains(table_pages, b["page"]) | is_pin_section(b["text"]) | has_strong_heading(b["text"]))


def reassembled(text_blocks: Column) -> Column:
    return F.array_join(F.transform(text_blocks, lambda b: marked(b["page"], b["text"])), "\n\n")


def filtered(content: DataFrame) -> DataFrame:
    """Content without what isn't about pins. The list of pages stays as it was, and so do the images."""
    tables = content.withColumn("tables", pin_tables(F.col("tables")))
    pages = F.array_distinct(F.transform("tables", lambda t: t["page"]))
    # The pages once, or they would be looked for again at each block.
    return tables.withColumn("text_content", T.let(pages, lambda p: reassembled(kept_blocks(blocks(F.col("text_content")), p))))


def page_blocks(pages: DataFrame) -> DataFrame:
    """(doc, page_number, pos, page, text): the blocks of each page (doc, page_number, text, last), cut where the page lies.

    A block is the same as if the pages' texts were joined before: each but the `last` of a document has the next one's marker
    where its own second line break ends."""
    cut = pages.select("doc", "page_number", blocks(F.concat(marked(F.col("page_number"), F.col("text")), F.when(F.col("last"), "\n\n").otherwise("\n"))).alias("cut"))
    return cut.select("doc", "page_number", F.posexplode("cut").alias("pos", "b")).select("doc", "page_number", "pos", F.col("b.page").alias("page"), F.col("b.text").alias("text"))


def _kept(cut: DataFrame, pin_pages: DataFrame) -> DataFrame:
    """Of the blocks (doc, page_number, pos, page, text) those of pages with a pin table (doc, page), of pin sections, and with
    strong headings. Each block is judged by itself, however many a document has."""
    about = T.let(F.lower("text"), lambda low: ((low != "") & _about_pins(low)) | T.any_contained(low, rules.STRONG_HEADINGS))
    judged = cut.withColumn("keep", F.coalesce(about, F.lit(False))).join(pin_pages.select("doc", "page", F.lit(True).alias("has_pins")), ["doc", "page"], "left")
    return judged.where(F.col("keep") | F.coalesce("has_pins", F.lit(False))).select("doc", "page_number", "pos", "page", "text")


def _put_together(kept: DataFrame) -> DataFrame:
    parts = kept.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page_number", "pos", "page", "text"))).alias("kept"))
    return parts.select("doc", reassembled(F.col("kept")).alias("text_content"))


def _heads(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("doc").agg(_page_order(candidates).alias("pages"), F.max("page_number").alias("last_page"))


def _with_text(candidates: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    said = candidates.select("doc", "doc_id", "page_number").join(heads.select("doc", "last_page"), "doc").join(texts.select("doc_id", "text"), "doc_id")
    return said.withColumn("last", F.col("page_number") == F.col("last_page"))


def filtered_pages(candidates: DataFrame, texts: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """`filtered(extracted(...))`, but blocks are judged page by page, and only those that are kept are gathered.

    What a document's row holds is then what its result holds: text without pins never leaves its page."""
    heads = _heads(candidates)
    own_tables, own_images = _gated(candidates, tables.where(is_pin_table(F.col("cells"))), images)
    pin_pages = own_tables.select("doc", F.explode(F.array_distinct(F.transform("tables", lambda t: t["page"]))).alias("page"))
    texts = _put_together(_kept(page_blocks(_with_text(candidates, heads, texts)), pin_pages))
    joined = heads.drop("last_page").join(texts, "doc", "left").join(own_tables, "doc", "left").join(own_images, "doc", "left")
    return _complete(joined).withColumn("text_content", F.coalesce("text_content", F.lit("")))


def filtered_pages_or_all(candidates: DataFrame, texts: DataFrame, tables: DataFrame, images: DataFrame, instead: Column | None = None) -> DataFrame:
    """`filtered_or_all(extracted(...))` of named documents, but blocks are judged page by page, once. What is kept is written
    down, so that only documents of which nothing is left have their whole text fetched and gathered.

    `instead`, of `doc`, is the text that a document has in place of its pages', where it isn't null."""
    candidates = candidates.where("doc is not null")
    heads = _heads(candidates).withColumn("said", F.lit(None).cast("string") if instead is None else instead)
    paged = candidates if instead is None else candidates.where(instead.isNull())
    pins = tables.where(is_pin_table(F.col("cells")))
    pin_pages = kept_tables(pins).select("doc_id").join(candidates.where("has_table").select("doc", "doc_id", F.col("page_number").alias("page")), "doc_id").select("doc", "page").distinct()
    cut = page_blocks(_with_text(paged, heads, texts))
    if instead is not None:
        own = heads.where("said is not null").select("doc", F.lit(0).alias("page_number"), F.posexplode(blocks(F.col("said"))).alias("pos", "b"))
        cut = cut.unionByName(own.select("doc", "page_number", "pos", F.col("b.page").alias("page"), F.col("b.text").alias("text")))
    kept = durable(_kept(cut, pin_pages))

    bare = paged.join(kept.select("doc").distinct(), "doc", "left_anti")
    whole = bare.join(texts.select("doc_id", "text"), "doc_id").groupBy("doc").agg(_joined_pages().alias("whole"))
    own_tables, own_images = _gated(candidates, tables, images)
    joined = heads.join(_put_together(kept), "doc", "left").join(whole, "doc", "left").join(own_tables, "doc", "left").join(own_images, "doc", "left")
    full = _complete(joined.withColumns({"text_content": F.coalesce("text_content", F.lit("")), "whole": F.coalesce("said", "whole", F.lit(""))}))
    nothing = (F.col("text_content") == "") & (F.col("whole") != "")
    chosen = {"tables": F.when(nothing, F.col("tables")).otherwise(pin_tables(F.col("tables"))), "text_content": F.when(nothing, F.col("whole")).otherwise(F.col("text_content"))}
    return full.withColumns(chosen).select("doc", "pages", "text_content", "tables", "images")


def filtered_or_all(content: DataFrame) -> DataFrame:
    """Filtered content; where the filter leaves no text but there was some, everything unfiltered."""
    named = content.withColumns({"_text": F.col("text_content"), "_tables": F.col("tables")})
    out = filtered(named)
    nothing = (F.col("text_content") == "") & (F.col("_text") != "")
    return out.withColumns({"tables": F.when(nothing, F.col("_tables")).otherwise(F.col("tables")), "text_content": F.when(nothing, F.col("_text")).otherwise(F.col("text_content"))}).drop("_text", "_tables")


def _row_text(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit("None"))), " | "), F.lit(" |"))


def _lines(*parts: Column) -> Column:
    return F.array_join(F.flatten(F.array(*parts)), "\n")


def _when(condition: Column, *lines: Column | str) -> Column:
    values = F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    return F.when(condition, values).otherwise(F.array().cast("array<string>"))


def _page_list(pages: Column) -> Column:
    return F.array(F.concat(F.lit(PAGES_LINE), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "), F.lit("\n")))


def prompt_full(pages: Column, text: Column, tables: Column, images: Column) -> Column:
    """Content as prompt text: each table's header, then its first 15 rows, the header among them, and a mark where it
    goes on."""

    def table(t: Column) -> Column:
        rows = F.transform(F.slice(t["cells"], 1, 15), _row_text)
        more = F.when(F.size(t["cells"]) > 15, F.array(F.lit(TRUNCATED))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.concat(F.lit(TABLE_TITLE), t["page"].cast("string"), F.lit(":")), _row_text(t["cells"][0])), rows, more)

    note = F.concat(F.lit(IMAGES_BEFORE), F.size(images).cast("string"), F.lit(IMAGES_AFTER))
    return _lines(
        _page_list(pages),
        _when(text != "", INFORMATION_LINE, text, ""),
        _when(F.size(tables) > 0, "\n" + TABLES_LINE),
        F.flatten(F.transform(tables, table)),
        _when(F.size(images) > 0, "\n" + NOTE_LINE, note),
    )


def prompt_short(pages: Column, text: Column, tables: Column) -> Column:
    """Content as prompt text: each table's header and 11 rows at most, without a note."""

    def table(t: Column) -> Column:
        rows = F.transform(F.slice(t["cells"], 2, 11), _row_text)
        return F.concat(F.array(F.concat(F.lit(TABLE_TITLE), t["page"].cast("string"), F.lit(":")), _row_text(t["cells"][0])), rows, F.array(F.lit("")))

    return _lines(_page_list(pages), _when(text != "", INFORMATION_LINE, text, ""), _when(F.size(tables) > 0, TABLES_LINE), F.flatten(F.transform(tables, table)))
