"""The registered queries: each operator over its whole logical tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import surface
from ..functions import text as T
from ..operators import content, grids, images, layout, lookup, packages, pages, reading, render, responses
from ..session import durable, shared_folder
from ..sources import formats, ledger, providers
from ..sources.virtual import frame
from ..streaming import ranking
from . import overlays, pipelines, summaries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Data:
    """Logical tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)

    @property
    def cells(self):
        """The cells of v_page_tables."""
        head = F.transform(F.split("header", r"\|"), lambda c: F.nullif(c, F.lit("")))
        row = lambda i: F.transform(head, lambda c, j: F.concat(F.lit("r"), i.cast("string"), F.lit("c"), j.cast("string")))
        rows = F.when(F.col("n_rows") > 1, F.transform(F.sequence(F.lit(1), F.col("n_rows") - 1), row)).otherwise(F.array().cast("array<array<string>>"))
        return F.concat(F.array(head), rows)

    @property
    def tables(self) -> DataFrame:
        return self.v_page_tables.withColumn("cells", self.cells)

    @property
    def scored(self) -> DataFrame:
        return pages.score(self.v_page_text, self.tables, self.v_page_images, numbers=self.v_page_numbers)

    @property
    def candidates(self) -> DataFrame:
        return pipelines.candidate_pages(self.v_page_text, self.tables, self.v_page_images, numbers=self.v_page_numbers)

    def numbered(self, *columns) -> DataFrame:
        """The pages' numbers with columns that are computed where the text lies."""
        return self.v_page_numbers.join(self.v_page_text.select("doc_id", *columns), "doc_id")

    @property
    def content(self) -> DataFrame:
        return content.extracted(self.candidates, self.v_page_text, self.tables, self.v_page_images)

    @property
    def filtered_pages(self) -> DataFrame:
        return content.filtered_pages(self.candidates, self.v_page_text, self.tables, self.v_page_images)

    @property
    def analysis(self) -> DataFrame:
        return images.analyzed(self.v_page_images, self.v_page_text, self.v_page_numbers)

    @property
    def sized(self) -> DataFrame:
        return layout.parameters(self.v_components, "pkg_raw", "pin_count")

    @property
    def places(self) -> DataFrame:
        return layout.positions(self.sized)

    @property
    def custom(self) -> DataFrame:
        rows = self.v_custom_layout.groupBy("comp_id").agg(F.array_sort(F.collect_list(F.struct("sec_pos", "section", "first_pin", "pins"))).alias("s"))
        section = lambda s: F.struct(s["section"].alias("section"), F.sequence(s["first_pin"], s["first_pin"] + s["pins"] - 1).alias("pins"))
        return self.sized.join(rows.select("comp_id", F.transform("s", section).alias("sections")), "comp_id")

    @property
    def parsed(self) -> DataFrame:
        return responses.parsed_pins(self.v_llm_responses)


def simple(name: str, f: Callable[[Data], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))


joined = lambda c, by=",": F.array_join(c, by)
md5 = lambda c: F.md5(c.cast("binary"))

# Scans, sources, sinks
simple("s1_page_scan", lambda d: providers.decoded(d.pages.select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content")), providers.PlainTextSource()).select("doc", "page_number", "total_pages", F.length("text").alias("n")))
simple("s2_rescan", lambda d: d.numbered(F.length(T.text_or_empty(F.col("text"))).alias("n_chars"), md5(T.text_or_empty(F.col("text"))).alias("text_md5")).select("doc", "doc_id", "page_number", "n_chars", "text_md5"))
simple("s3_image_scan", lambda d: providers.page_images(d.pages.select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content")), providers.PlainTextSource()).select("doc", "page_number", "image_index", F.length("data").alias("n")))
simple("s4_page_numbers", lambda d: d.v_page_numbers.select("doc", "doc_id", "page_number"))
# The documents have no null texts, so each ninth text counts as null here; the name says so.
simple("s5_text_ninth_null", lambda d: d.v_page_text.select("doc_id", md5(T.text_or_empty(F.when(F.col("doc_id") % 9 != 0, F.col("text")))).alias("text_md5")))
simple("s6_single_page", lambda d: content.single_page(d.v_pages, 3).select("doc", "page_number", md5(F.col("text")).alias("text_md5")))
simple("s7_tables", lambda d: content.kept_tables(d.tables).select("doc_id", "table_index", F.size("cells").alias("n_rows")))
cells_text = lambda cells: F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit("~"))), "|")), "/")
ruled = lambda d: grids.tables(overlays.table_lines(d.v_page_tables), overlays.table_words(d.v_page_tables, d.cells))
simple("s7_ruled_tables", lambda d: ruled(d).select("doc_id", "table_index", cells_text(F.col("cells")).alias("cells")))
simple("s5_positioned_text", lambda d: reading.page_text(overlays.page_words(d.documents)).select("doc_id", F.length("text").alias("n_chars"), md5(F.col("text")).alias("text_md5")))
# Images come from the provider as stored bytes: a stand-in that has none for every seventh.
stored = lambda d: d.v_page_images.join(d.v_page_numbers.select("doc_id", "page_number"), "doc_id").withColumn("data", F.when((F.col("doc_id") + F.col("image_index")) % 7 != 0, F.encode(F.concat_ws("-", "doc", "image_index"), "UTF-8")))
simple("s8_content_images", lambda d: stored(d).where("data is not null").select("doc_id", "image_index", F.base64("data").alias("data")))
simple("s9_detector_images", lambda d: stored(d).select("doc_id", "image_index", F.base64("data").alias("data")))
simple("s10_bulk_images", lambda d: images.of_pages(stored(d), d.v_page_numbers.select("doc", F.explode(F.array(F.lit(2), F.lit(5), F.lit(100000))).alias("page_number")).distinct()).select("doc", "page_number", "image_index"))
simple("s11_image_files", lambda d: providers.image_files(stored(d)).select("name", md5(F.col("content")).alias("content_md5")))
simple("s12_chat_answers", lambda d: providers.answered(d.v_components.select("comp_id", F.to_json(responses.pin_prompt(F.col("component_name"))).alias("request")), providers.FixedAnswers()).select("comp_id", "response"))
def ledger_of(d: Data) -> tuple[ledger.Ledger, DataFrame, providers.Unsteady]:
    """Requests of which many are equal, put to a service with failures through a ledger of its own."""
    requests = d.part.select("p_partkey", F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("request"))
    return ledger.Ledger(d.spark, f"{shared_folder(d.spark)}/ledger-{uuid.uuid4().hex}", attempts=2, pause=0.0), requests, providers.Unsteady(providers.FixedAnswers())


def ledger_calls(d: Data) -> DataFrame:
    book, requests, provider = ledger_of(d)
    book.ask(requests, provider)
    return book.calls()


def ledger_answers(d: Data) -> DataFrame:
    book, requests, provider = ledger_of(d)
    return book.answered(requests, provider).select("p_partkey", "response", "attempts", "call_error")


simple("s12_ledger_calls", ledger_calls)
simple("s12_ledger_answers", ledger_answers)
simple("s13_vision_answers", lambda d: providers.answered(stored(d).select("doc_id", "image_index", responses.vision_prompt(F.col("doc")).alias("request"), "data"), providers.FixedAnswers('{"status": 1}'), image="data").select("doc_id", "image_index", "response"))
described = lambda d: d.v_llm_responses.select("comp_id", F.when(F.col("comp_id") % 5 == 0, F.to_json(F.struct(F.col("response").alias("description")))).when(F.col("comp_id") % 5 < 4, F.col("response")).alias("raw"))
simple("s14_layout_text", lambda d: described(d).select("comp_id", T.layout_text(F.col("raw")).alias("layout_text")))
simple("s15_draw_rows", lambda d: pipelines.drawing_flow(d.v_llm_responses).select("comp_id", "part", "name", "shape", "width", "height", "depth", "size", "halign"))
simple("s17_valid_inputs", lambda d: providers.valid_inputs(d.v_files).select("file_id", "path"))
simple("s18_listing", lambda d: providers.valid_inputs(d.v_files).orderBy("path").select("path"))
simple("s19_base64", lambda d: d.v_page_text.select("doc_id", md5(images.base64(F.encode("text", "UTF-8"))).alias("encoded_md5")))

# Page scores
simple("p1_heading_score", lambda d: d.scored.select("doc_id", "heading", "heading_score"))
simple("p2_heading_line", lambda d: d.v_page_text.select("doc_id", pages.heading_pattern(F.col("text")).isNotNull().alias("is_heading")))
simple("p3_table_score", lambda d: d.scored.select("doc_id", "table_matches", "table_score", "has_table"))
simple("p4_header_text", lambda d: d.tables.select("doc_id", "table_index", pages.header_text(F.col("cells")).alias("header_text")))
simple("p5_diagram_score", lambda d: d.scored.select("doc_id", "has_diagram", "diagram_score"))
simple("p6_keyword_density", lambda d: d.scored.select("doc_id", "keywords", "words", "keyword_score"))
simple("p7_position_score", lambda d: d.scored.select("doc_id", "page_number", "position_score"))
simple("p8_page_score", lambda d: d.scored.select("doc", "page_number", "score", joined(F.col("reasons"), "; ").alias("reasons")))
simple("p9_unusual", lambda d: d.scored.select("doc_id", "unusual"))
simple("p10_relevant_pages", lambda d: pages.relevant(d.scored).select("doc", "page_number", "score", "rank"))
simple("p11_verification_mark", lambda d: d.scored.select("doc_id", "score", "needs_verification"))
simple("p12_low_confidence", lambda d: pages.low_confidence(d.scored).select("doc", "page_number", "score"))
simple("p13_retry_lower", lambda d: pages.relevant_or_lower(d.scored).select("doc", "page_number", "score"))

# Image pages
simple("i1_image_area", lambda d: images.measured(d.v_page_images, d.v_page_numbers).select("doc_id", "image_index", "area", "ratio", "is_large"))
simple("i2_image_confidence", lambda d: d.analysis.select("doc_id", "n_images", "any_large", "confidence"))
simple("i3_found_keywords", lambda d: d.v_page_text.select("doc_id", images.found_keywords(F.col("text")).alias("keywords")))
simple("i4_image_pages", lambda d: images.image_pages(d.analysis).select("doc", "page_number", "confidence", "rank"))
simple("i5_page_analysis", lambda d: d.analysis.select("doc_id", joined(F.transform("images", lambda i: F.concat_ws(":", i["image_index"], i["is_large"])), " ").alias("images"), joined(F.col("reasons"), "; ").alias("reasons")))

# Content
pages_text = lambda c: joined(F.transform(c, lambda p: p.cast("string")))
tables_text = lambda c: joined(F.transform(c, lambda t: F.concat_ws(":", t["page"], t["table_index"], F.size(t["cells"]))), " ")
simple("c1_gated_extract", lambda d: d.content.select("doc", pages_text("pages").alias("pages"), md5(F.col("text_content")).alias("text_md5"), tables_text("tables").alias("tables"), F.size("images").alias("n_images")))
simple("c2_page_marker", lambda d: d.v_pages.select("doc_id", md5(content.marked(F.col("page_number"), F.col("text"))).alias("marked_md5")))
simple("c3_filter_fallback", lambda d: content.filtered_pages_or_all(d.candidates, d.v_page_text, d.tables, d.v_page_images, F.when(F.substring("doc", -1, 1) == "1", F.lit("no marker here"))).select("doc", md5(F.col("text_content")).alias("text_md5"), tables_text("tables").alias("tables")))
simple("c4_pin_tables", lambda d: d.tables.select("doc_id", "table_index", content.is_pin_table(F.col("cells")).alias("is_pin_table")))
simple("c5_pin_sections", lambda d: d.v_page_text.select("doc_id", content.is_pin_section(F.col("text")).alias("is_section")))
simple("c6_filter_tables", lambda d: d.tables.where(content.is_pin_table(F.col("cells"))).select("doc_id", "table_index"))
cut = lambda d: d.v_marked_text.select("id", content.blocks(F.col("text")).alias("blocks"))
simple("c7_segments", lambda d: cut(d).select("id", F.posexplode("blocks").alias("pos", "b")).select("id", "pos", F.col("b.page").alias("page"), md5(F.col("b.text")).alias("text_md5")))
kept = lambda d: cut(d).withColumn("kept", content.kept_blocks(F.col("blocks"), F.array((F.col("id") % 3).cast("int"))))
simple("c8_block_filter", lambda d: kept(d).select("id", joined(F.transform("kept", lambda b: b["page"].cast("string"))).alias("pages")))
simple("c9_reassemble", lambda d: kept(d).select("id", md5(content.reassembled(F.col("kept"))).alias("text_md5")))
simple("c10_pages_kept", lambda d: d.filtered_pages.select("doc", pages_text("pages").alias("pages")))
simple("c11_filter_content", lambda d: d.filtered_pages.select("doc", md5(F.col("text_content")).alias("text_md5"), tables_text("tables").alias("tables"), F.size("images").alias("n_images")))
simple("c12_prompt_full", lambda d: d.content.select("doc", md5(content.prompt_full(*(F.col(c) for c in ("pages", "text_content", "tables", "images")))).alias("prompt_md5")))
simple("c13_prompt_short", lambda d: d.content.select("doc", md5(content.prompt_short(*(F.col(c) for c in ("pages", "text_content", "tables")))).alias("prompt_md5")))
simple("c14_candidate_tables", lambda d: d.tables.select("doc_id", "table_index", content.is_candidate_table(F.col("cells")).alias("is_candidate")))

# Model input and output
shape = lambda m: (joined(F.transform(m, lambda x: x["role"])).alias("roles"), m[0]["content"].alias("system"))
simple("d1_pin_prompt", lambda d: d.v_page_text.select("doc_id", *shape(responses.pin_prompt(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("doc")))), md5(responses.pin_prompt(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("doc")))[1]["content"]).alias("asked_md5")))
simple("d2_extract_pins", lambda d: responses.parsed_pins(providers.answered(d.content.select("doc", F.to_json(responses.pin_prompt(F.col("text_content"))).alias("request")), providers.FixedAnswers())).select("doc", "component_name", F.col("package.type").alias("type"), F.size("pins").alias("n_pins"), "error"))
simple("d3_parse_pins", lambda d: d.parsed.select("comp_id", "component_name", F.col("package.type").alias("type"), F.col("package.pin_count").alias("pin_count"), F.col("package.width").alias("width"), F.col("package.height").alias("height"), F.col("package.pitch").alias("pitch"), "extraction_method", F.size("pins").alias("n_pins"), F.col("error").isNotNull().alias("failed")))
simple("d4_pin_numbers", lambda d: d.parsed.select("comp_id", F.posexplode("pins").alias("pos", "p")).select("comp_id", "pos", F.col("p.number").alias("number"), F.col("p.name").alias("name"), F.col("p.function").alias("function")))
simple("d5_missing_or_null", lambda d: d.parsed.select("comp_id", "error", F.col("extraction_method").alias("method")))
page_answers = lambda d: d.v_page_numbers.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "YES it does").when(F.col("doc_id") % 4 == 1, " no, it doesn't").when(F.col("doc_id") % 4 == 2, "hard to say").alias("answer"))
simple("d6_verify_pages", lambda d: pages.verified(d.scored, page_answers(d)).select("doc_id", "score", F.size("reasons").alias("n_reasons")))
simple("d7_says_yes", lambda d: d.v_verifications.select("conv_id", "turn", responses.says_yes(F.col("answer")).alias("yes")))
simple("d7b_verify_one_page", lambda d: page_answers(d).select("doc_id", responses.says_yes(F.col("answer")).alias("yes")))
simple("d7c_verification_prompt", lambda d: d.v_page_text.select("doc_id", *shape(responses.verification_prompt(F.col("text"))), md5(responses.verification_prompt(F.col("text"))[1]["content"]).alias("asked_md5")))
samples = lambda d: d.v_pages.where("page_number <= 3").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p")).select("doc", F.slice(F.transform("p", lambda p: p["page_number"]), 1, 3).alias("numbers"), F.slice(F.transform("p", lambda p: p["text"]), 1, 2).alias("texts"))
simple("d7d_sample_prompt", lambda d: samples(d).select("doc", md5(F.substring_index(responses.sample_prompt(F.col("numbers"), F.col("texts"))[1]["content"], "Sample pages:\n", -1)).alias("samples_md5"), responses.sample_analysis(F.lit("ok"))["recommendation"].alias("recommendation")))
simple("d8_vision_parse", lambda d: responses.vision_results(d.v_vision_raw).select("id", "component_name", "package_type", "pin_count", "pins", "confidence", (F.col("notes") != "").alias("has_note")))
simple("d9_best_of_images", lambda d: responses.best_of(d.v_vision_results).select("doc", "ord", "confidence", "component_name"))
simple("d10_vision_prompt", lambda d: d.v_components.select("comp_id", F.coalesce(F.nullif(F.regexp_extract(responses.vision_prompt(F.when(F.col("comp_id") % 3 > 0, F.when(F.col("comp_id") % 3 > 1, F.col("component_name")).otherwise(""))), r"\n\nTarget component: ([\s\S]*)", 1), F.lit("")), F.lit("none")).alias("target")))
sections_text = lambda c: joined(F.transform(c["sections"], lambda s: F.concat(s["section"], F.lit("="), joined(F.transform(s["pins"], lambda p: p.cast("string"))))), ";")
layouts = lambda d, f: d.v_layout_text.select("id", f(F.col("text")).alias("l")).select("id", F.col("l.package_type").alias("package_type"), F.col("l.pin_count").alias("pin_count"), sections_text(F.col("l")).alias("sections"))
simple("d11_layout_as_coded", lambda d: layouts(d, responses.layout_as_coded))
simple("d11_layout_intended", lambda d: layouts(d, responses.layout_intended))
known = lambda d: d.v_components.withColumn("component_name", F.when(F.col("comp_id") % 4 == 0, F.concat(F.lit("ne555-"), "component_name")).when(F.col("comp_id") % 4 == 1, F.lit("ATMEGA164A")).otherwise(F.col("component_name")))
some_pins = lambda d: d.v_components.select("comp_id", F.explode(F.array(F.lit("VCC"), F.when(F.col("comp_id") % 8 < 4, F.lit("GND")), F.lit("RESET"))).alias("name")).where("name is not null")
simple("d12_known_pinouts", lambda d: responses.checked(known(d), some_pins(d)))
simple("d13_cache_misses", lambda d: responses.cache_misses(d.v_components.select("comp_id"), d.v_llm_responses.where("comp_id % 3 = 0"), "comp_id"))
simple("d14_part_number", lambda d: d.v_files.select("file_id", T.part_number(F.col("path")).alias("part")))

# Packages
simple("k1_detect_text", lambda d: d.v_components.select("comp_id", packages.from_text(F.col("pkg_raw")).alias("type")))
simple("k2_normalize", lambda d: d.v_components.select("comp_id", packages.normalized(F.col("pkg_raw")).alias("name")))
simple("k3_quasi_square", lambda d: d.v_components.select("comp_id", packages.quasi_square(F.col("width"), F.col("height")).alias("square")))
simple("k4_detect_layout", lambda d: d.v_components.select("comp_id", packages.from_layout(F.col("pin_count"), F.col("width"), F.col("height")).alias("type")))
typed = lambda d: d.v_components.withColumn("kind", packages.normalized(F.col("pkg_raw")))
simple("k5_expected_dimensions", lambda d: packages.with_expected(typed(d), "kind", "pin_count").select("comp_id", "kind", "min_w", "max_w", "min_h", "max_h"))
simple("k6_validate", lambda d: typed(d).select("comp_id", packages.valid(F.col("kind"), F.col("pin_count"), F.col("width"), F.col("height")).alias("valid")))
simple("k7_default", lambda d: d.v_components.select("comp_id", packages.default(F.col("pin_count")).alias("type")))
simple("k8_detect_package", lambda d: d.v_components.select("comp_id", packages.detected(F.col("pkg_raw"), F.concat(F.lit("in a "), "pkg_raw", F.lit(" package")), F.col("pin_count"), F.col("width"), F.col("height")).alias("type")))
simple("k9_estimate", lambda d: typed(d).select("comp_id", packages.estimated(F.col("kind"), F.col("pin_count")).alias("e")).select("comp_id", "e.width", "e.height"))
simple("k10_parse_type", lambda d: d.v_components.select("comp_id", packages.parsed(F.col("pkg_raw")).alias("type")))

# Geometry, layout, join
GEOMETRY = ["comp_id", "type", "n", "per_side", "pitch", "body_width", "body_height", "top_margin", "name_offset", "num_offset"]
for _number, _kind in enumerate(("DIP", "SOIC", "TQFP", "QFN", "BGA"), 1):
    simple(f"g{_number}_{_kind.lower()}_parameters", lambda d, kind=_kind: d.sized.where(F.col("type") == kind).select(*GEOMETRY))
simple("g6_parameters", lambda d: d.sized.select(*GEOMETRY, "leg_length", "leg_width", "border_thickness", "designator_offset"))
simple("g7_simple_position", lambda d: d.sized.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("comp_id", "i", layout.simple_position(F.col("i")).alias("p")).select("comp_id", "i", "p.*"))
simple("l0_layout", lambda d: d.places)
for _number, _kind in enumerate(("dip", "quad", "bga"), 1):
    simple(f"l{_number}_{_kind}_layout", lambda d, kind=_kind: layout.positions(d.sized.where(layout.layout_kind(F.col("type")) == kind)))
simple("l2_quad_layout_intended", lambda d: layout.positions(d.sized.where(layout.layout_kind(F.col("type")) == "quad"), counter_clockwise=True))
simple("l4_custom_layout", lambda d: layout.custom_positions(d.custom))
simple("l5_builder_pins", lambda d: layout.builder_pins(d.v_pins))
simple("j1_pin_join", lambda d: layout.pins_of(d.v_pins, d.sized).select("comp_id", "pin_number", "name", "pin_index", "x", "y", "side"))
simple("j1_unplaced_pins", lambda d: layout.unplaced_pins(d.v_pins, d.places))
simple("b1_borders", lambda d: render.borders(d.sized))
simple("b2_pin_primitives", lambda d: render.pin_primitives(layout.pins_of(d.v_pins, d.sized)))
simple("b3_labels", lambda d: render.labels(d.sized))
simple("b4_assembly", lambda d: render.assembly(d.sized, layout.pins_of(d.v_pins, d.sized)))
simple("b5_build", lambda d: pipelines.drawing_flow(d.v_llm_responses).select("comp_id", "part", "name", "x", "y", "label"))

# Aggregation, sort, limit, union
simple("a1_status_counts", lambda d: d.v_runs.groupBy("status").agg(F.count("*").alias("n")))
simple("a2_run_summary", lambda d: pipelines.run_summary(d.v_runs))
simple("a3_image_area_sum", lambda d: pages.image_areas(d.v_page_images))
simple("a4_predicate_hits", lambda d: d.tables.select("doc_id", T.count_matches(pages.header_text(F.col("cells")), pages.rules.TABLE_PATTERNS).alias("hits")))
simple("a5_any_large", lambda d: images.measured(d.v_page_images, d.v_page_numbers).groupBy("doc_id").agg(F.bool_or("is_large").alias("any_large")))
simple("a6_ordered_text", lambda d: d.numbered(F.length("text").alias("n")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page_number", "n"))).alias("p")).select("doc", joined(F.transform("p", lambda p: F.concat_ws(":", p["page_number"], p["n"]))).alias("lengths")))
simple("a7_first_maximum", lambda d: responses.best_of(d.v_vision_results).select("doc", "ord"))
simple("a8_distinct_pages", lambda d: d.tables.where(content.is_pin_table(F.col("cells"))).select("doc", "doc_id").distinct())
simple("a9_ordered_distinct", lambda d: d.v_layout_text.select("id", joined(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))), lambda x: x)).alias("numbers")))
simple("a10_group_lists", lambda d: d.v_custom_layout.withColumn("side", layout.section_side(F.col("section"))).groupBy("comp_id", "side").agg(F.array_sort(F.collect_list(F.struct("sec_pos", "section"))).alias("s")).select("comp_id", "side", joined(F.transform("s", lambda s: s["section"])).alias("sections")))
simple("o1_sort_score", lambda d: pages.relevant(d.scored).select("doc", "rank", "page_number").orderBy("doc", "rank"))
simple("o2_sort_page", lambda d: d.scored.where("score >= 5").select("doc", "page_number").orderBy("doc", "page_number"))
simple("o3_first_lines", lambda d: d.v_page_text.select("doc_id", F.size(F.slice(F.split("text", "\n"), 1, 10)).alias("n_lines"), md5(F.substring("text", 1, 30)).alias("head_md5")))
simple("o4_best_page", lambda d: pages.relevant(d.scored).where("rank = 1").select("doc", "page_number", "score"))
simple("o5_first_ten", lambda d: d.v_pins.groupBy("comp_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("number", "name"))), 1, 10).alias("p")).select("comp_id", joined(F.transform("p", lambda p: F.concat_ws(":", p["number"], p["name"]))).alias("pins")))
simple("u1_union", lambda d: d.v_page_tables.select("doc_id", F.lit("table").alias("kind"), F.col("table_index").alias("at")).unionByName(d.v_page_images.select("doc_id", F.lit("image").alias("kind"), F.col("image_index").alias("at"))))


def reports(d: Data) -> DataFrame:
    sizes = F.col("package").withField("width", F.col("package.width").cast("int")).withField("height", F.col("package.height").cast("int"))
    return d.parsed.where("error is null").select("comp_id", render.report(F.col("component_name"), sizes, F.col("pins")).alias("report"))


simple("f7_report", lambda d: reports(d).select("comp_id", md5(F.col("report")).alias("report_md5")))
simple("s16_console_report", lambda d: reports(d).select("comp_id", F.posexplode(F.split("report", "\n")).alias("line_at", "line")))

# Whole flows
simple("flow_a_text", lambda d: pipelines.text_flow(d.v_page_text, d.tables, d.v_page_images, numbers=d.v_page_numbers).select("doc", md5(F.col("text_content")).alias("text_md5"), F.size("prompt").alias("n_messages")))
simple("flow_a_drawing", lambda d: pipelines.drawing_flow(d.v_llm_responses))
simple("flow_b_custom", lambda d: pipelines.drawing_flow(d.v_llm_responses, d.custom.select("comp_id", "sections")))
simple("flow_c_vision", lambda d: pipelines.vision_flow(d.v_vision_raw.select((F.col("id") % 50).alias("doc"), F.col("id").alias("ord"), "response")).select("doc", "ord", "confidence", "component_name"))


def batch(d: Data) -> DataFrame:
    ask = lambda content: content.select("doc").join(d.v_batch_answers, "doc", "left")
    return pipelines.batch_flow(d.v_batch_pages, d.tables, d.v_page_images, d.v_undecoded, ask)


simple("flow_e_batch", batch)
simple("flow_e_batch_totals", lambda d: pipelines.run_summary(batch(d)))


def chosen(d: Data) -> DataFrame:
    confirm = lambda doubtful: doubtful.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "yes").when(F.col("doc_id") % 3 == 1, "No, none").alias("answer"))
    return pipelines.chosen_pages(d.v_batch_pages, d.tables, d.v_page_images, ask=confirm, fallback=3)


def laid_by_picture(d: Data) -> DataFrame:
    pins = lambda content: content.select("doc").join(d.v_batch_answers, "doc")
    picture = lambda best: best.join(d.v_batch_layouts, "doc")
    return pipelines.layout_flow(chosen(d), d.v_batch_pages, d.tables, d.v_page_images, pins, picture)


simple("flow_d_chosen_pages", lambda d: chosen(d).select("doc", "page_number", "score"))
simple("flow_d_layout", laid_by_picture)


def streamed_ranks(d: Data) -> DataFrame:
    """The batch's pages, in four files by a hash, so that documents come in pieces and out of order; ranked as they arrive."""
    folder = f"{shared_folder(d.spark)}/arriving-{uuid.uuid4().hex}"
    arrived = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") % 3600).alias("arrived_at")
    page_rows = d.v_batch_pages.select("*", arrived)
    page_rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4))).repartition(4, "part").drop("part").write.parquet(f"{folder}/pages")
    stream = d.spark.readStream.schema(page_rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/pages")
    tables, images_ = durable(pages.table_scores(d.tables)), durable(pages.image_areas(d.v_page_images))
    ranked = ranking.ranked(pages.scored_with(pages.features(stream), tables, images_), keep=3, delay="2 hours", idle_ms=60_000)
    ranking.into(ranked, f"{folder}/ranks", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return ranking.newest(d.spark.read.schema(ranking.RANKED).parquet(f"{folder}/ranks"))


simple("p10_streamed_ranks", streamed_ranks)


def merged_runs(d: Data) -> DataFrame:
    """Runs in two batches, the first of which is summarised again by the second in part; then all of them together."""
    kept = summaries.Summaries(d.spark, f"{shared_folder(d.spark)}/summaries-{uuid.uuid4().hex}")
    kept.add(d.v_costed_runs.where("run < 6"))
    kept.add(d.v_costed_runs.where("run >= 4"))
    return kept.totals().select("status", "n_runs", "n", "low", "high", "n_items")


simple("a2_merged_runs", merged_runs)


# The same through SQL functions
def in_sql(statement: str, *inputs: str) -> Callable[[Data], DataFrame]:
    def run(d: Data) -> DataFrame:
        surface.register(d.spark)
        return d.spark.sql(statement, **{name: getattr(d, name) for name in inputs})

    return run


SQL_SCORES = """WITH features AS (SELECT doc_id, lf_page_features(text) AS found FROM {v_page_text}),
  headers AS (SELECT doc_id, min_by(matches, table_index) AS table_matches FROM (SELECT doc_id, table_index, lf_table_matches(cells[0]) AS matches FROM {tables} WHERE size(cells) >= 2) WHERE matches >= 2 GROUP BY doc_id),
  areas AS (SELECT doc_id, sum(coalesce(width, 0D) * coalesce(height, 0D)) AS area FROM {v_page_images} GROUP BY doc_id)
SELECT n.doc, n.page_number, s.score, array_join(s.reasons, '; ') AS reasons
FROM features f JOIN {v_page_numbers} n USING (doc_id) LEFT JOIN headers h USING (doc_id) LEFT JOIN areas a USING (doc_id),
  LATERAL lf_page_score(f.found, h.table_matches, try_divide(a.area, n.width * n.height), n.page_number, n.total_pages, 5, 3) s"""
simple("p8_page_score_sql", in_sql(SQL_SCORES, "v_page_text", "tables", "v_page_images", "v_page_numbers"))
simple("k2_normalize_sql", in_sql("SELECT comp_id, lf_package_name(pkg_raw) AS name FROM {v_components}", "v_components"))
simple("c7_segments_sql", in_sql("SELECT id, pos, b.page, md5(b.text) AS text_md5 FROM (SELECT id, lf_blocks(text) AS blocks FROM {v_marked_text}) v LATERAL VIEW posexplode(v.blocks) x AS pos, b", "v_marked_text"))


# Joins with tables of any size
def part_ranges(d: Data) -> DataFrame:
    ends = F.col("p_size") - 5, F.when(F.col("p_partkey") % 17 != 0, F.col("p_size") + F.col("p_partkey") % 40)
    ranges = d.part.select(F.floor(F.col("p_partkey") / 50).alias("grp"), F.col("p_partkey").alias("range_id"), *(e.alias(n) for e, n in zip(ends, ("low", "high"))))
    rows = d.v_components.select("comp_id", "pin_count", F.floor(F.col("comp_id") / 50).alias("grp"))
    return lookup.in_ranges(rows, "pin_count", ranges, "low", "high", ["grp"])


def known_parts(d: Data) -> DataFrame:
    names = d.part.select(F.expr("substring(p_name, 1, cast(3 + p_partkey % 9 as int))").alias("known"), F.col("p_partkey").alias("known_id"))
    return lookup.longest_prefix(d.part.select("p_partkey", "p_name"), "p_name", names, "known", ["p_partkey"])


def many_keywords(d: Data) -> DataFrame:
    words = d.benchmark.select(F.split(F.lower("text"), "[^a-z]+").alias("w"))
    pair = F.transform(F.sequence(F.lit(2), F.size("w") - 1, F.lit(2)), lambda i: F.concat(F.element_at("w", i), F.when(i % 4 == 0, F.concat(F.lit(" "), F.element_at("w", i + 1))).otherwise("")))
    keywords = words.where("size(w) >= 3").select(F.explode(pair).alias("keyword"))
    found = lookup.keyword_counts(d.documents, "doc_id", "text", keywords)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_keywords"), F.sum("n").alias("n_hits"))


simple("k5_part_ranges", lambda d: part_ranges(d).select("comp_id", "range_id"))
simple("d12_known_parts", known_parts)
simple("p6_many_keywords", many_keywords)


def page_files(d: Data, lines: bool) -> str:
    """The documents as files in a folder of its own: one page, or a page for each line."""
    formats.register(d.spark)
    folder = f"{shared_folder(d.spark)}/files-{uuid.uuid4().hex}"
    text = F.translate("text", "\n", "\f") if lines else F.col("text")
    name = F.concat_ws("/", F.regexp_replace("source", r"[^\w.-]+", "_"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    d.documents.where("text is not null").select(name.alias("name"), F.encode(text, "UTF-8").alias("content")).write.format("leadframe_files").mode("append").save(folder)
    return folder


def read_pages(d: Data) -> DataFrame:
    pages_ = d.spark.read.format("leadframe_pages").option("bytesPerTask", 1 << 20).load(page_files(d, True))
    return pages_.select(F.regexp_extract("doc", r"([^/]+)\.txt$", 1).cast("bigint").alias("doc_id"), "page_number", "total_pages", "n_bytes", md5(F.col("text")).alias("text_md5"))


simple("s1_page_ranges", read_pages)
simple("s11_committed_files", lambda d: formats.manifest(d.spark, page_files(d, False)).select("name", F.col("bytes").alias("n_bytes"), "sha256"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant pages with their scores and reasons, best first within each document."""
    found = pages.relevant(Data(spark, sf_dir).scored)
    return found.select("doc", "page_number", "score", joined(F.col("reasons"), "; ").alias("reasons"), "rank")
