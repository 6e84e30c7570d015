"""Whole flows: from pages to drawings, to image results, and over batches of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import content, layout, pages, packages, render, responses
from ..session import durable


CANDIDATE = ["doc", "doc_id", "page_number", "score", "has_table", "has_diagram"]


def candidate_pages(page_rows: DataFrame, tables: DataFrame, images: DataFrame, min_score: int = 5, numbers: DataFrame | None = None) -> DataFrame:
    """The pages that score enough, without their text. They are few and narrow, and all that follows begins with them, so
    they are written down; pages are scored once."""
    return durable(pages.score(page_rows, tables, images, numbers=numbers).where(F.col("score") >= min_score).select(*CANDIDATE))


def chosen_pages(page_rows: DataFrame, tables: DataFrame, images: DataFrame, min_score: int = 5, numbers: DataFrame | None = None, ask: Callable[[DataFrame], DataFrame] | None = None, fallback: int | None = None) -> DataFrame:
    """`candidate_pages` after a model has looked at doubtful pages, and with lower pages where a document would have none.

    `ask` answers the pages that are marked for verification (doc, doc_id, page_number) with (doc_id, answer), a row for each;
    a page without an answer counts as confirmed, as a failed call does. Those confirmed score 5, the others go. Then a document none of
    whose pages scores `min_score` takes those from `fallback` on, if that is given. Pages are scored once."""
    least = min_score if fallback is None else min(min_score, fallback)
    scored = pages.score(page_rows, tables, images, min_score, numbers=numbers)
    of_use = (F.col("score") >= least) if ask is None else (F.col("score") >= least) | F.col("needs_verification")
    found = durable(scored.where(of_use).select(*CANDIDATE, "needs_verification", "reasons"))
    if ask is not None:
        found = pages.verified(found, ask(found.where("needs_verification").select("doc", "doc_id", "page_number")))
    found = found.where(F.col("score") >= min_score) if fallback is None else pages.relevant_or_lower(found, min_score, fallback)
    return durable(found.select(*CANDIDATE))


def text_flow(page_rows: DataFrame, tables: DataFrame, images: DataFrame, min_score: int = 5, numbers: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Content of each document's relevant pages, filtered, with the prompt for a model. `candidates` may have been chosen before."""
    if candidates is None:
        candidates = candidate_pages(page_rows, tables, images, min_score, numbers)
    kept = content.filtered_pages_or_all(candidates, page_rows, tables, images)
    return kept.withColumn("prompt", responses.pin_prompt(F.col("text_content")))


def batch_flow(page_rows: DataFrame, tables: DataFrame, images: DataFrame, undecoded: DataFrame, ask: Callable[[DataFrame], DataFrame], min_score: int = 5, numbers: DataFrame | None = None) -> DataFrame:
    """(doc, status, error, component_name, package_type, pin_count, n_pins): what became of each document of a batch, by its own
    path through the flow.

    `undecoded` (doc, error) are those that gave no pages. `ask` answers content (doc, pages, text_content, tables, images,
    prompt) with (doc, response) and, if it likes, call_error; it is asked about documents with relevant pages only. A document
    is `error` if it wasn't decoded, `no_pages` if no page is relevant, `extraction_error` if its relevant pages have neither
    text nor tables, `llm_error` if its call failed or its answer can't be used, else `success`."""
    candidates = candidate_pages(page_rows, tables, images, min_score, numbers)
    found = content.extracted(candidates, page_rows, tables, images).withColumn("prompt", responses.pin_prompt(F.col("text_content")))
    bare = F.regexp_replace("text_content", r"--- Page \d+ ---", "")
    full = durable(found.withColumn("empty", (F.trim(F.regexp_replace(bare, r"\s", "")) == "") & (F.size("tables") == 0)))
    answers = ask(full.where("not empty").drop("empty"))
    failed = F.col("call_error") if "call_error" in answers.columns else F.lit(None).cast("string")
    parsed = responses.parsed_pins(answers.select("doc", "response", failed.alias("call_error")))
    parsed = parsed.select("doc", "call_error", F.col("error").alias("wrong"), "component_name", F.col("package.type").alias("package_type"), F.col("package.pin_count").alias("pin_count"), F.size("pins").alias("n_pins"))

    named = page_rows if numbers is None else numbers
    every = named.select("doc", F.lit(None).cast("string").alias("broken")).distinct().unionByName(undecoded.select("doc", F.col("error").alias("broken")))
    joined = every.join(full.select("doc", "empty"), "doc", "left").join(parsed, "doc", "left")
    wrong = F.coalesce("call_error", "wrong")
    status = (
        F.when(F.col("broken").isNotNull(), "error").when(F.col("empty").isNull(), "no_pages").when(F.col("empty"), "extraction_error").when(wrong.isNotNull() | F.col("n_pins").isNull(), "llm_error").otherwise("success")
    )
    ok = lambda c: F.when(F.col("status") == "success", F.col(c)).alias(c)
    return joined.withColumn("status", status).select("doc", "status", F.coalesce("broken", F.when(F.col("status") == "llm_error", F.coalesce(wrong, F.lit("no answer")))).alias("error"), *map(ok, ("component_name", "package_type", "pin_count", "n_pins")))


def answer_flow(answers: DataFrame) -> DataFrame:
    """Parsed answers (comp_id, response) with the package name brought to its common form."""
    parsed = responses.parsed_pins(answers).where("error is null")
    named = F.coalesce(packages.normalized(F.col("package.type")), F.lit("UNKNOWN"))
    return parsed.withColumns({"package_name": named, "pin_count": F.coalesce("package.pin_count", F.lit(0))})


def drawing_flow(answers: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Drawing primitives from answers; with `sections` (comp_id, sections) custom layouts take the place of the package's.

    An answer is drawn by itself: ids tell answers apart."""
    parsed = answer_flow(answers).select("comp_id", "component_name", "package_name", "pin_count", "pins")
    sized = layout.parameters(parsed, "package_name", "pin_count")
    if sections is not None:
        sized = sized.join(sections.select("comp_id", "sections").hint("merge"), "comp_id", "left")
    # An answer's pins lie beside its component's parameters: one pass, which reads an answer once and shuffles no pin. The
    # component itself comes before its pins, as an entry without one.
    beside = F.explode(F.concat(F.array(F.lit(None).cast(responses.PIN_TYPE)), F.coalesce("pins", F.array().cast(f"array<{responses.PIN_TYPE}>")))).alias("pin")
    rows = sized.select(*(c for c in sized.columns if c != "pins"), beside).select("*", F.col("pin.number").alias("number"), F.col("pin.name").alias("name"))
    bare = F.col("pin").isNull()
    return render.drawn(layout.in_place(rows, None if sections is None else "sections", bare), bare)


def layout_flow(candidates: DataFrame, page_rows: DataFrame, tables: DataFrame, images: DataFrame, ask_pins: Callable[[DataFrame], DataFrame], ask_layout: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Drawing primitives (comp_id is the document) of pins from the text of a document's relevant pages, placed as the picture of
    its best page shows them.

    `candidates` come from `candidate_pages` or `chosen_pages`. `ask_pins` answers content as in `batch_flow`. `ask_layout` answers
    best pages (doc, doc_id, page_number), one of each document whose pins could be read, with (doc, response); see
    `responses.layout_prompt`. A layout counts if its answer names a section with numbers; without one, as for null answers and
    documents without an answer, pins lie as their package has them. Sections that name a pin again move it."""
    kept = text_flow(page_rows, tables, images, candidates=candidates)
    answers = durable(ask_pins(kept).select(F.col("doc").alias("comp_id"), "response"))
    return drawing_flow(answers, layout_sections(candidates, answers, ask_layout))


def layout_sections(candidates: DataFrame, answers: DataFrame, ask_layout: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(comp_id, sections) of the documents whose pins could be read from `answers` (comp_id, response) and whose layout answer
    names a section with numbers; see `layout_flow`."""
    readable = responses.parsed_pins(answers).where("error is null").select(F.col("comp_id").alias("doc"))
    best = pages.relevant(candidates, min_score=0).where("rank = 1").select("doc", "doc_id", "page_number").join(readable, "doc", "left_semi")
    layouts = ask_layout(best).select(F.col("doc").alias("comp_id"), responses.layout_intended(T.layout_text(F.col("response")))["sections"].alias("sections"))
    return durable(layouts.where(F.size("sections") > 0))


def vision_flow(answers: DataFrame, by: str = "doc", order: str = "ord") -> DataFrame:
    """The best image answer of each document (doc, ord, response)."""
    return responses.best_of(responses.vision_results(answers).drop("response"), by, order)


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals of a batch by outcome, in one row."""
    from ..functions.rules import ERROR_STATUSES

    of = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("bigint")), F.lit(0))
    return runs.agg(F.count("*").alias("total"), of("success").alias("successes"), of("no_pages").alias("no_pages"), of(*ERROR_STATUSES).alias("errors"))
