"""python -m leadframe INPUT [options]: pins of the documents in a folder, or of one document.

Each document gets a JSON file of what was found, at the same place below the output folder as it has below the input; reports go
to the console. Answers come from a model behind --url, or from the file given as --answer, which stands in for one. They are kept
in a ledger, in the output folder unless --ledger names another, so a run that is repeated, or goes on after it was stopped, asks
for what is missing only."""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import pages, render, responses
from .plans import pipelines
from .session import durable, shared_folder
from .sources import formats, ledger, models, providers


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="leadframe", description="Pins of component datasheets.")
    parser.add_argument("input", help="a document, or a folder of them")
    parser.add_argument("-o", "--output", help="folder for a JSON file of each document, and for drawings")
    parser.add_argument("--list", action="store_true", help="only list the documents")
    parser.add_argument("--min-confidence", type=int, default=5, help="least score of relevant pages")
    parser.add_argument("--fallback", type=int, help="least score of pages of a document that has no relevant ones")
    parser.add_argument("--verify", action="store_true", help="ask the chat model about doubtful pages")
    parser.add_argument("--layout-url", help="address of the model that describes how pins lie in the picture of the best page")
    parser.add_argument("--layout-answer", help="file with an answer that stands in for that model's")
    parser.add_argument("--part-number", help="the only variant that counts; else it is taken from the file name")
    parser.add_argument("--url", help="address of the chat model")
    parser.add_argument("--model", default="llama-3")
    parser.add_argument("--api-key", help=f"else one of {', '.join(models.CREDENTIALS)}")
    parser.add_argument("--answer", help="file with an answer that stands in for the model's")
    parser.add_argument("--ledger", help="folder of the calls that were made; all machines share it")
    parser.add_argument("--attempts", type=int, default=3, help="calls for an answer, at most")
    parser.add_argument("--draw", action="store_true", help="write drawings too")
    parser.add_argument("-v", "--verbose", action="store_true", help="show the relevant pages")
    return parser


def page_id() -> Column:
    return F.concat_ws("#", "doc", "page_number").alias("doc_id")


def place_below(path: Column, folder: str) -> Column:
    """A document's path below the input folder, without its extension; its name if the input is the document itself."""
    below = F.when(F.contains(path, F.lit(f"{folder.rstrip('/')}/")), F.substring_index(path, f"{folder.rstrip('/')}/", -1)).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))
    return F.regexp_replace(below, r"(?<=[^/.])\.[^./]*$", "")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, environment: Mapping[str, str] | None = None) -> int:
    given = arguments().parse_args(argv)
    provider = painter = None
    try:
        folder = given.input if os.path.isdir(given.input) else providers.existing_input(given.input)
        if given.output and os.path.isfile(given.output):
            raise ValueError(f"not a folder: {given.output}")
        if given.answer:
            with open(given.answer, encoding="utf-8") as f:
                provider = providers.FixedAnswers(f.read())
        elif given.url and not given.list:
            provider = models.Chat(models.Options(url=given.url, model=given.model, api_key=models.credential(given.api_key, environment)))
        if given.layout_answer:
            with open(given.layout_answer, encoding="utf-8") as f:
                painter = providers.FixedAnswers(f.read())
        elif given.layout_url:
            painter = models.LayoutVision(models.Options(url=given.layout_url))
        if given.verify and provider is None and not given.list:
            raise ValueError("to verify pages, a model's address is needed")
    except (OSError, ValueError) as wrong:
        print(wrong, file=sys.stderr)
        return 2
    if spark is None:
        from .session import session

        spark = session()
    if given.list:
        for row in providers.files(spark, folder).select("path").orderBy("path").toLocalIterator():
            print(row.path)
        return 0

    whole = durable(providers.contents(providers.files(spark, folder), providers.PlainTextSource(), tables=True, images=True))  # decoded once
    fine = whole.where("error is null")
    found = fine.select("doc", page_id(), "page_number", "total_pages", "width", "height", "text")
    pictures = providers.images_in(whole).select("*", page_id())
    tables, images = providers.tables_in(whole).select("*", page_id()), pictures.drop("data")
    for row in whole.where("error is not null").select("doc", "error").orderBy("doc").toLocalIterator():
        print(f"{row.doc}: not read: {row.error}", file=sys.stderr)
    if given.verbose:
        for row in pages.relevant(pages.score(found, tables, images, given.min_confidence), given.min_confidence).orderBy("doc", "rank").toLocalIterator():
            print(f"{row.doc}: page {row.page_number}, score {row.score}: {'; '.join(row.reasons)}")
    if provider is None:
        print("neither a model's address nor an answer was given; stopping after the pages", file=sys.stderr)
        return 0
    book = ledger.Ledger(spark, given.ledger or (f"{given.output.rstrip('/')}/_ledger" if given.output else f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"), given.attempts)

    def confirmed(doubtful: DataFrame) -> DataFrame:
        asked = doubtful.join(found.select("doc_id", "text"), "doc_id").select("doc_id", F.to_json(responses.verification_prompt(F.col("text"))).alias("request"))
        return book.answered(asked, provider).select("doc_id", F.col("response").alias("answer"))

    def described(best: DataFrame) -> DataFrame:
        """By the largest picture of the page, the first of equals; pages without one aren't asked about."""
        largest = pictures.where("data is not null").groupBy("doc_id").agg(F.max_by("data", F.struct(F.col("width") * F.col("height"), -F.col("image_index"))).alias("image"))
        return book.answered(best.join(largest, "doc_id").withColumn("request", responses.layout_prompt()), painter, image="image")

    candidates = pipelines.chosen_pages(found, tables, images, given.min_confidence, ask=confirmed if given.verify else None, fallback=given.fallback)
    content = pipelines.text_flow(found, tables, images, candidates=candidates)
    name = F.regexp_extract("doc", r"([^/]+)$", 1)
    part = F.lit(given.part_number) if given.part_number else T.part_number(name)
    asked = content.select("doc", F.to_json(responses.pin_prompt(F.col("text_content"), part)).alias("request"))
    answers = book.answered(asked, provider).select(F.col("doc").alias("comp_id"), "response", "call_error")
    parsed = durable(responses.parsed_pins(answers).withColumn("error", F.coalesce("call_error", "error")))
    result = F.struct("component_name", "package", "pins", "extraction_method", "error")
    for row in fine.select("doc").distinct().join(parsed.select(F.col("comp_id").alias("doc")), "doc", "left_anti").orderBy("doc").toLocalIterator():
        print(f"{row.doc}: no relevant pages", file=sys.stderr)
    for row in parsed.where("error is null").select("comp_id", render.report(F.col("component_name"), F.col("package"), F.col("pins")).alias("report")).orderBy("comp_id").toLocalIterator():
        print(row.report)
    for row in parsed.where("error is not null").select("comp_id", "error").orderBy("comp_id").toLocalIterator():
        print(f"{row.comp_id}: {row.error}", file=sys.stderr)
    if given.output:
        formats.register(spark)
        place = place_below(F.col("comp_id"), os.path.abspath(folder))
        files = parsed.select(F.concat(place, F.lit(".json")).alias("name"), F.encode(F.to_json(result), "UTF-8").alias("content"))
        if given.draw:
            plain = durable(answers.select("comp_id", "response"))
            sections = pipelines.layout_sections(candidates, plain, described) if painter else None
            drawn = providers.drawing_files(pipelines.drawing_flow(plain, sections).withColumn("comp_id", place))
            files = files.unionByName(drawn.withColumn("name", F.concat(F.lit("drawings/"), "name")))
        try:
            files.write.format("leadframe_files").option("replace", "true").mode("append").save(given.output)
        except Exception as wrong:  # noqa: BLE001, whatever the file system says
            print(f"nothing was written: {wrong}", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
