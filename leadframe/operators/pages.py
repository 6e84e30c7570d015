"""Scoring of pages by headings, tables, diagrams, keyword density and position.

pages: doc, page_number, total_pages, width, height, text and an id `doc_id` that tables and images share.
tables: doc_id, table_index, cells (array of rows of cells). images: doc_id, image_index, width, height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T

KEY = "doc_id"
LOW, HIGH = 0.2, 0.7


def heading_pattern(text: Column, patterns: list[str] = rules.HEADING_PATTERNS) -> Column:
    """The first heading pattern found in one of the first ten lines, or null."""
    return T.let(T.first_lines(F.lower(text), 10), lambda head: T.first_match(head, patterns))


def header_text(cells: Column) -> Column:
    return F.lower(T.cells_text(cells[0], ""))


def table_scores(tables: DataFrame, patterns: list[str] = rules.TABLE_PATTERNS) -> DataFrame:
    """(doc_id, table_matches): the matches in the header of the page's first table with two or more of them."""
    fit = tables.where(F.size("cells") >= 2).select(KEY, "table_index", T.count_matches(header_text(F.col("cells")), patterns).alias("matches"))
    return fit.where("matches >= 2").groupBy(KEY).agg(F.min(F.struct("table_index", "matches")).alias("first")).select(KEY, F.col("first.matches").alias("table_matches"))


def image_areas(images: DataFrame) -> DataFrame:
    area = F.coalesce("width", F.lit(0.0)) * F.coalesce("height", F.lit(0.0))
    return images.groupBy(KEY).agg(F.sum(area).alias("image_area"))


def keyword_count(text: Column, keywords: list[str] = rules.DENSITY_KEYWORDS) -> Column:
    return count_in(F.lower(text), keywords)


def count_in(low: Column, keywords: list[str]) -> Column:
    return sum((T.occurrences(low, k) for k in keywords), F.lit(0))


def in_position(page: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(page.cast("double"), total.cast("double")).between(LOW, HIGH), F.lit(False))


def features(pages: DataFrame, rule_set: rules.PageRules = rules.PAGE_RULES) -> DataFrame:
    """Pages without their text, with what the scores need of it. This is a projection: the text is read where it lies."""
    rest = [c for c in pages.columns if c != "text"]
    # In steps, so that what many expressions share is a column of its own and is computed once.
    text = pages.select(*rest, T.text_or_empty(F.col("text")).alias("_text"))
    low = text.withColumn("_low", F.lower("_text")).withColumn("_head", T.first_lines(F.col("_low"), 10))
    found = {
        "heading": T.first_match(F.col("_head"), rule_set.headings),
        "caption": T.first_match(F.col("_low"), rule_set.captions),
        "keywords": count_in(F.col("_low"), rule_set.keywords),
        "words": T.word_count(F.col("_text")),
        "short": F.length(T.strip(F.col("_text"))) < 100,
    }
    return low.select(*rest, *(c.alias(k) for k, c in found.items()))


def score(pages: DataFrame, tables: DataFrame, images: DataFrame, min_score: int = 5, verify_from: int = 3, numbers: DataFrame | None = None, rule_set: rules.PageRules = rules.PAGE_RULES) -> DataFrame:
    """Every page with its parts, score, reasons and verification mark, and without its text; join the pages on doc_id for
    that. Only what was found in the text goes into joins.

    `numbers` (doc_id, page_number, total_pages, width, height) gives the numbers of pages that come without them;
    `rule_set` holds patterns and keywords of the caller."""
    parts = features(pages, rule_set)
    if numbers is not None:
        parts = parts.join(numbers.select(KEY, "page_number", "total_pages", "width", "height"), KEY)
    return scored_with(parts, table_scores(tables, rule_set.tables), image_areas(images), min_score, verify_from)


def scored_with(parts: DataFrame, table_matches: DataFrame, areas: DataFrame, min_score: int = 5, verify_from: int = 3) -> DataFrame:
    """`score` of features with numbers, from `table_scores` and `image_areas`. The features may be a stream."""
    parts = parts.withColumn("positioned", in_position(F.col("page_number"), F.col("total_pages")))
    joined = parts.join(table_matches, KEY, "left").join(areas, KEY, "left")
    covered = F.coalesce(F.try_divide(F.col("image_area"), F.col("width") * F.col("height")), F.lit(0.0))
    flags = joined.withColumns(
        {
            "has_table": F.col("table_matches").isNotNull(),
            "has_diagram": (covered >= LOW) & F.col("caption").isNotNull(),
            "dense": F.coalesce(F.try_divide(F.col("keywords").cast("double"), F.col("words").cast("double")) * 100 >= 2, F.lit(False)),
        }
    )
    points = {"heading_score": F.col("heading").isNotNull().cast("int") * 3, "table_score": F.col("has_table").cast("int") * 4, "diagram_score": F.col("has_diagram").cast("int") * 2, "keyword_score": F.col("dense").cast("int") * 2, "position_score": F.col("positioned").cast("int")}
    scored = flags.withColumns(points)
    scored = scored.withColumn("score", sum((F.col(c) for c in list(points)[1:]), F.col("heading_score")))
    reasons = [
        F.when(F.col("heading_score") > 0, F.concat(F.lit("heading: "), "heading")),
        F.when(F.col("table_score") > 0, F.concat(F.lit("table columns: "), F.col("table_matches").cast("string"))),
        F.when(F.col("diagram_score") > 0, F.concat(F.lit("diagram caption: "), "caption")),
        F.when(F.col("keyword_score") > 0, F.concat(F.lit("keywords: "), F.col("keywords").cast("string"), F.lit(" in "), F.col("words").cast("string"))),
        F.when(F.col("position_score") > 0, F.lit("position")),
    ]
    unusual = ((F.col("score") >= 2) & ~F.col("has_table") & ~F.col("has_diagram")) | (F.col("short") & F.col("has_diagram"))
    return scored.withColumns({"reasons": F.filter(F.array(*reasons), lambda r: r.isNotNull()), "unusual": unusual}).withColumn(
        "needs_verification", F.col("unusual") | F.col("score").between(verify_from, min_score - 1)
    )


def relevant(scored: DataFrame, min_score: int = 5) -> DataFrame:
    """Pages that score enough, with their rank in the document: best first, ties by page."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc").orderBy(F.desc("score"), "page_number")
    return scored.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(order))


def low_confidence(scored: DataFrame, threshold: int = 4) -> DataFrame:
    return scored.where((F.col("score") >= threshold) & (F.col("score") < 5))


def relevant_or_lower(scored: DataFrame, min_score: int = 5, fallback: int = 3) -> DataFrame:
    """Pages at `min_score`; of documents that have none, those at `fallback`."""
    best = scored.groupBy("doc").agg((F.max("score") >= min_score).alias("enough"))
    return scored.join(best, "doc").where(F.col("score") >= F.when(F.col("enough"), min_score).otherwise(fallback)).drop("enough")


def verified(scored: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages after verification: unmarked pages pass, marked ones stay if the answer says so and then score 5.

    answers: doc_id, answer. A missing answer counts as a failed call, which says yes."""
    from .responses import says_yes

    joined = scored.join(answers.select(KEY, "answer"), KEY, "left")
    keep = joined.where(~F.col("needs_verification") | says_yes(F.col("answer")))
    score = F.when(F.col("needs_verification"), 5).otherwise(F.col("score"))
    reasons = F.when(F.col("needs_verification"), F.array_append("reasons", F.lit("verified"))).otherwise(F.col("reasons"))
    return keep.withColumns({"score": score, "reasons": reasons})
