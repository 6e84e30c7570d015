"""Plans: what is shuffled, and what the scan reads."""

import re

import pytest

from leadframe.plans.queries import QUERIES, flagship

from .conftest import DATA


def formatted(frame) -> str:
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def shuffled(plan: str) -> list[str]:
    """The input columns of every shuffle."""
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)


@pytest.mark.parametrize("name", ["p8_page_score", "p10_relevant_pages", "p13_retry_lower", "i4_image_pages", "o4_best_page", "s2_rescan"])
def test_page_text_is_never_shuffled(spark, name):
    plan = formatted(QUERIES[name](spark, f"{DATA}/sf0.001"))
    columns = shuffled(plan)
    assert columns and not any(re.search(r"\btext#", c) for c in columns), columns


def test_the_flagship_reads_what_it_needs(spark):
    plan = formatted(flagship(spark, f"{DATA}/sf0.001"))
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan)
    assert schemas and all(set(re.findall(r"(\w+):", s)) <= {"doc_id", "source", "text"} for s in schemas), schemas
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["c1_gated_extract", "c3_filter_fallback", "c10_pages_kept", "c11_filter_content", "c12_prompt_full", "flow_a_text"])
def test_pages_are_scored_once(spark, name):
    """What is left to do once the candidates are written down: a text, its tables twice and its images once are read."""
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 4 and plan.count("lower(") < 80, (plan.count("parquet"), plan.count("lower("))
    assert "heading_score" not in plan


def test_shared_parts_of_scores_are_columns_of_their_own(spark):
    plan = QUERIES["p8_page_score"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"lower\(_text", plan)) == 1 and len(re.findall(r"split\(_low", plan)) == 1


@pytest.mark.parametrize("name", ["k5_part_ranges", "d12_known_parts"])
def test_what_was_cut_into_many_rows_is_never_broadcast_by_a_guess(spark, name):
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize(("name", "joins"), [("b2_pin_primitives", 1), ("b4_assembly", 1), ("j1_pin_join", 1), ("b5_build", 0), ("s15_draw_rows", 0), ("flow_a_drawing", 0)])
def test_pins_are_shuffled_once_at_most(spark, name, joins):
    """Pins of answers lie beside their component; others meet it in one hash join, behind which places are reckoned."""
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == joins and "SortMergeJoin" not in plan and "rotation" not in " ".join(shuffled(plan))
    assert len(re.findall(r"explode\(sequence\(0", plan)) == 0


@pytest.mark.parametrize("name", ["c3_filter_fallback", "flow_a_text"])
def test_blocks_are_judged_one_by_one(spark, name):
    """A document's blocks meet its pages with pin tables in a join, and no row holds all of both."""
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "btrim(" not in plan


def test_keywords_meet_pieces_of_a_text_and_not_the_words_of_all_texts(spark):
    plan = QUERIES["p6_many_keywords"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "often" not in plan and "replace(_low" not in plan
