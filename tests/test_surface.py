"""SQL functions against the column functions they stand for."""

import re

import pytest
from pyspark.sql import functions as F

from leadframe.functions import rules, surface
from leadframe.functions import text as T
from leadframe.operators import content, packages, pages, responses
from leadframe.plans.queries import QUERIES

from .conftest import DATA
from .test_plans import formatted, shuffled

TEXTS = [
    None, "", " ", "Pin Configuration\nvcc gnd", "a\n" * 10 + "pinout", "PINOUT's \\d no connect no\\s*connect NC", "--- Page 3 ---\nx\ny\n --- Page  4---\n--- Page z ---\nq\n--- Page 5 ---\nlast",
    "junk\n--- Page 7 ---\n", "pdip-40", "Dual  in line", " sop ", "x\x0b", "NO\x0c", " yes", "not", "ABC-1.x.pdf", ".pdf", "ABC", "12-a.PDF", "lower.pdf", "pin diagram " * 300, "ﬁgure 1-1. pinout é",
]
COLUMNS = {
    "heading": pages.heading_pattern,
    "caption": lambda c: T.first_match(F.lower(c), rules.CAPTION_PATTERNS),
    "keyword_count": pages.keyword_count,
    "package_type": packages.from_text,
    "package_name": packages.normalized,
    "part_number": T.part_number,
    "says_yes": responses.says_yes,
    "blocks": content.blocks,
}


@pytest.fixture
def texts(spark):
    surface.register(spark)
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_scalars(texts, name):
    got = texts.selectExpr("id", "t", f"lf_{name}(t) AS x").select("t", "x", COLUMNS[name](F.col("t")).alias("y")).collect()
    assert len(got) == len(TEXTS) and not [r for r in got if r.x != r.y]


def test_headers(spark, texts):
    rows = [(None,), ([],), (["Pin No.", None, "FUNCTION"],), (["Symbol", "Description"],), ([None],)]
    got = spark.createDataFrame(rows, "h array<string>").select(F.expr("lf_table_matches(h)").alias("x"), T.count_matches(pages.header_text(F.array("h")), rules.TABLE_PATTERNS).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] == [None, 0, 2, 2, 0]


def test_features(spark, texts):
    names = ["heading", "caption", "keywords", "words", "short"]
    want = pages.features(texts.withColumnRenamed("t", "text")).orderBy("id").select(*names).collect()
    assert texts.selectExpr("id", "lf_page_features(t) AS f").orderBy("id").select("f.*").collect() == want


def test_rules_of_the_caller_and_a_schema(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS drawn")
    own = rules.PageRules(headings=["it's", r"a\d"], captions=[], keywords=["'", "x\\y"])
    made = surface.register(spark, "drawn", own)
    try:
        row = spark.sql(r"SELECT drawn.lf_heading('B\nIT''S a1') h, drawn.lf_caption('pinout') c, drawn.lf_keyword_count('''x\\y x\\Y''') k").first()
        assert (row.h, row.c, row.k) == ("it's", None, 4)
    finally:
        for name in made:
            spark.sql(f"DROP FUNCTION {name}")
        spark.sql("DROP DATABASE drawn")


def test_plans(spark):
    plan = QUERIES["p8_page_score_sql"](spark, f"{DATA}/sf0.001")._jdf.queryExecution()
    assert not any(w in plan.toString() for w in ("Python", "NestedLoop", "Cartesian"))
    found = plan.optimizedPlan().toString()
    assert len(re.findall(r"lower\(lambda whole", found)) == 1 and len(re.findall(r"split\(lambda low", found)) == 1, found
    columns = shuffled(formatted(QUERIES["p8_page_score_sql"](spark, f"{DATA}/sf0.001")))
    assert columns and not any(re.search(r"\btext#", c) for c in columns)
