"""Whole flows: pages chosen with a model's help, and pins placed as a picture shows them."""

import json

from pyspark.sql import functions as F

from leadframe.__main__ import main
from leadframe.operators import content, layout
from leadframe.plans import pipelines

PAGES = "doc string, doc_id string, page_number int, total_pages int, width double, height double, text string"
TABLES = "doc string, doc_id string, table_index int, cells array<array<string>>"
IMAGES = "doc string, doc_id string, image_index int, width double, height double"
#: A heading scores 3, the middle of a document 1, a table 4, dense keywords 2.
HEAD, DENSE = "Pin Configuration\n", "pin vcc gnd reset"
PLAIN = " ".join(["so many words that none of them is one of those that are looked for"] * 5)


def pages_of(spark, docs):
    rows = [(d, f"{d}{k}", k, len(texts), 612.0, 792.0, t) for d, texts in docs.items() for k, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, PAGES)


def chosen(spark, docs, answers=None, **how):
    asked = []

    def ask(doubtful):
        asked.extend(r.doc_id for r in doubtful.collect())
        return spark.createDataFrame(list(answers.items()) or [("none", "")], "doc_id string, answer string")

    found = pipelines.chosen_pages(pages_of(spark, docs), spark.createDataFrame([], TABLES), spark.createDataFrame([], IMAGES), ask=None if answers is None else ask, **how)
    return sorted((r.doc_id, r.score) for r in found.collect()), sorted(asked)


DOCS = {"a": [HEAD + DENSE, HEAD + PLAIN], "b": [PLAIN, HEAD + PLAIN, PLAIN], "c": [PLAIN, None]}


def test_pages_without_help(spark):
    assert chosen(spark, DOCS) == ([("a1", 6)], [])


def test_lower_pages_only_where_there_are_no_others(spark):
    assert chosen(spark, DOCS, fallback=3)[0] == [("a1", 6), ("b2", 4)]
    assert chosen(spark, DOCS, fallback=4)[0] == [("a1", 6), ("b2", 4)]


def test_doubtful_pages_are_asked_about(spark):
    # Unusual pages (no table, no diagram) are doubtful, however they score.
    found, asked = chosen(spark, DOCS, {"a1": " no.", "a2": "Yes", "b2": None})
    assert asked == ["a1", "a2", "b2"]
    assert found == [("a2", 5), ("b2", 5)]


def test_a_refused_page_does_not_come_back(spark):
    assert chosen(spark, DOCS, {"a1": "NO", "a2": "no", "b2": "No"}, fallback=3)[0] == []


def test_no_pages(spark):
    assert chosen(spark, {}, {}, fallback=3) == ([], [])


def answer(kind, count, pins):
    return json.dumps({"component_name": "X", "package": {"type": kind, "pin_count": count}, "pins": [{"number": n, "name": f"P{n}"} for n in pins]})


def test_pins_lie_as_the_picture_shows_them(spark):
    docs = {d: [HEAD + DENSE, HEAD + DENSE + " pin"] for d in "abcdef"}
    pins = {d: answer("DIP", 4, [1, 2, 9]) for d in "abcde"} | {"f": "no JSON"}
    pictures = {"a": "Left Side: 2, 1\nRight Side: 9, 2", "b": json.dumps({"description": "```\nTop: 1-2\n```"}), "c": None, "d": "no sections: here"}
    asked = []

    def look(best):
        asked.extend(sorted((r.doc, r.page_number) for r in best.collect()))
        return best.join(spark.createDataFrame(list(pictures.items()), "doc string, response string"), "doc")

    page_rows, none = pages_of(spark, docs), spark.createDataFrame([], TABLES)
    images = spark.createDataFrame([], IMAGES)
    candidates = pipelines.candidate_pages(page_rows, none, images)
    answered = lambda content: content.select("doc").join(spark.createDataFrame(list(pins.items()), "doc string, response string"), "doc")
    drawn = pipelines.layout_flow(candidates, page_rows, none, images, answered, look)
    legs = {(r.comp_id, r.name): (r.x, r.y) for r in drawn.where("shape = 'box' and part = 'Legs'").collect()}

    assert asked == [(d, 1) for d in "abcde"]  # the first of equals, and no page of a document whose pins can't be read
    assert {k[1] for k in legs if k[0] == "a"} == {"1_leg", "2_leg", "9_leg"}
    assert legs["a", "2_leg"][0] > 0 > legs["a", "1_leg"][0] and legs["a", "9_leg"][0] > 0  # the later mention of pin 2 counts
    assert {k[1] for k in legs if k[0] == "b"} == {"1_leg", "2_leg"} and legs["b", "1_leg"][1] == legs["b", "2_leg"][1] > 0
    plain = spark.createDataFrame([("p", "DIP", 4)], "comp_id string, package string, pins int")
    want = {r.pin_number: (r.x, r.y) for r in layout.positions(layout.parameters(plain, "package", "pins")).collect()}
    for doc in "cde":
        assert {k[1]: v for k, v in legs.items() if k[0] == doc} == {f"{n}_leg": want[n] for n in ("1", "2")}
    assert drawn.where(F.col("comp_id") == "f").count() == 0


def test_command_line_draws_by_the_picture(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "A.pdf").write_text("\f".join([PLAIN, HEAD + PLAIN, PLAIN]))  # scores 4
    (tmp_path / "pins").write_text(answer("DIP", 2, [1, 2]))
    (tmp_path / "layout").write_text("Bottom Edge: 2, 1")
    said = [str(folder), "--output", str(out), "--answer", str(tmp_path / "pins"), "--layout-answer", str(tmp_path / "layout"), "--draw"]
    assert main(said, spark) == 0 and not (out / "A.json").exists()
    assert main([*said, "--fallback", "3", "--verify"], spark) == 0 and (out / "A.json").exists()
    legs = [p for p in json.loads((out / "drawings" / "A.json").read_text())["primitives"] if p["name"].endswith("_leg")]
    assert len(legs) == 2 and len({p["y"] for p in legs}) == 1  # side by side at the bottom; a DIP has them left and right
    assert legs[0]["y"] < 0
    assert main([str(folder), "--verify"], spark) == 2


def test_content_by_page_is_content_by_document(spark):
    odd = ["x\n--- Page 2 ---\nPinout\n--- Page x ---\ntail", "Pin Configuration\n--- Page 7 ---", "plain\n", None, "", "--- Page 1 ---\n\nof another page", "Pin Description\n--- Page y ---\nz"]
    docs = {f"d{k}": odd[k:] + odd[:k] for k in range(len(odd))} | {"plain": ["nothing", "here", None], "one": [""], "src1": ["Pinout", "b"]}
    candidates = spark.createDataFrame([(d, f"{d}{k}", k, 5 + k % 3, k % 2 == 1, k % 3 == 1) for d, texts in docs.items() for k in range(1, len(texts) + 1)], "doc string, doc_id string, page_number int, score int, has_table boolean, has_diagram boolean")
    heads = [["Pin No.", "Pin Name"], ["a", "b"], ["Function"]]
    tables = spark.createDataFrame([(d, f"{d}{k}", k % 2, [heads[k % 3], ["1"]][: 1 + (k > 1)]) for d, texts in docs.items() for k in range(1, len(texts) + 1)], TABLES)
    images = spark.createDataFrame([(d, f"{d}1", 0, 1.0, 1.0) for d in docs], IMAGES)
    instead = F.when(F.col("doc") == "src1", F.lit("no marker here")).when(F.col("doc") == "d1", F.lit("--- Page 9 ---\nPinout\n\n--- Page 2 ---\nx"))
    full = content.extracted(candidates, pages_of(spark, docs), tables, images)
    rows = lambda frame: sorted((r.asDict(recursive=True) for r in frame.collect()), key=lambda r: r["doc"])
    assert rows(content.filtered_pages_or_all(candidates, pages_of(spark, docs), tables, images)) == rows(content.filtered_or_all(full))
    assert rows(content.filtered_pages(candidates, pages_of(spark, docs), tables, images).select(*full.columns)) == rows(content.filtered(full))
    replaced = full.withColumn("text_content", F.coalesce(instead, "text_content"))
    assert rows(content.filtered_pages_or_all(candidates, pages_of(spark, docs), tables, images, instead)) == rows(content.filtered_or_all(replaced))
