"""Files, providers, sinks and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from leadframe.sources import models, providers
from leadframe.streaming import arrivals


def test_files_pages_and_images(spark, tmp_path):
    (tmp_path / "a.PDF").write_text("Pin Configuration\fnothing")
    (tmp_path / "b.txt").write_text("x")
    found = providers.files(spark, str(tmp_path))
    assert found.count() == 1
    rows = providers.decoded(found, providers.PlainTextSource()).orderBy("page_number").collect()
    assert [(r.page_number, r.total_pages, r.text) for r in rows] == [(1, 2, "Pin Configuration"), (2, 2, "nothing")]
    assert providers.page_images(found, providers.PlainTextSource()).count() == 2


def test_a_bad_document_or_call_stops_nobody(spark):
    class Picky(providers.PlainTextSource):
        def decode(self, path, content):
            if path == "bad":
                raise ValueError(path)
            return super().decode(path, content)

        def answer(self, request, image=None):
            return self.decode(request, b"ok") and "fine"

    frame = spark.createDataFrame([("good", b"x"), ("bad", b"y")], "path string, content binary")
    assert [r.doc for r in providers.decoded(frame, Picky()).collect()] == ["good"]
    answers = providers.answered(frame.select(F.col("path").alias("request")), Picky()).collect()
    assert {r.request: r.response for r in answers} == {"good": "fine", "bad": None}


def test_export_writes_on_the_executors(spark, tmp_path):
    folder = str(tmp_path)

    def write(rows):
        for r in rows:
            with open(os.path.join(folder, r.name), "wb") as f:
                f.write(r.data)

    providers.export(spark.createDataFrame([("p.png", bytearray(b"1")), ("q.png", bytearray(b"2"))], "name string, data binary"), write)
    assert sorted(os.listdir(folder)) == ["p.png", "q.png"]


def test_arriving_files_are_scored(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "a.txt").write_text("Pin Configuration vcc gnd\fother words only\fthird")
    scores = arrivals.text_scores(arrivals.arriving(spark, str(inbox)), providers.PlainTextSource())
    query = arrivals.into(scores, str(out), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.page_number: r.score for r in spark.read.parquet(str(out)).collect()}
    assert got == {1: 6, 2: 1, 3: 0}


def test_credentials_in_their_order():
    names = {"LEADFRAME_API_KEY": "one", "CHAT_API_KEY": "two"}
    assert models.credential("own", names) == "own" and models.credential(None, names) == "one"
    assert models.credential(None, {"CHAT_API_KEY": "two", "LEADFRAME_API_KEY": ""}) == "two"
    with pytest.raises(models.MissingCredential):
        models.credential(None, {})


def test_chat_takes_the_first_choice_and_failures_are_null(spark):
    def transport(url, headers, body, timeout):
        asked = json.loads(body)
        if asked["messages"][0]["content"] == "fail":
            raise OSError(url)
        return json.dumps({"choices": [{"message": {"content": f"{asked['model']}:{asked['max_tokens']}:{headers['Authorization']}:{timeout}"}}, {}]}).encode()

    chat = models.Chat(models.Options(url="http://x", api_key="k").changed(model="m"), transport)
    requests = spark.createDataFrame([(json.dumps([{"role": "user", "content": c}]),) for c in ("a", "fail")], "request string")
    assert sorted((r.response or "") for r in providers.answered(requests, chat).collect()) == ["", "m:8192:Bearer k:120.0"]


def test_vision_sends_a_form_and_layouts_fall_back():
    sent = []

    def transport(url, headers, body, timeout):
        sent.append((headers["Content-Type"], body))
        return sent[0][1] and replies.pop(0)

    replies = [b'{"description": "```json\\n{}\\n```"}', b"not json", b'{"other": 1}', b"whole"]
    layout = models.LayoutVision(models.Options(url="http://x"), transport)
    assert [layout.answer("read", b"PNG") for _ in range(3)] == ["{}", "not json", '{"other": 1}']
    assert models.Vision(models.Options(), transport).answer("p", b"PNG") == "whole" and layout.answer("p") is None
    mark = sent[0][0].split("boundary=")[1].encode()
    assert sent[0][1].count(mark) == 4 and b'name="prompt"\r\n\r\nread\r\n' in sent[0][1] and b"PNG\r\n--" + mark + b"--" in sent[0][1]


def test_exporters_tell_what_was_written(spark, tmp_path):
    images = spark.createDataFrame([("a b", 1, 0, bytearray(b"1")), ("a b", 1, 1, None), ("c", 2, 0, bytearray(b"3"))], "doc string, page_number int, image_index int, data binary")
    done = providers.exported(providers.image_files(images), providers.FolderExporter(str(tmp_path))).collect()
    assert {r.name: r.written for r in done} == {"a_b/page_1_img_0.png": True, "c/page_2_img_0.png": True}
    assert (tmp_path / "c" / "page_2_img_0.png").read_bytes() == b"3"
    rows = spark.createDataFrame([(7, "Legs", 1.5), (7, "BodyLine", None)], "comp_id int, part string, x double")
    assert all(r.written for r in providers.exported(providers.drawing_files(rows), providers.FolderExporter(str(tmp_path))).collect())
    assert json.loads((tmp_path / "7.json").read_text()) == {"comp_id": 7, "primitives": [{"part": "BodyLine"}, {"part": "Legs", "x": 1.5}]}
    (tmp_path / "file").write_text("")
    assert [r.written for r in providers.exported(providers.drawing_files(rows), providers.FolderExporter(str(tmp_path / "file"))).collect()] == [False]


def test_inputs_that_are_not_there_or_no_documents(tmp_path):
    (tmp_path / "a.Pdf").write_text("x")
    (tmp_path / "b.txt").write_text("x")
    assert providers.existing_input(str(tmp_path / "a.Pdf"))
    with pytest.raises(FileNotFoundError):
        providers.existing_input(str(tmp_path / "c.pdf"))
    with pytest.raises(ValueError):
        providers.existing_input(str(tmp_path / "b.txt"))


def test_command_line(spark, tmp_path, capsys):
    from leadframe.__main__ import main

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    page = "Pin Configuration\nvcc gnd reset pin input output vcc gnd"
    (folder / "PART-1.PDF").write_text("\f".join(["cover", "more", page, "other", "last"]))
    (folder / "notes.txt").write_text(page)
    answer = '{"component_name": "PART-1", "package": {"type": "DIP", "pin_count": 2}, "pins": [{"number": 1, "name": "VCC"}, {"number": 2, "name": "GND"}]}'
    (tmp_path / "answer.json").write_text(answer)
    assert main([str(folder), "--output", str(out), "--answer", str(tmp_path / "answer.json"), "--draw", "--verbose"], spark) == 0
    shown = capsys.readouterr().out
    assert "page 3" in shown and "Component: PART-1" in shown and "Pin 2: GND" in shown
    assert json.loads((out / "PART-1.json").read_text())["pins"][1] == {"number": 2, "name": "GND"}
    assert (out / "drawings").is_dir() and len(os.listdir(out / "drawings")) == 1
    assert main([str(folder), "--list"], spark) == 0 and "PART-1.PDF" in capsys.readouterr().out
    assert main([str(tmp_path / "nowhere")], spark) == 2
    assert main([str(folder), "--url", "http://x"], spark, environment={}) == 2


class Broken(providers.PlainTextSource):
    """Fails on the second page of documents that say so."""

    def decode(self, path, content):
        for page in super().decode(path, content):
            if page["text"] == "broken":
                raise ValueError("torn page")
            yield page


def test_a_document_is_decoded_whole_or_not_at_all(spark):
    rows = [("a", b"1\fbroken\f3"), ("b", b"x|y|\n1||2\nno\nz|"), ("c", b"")]
    frame = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    whole = providers.contents(frame, Broken(), tables=True, images=True).collect()
    assert [(r.doc, r.page_number, r.error) for r in whole] == [("a", None, "ValueError: torn page"), ("b", 1, None), ("c", 1, None)]
    assert whole[1].tables == [[["x", "y"], ["1", None, "2"]], [["z"]]]
    assert [r.doc for r in providers.decoded(frame, Broken()).collect()] == ["b", "c"] == [r.doc for r in providers.page_images(frame, Broken()).collect()]


def test_command_line_over_folders(spark, tmp_path, capsys):
    from leadframe.__main__ import main

    folder, out = tmp_path / "in", tmp_path / "out"
    page = "Pin Configuration\nvcc gnd reset pin input output vcc gnd"
    table = "x\nPin No. | Symbol | Function\n1 | VCC | power"  # no heading: the table's columns make it relevant
    for name, text in (("a/X.PDF", "cover\fmore\f" + page), ("b/X.pdf", "\f".join(["c", "d", table, "e", "f"])), ("c.pdf", "nothing")):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    answer = '{"component_name": "N", "package": {"type": "DIP", "pin_count": 2}, "pins": [{"number": 1, "name": "VCC"}]}'
    (tmp_path / "answer.json").write_text(answer)
    asked = ["--output", str(out), "--answer", str(tmp_path / "answer.json"), "--draw", "-v"]
    assert main([str(folder), *asked], spark) == 0
    shown = capsys.readouterr()
    assert "b/X.pdf: page 3" in shown.out and "table columns: 3" in shown.out and "c.pdf: no relevant pages" in shown.err
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*.json") if not str(p.relative_to(out)).startswith("_")) == ["a/X.json", "b/X.json", "drawings/a/X.json", "drawings/b/X.json"]
    assert spark.read.parquet(f"{out}/_ledger/calls").count() == 2
    assert main([str(folder), *asked], spark) == 0 and spark.read.parquet(f"{out}/_ledger/calls").count() == 2  # nobody is asked again
    assert main([str(folder), *asked[2:], "--output", str(tmp_path / "answer.json")], spark) == 2
