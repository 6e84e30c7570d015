"""The ledger of calls: who is asked how often, after failures, killed tasks and killed runs."""

import os
import subprocess
import sys
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadframe.sources import ledger, models, providers

REQUESTS = "id long, request string"


class Counting:
    """Leaves a file for each call that it answers. With `die`, the first process that gets this request dies of it."""

    def __init__(self, folder, die=None, fails=()):
        self.folder, self.die, self.fails = str(folder), die, fails

    def answer(self, request, image=None):
        if request == self.die:
            try:
                os.close(os.open(os.path.join(self.folder, "died"), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                pass
            else:
                os._exit(1)
        with open(os.path.join(self.folder, f"{request}-{uuid.uuid4().hex}"), "w"):
            pass
        if request in self.fails:
            raise TimeoutError(request)
        return None if request == "silent" else f"to {request}"


def calls(folder):
    return Counter(name.rpartition("-")[0] for name in os.listdir(folder) if name != "died")


def test_equal_requests_are_one_call_and_nothing_is_asked_again(spark, tmp_path):
    (made := tmp_path / "made").mkdir()
    rows = [(i, f"r{i % 7}") for i in range(50)] + [(50, None), (51, "bad"), (52, "silent"), (None, "r0")]
    frame = spark.createDataFrame(rows, REQUESTS).withColumns({c: F.lit("x") for c in ("digest", "attempt", "outcome", "tried", "image")})
    book = ledger.Ledger(spark, str(tmp_path / "book"), attempts=3, pause=0.0, per_task=2)
    provider = Counting(made, fails=("bad",))
    got = {(r.id, r.request): (r.response, r.attempts, r.call_error) for r in book.answered(frame, provider).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = {None: (None, 0, None), "bad": (None, 3, "TimeoutError: bad"), "silent": (None, 3, "no answer")}
        assert got[i, text] == want.get(text, (f"to {text}", 1, None))
    assert calls(made) == {**{f"r{k}": 1 for k in range(7)}, "bad": 3, "silent": 3}
    more = frame.unionByName(spark.createDataFrame([(99, "new")], REQUESTS), allowMissingColumns=True)
    assert book.answered(more, provider).where("response is not null").count() == 52
    assert calls(made) == {**{f"r{k}": 1 for k in range(7)}, "bad": 3, "silent": 3, "new": 1}
    patient = ledger.Ledger(spark, str(tmp_path / "book"), attempts=5, pause=0.0)
    patient.ask(frame, Counting(made))  # it answers now, but for the silent one
    assert calls(made)["bad"] == 4 and calls(made)["silent"] == 5
    assert sorted((r.attempt, r.outcome) for r in patient.calls().where("error like '%bad' or response = 'to bad'").collect()) == [(1, "failed"), (2, "failed"), (3, "failed"), (4, "answered")]


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    (made := tmp_path / "made").mkdir()
    frame = spark.createDataFrame([(i, f"r{i}") for i in range(60)], REQUESTS)
    book = ledger.Ledger(spark, str(tmp_path / "book"), per_task=20)
    provider = Counting(made, die="r30")
    with pytest.raises(Exception, match="crashed|exited"):
        book.ask(frame, provider)  # the session gives a task one chance only
    before = sum(calls(made).values())
    assert before and book.calls().count() == 0
    got = book.answered(frame, provider)
    assert got.where("response = concat('to ', request) and attempts = 1").count() == 60
    assert set(calls(made).values()) == {1} and len(calls(made)) == 60
    assert not os.path.exists(tmp_path / "book/notes") and not os.path.exists(tmp_path / "book/pending")


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from leadframe.session import session
from leadframe.sources import ledger
from tests.test_ledger import REQUESTS, Counting
spark = session("local[2,4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
frame = spark.createDataFrame([(i, f"r{{i}}") for i in range(40)], REQUESTS)
book = ledger.Ledger(spark, {book!r}, per_task=10, flush={flush})
print("ROWS", book.answered(frame, Counting({made!r}, die="r20")).where("response is not null").count())
"""


@pytest.mark.parametrize("flush", [1, 8])
def test_a_killed_task_asks_nobody_twice(tmp_path, flush):
    (made := tmp_path / "made").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    text = SCRIPT.format(root=root, book=f"file://{tmp_path}/book", made=str(made), flush=flush)
    done = subprocess.run([sys.executable, "-c", text], capture_output=True, text=True, timeout=300, cwd=root)
    assert "ROWS 40" in done.stdout, done.stderr[-2000:]
    asked = calls(made)
    assert os.path.exists(made / "died") and len(asked) == 40
    assert sum(n - 1 for n in asked.values()) <= flush - 1 and max(asked.values()) <= 2


def test_the_key_of_the_provider_and_the_picture(spark):
    a, b = models.Options(url="u", api_key="one"), models.Options(url="u", api_key="two", timeout=3.0)
    assert ledger.identity(models.Chat(a)) == ledger.identity(models.Chat(b)) != ledger.identity(models.Chat(a.changed(temperature=0.5)))
    assert ledger.identity(models.Vision(a)) != ledger.identity(models.LayoutVision(a))
    frame = spark.createDataFrame([("q", b"1"), ("q", b"2"), ("q", None), ("q", b"1")], "request string, image binary")
    digests = [r[0] for r in frame.select(ledger.digest_of(models.Vision(a), F.col("request"), F.col("image"))).collect()]
    assert len(set(digests)) == 3 and digests[0] == digests[3]


def test_pictures_go_along_and_rows_without_one_are_not_asked(spark, tmp_path):
    class Size:
        def answer(self, request, image=None):
            return f"{request} {len(image)}"

    frame = spark.createDataFrame([(1, "q", b"123"), (2, "q", None), (3, "q", b"")], "id long, request string, image binary")
    got = ledger.Ledger(spark, str(tmp_path / "book")).answered(frame, Size(), image="image").select("id", "response", "attempts").collect()
    assert sorted(map(tuple, got)) == [(1, "q 3", 1), (2, None, 0), (3, "q 0", 1)]


def test_a_missing_credential_is_an_error_of_the_driver(spark, tmp_path, monkeypatch):
    for name in models.CREDENTIALS:
        monkeypatch.delenv(name, raising=False)
    frame = spark.createDataFrame([(1, "[]")], REQUESTS)
    chat = models.Chat(models.Options(url="http://nowhere"))
    with pytest.raises(models.MissingCredential):
        ledger.Ledger(spark, str(tmp_path / "book")).answered(frame, chat)
    with pytest.raises(models.MissingCredential):
        providers.answered(frame, chat)
    monkeypatch.setenv(models.CREDENTIALS[1], "k")
    assert chat.prepared().options.api_key == "k"


def test_a_failed_call_tells_why(spark):
    rows = providers.answered(spark.createDataFrame([(1, "q")], REQUESTS), Counting("/nowhere/at/all")).collect()
    assert rows[0].response is None and rows[0].call_error.startswith("FileNotFoundError")


def test_an_empty_table_asks_nobody(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    assert book.answered(spark.createDataFrame([], REQUESTS), Counting(tmp_path)).count() == 0 and book.calls().count() == 0
