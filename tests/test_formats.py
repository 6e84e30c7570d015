"""The data source of pages and the committing sink of files."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from leadframe.sources import formats


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def written(folder, files):
    for name, content in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(content)
    return str(folder)


def found(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


DOCUMENTS = {
    "a.txt": "one\ftwo\f\fföur".encode(), "b.TXT": b"", "sub/c.txt": b"\f", "sub/d.txt": b"x" * 40 + b"\f" + b"y" * 3 + b"\f", "e.md": b"no",
    "bad.txt": b"fine\f\xff\xfe\fagain",
}


@pytest.mark.parametrize("per_task", [1, 2, 3, 7, 1 << 20])
def test_ranges_of_any_size_give_the_same_pages(known, tmp_path, per_task):
    folder = written(tmp_path, DOCUMENTS)
    rows = known.read.format("leadframe_pages").option("bytesPerTask", per_task).load(folder).collect()
    want = []
    for name, content in DOCUMENTS.items():
        parts = content.split(b"\f") if name.lower().endswith(".txt") else []
        for i, p in enumerate(parts, 1):
            bad = b"\xff" in p
            want.append((f"{folder}/{name}", i, len(parts), len(p), None if bad else p.decode(), "byte 0: invalid start byte" if bad else None))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_one_document_is_read_by_several_tasks(known, tmp_path):
    pages = [f"page {i} " + "w " * 500 for i in range(1, 201)]
    folder = written(tmp_path, {"long.txt": "\f".join(pages).encode()})
    frame = known.read.format("leadframe_pages").option("bytesPerTask", 20_000).load(folder)
    per_task = [r[0] for r in frame.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(per_task) > 5 and max(per_task) < 60
    assert [r.text for r in frame.orderBy("page_number").select("text").collect()] == pages
    small = written(tmp_path / "small", {f"{i}.txt": b"x" for i in range(100)})
    assert known.read.format("leadframe_pages").load(small).rdd.getNumPartitions() == 1


def test_filters_and_columns_reach_the_source(known, tmp_path):
    folder = written(tmp_path, {"a.txt": b"1\f\xff\f3\f4", "b.txt": b"1\f2"})
    frame = known.read.format("leadframe_pages").load(folder)
    picked = frame.where((F.col("page_number") >= 3) & (F.col("page_number") < 4) & (F.col("doc") == f"{folder}/a.txt")).select("text", "error")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in picked.collect()] == [("3", None)] and "page_number >= 3" not in plan.split("BatchScan")[0]
    assert sorted(r.page_number for r in frame.where("page_number in (2, 9) and n_bytes > 0").collect()) == [2, 2]
    numbers = known.read.format("leadframe_pages").schema("doc string, page_number int").load(folder)
    assert numbers.columns == ["doc", "page_number"] and numbers.count() == 6
    undecoded = known.read.format("leadframe_pages").schema("n_bytes long").load(folder)
    assert sorted(r[0] for r in undecoded.collect()) == [1] * 6
    with pytest.raises(Exception, match="not among"):
        known.read.format("leadframe_pages").schema("words int").load(folder).collect()
    with pytest.raises(Exception, match="nowhere"):
        known.read.format("leadframe_pages").load(f"{folder}/nowhere").collect()


def save(frame, folder, **options):
    frame.write.format("leadframe_files").options(**options).mode("append").save(str(folder))


FILES = "name string, content binary"


def test_files_and_manifest(known, tmp_path):
    rows = [(f"{k}/x.json", f"of {k}".encode()) for k in "abc"] + [("none", None)]
    save(known.createDataFrame(rows, FILES).repartition(3), tmp_path)
    assert {n: (tmp_path / n).read_bytes() for n, _ in rows} == {n: c or b"" for n, c in rows}  # equal stems are different files
    save(known.createDataFrame([("later", b"1")], FILES), f"file://{tmp_path}")
    listed = formats.manifest(known, str(tmp_path)).collect()
    assert sorted(r.name for r in listed) == ["a/x.json", "b/x.json", "c/x.json", "later", "none"] and len({r.job for r in listed}) == 2
    others = [f for f in found(tmp_path) if not f.startswith("_manifest/")]
    assert sorted(others) == sorted(r.name for r in listed)


@pytest.mark.parametrize("rows,said", [([("x", b"1"), ("x", b"2")], "twice"), ([("there", b"2")], "exist"), ([("../up", b"1")], "not a name"), ([("/root", b"1")], "not a name"), ([("_manifest/x", b"")], "not a name"), ([(None, b"1")], "not a name")])
def test_nothing_is_written_of_a_job_that_may_not(known, tmp_path, rows, said):
    save(known.createDataFrame([("there", b"1")], FILES), tmp_path)
    before = found(tmp_path)
    with pytest.raises(Exception, match=said):
        save(known.createDataFrame([("fine", b"1"), *rows], FILES).repartition(3), tmp_path)
    assert [f for f in found(tmp_path) if not f.startswith("_staging/")] == before and (tmp_path / "there").read_bytes() == b"1"
    save(known.createDataFrame([("there", b"3")], FILES), tmp_path, replace="true")
    assert (tmp_path / "there").read_bytes() == b"3"


def test_a_failing_task_leaves_nothing(known, tmp_path):
    rows = known.range(0, 40, 1, 4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise(F.encode(F.lit("x"), "UTF-8")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        save(rows, tmp_path)
    assert [f for f in found(tmp_path) if not f.startswith("_staging/")] == []  # tasks may be killed while they write there
    time.sleep(1)
    save(known.createDataFrame([("fine", b"1")], FILES), tmp_path)
    assert [f for f in found(tmp_path) if not f.startswith("_manifest/")] == ["fine"]


def test_a_job_that_stopped_while_moving_is_ended_by_the_next(known, tmp_path, monkeypatch):
    writer = formats.FileWriter({"path": str(tmp_path)}, known.createDataFrame([], FILES).schema)
    message = writer.write(iter([{"name": "d/one", "content": b"1"}, {"name": "two", "content": b"2"}]))
    lost = writer.write(iter([{"name": "d/one", "content": b"1"}]))  # the same task, run twice; its message is not used
    real = formats.finish
    calls = iter([lambda path: None])
    monkeypatch.setattr(formats, "finish", lambda path: next(calls)(path))
    with pytest.raises(StopIteration):  # it dies when it is about to move the files
        writer.commit([message, None])
    monkeypatch.setattr(formats, "finish", real)
    os.makedirs(tmp_path / "d")
    os.rename(f"{message.folder}/d/one", tmp_path / "d/one")  # the process died after the first move
    assert os.path.exists(f"{lost.folder}/d/one") and formats._listed(str(tmp_path), formats.MANIFEST) == []
    save(known.createDataFrame([("three", b"3")], FILES), tmp_path)
    assert sorted(f for f in found(tmp_path) if not f.startswith("_")) == ["d/one", "three", "two"]
    names = sorted(x["name"] for f in os.listdir(tmp_path / "_manifest") for x in json.loads((tmp_path / "_manifest" / f).read_text())["files"])
    assert names == ["d/one", "three", "two"] and not [f for f in found(tmp_path) if f.startswith("_staging")]


def test_a_folder_is_made_once_for_all_its_files(tmp_path, monkeypatch):
    """The commit asks for folders, not for each file; files that were moved before are left, and a failed move is an error."""
    made, listed = [], []
    system, _ = formats.opened(str(tmp_path))

    class Counting:
        def __getattr__(self, name):
            return getattr(system, name)

        def create_dir(self, path, recursive=True):
            made.append(path)
            system.create_dir(path, recursive=recursive)

    for i in range(40):
        name, origin = f"{'ab'[i % 2]}/{i}.txt", tmp_path / "_staging" / "j" / f"{i}"
        origin.parent.mkdir(parents=True, exist_ok=True)
        if i:
            origin.write_text(str(i))
        listed.append({"name": name, "bytes": 1, "sha256": "", "from": str(origin)})
    (tmp_path / "_pending").mkdir()
    (tmp_path / "_pending" / "j.json").write_text(json.dumps({"job": "j", "files": listed}))
    monkeypatch.setattr(formats, "opened", lambda path: (Counting(), path))
    formats.finish(str(tmp_path))
    assert len(made) == 3 and sorted(p.name for p in tmp_path.glob("[ab]/*.txt")) == sorted(f"{i}.txt" for i in range(1, 40))
