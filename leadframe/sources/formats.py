"""Documents and files as data sources of Spark: `spark.read.format("leadframe_pages")`, `df.write.format("leadframe_files")`.

`register(spark)` makes both known. Paths are local or URIs of any file system that Arrow knows; driver and executors share them.

**leadframe_pages** reads text documents whose pages are parted by form feeds. A task reads a range of bytes, so a huge document
is read by many tasks, and small documents share one; a page belongs to the range that it begins in. Only what the schema asks
for is made: `.schema("doc string, page_number int")` decodes no text. Comparisons of page_number with numbers, and of doc with
names, are pushed down: other documents aren't opened, other pages not decoded. A page that isn't UTF-8 has a null text and an
`error`, and stops nobody. A range doesn't know how many pages lie before it and counts form feeds there, without decoding;
it does so only if numbers are asked for.

**leadframe_files** writes rows (name, content) as files, all of a job or none. Tasks write to a staging folder; on success the
driver writes the list of all files, moves them to their names and makes the list the job's manifest. Until then no reader finds
any of them, and a job that was stopped in between is ended by the next one in that folder. A task that fails, or runs twice,
leaves nothing outside of manifests but what lies in the staging folder until the next job ends; one job at a time writes to a
folder. Two rows of one name, or a name outside of the folder, are an error, and nothing is
written; files of earlier jobs are replaced only with `option("replace", "true")`.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

PAGES = "doc string, page_number int, total_pages int, n_bytes long, text string, error string"
FEED, BLOCK, BATCH = b"\f", 1 << 20, 1 << 22
STAGING, PENDING, MANIFEST = "_staging", "_pending", "_manifest"
COMPARISONS = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSourceFormat)
    spark.dataSource.register(FilesFormat)


def opened(path: str):
    """(file system, path on it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


# --- reading --------------------------------------------------------------------------------------------------------


@dataclass
class Ranges(InputPartition):
    """(path, size, first byte, end) of ranges that one task reads."""

    parts: list[tuple[str, int, int, int]]


class PageSourceFormat(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leadframe_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(schema, self.options)


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        known = dict(x.split() for x in PAGES.split(", "))
        wrong = [f"{n} {k}" for n, k in self.columns if known.get(n) != {"bigint": "long"}.get(k, k)]
        if wrong:
            raise ValueError(f"not among {PAGES}: {', '.join(wrong)}")
        self.path, self.suffix = options["path"], options.get("suffix", ".txt").lower()
        self.per_task = int(options.get("bytespertask", 16 << 20))
        self.low, self.high, self.numbers, self.docs = 1, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, COMPARISONS) and len(f.attribute) == 1 else None
            if column == "page_number":
                self._number(f)
            elif column == "doc" and isinstance(f, EqualTo | In):
                names = set(f.value if isinstance(f, In) else [f.value])
                self.docs = names if self.docs is None else self.docs & names
            else:
                yield f

    def _number(self, f: Filter) -> None:
        if isinstance(f, EqualTo | In):
            numbers = set(f.value if isinstance(f, In) else [f.value])
            self.numbers = numbers if self.numbers is None else self.numbers & numbers
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        else:
            most = f.value - isinstance(f, LessThan)
            self.high = most if self.high is None else min(self.high, most)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = opened(self.path)
        root = system.get_file_info(path)
        if root.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [root] if root.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.suffix) and (self.docs is None or f.path in self.docs))
        tasks, own, held = [], [], 0
        for name, size in files:
            for at in range(0, max(size, 1), self.per_task):
                part = (name, size, at, min(size, at + self.per_task))
                if own and held + part[3] - at > self.per_task:
                    tasks.append(Ranges(own))
                    own, held = [], 0
                own.append(part)
                held += part[3] - at
        return [*tasks, Ranges(own)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        rows, held = [], 0
        for path, size, at, end in partition.parts:
            with system.open_input_file(path) as source:
                for row in self._pages(source, path, size, at, end):
                    rows.append(row)
                    held += row["n_bytes"]
                    if held >= BATCH:
                        yield self._batch(rows)
                        rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in self.columns], names=[n for n, _ in self.columns])

    def _pages(self, source, path: str, size: int, at: int, end: int) -> Iterator[dict]:
        wanted = {n for n, _ in self.columns}
        bounded = self.low > 1 or self.high is not None or self.numbers is not None
        number = 1 + _feeds(source, 0, max(0, at - 1)) if bounded or wanted & {"page_number", "total_pages"} else 0
        total = number + _feeds(source, max(0, at - 1), size) if "total_pages" in wanted else None
        for start, stop in _bounds(source, size, at, end):
            number += start > 0 and number > 0
            if self.high is not None and number > self.high:
                return
            if number and (number < self.low or self.numbers is not None and number not in self.numbers):
                continue
            row = {"doc": path, "page_number": number or None, "total_pages": total, "n_bytes": stop - start, "text": None, "error": None}
            if wanted & {"text", "error"}:
                source.seek(start)
                try:
                    row["text"] = source.read(stop - start).decode()
                except UnicodeDecodeError as wrong:
                    row["error"] = f"byte {wrong.start}: {wrong.reason}"
            yield row


def _feeds(source, at: int, end: int) -> int:
    """Form feeds in a range of bytes."""
    source.seek(at)
    n = 0
    for begin in range(at, end, BLOCK):
        n += source.read(min(BLOCK, end - begin)).count(FEED)
    return n


def _bounds(source, size: int, at: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of the pages that begin in a range; a page after a last form feed begins at the end of the file."""
    start, here = (0 if at == 0 else None), max(0, at - 1)  # a form feed just before the range begins a page in it
    while here < size:
        source.seek(here)
        block = source.read(min(BLOCK, size - here))
        place = block.find(FEED)
        while place >= 0:
            if start is not None:
                yield start, here + place
            start = here + place + 1
            if start >= end and end < size:
                return
            place = block.find(FEED, place + 1)
        here += len(block)
    if start is not None:
        yield start, size


# --- writing --------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[tuple[str, int, str]]


class FilesFormat(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leadframe_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added; use option replace to replace those of equal names")
        return FileWriter(self.options, schema)


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.replace = options["path"].rstrip("/"), options.get("replace", "false").lower() == "true"
        self.job, self.names = uuid.uuid4().hex, schema.fieldNames()
        if sorted(self.names) != ["content", "name"]:
            raise ValueError("rows to be written are (name, content)")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = opened(self.path)
        folder, files, made = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", [], set()
        try:
            for row in rows:
                name, content = row["name"], bytes(row["content"] or b"")
                if not name or name.startswith(("/", "_")) or ".." in name.split("/") or posixpath.normpath(name) != name:
                    raise ValueError(f"not a name of a file within the folder: {name!r}")
                below = posixpath.dirname(f"{folder}/{name}")
                if below not in made:
                    system.create_dir(below, recursive=True)
                    made.add(below)
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
                files.append((name, len(content), sha256(content).hexdigest()))
        except BaseException:
            _delete(system, folder)
            raise
        return Written(folder, files)

    def commit(self, messages: list) -> None:
        system, root = opened(self.path)
        finish(self.path)
        made = [m for m in messages if m is not None]
        names = [name for m in made for name, _, _ in m.files]
        repeated = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        there = [] if self.replace else [n for n, info in zip(names, system.get_file_info([f"{root}/{n}" for n in names])) if info.type.name != "NotFound"]
        if repeated or there:
            self.abort(messages)
            raise ValueError(f"names that occur twice: {repeated[:5]}; that exist: {there[:5]}")
        system.create_dir(f"{root}/{PENDING}", recursive=True)
        listed = {"job": self.job, "files": [{"name": n, "bytes": size, "sha256": digest, "from": f"{m.folder}/{n}"} for m in made for n, size, digest in m.files]}
        with system.open_output_stream(f"{root}/{PENDING}/{self.job}.part") as out:
            out.write(json.dumps(listed).encode())
        system.move(f"{root}/{PENDING}/{self.job}.part", f"{root}/{PENDING}/{self.job}.json")
        finish(self.path)
        _delete(system, f"{root}/{STAGING}")

    def abort(self, messages: list) -> None:
        system, root = opened(self.path)
        _delete(system, f"{root}/{STAGING}/{self.job}")


def _delete(system, folder: str) -> None:
    if system.get_file_info(folder).type.name == "Directory":
        system.delete_dir(folder)


def _listed(path: str, kind: str) -> list:
    from pyarrow import fs

    system, root = opened(path)
    return [f for f in system.get_file_info(fs.FileSelector(f"{root}/{kind}", allow_not_found=True)) if f.base_name.endswith(".json")]


def finish(path: str) -> None:
    """End the jobs whose list of files is complete: moves that were made are found made, the rest are made now."""
    system, root = opened(path)
    for info in _listed(path, PENDING):
        with system.open_input_stream(info.path) as source:
            text = source.read()
        listed = json.loads(text)

        def place(file: dict) -> None:
            try:
                system.move(file["from"], f"{root}/{file['name']}")
            except OSError:
                if system.get_file_info(file["from"]).type.name == "File":
                    raise

        with ThreadPoolExecutor(16) as pool:
            folders = {posixpath.dirname(f"{root}/{file['name']}") for file in listed["files"]}
            list(pool.map(lambda folder: system.create_dir(folder, recursive=True), sorted(folders)))
            list(pool.map(place, listed["files"]))
        system.create_dir(f"{root}/{MANIFEST}", recursive=True)
        system.move(info.path, f"{root}/{MANIFEST}/{info.base_name}")
        _delete(system, f"{root}/{STAGING}/{listed['job']}")


def manifest(spark: SparkSession, path: str):
    """(job, name, bytes, sha256) of all files that were committed."""
    from pyspark.sql import functions as F

    rows = spark.read.schema("job string, files array<struct<name:string,bytes:long,sha256:string>>").json(f"{path.rstrip('/')}/{MANIFEST}/*.json")
    return rows.select("job", F.explode("files").alias("f")).select("job", "f.*")
