"""Edges to the outside: document decoders, models and exporters, as replaceable objects with offline stand-ins.

A provider runs on the executors, over batches of rows; its answers are not repeatable in general, so callers write them
down (a table or a checkpoint) before they use them twice."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from hashlib import sha256
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "doc string, page_number int, total_pages int, width double, height double, text string"


class PageSource(Protocol):
    """Decodes a document's bytes to dicts of page_number, total_pages, width, height, text, and perhaps images (width, height,
    data) and tables (rows of cells)."""

    def decode(self, path: str, content: bytes) -> Iterator[dict]: ...


class Answerer(Protocol):
    """Answers one request: a chat's messages as JSON, or an image with a prompt. None means that the call failed."""

    def answer(self, request: str, image: bytes | None = None) -> str | None: ...


class PlainTextSource:
    """Stand-in decoder: UTF-8 text whose pages are parted by form feeds; one image, the page's bytes, for each page. Lines with
    bars in a row are a table, of which an empty cell is null."""

    @staticmethod
    def tables(text: str) -> list[list[list[str | None]]]:
        found, row = [], -2
        for at, line in enumerate(text.split("\n")):
            if "|" in line:
                if at != row + 1:
                    found.append([])
                found[-1].append([c.strip() or None for c in line.strip().strip("|").split("|")])
                row = at
        return found

    def decode(self, path: str, content: bytes) -> Iterator[dict]:
        pages = content.decode("utf-8", "replace").split("\f")
        for number, text in enumerate(pages, 1):
            yield {"page_number": number, "total_pages": len(pages), "width": 612.0, "height": 792.0, "text": text, "images": [(100.0, 100.0, text.encode())], "tables": self.tables(text)}


class FixedAnswers:
    """Stand-in model: the same answer for everyone, or one that names the request's length."""

    def __init__(self, text: str | None = None):
        self.text = text

    @property
    def identity(self) -> str:
        return type(self).__name__ if self.text is None else f"{type(self).__name__} {sha256(self.text.encode()).hexdigest()}"

    def answer(self, request: str, image: bytes | None = None) -> str | None:
        return self.text if self.text is not None else json.dumps({"component_name": "stub", "package": {"type": "DIP", "pin_count": len(request) % 8}, "pins": []})


class Unsteady:
    """Stand-in for a service with failures: by the request and the number of the attempt, every third attempt fails, and one
    request in sixteen always does."""

    def __init__(self, inner: Answerer):
        self.inner = inner

    def attempt(self, request: str, image: bytes | None, number: int) -> str | None:
        first = int(sha256(request.encode()).hexdigest()[0], 16)
        if first == 15 or (first + number) % 3 == 0:
            raise ConnectionError(f"attempt {number}")
        return self.inner.answer(request, image)


def files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, content) of the folder's files with this suffix in any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(F.endswith(F.lower("path"), F.lit(suffix))).select("path", "content")


TABLES_TYPE = "array<array<array<string>>>"
IMAGES_TYPE = "array<struct<width:double,height:double,data:binary>>"
#: Pages, and characters of text, in a frame of decoded pages, about.
FRAME_PAGES, FRAME_CHARS = 1000, 1 << 22


def contents(documents: DataFrame, source: PageSource, tables: bool = False, images: bool = False) -> DataFrame:
    """Pages of documents (path, content) with `error`, and their `tables` and `images` if asked for.

    A document that can't be decoded, wherever the fault lies, is one row without a page that tells the error. Pages are given
    out document by document, so a task holds those of one document and of what came with it in a batch of bytes."""
    extra = {"tables": TABLES_TYPE} if tables else {}
    extra |= {"images": IMAGES_TYPE} if images else {}
    names = ["doc", "page_number", "total_pages", "width", "height", "text", "error", *extra]
    schema = PAGE_SCHEMA + ", error string" + "".join(f", {n} {k}" for n, k in extra.items())

    def rows_of(path: str, content: bytes) -> list[tuple]:
        try:
            pages = list(source.decode(path, content))
        except Exception as wrong:  # noqa: BLE001, a bad file must not stop the others
            return [(path, None, None, None, None, None, f"{type(wrong).__name__}: {wrong}", *([] for _ in extra))]
        more = {"tables": lambda p: p.get("tables", []), "images": lambda p: [{"width": w, "height": h, "data": d} for w, h, d in p.get("images", [])]}
        return [(path, *(p[k] for k in ("page_number", "total_pages", "width", "height", "text")), None, *(more[n](p) for n in extra)) for p in pages]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"page_number": "Int32", "total_pages": "Int32"})

    def run(batches):
        for frame in batches:
            rows, chars = [], 0
            for path, content in zip(frame["path"], frame["content"]):
                new = rows_of(path, bytes(content))
                rows += new
                chars += sum(len(r[5] or "") for r in new)
                if len(rows) >= FRAME_PAGES or chars >= FRAME_CHARS:
                    yield framed(rows)
                    rows, chars = [], 0
            yield framed(rows)

    return documents.select("path", "content").mapInPandas(run, schema)


def decoded(documents: DataFrame, source: PageSource) -> DataFrame:
    """Pages of documents (path, content). A document that can't be decoded has none."""
    return contents(documents, source).where("error is null").drop("error")


def images_in(found: DataFrame) -> DataFrame:
    """Images of `contents`, one a row."""
    return found.where("error is null").select("doc", "page_number", F.posexplode("images").alias("image_index", "i")).select("doc", "page_number", "image_index", "i.*")


def tables_in(found: DataFrame) -> DataFrame:
    """Tables of `contents`, one a row."""
    return found.where("error is null").select("doc", "page_number", F.posexplode("tables").alias("table_index", "cells"))


def page_images(documents: DataFrame, source: PageSource) -> DataFrame:
    """Images of documents (path, content), apart from the text, so that nobody reads them who doesn't ask. A document that can't
    be decoded has none."""
    return images_in(contents(documents, source, images=True))


def answered(requests: DataFrame, provider: Answerer, request: str = "request", image: str | None = None) -> DataFrame:
    """Requests with their `response`; where the call failed, that is null and `call_error` tells why.

    Calls are made again whenever the result is computed again; `ledger.Ledger` makes each once. What a provider needs of its
    surroundings, such as a credential, is looked for here and not on the executors."""
    provider = provider.prepared() if hasattr(provider, "prepared") else provider
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", response string, call_error string"

    def run(batches):
        for frame in batches:
            pictures = frame[image] if image else [None] * len(frame)
            out, wrong = [], []
            for text, picture in zip(frame[request], pictures):
                response, error = None, None
                try:
                    response = provider.answer(text, picture)
                    error = "no answer" if response is None else None
                except Exception as failure:  # noqa: BLE001
                    error = f"{type(failure).__name__}: {failure}"
                out.append(response)
                wrong.append(error)
            yield frame.assign(response=pd.Series(out, dtype="object", index=frame.index), call_error=pd.Series(wrong, dtype="object", index=frame.index))

    return requests.mapInPandas(run, schema)


def export(rows: DataFrame, write) -> None:
    """Hand each partition's rows to `write`, which runs on the executors: saving images, or exporting drawings."""
    rows.foreachPartition(lambda part: write(part))


class Exporter(Protocol):
    """Writes one named file. Runs on the executors, so `folder` is one that they share."""

    def write(self, name: str, content: bytes) -> None: ...


class FolderExporter:
    """Files in a folder; each appears whole or not at all."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, name: str, content: bytes) -> None:
        path = os.path.join(self.folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as out:
            out.write(content)
        os.replace(part, path)


def exported(files: DataFrame, exporter: Exporter) -> DataFrame:
    """(name, written) for files (name, content): whether each was written. One that fails stops nobody."""

    def run(batches):
        for frame in batches:
            done = []
            for name, content in zip(frame["name"], frame["content"]):
                try:
                    exporter.write(name, bytes(content))
                    done.append(True)
                except Exception:  # noqa: BLE001
                    done.append(False)
            yield pd.DataFrame({"name": frame["name"], "written": done})

    return files.select("name", "content").mapInPandas(run, "name string, written boolean")


def image_files(images: DataFrame) -> DataFrame:
    """(name, content) of images (doc, page_number, image_index, data) that have data: a folder for each document."""
    name = F.concat(F.regexp_replace("doc", r"[^\w.-]+", "_"), F.lit("/page_"), F.col("page_number").cast("string"), F.lit("_img_"), F.col("image_index").cast("string"), F.lit(".png"))
    return images.where("data is not null").select(name.alias("name"), F.col("data").alias("content"))


def drawing_files(primitives: DataFrame) -> DataFrame:
    """(name, content): one JSON file of primitives for each component, in a fixed order. A drawing is as large as its
    component, a few rows for each pin."""
    rest = [c for c in primitives.columns if c != "comp_id"]
    rows = F.array_sort(F.collect_list(F.struct(*rest)))
    whole = primitives.groupBy("comp_id").agg(rows.alias("primitives"))
    text = F.to_json(F.struct("comp_id", "primitives"))
    return whole.select(F.concat(F.col("comp_id").cast("string"), F.lit(".json")).alias("name"), F.encode(text, "UTF-8").alias("content"))


def existing_input(path: str) -> str:
    """The path of a document that exists and whose name ends as a document's does; else an error that says what is wrong."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no such file: {path}")
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF: {path}")
    return path


def valid_inputs(listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows of a listing, so of files that exist, whose names end in .pdf in any case."""
    return listing.where(F.endswith(F.lower(path), F.lit(".pdf")))
