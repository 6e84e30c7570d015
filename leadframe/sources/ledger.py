"""A ledger of model calls: every attempt is written down, equal requests are one call, nothing is asked again that was answered.

The ledger is a folder that driver and executors share. `calls` is an append-only table of attempts (digest, attempt, outcome,
response, error); a request's digest is a SHA-256 of the provider's identity (its model and options, never its key), the
image's SHA-256 and the request. A round asks for every digest that has no answer yet and fewer than `attempts` attempts, and
is appended as a whole; what failed is asked again in the next round, after a pause that doubles.

A task also notes each `flush` calls in a file of `notes`, as soon as they were made. A task that runs again, because its
executor was lost, first reads the notes of its earlier runs and makes none of those calls twice; a run that was killed leaves
notes that the next one takes into `calls`. So a call is repeated only if it was under way, or among the last `flush` - 1,
when its process died.

Pending requests are written before they are asked, so a task that runs again has the same ones, and are dealt out `per_task`
to a task. Joins with the ledger are by digest; equal requests are summed before the shuffle.

Defined cases: null requests aren't asked and have no answer. Equal requests get the same answer and the same number of
attempts. A request that failed `attempts` times has a null response and the last error; an answer of null is a failure. An
empty table asks nobody. A later run with more `attempts` goes on where this one gave up.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = "digest string, attempt int, outcome string, response string, error string"
ANSWERED, FAILED = "answered", "failed"
SEPARATOR = "\x1f"


def identity(provider) -> str:
    """What tells answers of this provider from those of others."""
    return getattr(provider, "identity", None) or type(provider).__name__


def digest_of(provider, request: Column, image: Column | None = None) -> Column:
    picture = F.lit("") if image is None else F.coalesce(F.sha2(image, 256), F.lit(""))
    whole = F.concat(F.lit(identity(provider) + SEPARATOR), picture, F.lit(SEPARATOR), request)
    return F.sha2(whole.cast("binary"), 256)


def prepared(provider):
    """The provider as it goes to the executors, with whatever it needs from the driver's surroundings; raises what is wrong."""
    return provider.prepared() if hasattr(provider, "prepared") else provider


class Notes:
    """Small files of calls in a folder, on any file system that Arrow knows by its URI."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, self.folder = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)

    def files(self) -> list:
        from pyarrow import fs

        return [f for f in self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True, recursive=True)) if f.base_name.endswith(".json")]

    def read(self) -> list[dict]:
        found = []
        for file in self.files():
            with self.system.open_input_stream(file.path) as source:
                found += map(json.loads, source.read().decode().splitlines())
        return found

    def add(self, calls: list[dict]) -> None:
        """A file appears whole or not at all: it is written under another name first."""
        self.system.create_dir(self.folder, recursive=True)
        name = f"{self.folder}/{uuid.uuid4().hex}"
        with self.system.open_output_stream(f"{name}.part") as out:
            out.write("".join(json.dumps(c) + "\n" for c in calls).encode())
        self.system.move(f"{name}.part", f"{name}.json")

    def clear(self) -> None:
        from pyarrow import fs

        if self.system.get_file_info(self.folder).type == fs.FileType.Directory:
            self.system.delete_dir(self.folder)


class Ledger:
    """The calls in `folder`. One run at a time writes to it, without speculative tasks, which would ask beside others."""

    def __init__(self, spark: SparkSession, folder: str, attempts: int = 3, pause: float = 1.0, per_task: int = 256, flush: int = 1):
        if min(attempts, per_task, flush) < 1 or pause < 0:
            raise ValueError("attempts, per_task and flush are at least 1, pause at least 0")
        self.spark, self.folder = spark, folder.rstrip("/")
        self.attempts, self.pause, self.per_task, self.flush = attempts, pause, per_task, flush

    def calls(self) -> DataFrame:
        """(digest, attempt, outcome, response, error): one row for each attempt."""
        self.spark.createDataFrame([], CALLS).write.mode("ignore").parquet(f"{self.folder}/calls")  # so that there is a table
        return self.spark.read.schema(CALLS).parquet(f"{self.folder}/calls").dropDuplicates(["digest", "attempt"])

    def state(self) -> DataFrame:
        """(digest, tried, done, response, last_error) of each request that was ever asked."""
        answer = F.when(F.col("outcome") == ANSWERED, F.struct("attempt", "response"))
        wrong = F.when(F.col("outcome") == FAILED, F.struct("attempt", "error"))
        rows = self.calls().groupBy("digest").agg(F.max("attempt").alias("tried"), F.min(answer).alias("answer"), F.max(wrong).alias("wrong"))
        done = F.col("answer").isNotNull()
        return rows.select("digest", "tried", done.alias("done"), F.col("answer.response").alias("response"), F.when(~done, F.col("wrong.error")).alias("last_error"))

    def recover(self) -> None:
        """Take in what a run that was killed had noted. It may already be in `calls`, which counts an attempt once."""
        notes = Notes(f"{self.folder}/notes")
        if notes.files():
            self.spark.read.schema(CALLS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(notes_path := f"{self.folder}/notes").write.mode("append").parquet(f"{self.folder}/calls")
            Notes(notes_path).clear()

    def ask(self, requests: DataFrame, provider, request: str = "request", image: str | None = None) -> None:
        """Rounds of calls until each request has an answer or `attempts` attempts. Where there is a column of images, rows
        without one aren't asked."""
        provider = prepared(provider)
        picture = F.col(image) if image else F.lit(None).cast("binary")
        asked = requests.where(F.col(request).isNotNull() & (F.col(image).isNotNull() if image else F.lit(True)))
        rows = asked.select(digest_of(provider, F.col(request), F.col(image) if image else None).alias("digest"), F.col(request).alias("request"), picture.alias("image"))
        self.recover()
        for round_ in range(self.attempts):
            state = self.state().select("digest", "tried", "done")
            open_ = rows.select("digest", "request", "image").join(state.where(F.col("done") | (F.col("tried") >= self.attempts)), "digest", "left_anti")
            # The first of equal requests is any of them: they are equal.
            once = open_.groupBy("digest").agg(F.first("request").alias("request"), F.first("image").alias("image")) if not round_ else open_
            pending = f"{self.folder}/pending/{uuid.uuid4().hex}"
            once.join(state.select("digest", "tried"), "digest", "left").select("digest", "request", "image", (F.coalesce("tried", F.lit(0)) + 1).alias("attempt")).write.parquet(pending)
            rows = self.spark.read.parquet(pending)
            count = rows.count()
            if not count:
                break
            if round_:
                time.sleep(self.pause * 2 ** (round_ - 1))
            # By a hash of the digest into a fixed number of tasks, so a task that runs again has the same requests.
            dealt = rows.repartition(-(-count // self.per_task), "digest")
            dealt.mapInPandas(asking(provider, f"{self.folder}/notes/{uuid.uuid4().hex}", self.flush), CALLS).write.mode("append").parquet(f"{self.folder}/calls")
            Notes(f"{self.folder}/notes").clear()
        Notes(f"{self.folder}/pending").clear()

    def answered(self, requests: DataFrame, provider, request: str = "request", image: str | None = None) -> DataFrame:
        """The requests with `response`, `attempts` and `call_error`; calls are made for those without an answer."""
        self.ask(requests, provider, request, image)
        state = self.state().select(F.col("digest").alias("_digest"), "response", F.col("tried").alias("attempts"), F.col("last_error").alias("call_error"))
        keyed = requests.withColumn("_digest", digest_of(provider, F.col(request), F.col(image) if image else None))
        return keyed.join(state, "_digest", "left").drop("_digest").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def asking(provider, notes: str, flush: int):
    """For mapInPandas: calls of pending requests, with notes of those made. Notes of the task's earlier runs come first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = Notes(f"{notes}/{TaskContext.get().partitionId()}")
        before = {c["digest"]: c for c in kept.read()}
        attempt = getattr(provider, "attempt", None) or (lambda request, image, number: provider.answer(request, image))
        for frame in frames:
            out, new = [], []
            for digest, request, image, number in zip(frame["digest"], frame["request"], frame["image"], frame["attempt"]):
                call = before.get(digest)
                if call is None:
                    call = {"digest": digest, "attempt": int(number), "outcome": FAILED, "response": None, "error": "no answer"}
                    try:
                        response = attempt(request, image, int(number))
                    except Exception as wrong:  # noqa: BLE001, whatever goes wrong is written down
                        call["error"] = f"{type(wrong).__name__}: {wrong}"
                    else:
                        if response is not None:
                            call |= {"outcome": ANSWERED, "response": response, "error": None}
                    new.append(call)
                out.append(call)
                if len(new) >= flush:
                    kept.add(new)
                    new = []
            if new:
                kept.add(new)
            yield pd.DataFrame(out, columns=["digest", "attempt", "outcome", "response", "error"])

    return run
