"""Rankings of documents whose pages arrive in any order: state by document, bounded by `keep` pages.

Pages come with their time of arrival. Each micro-batch that changes a document's `keep` best pages gives a row with its whole
new ranking and a revision; the last revision is what the batch operators give for all pages so far (best first, ties by page).
A page that comes again counts once, with its higher score. A document's state ends when the watermark has passed its latest
page by `idle`: then a row says that it is final, and what is kept of it goes. Pages older than the watermark are left out.

State is two numbers for a page and never more than `keep` pages, whatever a document sends; a hot document is one group, whose pages
go through in bounded frames. `since` tells apart what a document's state began with, and stays. Null documents are left out, null pages and scores too. A document that comes back after its end
begins anew, with a later `since`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RANKED = "doc string, since timestamp, revision long, final boolean, pages array<struct<page_number:int,score:int>>"
STATE = "since timestamp, latest timestamp, revision long, pages array<int>, scores array<int>"


def best(pages: list[int], scores: list[int], keep: int) -> tuple[list[int], list[int]]:
    """The `keep` best of the pages, each once, best first."""
    highest: dict[int, int] = {}
    for page, score in zip(pages, scores):
        highest[page] = max(score, highest.get(page, score))
    order = sorted(highest.items(), key=lambda x: (-x[1], x[0]))[:keep]
    return [p for p, _ in order], [s for _, s in order]


def _row(doc, since, revision: int, final: bool, pages: list[int], scores: list[int]) -> pd.DataFrame:
    return pd.DataFrame([{"doc": doc, "since": since, "revision": revision, "final": final, "pages": [{"page_number": int(p), "score": int(s)} for p, s in zip(pages, scores)]}])


def millis(at) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


def ranking(keep: int, idle_ms: int):
    """For applyInPandasWithState."""

    def end_of(latest) -> int:
        return millis(latest) + idle_ms

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (doc,) = key
        if state.hasTimedOut:
            since, _, revision, pages, scores = state.get
            state.remove()
            yield _row(doc, since, revision + 1, True, list(pages), list(scores))
            return
        watermark = state.getCurrentWatermarkMs()
        held = state.get if state.exists else None
        if held is not None and end_of(held[1]) <= watermark:  # its end has come, though new pages are here
            yield _row(doc, held[0], held[2] + 1, True, list(held[3]), list(held[4]))
            state.remove()
            held = None
        since, latest, revision, pages, scores = held or (None, None, 0, [], [])
        before = pages, scores = list(pages), list(scores)
        for frame in frames:
            # Spark itself leaves out what is older than the watermark of the batch before.
            frame = frame[frame["arrived_at"].map(millis) >= watermark]
            if len(frame):
                pages, scores = best([*pages, *frame["page_number"].tolist()], [*scores, *frame["score"].tolist()], keep)
                first, last = frame["arrived_at"].min(), frame["arrived_at"].max()
                since, latest = (first, last) if since is None else (since, max(latest, last))
        if since is None:
            return
        changed = (pages, scores) != before
        state.update((since, latest, revision + changed, pages, scores))
        state.setTimeoutTimestamp(max(end_of(latest), watermark + 1))
        if changed:
            yield _row(doc, since, revision + 1, False, pages, scores)

    return run


def ranked(scored: DataFrame, keep: int = 10, min_score: int = 5, delay: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """(doc, since, revision, final, pages) of a stream of scored pages (doc, page_number, score, arrived_at)."""
    if keep < 1:
        raise ValueError("at least one page is kept")
    rows = scored.where("doc is not null and page_number is not null and arrived_at is not null").where(F.col("score") >= min_score)
    rows = rows.select(F.col("doc").cast("string"), F.col("page_number").cast("int"), F.col("score").cast("int"), F.col("arrived_at").cast("timestamp")).withWatermark("arrived_at", delay)
    return rows.groupBy("doc").applyInPandasWithState(ranking(keep, idle_ms), RANKED, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def into(rankings: DataFrame, folder: str, checkpoint: str):
    """A writer that appends each micro-batch's rankings under its number; a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rankings.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def newest(rankings: DataFrame) -> DataFrame:
    """(doc, page_number, score, rank): the last ranking of each document."""
    last = rankings.groupBy("doc").agg(F.max_by("pages", F.struct("since", "revision")).alias("pages"))
    return last.select("doc", F.posexplode("pages").alias("at", "p")).select("doc", "p.page_number", "p.score", (F.col("at") + 1).alias("rank"))


def top(scored: DataFrame, keep: int = 10, min_score: int = 5) -> DataFrame:
    """The same rows of a table: what the stream's last revisions are held against."""
    order = Window.partitionBy("doc").orderBy(F.desc("score"), "page_number")
    rows = scored.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= keep).select("doc", "page_number", "score", "rank")
