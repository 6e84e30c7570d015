"""Rankings of arriving pages: any order, repeats, late pages, ends, and the bound on state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadframe.streaming import ranking

PAGES = "doc string, page_number int, score int, arrived_at timestamp"
START = datetime(2024, 1, 1)


def run(spark, folder, batches, **options):
    """The rankings of some micro-batches, one after another."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k:03d}")
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = ranking.into(ranking.ranked(stream, **options), f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(ranking.RANKED + ", batch int").parquet(f"{folder}/out")


def arrivals(seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c"]), i % 40, (i * 7) % 11, START + timedelta(minutes=rng.randrange(50))) for i in range(n)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    return rows + rng.sample(rows, 10)  # some pages come twice


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_rows_of_the_batch(spark, tmp_path, seed):
    rows = arrivals(0)
    random.Random(seed).shuffle(rows)
    out = run(spark, tmp_path, [rows[i::4] for i in range(4)] + [[(None, 1, 9, START), ("a", None, 9, START)]], keep=4, delay="3 hours")
    want = ranking.top(spark.createDataFrame(rows, PAGES).distinct(), 4).collect()
    assert sorted(map(tuple, ranking.newest(out).collect())) == sorted(map(tuple, want)) and want
    assert out.agg(F.max(F.size("pages"))).first()[0] == 4 and out.where("final").isEmpty()


def test_ends_late_pages_and_a_document_that_comes_back(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [[("a", 1, 6, at(0)), ("a", 2, 9, at(1))], [("b", 1, 7, at(200))], [("a", 3, 10, at(2)), ("b", 2, 7, at(201))], [("a", 4, 5, at(300))], [("c", 1, 5, at(900))], [("d", 1, 5, at(901))]]
    out = run(spark, tmp_path, batches, keep=2, delay="30 minutes", idle_ms=60_000)
    rows = sorted((r.doc, r.revision, r.final, [(p.page_number, p.score) for p in r.pages]) for r in out.where("doc in ('a', 'b')").collect())
    first = [r for r in rows if r[0] == "a" and r[3][0] == (2, 9)]
    assert first == [("a", 1, False, [(2, 9), (1, 6)]), ("a", 2, True, [(2, 9), (1, 6)])]  # page 3 was too late
    assert ("a", 1, False, [(4, 5)]) in rows and ("a", 2, True, [(4, 5)]) in rows
    assert [r for r in rows if r[0] == "b"] == [("b", 1, False, [(1, 7)]), ("b", 2, False, [(1, 7), (2, 7)]), ("b", 3, True, [(1, 7), (2, 7)])]
    assert {(r.doc, r.page_number) for r in ranking.newest(out).collect()} == {("a", 4), ("b", 1), ("b", 2), ("c", 1), ("d", 1)}


def test_state_is_bounded_whatever_a_document_sends():
    rng = random.Random(3)
    pages, scores = [], []
    for _ in range(200):
        new = [(rng.randrange(10_000), rng.randrange(100)) for _ in range(50)]
        pages, scores = ranking.best([*pages, *(p for p, _ in new)], [*scores, *(s for _, s in new)], 5)
        assert len(pages) == len(set(pages)) <= 5 and scores == sorted(scores, reverse=True)
    with pytest.raises(ValueError):
        ranking.ranked(None, keep=0)
