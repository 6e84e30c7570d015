"""Merged summaries against recomputed ones."""

import random
import statistics

from leadframe.plans.summaries import Summaries

ROWS = "run string, status string, item long, cost double"


def recomputed(rows):
    found = {}
    for run, status, item, cost in rows:
        found.setdefault(status, []).append((run or "", item, None if cost != cost else cost))
    whole = {}
    for status, r in found.items():
        costs = [c for _, _, c in r if c is not None]
        whole[status] = (len({x[0] for x in r}), len(r), min(costs, default=None), max(costs, default=None), len({x[1] for x in r if x[1] is not None}))
    return whole


def exact(frame):
    return {r.status: (r.n_runs, r.n, r.low, r.high, r.n_items) for r in frame.collect()}


def drawn(run, n, seed):
    rng = random.Random(seed)
    return [(run, rng.choice(["success", "error", None]), rng.choice([None, -3, rng.randrange(40_000), rng.randrange(100)]), rng.choice([None, float("nan"), rng.random()])) for _ in range(n)]


def test_merged_equals_recomputed(spark, tmp_path):
    kept, rows = Summaries(spark, str(tmp_path / "runs")), []
    assert kept.totals().count() == 0
    for run, seed in (("a", 1), ("b", 2), (None, 3)):
        more = drawn(run, 400, seed)
        rows += more
        kept.add(spark.createDataFrame(more, ROWS))
        assert exact(kept.totals()) == recomputed(rows)
    assert exact(kept.totals(["b"])) == recomputed([r for r in rows if r[0] == "b"])
    again = drawn("b", 50, 9)  # the run is summarised anew
    kept.add(spark.createDataFrame(again, ROWS))
    assert exact(kept.totals()) == recomputed([r for r in rows if r[0] != "b"] + again)
    kept.add(spark.createDataFrame([], ROWS))
    assert exact(kept.totals()) == recomputed([r for r in rows if r[0] != "b"] + again)
    bare = [("b", "error", None, 1.0)]  # nothing is left of its items
    kept.add(spark.createDataFrame(bare, ROWS))
    assert exact(kept.totals()) == recomputed([r for r in rows if r[0] != "b"] + bare)


def test_error_of_sketches(spark, tmp_path):
    kept = Summaries(spark, str(tmp_path / "runs"))
    rows = spark.range(200_000).selectExpr("cast(id % 16 as string) as run", "'success' as status", "id div 2 as item", "cast(hash(id) as double) as cost")
    kept.add(rows)
    total = kept.totals().first()
    assert (total.n_runs, total.n, total.n_items) == (16, 200_000, 100_000)
    assert abs(total.n_items_sketched - 100_000) <= 3 * 0.016 * 100_000
    costs = sorted(r.cost for r in rows.select("cost").collect())
    low, high = costs[int(0.48 * len(costs))], costs[int(0.52 * len(costs))]
    assert low <= total.median <= high and abs(statistics.median(costs)) < 2**31


def test_totals_read_no_runs(spark, tmp_path):
    kept = Summaries(spark, str(tmp_path / "runs"))
    kept.add(spark.createDataFrame([("a", "error", None, None)], ROWS))
    assert exact(kept.totals()) == {"error": (1, 1, None, None, 0)} and kept.totals().first().median is None
    plan = kept.totals()._jdf.queryExecution().toString()
    assert "Python" not in plan and "NestedLoop" not in plan
