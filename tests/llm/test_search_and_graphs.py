"""Vector search, link graph and tool calls against brute force, and on awkward rows."""

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadframe.llm import ann, blocks, linkgraph, toolcalls, topk
from leadframe.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>"


def odd_vectors(spark, more=()):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0])]
    return spark.createDataFrame([*rows, *more], VECTORS).withColumns({"id": F.lit("x"), "vec": F.lit(1), "dim": F.lit(9), "score": F.lit(0), "rank": F.lit(3)})


def brute(vectors, asked, k, measure):
    out = []
    for q in asked:
        scored = [(measure(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        out += [(q, rank, i, s) for rank, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


def inner(a, b):
    return sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b))


def test_exact_top_k_on_odd_vectors(spark):
    got = topk.top_k(odd_vectors(spark), F.col("id") >= 0, 2)
    vectors = {0: [1, 0], 1: [1, 0], 2: [2, 0], 3: [0, 1], 4: [0, 0], 10: [1, 1, 1], 11: [-1, 0]}
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(vectors, list(vectors), 2, inner)
    assert topk.top_k(odd_vectors(spark).where("false"), F.col("id") >= 0).count() == 0


def test_exact_top_k_where_64_bits_do_not_hold():
    huge = np.array([[1e30, -1e30], [1.0, 2.0]])
    exact = topk.accumulate(topk.weights(huge), topk.weights(huge))
    assert exact[0, 0] == 2 * math.floor(1024 * 1e30) ** 2 and exact[1, 1] == 5 * 1024**2


@pytest.mark.parametrize("rows", [1, 7])
def test_exact_top_k_with_many_ties(spark, rows, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = {i: [float(x) for x in rng.integers(-2, 3, 3)] for i in range(60)}
    frame = spark.createDataFrame([(i, v) for i, v in vectors.items()], VECTORS).repartition(rows)
    got = topk.top_k(frame, F.col("id") % 5 == 0, 4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(vectors, range(0, 60, 5), 4, inner)


def test_tiles_of_few_and_of_many_zeros(monkeypatch):
    monkeypatch.setattr(topk, "TILE", (3, 7))
    rng = np.random.default_rng(2)
    for zeros, large in ((0.0, 1 << 10), (0.03, 1 << 10), (0.7, 1 << 10), (0.03, 1 << 25)):  # the last in 64 bits
        q, c = (rng.integers(-large, large, (n, 5)) * (rng.random((n, 5)) >= zeros) for n in (10, 23))
        found = topk.accumulate(q, c)
        assert found.dtype == (np.int32 if large == 1 << 10 else np.int64) and (found == q @ c.T).all()


def test_copies_of_queries_are_never_broadcast(spark):
    """They look as small as the queries are, and would all go through the driver."""
    rows = blocks.usable(spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], VECTORS), "vec_id", "embedding", False)
    found = blocks.search(rows, F.col("id") % 10 == 0, topk.best(3), 3, "long")
    assert len(found.collect()) == 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_no_more_copies_of_queries_than_blocks_or_cores(spark, monkeypatch):
    rows = blocks.usable(spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)] + [(200, [1.0])], VECTORS), "vec_id", "embedding", False)
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 200)
        assert blocks.salts_for(rows) == 2 * cores and blocks.salts_for(rows.where("false")) == 2 * cores
        monkeypatch.setattr(blocks, "CANDIDATE_BYTES", 32)  # two rows
        assert blocks.salts_for(rows) == 101
        spark.conf.set("spark.sql.shuffle.partitions", 6)
        assert blocks.salts_for(rows) == 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


def test_nearest_on_odd_vectors(spark):
    got = ann.nearest(odd_vectors(spark), F.col("id") >= 0, 2).collect()
    vectors = {0: [1, 0], 1: [1, 0], 2: [2, 0], 3: [0, 1], 10: [1, 1, 1], 11: [-1, 0]}
    want = brute(vectors, list(vectors), 2, cosine)
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [w[:3] for w in want]
    assert ann.nearest(odd_vectors(spark).where("false"), F.col("id") >= 0).count() == 0


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, scale):
    frame = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in frame.collect()}
    ids = np.array(sorted(vectors))
    z = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    asked = np.flatnonzero(ids % 50 == 0)
    score = z[asked] @ z.T
    score[np.arange(len(asked)), asked] = -2
    want = {(int(ids[a]), int(ids[b])) for a, row in zip(asked, np.argsort(-score, axis=1)[:, :5]) for b in row}
    rows = QUERIES["op3_multiprobe_ann"](spark, f"/root/testdata/{scale}").collect()
    assert len({(r.query_id, r.vec_id) for r in rows} & want) / len(want) >= 0.9
    assert all(abs(r.score - float(vectors[r.query_id] @ vectors[r.vec_id] / np.linalg.norm(vectors[r.query_id]) / np.linalg.norm(vectors[r.vec_id]))) < 1e-12 for r in rows)
    assert all(len([1 for r in rows if r.query_id == q]) == 5 for q in {r.query_id for r in rows})


def clustered(n, dim=32, per=25, seed=4):
    """n vectors in clusters of about `per`, whose members are much nearer to each other than to others."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // per), dim))
    return centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, dim))


def recall(rows, vectors, asked, k=5):
    z = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    score = z[asked] @ z.T
    score[np.arange(len(asked)), asked] = -2
    want = {(int(a), int(b)) for a, row in zip(asked, np.argsort(-score, axis=1)[:, :k]) for b in row}
    return len({(r.query_id, r.vec_id) for r in rows} & want) / len(want)


def neighbours_of(z, asked, k=5):
    score = z[asked] @ z.T
    score[np.arange(len(asked)), asked] = -2
    return np.argsort(-score, axis=1)[:, :k]


def test_the_joined_index_finds_near_neighbours_in_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_SLOT", 300)
    monkeypatch.setattr(ann, "PER_PART", 100)  # so that slots are split, those of rows and those of queries
    vectors = clustered(4000)
    vectors[:150] = vectors[0] + 0.001 * np.arange(150)[:, None]  # a hot bucket
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    probes, share, _ = ann.fitted(blocks.usable(frame, "vec_id", "embedding", True), 5)
    assert probes is not None and share < ann.SELECTIVE
    rows = ann.nearest(frame, F.col("id") % 20 == 0, 5).collect()
    asked = np.arange(0, 4000, 20)
    assert len(rows) == 5 * len(asked) and recall(rows, vectors, asked) >= 0.9
    assert all(abs(r.score - cosine(vectors[r.query_id], vectors[r.vec_id])) < 1e-12 for r in rows)


def test_both_ways_rank_the_same_candidates(spark):
    vectors = clustered(600, per=60)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1001, [0.0] * 32), (1002, [1.0, 2.0])], "vec_id long, embedding array<double>")
    one, two = (sorted(map(tuple, ann.nearest(frame, F.col("id") % 10 == 0, 5, probes=64, joined=way).collect())) for way in (True, False))
    # In blocks a query without enough candidates of a block is ranked against that block; here all have enough.
    assert one == two and {r[0] for r in one} == set(range(0, 600, 10))


def test_candidates_per_query_grow_far_less_than_rows():
    """On clusters of one size, eight times the rows bring little more than the same rows to look at."""
    looked = []
    for n in (4000, 32000):
        z = ann.unit(clustered(n))
        hashes, asked = ann.hashes_for(n), np.arange(100)
        true = neighbours_of(z, asked)
        probes, _ = ann.fit_probes(z[asked], z[true], z[:4096], hashes)
        seen = ann.Block(ann.Tables(32, hashes), z).candidates(z[asked], probes)
        assert np.take_along_axis(seen, true, axis=1).mean() >= ann.TARGET
        looked.append(seen.sum(1).mean())
    assert looked[1] < 2.5 * looked[0], looked


def test_a_target_that_no_probes_reach_means_all_rows(spark):
    vectors = np.random.default_rng(1).normal(size=(300, 16))
    z = ann.unit(vectors)
    assert ann.fit_probes(z[:9], z[neighbours_of(z, np.arange(9))], z, ann.HASHES, target=1.1) == (None, 1.0)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = blocks.search(blocks.usable(frame, "vec_id", "embedding", True), F.col("id") % 10 == 0, ann.best(5, None), 5, "double").collect()
    assert recall(rows, vectors, np.arange(0, 300, 10)) == 1


def test_template_is_in_order_of_cost_without_both_borders_of_a_hash():
    for m in (3, 8, 16):
        rows = ann.template(m)
        assert not rows[0].any() and len(np.unique(rows, axis=0)) == len(rows) and (rows + rows[:, ::-1] <= 1).all()
    assert len(ann.template(3)) == 27  # each of three hashes crosses its lower border, its upper one, or none


def test_probes_begin_at_home_and_get_dearer():
    tables = ann.Tables(8)
    rng = np.random.default_rng(0)
    points = ann.unit(rng.normal(size=(20, 8)))
    cell, above = tables.place(points, 0)
    assert (tables.probes(points, 0, 16)[:, 0] == tables.code(cell, 0)).all()
    assert len(set(tables.probes(points, 0, 16)[3].tolist())) == 16


# --- link graph -------------------------------------------------------------------------------------------------------

RULES = [("good.org", "/", "allow"), ("bad.com", "/", "block"), ("bad.com", "/ok", "allow")]
PAGES = [
    (1, "http://good.org/a", '<a href="http://friend.net/x">x</a>'),
    (2, "http://friend.net/x", None),
    (3, "https://liker.net/", "<A HREF = '//bad.com/y?z'>"),
    (4, "http://BAD.com/y#f", ""),
    (5, "http://www.bad.com/okay", ""),
    (6, None, "<a href=http://good.org>"),
    (7, "no scheme", None),
    (8, "http://", "x"),
    (9, "ftp://lone.net?q", "<a href='/relative'>"),
    (9, "ftp://lone.net?q", "<a href='/relative'>"),
]


def test_link_graph(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "path": F.lit("p"), "rule": F.lit(1), "verdict": F.lit("v"), "suspect": F.lit(True), "by": F.lit(1)})
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in linkgraph.judge(pages, RULES).collect()), key=str)
    assert got == sorted(
        [
            (1, "good.org", "/a", "good.org/", "allow"),
            (2, "friend.net", "/x", None, "allow"),
            (3, "liker.net", "/", None, "block"),
            (4, "bad.com", "/y", "bad.com/", "block"),
            (5, "www.bad.com", "/okay", "bad.com/ok", "allow"),
            (6, "", "", None, "allow"),
            (7, "", "", None, "allow"),
            (8, "", "", None, "allow"),
            (9, "lone.net", "", None, "allow"),
            (9, "lone.net", "", None, "allow"),
        ],
        key=str,
    )
    assert linkgraph.judge(pages.where("false"), RULES).count() == 0


def test_hostile_pages_take_linear_time(spark):
    dots, labels = "a" + "." * 100_000 + "org", ".".join("x" * 1 for _ in range(50_000)) + ".org"
    rows = [
        (1, "http://good.org/", "href=" + " " * 1_000_000 + "//bad.com"),
        (2, "http://org/", "href=" + " " * 1_000_000),
        (3, f"http://{dots}/a", "href= " * 100_000 + "href='" + "a" * 500_000),
        (4, f"http://{labels}/b", f"<a href='//{dots}'>"),
        (5, "http://www.good.org/" + "?" * 1_000_000, "href=//bad.com" * 100_000),
        (6, "http://" + "h" * 1_000_000, "href" * 250_000 + "=" * 250_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    began = time.time()
    links = linkgraph.host_links(pages.withColumn("host", linkgraph.located(F.col("url"))[0]), "html").collect()
    found = {(r.src, r.dst): r.n for r in links if len(r.src) < 300 and len(r.dst) < 300}
    assert found == {("good.org", "bad.com"): 1, ("good.org", "www.good.org"): 1, ("www.good.org", "good.org"): 1, ("good.org", "org"): 1, ("org", "good.org"): 1, ("www.good.org", "bad.comhref="): 1}
    assert {(r.src, r.dst) for r in links if len(r.src) > 300 or len(r.dst) > 300} == {(labels, dots)}
    assert len(linkgraph.judge(pages, RULES).select("page_id", "verdict").collect()) == len(rows)
    assert time.time() - began < 90


@pytest.mark.parametrize("hub", [linkgraph.HUB, 1])
def test_propagation_equals_power_iteration(spark, hub):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 3)]
    frame = spark.createDataFrame(links, "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a", 1.0), ("distrust", "c", 0.5)], "kind string, host string, score double")
    got = {(r.kind, r.host): r.score for r in linkgraph.propagate(frame, seeds, hub=hub).collect()}
    for kind, edges, start in (("trust", links, {"a": 1.0}), ("distrust", [(b, a, n) for a, b, n in links], {"c": 0.5})):
        out = {s: sum(n for a, _, n in edges if a == s) for s, _, _ in edges}
        now = dict(start)
        for _ in range(linkgraph.rounds_for(linkgraph.DAMPING, linkgraph.RESIDUAL)):
            new = {h: (1 - linkgraph.DAMPING) * s for h, s in start.items()}
            for a, b, n in edges:
                new[b] = new.get(b, 0) + linkgraph.DAMPING * n / out[a] * now.get(a, 0)
            now = new
        for h, s in now.items():
            assert abs(got.get((kind, h), 0) - s) < 1e-12


# --- tool calls -------------------------------------------------------------------------------------------------------

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False)}, "say": {"text": ("string", True)}}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "x", 0, "add", '{"b": 1.5, "a": 2}', None),
            (1, "y", 1, "say", '{"text": "é\\n\\"q\\""}', ["x"]),
            (1, "z", 2, "say", '{"text": 5, "more": 1}', ["y", "x", "x"]),
            (1, "p", 3, "add", "{}", ["q"]),
            (1, "q", 4, "add", '{"a": 1}', ["p"]),
            (1, "r", 5, "add", '{"a": 1}', ["q"]),
            (1, "s", 6, "nope", "{", ["gone"]),
            (1, "x", 7, "add", '{"a": 3}', None),
            (1, None, 8, None, None, None),
            (2, "x", 0, "add", "[1]", []),
            (None, "x", 0, "add", '{"a": null}', []),
        ],
        "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>",
    ).withColumns({"level": F.lit(9), "parsed": F.lit(1), "answer": F.lit(2), "errors": F.lit("e")})
    results = spark.createDataFrame([(1, "x", 9, "late"), (1, "x", 2, "first"), (1, "lost", 1, "?"), (2, "x", 1, None), (None, "x", 1, "n")], "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.turn): r for r in toolcalls.link(calls, results, SCHEMAS).collect()}
    assert len(got) == 11
    assert {k: v.level for k, v in got.items() if k[0] == 1} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): None, (1, 4): None, (1, 5): None, (1, 6): 0, (1, 7): 0, (1, 8): None}
    assert got[1, 0].valid and got[1, 0].json == '{"arguments":{"a":2,"b":1.5},"id":"x","name":"add","result":{"content":"first","turn":2}}'
    assert json.loads(got[1, 1].json) == {"arguments": {"text": 'é\n"q"'}, "id": "y", "name": "say", "result": None}
    assert got[1, 2].errors == "text is not string; unknown more"
    assert got[1, 3].errors == "missing a; no order"
    assert got[1, 6].errors == "unknown tool; unknown dependency" and json.loads(got[1, 6].json)["arguments"] == "{"
    assert got[2, 0].errors == "arguments are not an object" and json.loads(got[2, 0].json)["result"] == {"content": None, "turn": 1}
    assert "a is not integer" in got[None, 0].errors
    assert json.loads(got[1, 8].json) == {"arguments": None, "id": None, "name": None, "result": None}
    assert toolcalls.link(calls.where("false"), results, SCHEMAS).count() == 0


def test_levels_of_long_chains_cycles_and_several_needs(spark):
    """Against plain recursion: a chain of 1,000 calls, a cycle with a tail, fan-in over chains, a call that needs itself."""
    needs = {i: [i - 1] if i else [] for i in range(1000)}
    needs |= {2000: [2002], 2001: [2000], 2002: [2001], 2003: [2000], 2004: [2003, 5]}
    needs |= {3000: [999, 10, 20], 3001: [3000, 7], 3002: [3001], 3003: [3002, 3000], 3004: [3004], 3005: [3004, 1]}
    edges = [(1, f"c{k}", f"c{n}") for k, v in needs.items() for n in v]
    calls = spark.createDataFrame([(1, f"c{k}") for k in needs], "conv_id long, call_id string")
    got = {r.call_id: r.level for r in toolcalls.levels(calls, spark.createDataFrame(edges, "conv_id long, call_id string, needs string")).collect()}
    want, waiting = {}, dict(needs)
    while free := [k for k, v in waiting.items() if all(n in want for n in v)]:
        want |= {k: max((want[n] + 1 for n in waiting[k]), default=0) for k in free}
        waiting = {k: v for k, v in waiting.items() if k not in want}
    assert got == {f"c{k}": v for k, v in want.items()}
    assert got["c999"] == 999 and "c2004" not in got and "c3005" not in got


def test_numbers_of_arguments(spark):
    """Whole values are integers however they are written; the text loses zeros that say nothing, but not in strings."""
    cases = [
        ('{"a":99999999999999999999}', True, '{"a":99999999999999999999}'),
        ('{"a":1e2}', True, '{"a":100}'),
        ('{"a":5.0}', True, '{"a":5}'),
        ('{"a": -5.00, "b": 2.50}', True, '{"a":-5,"b":2.5}'),
        ('{"a":1.5}', False, '{"a":1.5}'),
        ('{"a":"1.0"}', False, '{"a":"1.0"}'),
        ('{"a":7,"b":1e-7}', True, '{"a":7,"b":1.0E-7}'),
        ('{"b":[1.0,{"c":"x:1.0,\\\\\\"2.0,"}],"a":0.0}', True, None),
    ]
    calls = spark.createDataFrame([(1, f"c{i}", i, "any", text, None) for i, (text, _, _) in enumerate(cases)], "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    rows = sorted(toolcalls.link(calls, results, {"any": {"a": ("integer", True), "b": ("number", False)}}).collect(), key=lambda r: r.turn)
    for row, (text, whole, json_text) in zip(rows, cases):
        assert ("a is not integer" not in row.errors) == whole, (text, row.errors)
        if json_text:
            assert row.json.startswith('{"arguments":' + json_text + ',"id"'), (text, row.json)
        assert json.loads(row.json)["arguments"] == json.loads(text)
    long = '{"a":1,"b":"' + "\\n\\\"x" * 30_000 + '1.0,"}'
    call = spark.createDataFrame([(1, "c", 0, "any", long, None)], calls.schema)
    assert json.loads(toolcalls.link(call, results, {"any": {}}).first().json)["arguments"] == json.loads(long)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    from tests.harness import same

    same(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")
