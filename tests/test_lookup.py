"""Ranges, prefixes and keywords of any number against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadframe.functions import rules
from leadframe.operators import lookup, occurrences, pages


def nested(frame) -> bool:
    plan = frame._jdf.queryExecution().toString()
    return "NestedLoop" in plan or "Cartesian" in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges(spark, seed):
    rng = random.Random(seed)
    most = (1 << lookup.LEVELS) - 1
    numbers = [(i, rng.choice("ab"), rng.choice([None, -1, 0, 1, 7, 8, 63, 64, most, most + 1, rng.randrange(100), rng.randrange(1 << 20)])) for i in range(200)]
    ranges = [(i, rng.choice("ab"), rng.choice([None, -5, rng.randrange(100), rng.randrange(1 << 20)]), rng.choice([None, rng.randrange(100), rng.randrange(1 << 20), most])) for i in range(80)]
    ranges += [(90, "a", 7, 7), (91, "a", 8, 7), (91, "a", 0, 0), (91, "a", 0, 0), (92, "b", None, None)]
    got = lookup.in_ranges(spark.createDataFrame(numbers, "id long, k string, n long"), "n", spark.createDataFrame(ranges, "r long, k string, low long, high long"), "low", "high", ["k"])
    want = [(i, r) for i, k, n in numbers for r, j, a, b in ranges if n is not None and 0 <= n <= most and k == j and (a is None or n >= a) and (b is None or n <= b)]
    assert sorted((x.id, x.r) for x in got.collect()) == sorted(want) and not nested(got)


def test_pieces_cover_a_range_once(spark):
    for a in range(0, 18):
        for b in range(a, 40):
            found = spark.sql("select 1").select(lookup._pieces(F.lit(a), F.lit(b)).alias("p")).first().p if (a, b) in {(0, 0), (1, 6), (3, 17), (7, 39), (0, 31), (5, 5), (16, 31)} else None
            if found is not None:
                covered = sorted(n for p in found for n in range(p.piece << p.level, (p.piece + 1) << p.level))
                assert covered == list(range(a, b + 1)) and len(found) <= 2 * lookup.LEVELS


def test_no_ranges(spark):
    numbers = spark.createDataFrame([(1, 5)], "id long, n long")
    assert lookup.in_ranges(numbers, "n", spark.createDataFrame([], "low long, high long"), "low", "high").count() == 0


def test_longest_prefix(spark):
    names = [("NE5", 1), ("NE555", 2), ("NE555", 0), ("STM32", 3), ("", 4), (None, 5), ("é", 6)]
    texts = ["NE555P", "NE55", "NE", "STM32F1", "é1", "x", None, "NE555", "NE555P"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "NE5x")], "id long, t string")
    got = lookup.longest_prefix(rows, "t", spark.createDataFrame(names, "known string, k long"), "known", ["id"])
    want = {0: ("NE555", 0), 1: ("NE5", 1), 2: (None, None), 3: ("STM32", 3), 4: ("é", 6), 5: (None, None), 6: (None, None), 7: ("NE555", 0), 8: ("NE555", 0), None: ("NE5", 1)}
    assert {r.id: (r.known, r.k) for r in got.collect()} == want and not nested(got)
    nothing = lookup.longest_prefix(rows, "t", spark.createDataFrame([], "known string, k long"), "known", ["id"])
    assert nothing.where("known is null").count() == len(texts) + 1


def counts(texts, keywords):
    return sorted((i, k, (t or "").lower().count(k)) for i, t in texts for k in set(keywords) if k and (t or "").lower().count(k))


@pytest.mark.parametrize("window", [1, 7, 1 << 18])
def test_occurrences_against_count(window, monkeypatch):
    """Keywords of all lengths that overlap each other and themselves, over the edges of windows and of texts."""
    monkeypatch.setattr(occurrences, "WINDOW", window)
    rng = random.Random(window)
    for held, dense, letters in [(3, 0, b"ab"), (1 << 22, 1 << 22, b"ab\0"), (5, 1 << 22, "aüz ".encode())]:
        monkeypatch.setattr(occurrences, "HELD", held)
        monkeypatch.setattr(occurrences, "DENSE", dense)
        keywords = sorted({bytes(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 7, 8, 9, 16, 17, 24, 25, 90]))) for _ in range(50)} | {b"a" * k for k in (2, 3, 9, 17)})
        texts = [b"", b"a" * 60, *(bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60]))) + rng.choice(keywords) for _ in range(12)), b""]
        edges = np.cumsum([0, *map(len, texts)])
        found = occurrences.Finder(keywords).counts(np.frombuffer(b"".join(texts), np.uint8), edges)
        assert sorted(zip(*(x.tolist() for x in found))) == [(i, k, t.count(w)) for i, t in enumerate(texts) for k, w in enumerate(keywords) if w in t]


def test_keywords_that_tasks_hold_shuffle_no_text(spark):
    texts = spark.createDataFrame([(1, "Pin pinout"), (1, "pin"), (None, "PINS x"), (2, None), (3, "")], "id long, t string")
    got = lookup.keyword_counts(texts, "id", "t", spark.createDataFrame([("pin",), ("x",), ("pin",), ("",), (None,)], "keyword string"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "pin", 1), (1, "pin", 2), (None, "pin", 1), (None, "x", 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert lookup.keyword_counts(texts, "id", "t", spark.createDataFrame([], "keyword string")).count() == 0


@pytest.mark.parametrize("held", [0, lookup.HELD])
def test_keywords_against_count_whether_held_or_joined(spark, held, monkeypatch):
    monkeypatch.setattr(lookup, "HELD", held)
    monkeypatch.setattr(lookup, "CHUNK", 100)
    monkeypatch.setattr(lookup, "ROWS", 3)
    rng = random.Random(9)
    alphabet = ["pin", "Rx", "no", "connect", "ü", "--", "aa"]
    texts = [(i, rng.choice(["", " "]).join(rng.choice(alphabet) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(30)))) for i in range(40)] + [(40, None), (41, "")]
    keywords = ["pin", "no connect", " no ", "-", "--", "rx", "aa", "t r", "ü", "x\nno ", "nowhere at all", "", None]
    frame = spark.createDataFrame(texts, "id long, t string").repartition(3)
    got = lookup.keyword_counts(frame, "id", "t", spark.createDataFrame([(k,) for k in keywords], "keyword string"))
    assert sorted(map(tuple, got.collect())) == counts(texts, keywords) and not nested(got)


def test_keywords_against_count(spark):
    rng = random.Random(4)
    alphabet = ["pin", "spin", "pinout", "rx", "r", "no", "connect", "a1", "ü", "pin-out", "--", "…", "aa", "aaa"]
    texts = [(i, rng.choice(["", " "]).join(rng.choice(alphabet) + rng.choice(["", " ", ".", "\n"]) for _ in range(rng.randrange(30)))) for i in range(60)] + [(60, None), (61, ""), (62, "PIN Rx")]
    keywords = ["pin", "pin", "no connect", " no ", "-", "--", "rx", "aa", "out p", "ü", "x\nno ", " pin.", "pin-out", "nowhere at all", "", None, "…", ". pin ", "r"]
    frame = spark.createDataFrame(texts, "id long, t string").withColumns({c: F.lit("x") for c in ("word", "keyword", "n", "part")})
    got = lookup.keyword_counts(frame, "id", "t", spark.createDataFrame([(k,) for k in keywords], "keyword string"))
    assert sorted(map(tuple, got.collect())) == counts(texts, keywords) and not nested(got)


def test_the_fixed_list_counts_as_the_score_does(spark):
    texts = [(i, t) for i, t in enumerate(["Pin configuration: VCC, GND, pin 3", "no\\s*connect tx rx", "nothing", None, "pinpin input/output reset clock"])]
    frame = spark.createDataFrame(texts, "id long, text string")
    words = spark.createDataFrame([(k,) for k in rules.DENSITY_KEYWORDS], "keyword string")
    found = lookup.keyword_counts(frame, "id", "text", words.distinct()).join(words.groupBy("keyword").count(), "keyword").groupBy("id").agg(F.sum(F.col("n") * F.col("count")).alias("n"))
    want = {r.id: r.n for r in frame.select("id", pages.keyword_count(F.col("text")).alias("n")).collect() if r.n}
    assert {r.id: r.n for r in found.collect()} == want and want


def test_five_thousand_keywords(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("st", "nd", "r", "xx", "lo")]
    keywords = sorted({" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3]))) for _ in range(7000)})[:5000]
    texts = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(40)]
    got = lookup.keyword_counts(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([(k,) for k in keywords], "keyword string"))
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 40_000  # no expression for each keyword
    assert sorted(map(tuple, got.collect())) == counts(texts, keywords)
