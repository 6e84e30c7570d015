"""Mixed timestamps, benchmark passages and interactions of filters: against brute force, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter
from datetime import datetime, timedelta, timezone
from itertools import permutations
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadframe.llm import audit, decontaminate, stamps
from leadframe.llm import queries as llm

from ..conftest import DATA
from ..harness import same


@pytest.mark.parametrize("name", ["op11_stamp_automaton", "op12_winnowing", "op13_filter_lattice"])
def test_equal_to_sql(spark, name):
    same(spark, llm.QUERIES[name], llm.ORACLES[name], f"{DATA}/sf0.001")


# --- op11 -----------------------------------------------------------------------------------------------------------

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
Y, TWO = "(20[0-9][0-9])", "([0-9][0-9])"
DATES = {"y-m-d": f"{Y}-{TWO}-{TWO}", "ymd": f"{Y}{TWO}{TWO}", "d.m.y": f"{TWO}\\.{TWO}\\.{Y}", "d b y": f"{TWO} ({'|'.join(MONTHS)}) {Y}", "slashed": f"{TWO}/{TWO}/{Y}"}
TAIL = f"(?:[T ]{TWO}:{TWO}(?::{TWO})?(?: ?([AP])M)?(?: ?(Z|([+-]){TWO}:?{TWO}))?)?"


def plainly(raw, zone):
    """(layout, {order: (utc seconds, doubtful)}) by regular expressions; no orders if it is bad."""
    raw = (raw or "").strip(" \t\n\v\f\r")
    if re.fullmatch("[0-9]{10}", raw):
        return "seconds", {"month": (int(raw), False)}
    if re.fullmatch("[0-9]{13}", raw):
        return "milliseconds", {"month": (int(raw) / 1000, False)}
    for layout, date in DATES.items():
        m = re.fullmatch(date + TAIL, raw)
        if not m:
            continue
        a, b, c, h, mi, s, half, z, sign, oh, om = m.groups()
        h, mi, s, oh, om = (int(x or 0) for x in (h, mi, s, oh, om))
        if half and not 1 <= h <= 12 or h > 23 or mi > 59 or s > 59 or oh > 14 or om > 59:
            return "bad", {}
        h = h % 12 + 12 * (half == "P") if half else h
        orders = {"y-m-d": [(a, b, c)], "ymd": [(a, b, c)], "d.m.y": [(c, b, a)], "d b y": [(c, MONTHS.index(b) + 1 if b in MONTHS else 0, a)], "slashed": [(c, a, b), (c, b, a)]}[layout]
        out = {}
        for order, (y, mo, d) in zip(("month", "day"), orders):
            try:
                wall = datetime(int(y), int(mo), int(d), h, mi, s)
            except ValueError:
                continue
            if z:
                out[order] = ((wall - datetime(1970, 1, 1)).total_seconds() - (-1 if sign == "-" else 1) * (oh * 3600 + om * 60), False)
                continue
            try:
                at = wall.replace(tzinfo=ZoneInfo(zone))
            except Exception:
                continue
            before, after = at.utcoffset(), at.replace(fold=1).utcoffset()  # fold 0 is the offset before the change
            out[order] = ((wall - datetime(1970, 1, 1) - before).total_seconds(), before != after)
        return layout, out
    return "bad", {}


def resolved(rows):
    """{stamp_id: (utc_us, rule, ambiguous)} by hand."""
    said = [(i, source, *plainly(raw, zone)) for i, source, zone, raw in rows]
    votes = Counter((source, next(iter(orders))) for _, source, layout, orders in said if layout == "slashed" and len(orders) == 1)
    out = []
    for i, source, layout, orders in said:
        if not orders:
            out.append((i, None, "bad", False))
            continue
        month, day = votes[source, "month"], votes[source, "day"]
        take, rule, ambiguous = next(iter(orders)), "epoch" if layout in ("seconds", "milliseconds") else "plain", False
        if len(orders) == 2 and orders["month"][0] != orders["day"][0]:
            take = "day" if day > 3 * month else "month"
            rule, ambiguous = ("votes" if day > 3 * month or month > 3 * day else "default"), True
        out.append((i, round(orders[take][0] * 1000) * 1000, rule, ambiguous or orders[take][1]))
    return sorted(out, key=repr)


STAMPS = [
    None, "", " ", "n/a", "0", "2024-03", "2024-03-10", " 2024-03-10T02:30\t", "2024-11-03 01:30:00", "2024-11-03 01:30:00 -0500", "2024-10-27 02:30", "2024-03-31 02:30:59",
    "20240229", "20230229", "20240229T0101", "29.02.2024 23:59:59", "29.02.2100", "31 Apr 2024", "30 Apr 2024 12:00 AM", "30 apr 2024", "30 Apr 2024 12:30PM+05:30", "30 Apr 2024 13:00 PM",
    "30 Apr 2024 00:10 AM", "2024-01-01 24:00", "2024-01-01 23:60", "2024-01-01 23:59:60", "2024-01-01T05:06Z", "2024-01-01T05:06 Z", "2024-01-01T05:06  Z", "2024-01-01T05:06+14:59",
    "2024-01-01T05:06+15:00", "2024-01-01T05:06-0060", "2024-01-01T05:06-00:00", "2024-01-01T", "1709513000", "17095130001", "1709513000123", "0000000000", "1999-01-01", "3024-01-01", "13/02/2024",
    "02/13/2024", "02/03/2024", "03/03/2024", "30/02/2024", "02/30/2024", "31/04/2024 10:00", "04/31/2024 10:00", "99/99/2024", "01/02/2024 10:00 PM", "20/01/2024 23:61", "٠١/٠٢/2024", "2024-01-01é",
    "x" * 5000, " " * 70000 + "2024-05-05" + "\n" * 70000, "2024-05-05\x1c", "\v2024-05-05\f", "03 Jan 2024 05:26:07 AM +05:30", "03 Jan 2024 05:26:07 AM +05:301", "2024-01-01 05:06 am",
]
ZONES = ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "UTC", "Asia/Kolkata", None, "No/Where", "../etc"]


def test_stamps_one_by_one():
    rows = [(raw, zone) for zone in ZONES for raw in STAMPS]
    data, starts, ends = stamps.spans(pa.array([r for r, _ in rows]))
    got = stamps.read(data, starts, ends, pa.array([z for _, z in rows]))
    for k, (raw, zone) in enumerate(rows):
        layout, orders = plainly(raw, zone)
        if layout == "slashed":
            want = [orders.get("month"), orders.get("day")]
        else:
            want = [orders.get("month")] * 2
        for which, at in zip(("first", "second"), want):
            assert bool(got[f"{which}_fine"][k]) == (at is not None), (raw, zone)
            if at:
                assert (got[which][k], bool(got[f"{which}_doubtful"][k])) == (round(at[0] * 1000) * 1000, at[1]), (raw, zone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="0123456789/-.: TZAPM+JanFeb\t", max_size=32) | st.from_regex(f"({'|'.join(DATES.values())}){TAIL}", fullmatch=True), max_size=20))
def test_the_automaton_equals_the_patterns(texts):
    data, starts, ends = stamps.spans(pa.array(texts, pa.string()))
    layouts, _ = stamps.automaton().run(data, *stamps.stripped(data, starts, ends))
    for text, layout in zip(texts, layouts.tolist()):
        bare = text.strip(" \t\n\v\f\r")
        fits = [k for k, d in DATES.items() if re.fullmatch(d.replace("20[0-9]", "[0-9][0-9][0-9]") + TAIL, bare, re.ASCII)]
        fits += ["seconds"] * bool(re.fullmatch("[0-9]{10}", bare)) + ["milliseconds"] * bool(re.fullmatch("[0-9]{13}", bare))
        assert [stamps.LAYOUTS[layout]] == (fits or ["bad"])


def test_every_change_of_a_zone_of_a_century():
    for name in ("America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "Pacific/Apia", "Asia/Pyongyang", "UTC"):
        zone, known = ZoneInfo(name), stamps.zone_named(name)
        around = np.concatenate([known.from_wall[:60, None] + np.arange(-7200, 7201, 1800), known.upto_wall[:60, None] + np.arange(-7200, 7201, 1800)]).ravel() if len(known.from_wall) else np.arange(0)
        walls = np.concatenate([around, np.arange(947_000_000, 4_102_000_000, 9_000_001)])
        utc, doubtful = known.resolve(walls)
        for w, u, d in zip(walls.tolist(), utc.tolist(), doubtful.tolist()):
            at = (datetime(1970, 1, 1) + timedelta(seconds=w)).replace(tzinfo=zone)
            assert (w - at.utcoffset().total_seconds(), at.utcoffset() != at.replace(fold=1).utcoffset()) == (u, d)


@pytest.mark.parametrize("small", [True, False])
def test_votes_by_source_with_hot_null_and_repeated_rows(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(stamps, "FEW", 0)  # joined by a shuffle
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None, "", "hot", "hot", "hot"]), rng.choice(ZONES), rng.choice(STAMPS)) for i in range(3000)]
    rows += [(5, "a", "UTC", "13/02/2024")] * 3 + [(None, None, "UTC", "05/06/2024"), (None, "hot", None, "05/06/2024")]
    rows += [(9000 + k, f"even{n}", "UTC", raw) for n in (3, 4) for k, raw in enumerate(["13/02/2024"] * n + ["02/13/2024", "01/02/2024"])]
    frame = spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string").withColumns({c: F.lit(1) for c in ("id", "layout", "rule", "of", "us_first", "utc_us")})
    got = stamps.normalise(frame).select("stamp_id", "utc_us", "rule", "ambiguous").collect()
    assert sorted(map(tuple, got), key=repr) == resolved(rows)


def test_stamps_empty(spark):
    frame = spark.createDataFrame([], "stamp_id long, source string, zone string, raw string")
    assert stamps.normalise(frame).count() == 0


# --- op12 -----------------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - 9) if w and item is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= of
        out.append((doc, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def passages(seed, vocabulary):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([1, 3, 4, 5, 6, 9, 10, 11, 14, 30, 60]))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "--- !!"), (43, items[3][1]), (7, some(20)), (None, some(12)), (44, "Ünïcode Ä words 日本 x1 y2 z3 a b c d"), (45, "a " * 40)]
    docs = [(i, " , ".join(rng.choice([some(rng.randrange(0, 30)), rng.choice(items)[1] or "", (rng.choice(items)[1] or "")[5:70].upper()]) for _ in range(rng.randrange(6)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "..."), (0, "again"), (0, items[5][1]), (None, items[12][1]), (153, "a " * 3000), (154, "ünïcode Ä words 日本 x1 y2 z3 a b c d"), (155, "ÜnÏcode ä words 日本 x1 y2 z3 a b")]
    return docs, items


@pytest.mark.parametrize("vocabulary", [list("ab"), [f"w{i}" for i in range(12)], [f"word{i}" for i in range(3000)]])
@pytest.mark.parametrize("small", [True, False])
def test_passages_against_brute_force(spark, monkeypatch, vocabulary, small):
    monkeypatch.setattr(decontaminate, "CHUNK", 1000)  # long rows are read in pieces
    monkeypatch.setattr(decontaminate, "WORDS", 64)
    if not small:
        monkeypatch.setattr(decontaminate, "FEW", 0)
    docs, items = passages(1, vocabulary)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "row", "hash", "found", "item_id", "n_words")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "size", "item", "print")})
    got = decontaminate.contamination(d, b)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == contaminated(docs, items)


def test_any_window_is_found_wherever_it_lies():
    rng = np.random.default_rng(0)
    for letters in (2, 3, 1000):
        h = rng.integers(0, letters, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        kept = {int(v) for _, value, *_ in decontaminate.prints(h, np.array([len(h)]), []) for v in value}
        for at in rng.integers(0, len(h) - 10, 300):
            alone = [v for _, value, *_ in decontaminate.prints(h[at : at + 10], np.array([10]), []) for v in value]
            assert len(alone) == 1 and int(alone[0]) in kept


def test_fewer_hashes_are_kept_than_there_are_words():
    h = np.random.default_rng(1).integers(0, 1 << 63, 60_000).astype(np.uint64)
    kept = sum(len(value) for _, value, *_ in decontaminate.prints(h, np.array([len(h)]), []))
    assert kept / len(h) == pytest.approx(2 / 7, abs=0.02)  # the density of winnowing with windows of six


def test_spans_are_the_longest_runs(spark):
    w = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(["x"] * 5 + w[10:40] + ["y"] + w[50:60])), (2, " ".join(w[0:12] + w[0:12])), (3, "nothing")]
    items = [(7, " ".join(w)), (8, " ".join(w[20:31])), (9, "x x")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.Hits(d, b).spans().collect()))
    assert got == [(1, 7, 5, 30), (1, 7, 36, 10), (1, 8, 15, 11), (1, 9, 0, 5), (2, 7, 0, 24)]


def test_no_documents_and_no_items(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(one, b.where("false")).collect()] == [(1, 3, 0, 0, [], False)]


# --- op13 -----------------------------------------------------------------------------------------------------------


def interactions(docs, labels):
    marks = {}
    for i, q, t in labels:
        a, b = marks.get(i, (0, 0))
        marks[i] = max(a, q or 0), max(b, t or 0)
    judged = {}
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        judged.setdefault(part or "", []).append((fails, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = []
    for part, rows in judged.items():
        found, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[0]]
                redundant = sum(f in r[0] for r in gone)
                left, gone = [r for r in left if f not in r[0]], gone + removed
                shapley[f] += len(removed)
                found.append((f, (part, order, step, len(left), len(removed), redundant, sum(r[0] == {f} for r in rows), sum(r[1] == 1 for r in removed), sum(r[2] == 1 for r in removed))))
        out += [(*row, shapley[f]) for f, row in found]
    return sorted(out)


def mixed():
    rng = random.Random(5)
    text = lambda n, v, k: " ".join((rng.choice("Ab").upper() if rng.random() < k else "w") + str(rng.randrange(v)) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 199, 200, 201, 400]), rng.choice([3, 100, 1000]), rng.choice([0, 0.03, 0.2])) + rng.choice(["", "", "#", " |"]), rng.choice(["p", "q", None, "", "hot", "hot"])) for i in range(120)]
    same = text(250, 1000, 0)
    docs += [(200 + i, same, rng.choice(["hot", "q"])) for i in range(40)] + [(150, same, "q"), (150, same, "q"), (150, same, "p"), (None, same, "p"), (None, None, None), (None, None, None)]
    docs += [(300, None, "p"), (301, "", "p"), (302, " \t", "p"), (303, "é" * 50 + "A", "p"), (304, "é" * 49 + "A", "p"), (305, "\x1c a\x0bb", "q"), (306, "w " * 30000, "q"), (1, docs[0][1], "q")]
    labels = [(d[0], rng.randrange(2), rng.randrange(2)) for d in docs if d[0] is not None and rng.random() < 0.5] + [(None, 1, 1), (3, None, None), (3, 1, None), (9999, 1, 1)]
    return docs, labels


def test_interactions_against_applying_all_orders(spark):
    docs, labels = mixed()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("id", "part", "mask", "n", "digest", "quality", "toxic", "of")})
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("x") for c in ("id", "text", "source", "part", "n", "spread")})
    got = audit.interactions(d, m)
    assert sorted(map(tuple, got.collect())) == interactions(docs, labels)


def test_a_part_has_eighty_edges(spark):
    frame = spark.createDataFrame([("p", 0, False, False, 1)], "part string, mask int, good boolean, toxic boolean, n long")
    assert audit.edges(frame).count() == 80 and audit.orders(spark).count() == 600


def test_audit_of_nothing(spark):
    d, m = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(d, m).count() == 0
    one = audit.interactions(spark.createDataFrame([(1, None, None)], d.schema), m).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one) == 120
