"""Timestamps of mixed layouts: one automaton run over whole Arrow buffers, then votes on the order of slashed dates.

The automaton is a table: (state, class of the byte) gives the next state and an action on one register, which is
multiplied by 0, 1 or 10 and increased by the byte's digit or a constant. All stamps of a batch advance together, one byte
a step; the state in which a stamp ends tells its layout, its registers hold the fields. A stamp that can be accepted has at
most 30 bytes without its margins, so that is the number of steps.

Layouts, after `[\\x20\\x09-\\x0D]` is stripped at both ends: ten digits are epoch seconds, thirteen milliseconds; y-m-d, ymd,
d.m.y, d b y, d/m/y or m/d/y are dates, with y in 2000 to 2099, b from Jan to Dec and two digits for the rest. Then may come
T or a space and h:m or h:m:s, then AM or PM (hours 01 to 12), then Z or an offset +h:m or +hm (hours up to 14), each of both
after a space or none. Without a time it is midnight. Dates without offset are in the row's zone; wall times that it skips or
repeats take the offset before the change.

A slashed stamp that is possible in one order only votes for it in its source. One that gives different dates is read in the
order that has over `MAJORITY` times the other's votes there, else month first.

Only stamps with a slash can vote or depend on votes: those alone are read twice, and joined with the votes. Votes are summed
before they are shuffled. Their table is broadcast if it was counted to be small (`FEW` sources of `SHORT` bytes), else
joined by a shuffle, in which adaptive execution splits a source that holds a large part of the rows. Nothing is gathered by
source.

Defined cases: null, empty and other stamps that fit no layout, impossible dates and times, and dates without offset in a
zone that is null or no IANA name, are bad: null time, not ambiguous, no vote. Stamps of any length are read in bounded
steps. Null is a source like any other. Repeated rows each vote and each give a row; null ids stay. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, slices, spans, tidy

MAJORITY = 3
#: The table of votes is broadcast up to this many sources, if none has more than so many bytes: 1 MB in all.
FEW, SHORT = 2048, 512
#: Bytes of stamps that advance together, about.
CHUNK = 1 << 20

#: The names of months in stamps.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

BAD, SECONDS, MILLIS, ISO, COMPACT, DOTTED, NAMED, SLASHED = range(8)
LAYOUTS = ["bad", "seconds", "milliseconds", "y-m-d", "ymd", "d.m.y", "d b y", "slashed"]
RUN1, RUN2, RUN3, HOUR, MINUTE, SECOND, HALF, SIGN, OFFSET_HOUR, OFFSET_MINUTE, NONE = range(11)
AM, PM = 1, 2
#: No stamp with more bytes is accepted: "03 Jan 2024 05:26:07 AM +05:30" has 30.
LONGEST = 30


# --- the automaton --------------------------------------------------------------------------------------------------


class Automaton:
    """Transition table, built rule by rule. State 0 is dead, state 1 the start; class 0 is any byte without a rule."""

    def __init__(self):
        self.rules: dict[tuple[int, str], tuple[int, int, int, int]] = {}
        self.layout = [BAD, BAD]
        dates = self._dates()
        for layout, end in dates.items():
            self._time(layout, end)
        self._compile()

    def _state(self, layout: int = BAD) -> int:
        self.layout.append(layout)
        return len(self.layout) - 1

    def _go(self, state: int, letters: str, register: int = NONE, times: int = 1, plus: int | None = None, layout: int = BAD, to: int | None = None) -> int:
        """A transition on any of these letters, to a new state unless `to` is given. `plus` None adds the digit read."""
        to = self._state(layout) if to is None else to
        for letter in letters:
            self.rules[state, letter] = (to, register, times, int(letter) if plus is None else plus)
        return to

    def _digits(self, state: int, n: int, register: int, layout: int = BAD) -> int:
        for k in range(n):
            state = self._go(state, "0123456789", register, 10, layout=layout if k == n - 1 else BAD)
        return state

    def _sign(self, state: int, letter: str, layout: int = BAD) -> int:
        return self._go(state, letter, plus=0, layout=layout)

    def _dates(self) -> dict[int, int]:
        """The state after each layout's date."""
        two = self._digits(1, 2, RUN1)
        four = self._digits(two, 2, RUN1)
        eight = self._digits(four, 4, RUN1, COMPACT)
        ten = self._digits(eight, 2, RUN1, SECONDS)
        self._digits(ten, 3, RUN1, MILLIS)
        ends = {COMPACT: eight}
        month = self._digits(self._sign(four, "-"), 2, RUN2)
        ends[ISO] = self._digits(self._sign(month, "-"), 2, RUN3, ISO)
        for mark, layout in ((".", DOTTED), ("/", SLASHED)):
            second = self._digits(self._sign(two, mark), 2, RUN2)
            ends[layout] = self._digits(self._sign(second, mark), 4, RUN3, layout)
        blank, named = self._sign(two, " "), self._state()
        for number, name in enumerate(MONTHS, 1):
            state = blank
            for letter in name[:2]:
                found = self.rules.get((state, letter))
                state = found[0] if found else self._sign(state, letter)
            self._go(state, name[2], RUN2, 0, number, to=named)
        ends[NAMED] = self._digits(self._sign(named, " "), 4, RUN3, NAMED)
        return ends

    def _time(self, layout: int, date: int) -> None:
        hour = self._digits(self._go(date, "T ", plus=0), 2, HOUR)
        minute = self._digits(self._sign(hour, ":"), 2, MINUTE, layout)
        second = self._digits(self._sign(minute, ":"), 2, SECOND, layout)
        letter, half, after_half, blank = self._state(), self._state(layout), self._state(), self._state()
        zulu, signed = self._state(layout), self._state()
        self._go(letter, "M", plus=0, to=half)
        self._go(half, " ", plus=0, to=after_half)
        for state in (minute, second):
            self._go(state, " ", plus=0, to=blank)
        for state in (minute, second, blank):
            self._go(state, "A", HALF, 0, AM, to=letter)
            self._go(state, "P", HALF, 0, PM, to=letter)
        for state in (minute, second, blank, half, after_half):
            self._go(state, "Z", SIGN, 0, 1, to=zulu)
            self._go(state, "+", SIGN, 0, 1, to=signed)
            self._go(state, "-", SIGN, 0, -1, to=signed)
        hours = self._digits(signed, 2, OFFSET_HOUR)
        first = self._digits(self._sign(hours, ":"), 1, OFFSET_MINUTE)
        self._go(hours, "0123456789", OFFSET_MINUTE, 10, to=first)
        self._go(first, "0123456789", OFFSET_MINUTE, 10, layout=layout)

    def _compile(self) -> None:
        letters = sorted({letter for _, letter in self.rules})
        self.classes = np.zeros(256, np.uint8)
        for k, letter in enumerate(letters, 1):
            self.classes[ord(letter)] = k
        shape = (len(self.layout), len(letters) + 1)
        self.next = np.zeros(shape, np.uint8)
        self.register, self.times, self.plus = np.full(shape, NONE, np.uint8), np.ones(shape, np.int64), np.zeros(shape, np.int64)
        for (state, letter), (to, register, times, plus) in self.rules.items():
            at = state, self.classes[ord(letter)]
            self.next[at], self.register[at], self.times[at], self.plus[at] = to, register, times, plus
        self.accepts = np.array(self.layout, np.uint8)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(layout of each stamp data[start:end], its registers as a table of register by stamp)."""
        n = len(starts)
        state, registers = np.ones(n, np.uint8), np.zeros((NONE + 1, n), np.int64)
        size = ends - starts
        state[size > LONGEST] = 0
        live = np.flatnonzero(state)
        for step in range(LONGEST):
            live = live[(size[live] > step) & (state[live] > 0)]
            if not len(live):
                break
            at = state[live], self.classes[data[starts[live] + step]]
            register = self.register[at]
            registers[register, live] = registers[register, live] * self.times[at] + self.plus[at]
            state[live] = self.next[at]
        return self.accepts[state], registers


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bounds without white space at both ends."""
    first, last = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
    part = data[first:last]
    solid = np.flatnonzero((part != 32) & ((part < 9) | (part > 13))) + first
    if not len(solid):
        return starts, starts
    a = np.append(solid, last)[np.searchsorted(solid, starts)]
    before = np.searchsorted(solid, ends) - 1
    b = np.where(before >= 0, solid[np.maximum(before, 0)] + 1, starts)
    return np.minimum(a, ends), np.maximum(b, np.minimum(a, ends))


# --- zones ----------------------------------------------------------------------------------------------------------


class Zone:
    """Offsets of a zone from 2000 to 2099, in seconds, and the changes between them."""

    FROM, UPTO = 946_512_000 - 86_400 * 2, 4_102_444_800 + 86_400 * 2

    def __init__(self, name: str):
        from zoneinfo import ZoneInfo

        zone, epoch = ZoneInfo(name), datetime(1970, 1, 1, tzinfo=timezone.utc)

        def offset(at: int) -> int:
            return int((epoch + timedelta(seconds=at)).astimezone(zone).utcoffset().total_seconds())

        days = range(self.FROM, self.UPTO, 86_400)
        found = [offset(at) for at in days]
        changes, offsets = [], found[:1]
        for k in range(1, len(found)):
            if found[k] != found[k - 1]:
                low, high = days[k - 1], days[k]  # the change is in (low, high]
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if offset(middle) == found[k - 1] else (low, middle)
                changes.append(high)
                offsets.append(found[k])
        at, self.offsets = np.array(changes, np.int64), np.array(offsets, np.int64)
        before, after = self.offsets[:-1], self.offsets[1:]
        self.from_wall, self.upto_wall = at + np.minimum(before, after), at + np.maximum(before, after)

    def resolve(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTC seconds of wall times in seconds, whether the zone skips or repeats them)."""
        k = np.searchsorted(self.upto_wall, wall, "right")
        doubtful = np.append(self.from_wall, np.iinfo(np.int64).max)[k] <= wall
        return wall - self.offsets[k], doubtful


@lru_cache(1024)
def zone_named(name: str) -> Zone | None:
    try:
        return Zone(name)
    except (KeyError, ValueError, OSError):
        return None


# --- fields to instants ---------------------------------------------------------------------------------------------


def days_of(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(days since 1970, whether there is such a date from 2000 to 2099)."""
    fine = (year >= 2000) & (year <= 2099) & (month >= 1) & (month <= 12) & (day >= 1)
    months = np.where(fine, (year - 1970) * 12 + month - 1, 0)
    first = months.astype("M8[M]").astype("M8[D]").astype(np.int64)
    after = (months + 1).astype("M8[M]").astype("M8[D]").astype(np.int64)
    fine &= day <= after - first
    return np.where(fine, first + day - 1, 0), fine


def read(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, zones: pa.Array) -> dict[str, np.ndarray]:
    """What each stamp says: layout; `first` and `second` with the microseconds UTC by month-first and day-first order (the
    same but for slashed dates), whether each is possible, and whether its wall time is skipped or repeated."""
    layout, r = automaton().run(data, *stripped(data, starts, ends))
    half, hour = r[HALF], r[HOUR]
    timed = np.where(half > 0, (hour >= 1) & (hour <= 12), hour <= 23)
    timed &= (r[MINUTE] <= 59) & (r[SECOND] <= 59) & (r[OFFSET_HOUR] <= 14) & (r[OFFSET_MINUTE] <= 59)
    hour = np.where(half > 0, hour % 12 + 12 * (half == PM), hour)
    seconds = hour * 3600 + r[MINUTE] * 60 + r[SECOND]
    offset = r[SIGN] * (r[OFFSET_HOUR] * 3600 + r[OFFSET_MINUTE] * 60)

    iso, compact = layout == ISO, layout == COMPACT
    year = np.where(iso, r[RUN1], np.where(compact, r[RUN1] // 10_000, r[RUN3]))
    later = np.where(iso, r[RUN3], np.where(compact, r[RUN1] % 100, r[RUN1]))  # the day, but for month-first
    month = np.where(compact, r[RUN1] // 100 % 100, r[RUN2])
    slashed = layout == SLASHED
    epoch = (layout == SECONDS) | (layout == MILLIS)
    out = {"layout": layout}
    encoded = zones.dictionary_encode()
    codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    names = encoded.dictionary.to_pylist()
    for which, (m, d) in (("first", (np.where(slashed, later, month), np.where(slashed, month, later))), ("second", (month, later))):
        days, dated = days_of(year, m, d)
        fine = dated & timed & (layout >= ISO)
        wall = days * 86_400 + seconds
        utc, doubtful = wall - offset, np.zeros(len(wall), bool)
        local = np.flatnonzero(fine & (r[SIGN] == 0))
        order = local[np.argsort(codes[local], kind="stable")]
        edge = np.flatnonzero(np.diff(codes[order], prepend=-2, append=len(names)))
        for a, b in zip(edge, edge[1:]):
            rows = order[a:b]
            known = zone_named(names[codes[rows[0]]]) if codes[rows[0]] >= 0 else None
            if known is None:
                fine[rows] = False
            else:
                utc[rows], doubtful[rows] = known.resolve(wall[rows])
        out |= {which: np.where(epoch, r[RUN1] * np.where(layout == SECONDS, 1_000_000, 1_000), utc * 1_000_000), f"{which}_fine": fine | epoch, f"{which}_doubtful": doubtful}
    return out


FIELDS = "layout byte, us_first long, us_second long, doubtful_first boolean, doubtful_second boolean"


def parsed(stamps: DataFrame, id_col: str, raw_col: str, source_col: str, zone_col: str) -> DataFrame:
    """(id, source, layout, us_first, us_second, doubtful_first, doubtful_second); times are null where the stamp is impossible
    in that order."""
    fields = stamps.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(raw_col).cast("string").alias("raw"), F.col(zone_col).cast("string").alias("zone"))
    kinds = [fields.schema[c].dataType.simpleString() for c in ("id", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = spans(batch.column(2))
            for a, b in slices(starts, ends, CHUNK):
                part = batch.slice(a, b - a)
                got = read(data, starts[a:b], ends[a:b], part.column(3))
                times = [pa.array(got[w], mask=~got[f"{w}_fine"]) for w in ("first", "second")]
                doubts = [pa.array(got[f"{w}_doubtful"]) for w in ("first", "second")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got["layout"].astype(np.int8)), *times, *doubts], names=["id", "source", *(x.split()[0] for x in FIELDS.split(", "))])

    return fields.mapInArrow(tidy(run), f"id {kinds[0]}, source {kinds[1]}, {FIELDS}")


# --- votes ----------------------------------------------------------------------------------------------------------


def votes(slashed: DataFrame) -> DataFrame:
    """(of, month_first, day_first): the votes of each source that has any."""
    first, second = F.col("us_first").isNotNull(), F.col("us_second").isNotNull()
    one = slashed.where((F.col("layout") == SLASHED) & (first != second))
    return one.groupBy(F.col("source").alias("of")).agg(F.count_if(first).alias("month_first"), F.count_if(second).alias("day_first"))


def normalise(stamps: DataFrame, id_col: str = "stamp_id", raw_col: str = "raw", source_col: str = "source", zone_col: str = "zone") -> DataFrame:
    """(id_col, utc_us, rule, ambiguous, layout, day_first): a row for each stamp.

    `rule` is bad, epoch, votes, default or plain; `day_first` tells how a slashed date was read, else null."""
    has_slash = F.coalesce(F.contains(F.col(raw_col).cast("string"), F.lit("/")), F.lit(False))
    names = id_col, raw_col, source_col, zone_col
    slashed = parsed(stamps.where(has_slash), *names)
    tally = durable(votes(slashed))
    count, longest = tally.agg(F.count("*"), F.max(F.octet_length(F.col("of").cast("string")))).first()
    small = count <= FEW and (longest or 0) <= SHORT
    counted = slashed.join(F.broadcast(tally) if small else tally, F.col("source").eqNullSafe(F.col("of")), "left")
    rest = parsed(stamps.where(~has_slash), *names).withColumns({"month_first": F.lit(None).cast("long"), "day_first": F.lit(None).cast("long")})
    rows = counted.select(*rest.columns).unionByName(rest)

    first, second = F.col("us_first"), F.col("us_second")
    month_votes, day_votes = F.coalesce("month_first", F.lit(0)), F.coalesce("day_first", F.lit(0))
    open_ = (F.col("layout") == SLASHED) & first.isNotNull() & second.isNotNull() & (first != second)
    by_days, by_months = day_votes > MAJORITY * month_votes, month_votes > MAJORITY * day_votes
    take_second = first.isNull() | (open_ & by_days)
    utc = F.when(take_second, second).otherwise(first)
    rule = (
        F.when(utc.isNull(), "bad").when(F.col("layout").isin(SECONDS, MILLIS), "epoch").when(open_ & (by_days | by_months), "votes").when(open_, "default").otherwise("plain")
    )
    doubtful = F.when(take_second, F.col("doubtful_second")).otherwise(F.col("doubtful_first"))
    return rows.select(
        F.col("id").alias(id_col),
        utc.alias("utc_us"),
        rule.alias("rule"),
        (utc.isNotNull() & (open_ | doubtful)).alias("ambiguous"),
        F.element_at(F.array(*map(F.lit, LAYOUTS)), F.when(utc.isNull(), BAD).otherwise(F.col("layout")).cast("int") + 1).alias("layout"),
        F.when((F.col("layout") == SLASHED) & utc.isNotNull(), take_second).alias("day_first"),
    )


ORACLE = r"""
with s as (
    select stamp_id, source, zone, regexp_replace(raw, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') as raw from stamps
), cut as (
    select *, regexp_extract(raw, '^(20[0-9]{2}-[0-9]{2}-[0-9]{2}|20[0-9]{6}|[0-9]{2}\.[0-9]{2}\.20[0-9]{2}|[0-9]{2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9]{2}|[0-9]{2}/[0-9]{2}/20[0-9]{2})([T ]([0-9]{2}):([0-9]{2})(:([0-9]{2}))?( ?([AP])M)?( ?(Z|([+-])([0-9]{2}):?([0-9]{2})))?)?$',
        ['d', 'b', 't', 'h', 'm', 's1', 's', 'p1', 'p', 'z1', 'z', 'sign', 'oh', 'om']) as x
    from s
), fields as (
    select stamp_id, source, zone, raw, x.d as d, case when x.b <> '' then 1 + list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], x.b) - 1 end as b,
           coalesce(try_cast(nullif(x.h, '') as int), 0) as h, x.p as p, x.t as t, x.z as z, x.sign as sign,
           coalesce(try_cast(nullif(x.m, '') as int), 0) as m, coalesce(try_cast(nullif(x.s, '') as int), 0) as sec,
           coalesce(try_cast(nullif(x.oh, '') as int), 0) as oh, coalesce(try_cast(nullif(x.om, '') as int), 0) as om
    from cut
), dated as (
    select *, contains(d, '/') as slashed,
           case when d = '' or d is null then null
                when contains(d, '-') then d
                when length(d) = 8 then d[1:4] || '-' || d[5:6] || '-' || d[7:8]
                when contains(d, '.') then d[7:10] || '-' || d[4:5] || '-' || d[1:2]
                when contains(d, '/') then d[7:10] || '-' || d[1:2] || '-' || d[4:5]
                else d[8:11] || '-' || lpad(cast(b as varchar), 2, '0') || '-' || d[1:2] end as first_,
           case when contains(d, '/') then d[7:10] || '-' || d[4:5] || '-' || d[1:2] end as second_,
           case when p = '' then h <= 23 else h between 1 and 12 end and m <= 59 and sec <= 59 and oh <= 14 and om <= 59
             and (z <> '' or zone in (select name from pg_timezone_names())) as timed,
           case when p = '' then h else h % 12 + case when p = 'P' then 12 else 0 end end * 3600 + m * 60 + sec as seconds
    from fields
), pairs as (
    select *, case when timed then try_cast(first_ as date) end as d1, case when timed then try_cast(case when slashed then second_ else first_ end as date) end as d2 from dated
), votes as (
    select source, count(*) filter (where d1 is not null) as months, count(*) filter (where d2 is not null) as days
    from pairs where slashed and (d1 is null) <> (d2 is null) group by source
), chosen as (
    select b.*, slashed and d1 <> d2 as open_, coalesce(months, 0) as months, coalesce(days, 0) as days,
           case when d1 is null then d2 when slashed and d1 <> d2 and coalesce(days, 0) > 3 * coalesce(months, 0) then d2 else d1 end as d0
    from pairs b left join votes v on v.source is not distinct from b.source
), walls as (
    select *, epoch_us(cast(d0 as timestamp)) // 1000000 + seconds as wall from chosen
), shifted as (
    select *, case when z <> '' then 0 else epoch_us(timezone(zone, make_timestamptz((wall - 93600) * 1000000))) // 1000000 - (wall - 93600) end as before_,
           case when z <> '' then 0 else epoch_us(timezone(zone, make_timestamptz((wall + 93600) * 1000000))) // 1000000 - (wall + 93600) end as after_
    from walls where d0 is not null
), tried as (
    select *, epoch_us(timezone(zone, make_timestamptz((wall - before_) * 1000000))) // 1000000 = wall as fits_before,
           epoch_us(timezone(zone, make_timestamptz((wall - after_) * 1000000))) // 1000000 = wall as fits_after
    from shifted
), found as (
    select stamp_id, case when z <> '' then wall - case sign when '-' then -1 else 1 end * (oh * 3600 + om * 60)
                          when fits_after and not fits_before then wall - after_ else wall - before_ end * 1000000 as utc_us,
           case when open_ then case when days > 3 * months or months > 3 * days then 'votes' else 'default' end else 'plain' end as rule,
           coalesce(open_, false) or (z = '' and before_ <> after_ and fits_before = fits_after) as ambiguous
    from tried
)
select stamp_id, cast(utc_us as bigint) as utc_us, rule, ambiguous from found
union all
select stamp_id, case when length(raw) = 10 then cast(raw as bigint) * 1000000 else cast(raw as bigint) * 1000 end, 'epoch', false
from s where regexp_full_match(raw, '[0-9]{10}|[0-9]{13}')
union all
select stamp_id, cast(null as bigint), 'bad', false
from walls where d0 is null and not coalesce(regexp_full_match(raw, '[0-9]{10}|[0-9]{13}'), false)
"""
