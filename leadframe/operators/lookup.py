"""Joins that aren't equalities, as equalities: ranges, prefixes, and keywords in text.

* `in_ranges`: rows with a number against ranges of it. Ranges are cut at the powers of two that they span (as a segment tree
  cuts them), so a range of any length is at most two pieces for each level and a number is in one piece of each level: a join
  by (key, level, piece), and no comparison is left over. An end that is null is open.
* `longest_prefix`: texts against known names, the longest that the text begins with. A text gives prefixes of only those
  lengths that known names have.
* `keyword_counts`: documents against a table of keywords, as many as there are. Lists of up to HELD keywords are looked for where
  the texts lie, all in one pass. From longer ones a keyword is found at a word of it: its rarest one among all documents, when
  that is a word that its neighbours can't change, else at a piece of the text's words; it is then counted in the text.

All joins are by equality. Where a side is cut into many rows, or is what grouping left, the optimiser's guess of its size comes
from the file it was read from and may be far too small; such joins ask for a merge, so nothing is broadcast by a guess.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import occurrences

#: Numbers are looked up from 0 to 2**LEVELS - 1.
LEVELS = 31


# --- ranges ---------------------------------------------------------------------------------------------------------


def _pieces(low: Column, high: Column) -> Column:
    """Array of (level, piece): disjoint blocks of 2**level numbers that make up low..high.

    At each level the range, in blocks of that level, gives away its first block if that is odd and its last if that is even,
    and goes on with the rest at the next level."""
    shift = lambda x, k: F.call_function("shiftright", x, k)
    step = lambda s, k: F.struct(
        ((s["a"] + (s["a"] % 2)) / 2).cast("bigint").alias("a"),
        (shift(s["b"] + 1, F.lit(1)) - 1).alias("b"),
        F.concat(
            s["out"],
            F.when((s["a"] <= s["b"]) & (s["a"] % 2 == 1), F.array(F.struct(k.cast("int").alias("level"), s["a"].alias("piece")))).otherwise(F.array().cast(PIECES)),
            F.when((s["a"] <= s["b"]) & (s["b"] % 2 == 0) & ~((s["a"] == s["b"]) & (s["a"] % 2 == 1)), F.array(F.struct(k.cast("int").alias("level"), s["b"].alias("piece")))).otherwise(F.array().cast(PIECES)),
        ).alias("out"),
    )
    start = F.struct(low.cast("bigint").alias("a"), high.cast("bigint").alias("b"), F.array().cast(PIECES).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["out"])


PIECES = "array<struct<level:int,piece:bigint>>"


def in_ranges(rows: DataFrame, number: str, ranges: DataFrame, low: str, high: str, keys: list[str] | None = None) -> DataFrame:
    """Inner join of `rows` with the `ranges` that their number lies in, ends included, for equal keys; keys are kept once.

    Numbers and ends are whole; numbers that are null, negative or over 2**LEVELS - 1 lie in no range. Ranges without numbers
    join nothing. Ranges may overlap, repeat and nest; each that holds a number gives a row."""
    keys, most = keys or [], (1 << LEVELS) - 1
    first = F.greatest(F.coalesce(F.col(low).cast("bigint"), F.lit(0)), F.lit(0))
    last = F.least(F.coalesce(F.col(high).cast("bigint"), F.lit(most)), F.lit(most))
    cut = ranges.where(first <= last).withColumn("_p", F.explode(_pieces(first, last))).withColumns({"_level": F.col("_p.level"), "_piece": F.col("_p.piece")}).drop("_p")
    used = cut.select("_level").distinct().agg(F.coalesce(F.sort_array(F.collect_list("_level")), F.array().cast("array<int>"))).first()[0]  # 32 at most
    n = F.col(number).cast("bigint")
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("_level"), F.call_function("shiftright", n, F.lit(k)).alias("_piece")) for k in used)) if used else F.array().cast("array<struct<_level:int,_piece:bigint>>"))
    placed = rows.where((n >= 0) & (n <= most)).withColumn("_at", at).select("*", "_at.*").drop("_at")
    return placed.join(cut.hint("merge"), [*keys, "_level", "_piece"]).drop("_level", "_piece")


# --- prefixes -------------------------------------------------------------------------------------------------------


def longest_prefix(rows: DataFrame, text: str, names: DataFrame, name: str, by: list[str]) -> DataFrame:
    """`rows`, told apart by the columns `by`, with the columns of the known name that is their text's longest prefix; null
    where none is.

    Of names that are equal, the least row counts. Empty and null names are none; null texts have no prefix. Lengths of names
    are few; each different text is cut at those only, once. Only lengths are gathered for texts, and a name's row is fetched last."""
    known = names.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(F.col(name).alias("_prefix")).agg(F.min(F.struct(*names.columns)).alias("_known"))
    lengths = sorted(r[0] for r in known.select(F.length("_prefix").alias("n")).distinct().collect())  # as many as the longest name has characters
    cuts = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda k: k <= F.length("_text"))
    texts = rows.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    prefixes = texts.select("_text", F.explode(F.transform(cuts, lambda k: F.substring(F.col("_text"), F.lit(1), k))).alias("_prefix"))
    longest = prefixes.join(known.select("_prefix").hint("merge"), "_prefix").groupBy("_text").agg(F.max(F.length("_prefix")).alias("_length"))
    own = rows.select("*", F.col(text).alias("_text")).join(longest.hint("merge"), "_text", "left").withColumn("_prefix", F.substring(F.col("_text"), F.lit(1), F.col("_length")))
    found = own.join(known.hint("merge"), "_prefix", "left")
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(f"_known.`{c}`").alias(c) for c in names.columns))


# --- keywords -------------------------------------------------------------------------------------------------------

#: Keywords, and bytes of them in all, that a task holds. More of them meet the texts in joins.
HELD, HELD_BYTES = 1 << 18, 1 << 23
#: Bytes of texts whose occurrences are counted together, and rows given out together.
CHUNK, ROWS = 1 << 20, 1 << 16
#: Characters of words, in a regular expression's class.
LETTERS = r"0-9a-z\x{80}-\x{10ffff}"
WORD = f"[{LETTERS}]+"
#: Keywords without any such character are looked for in every text; there may be so many.
MOST_BARE = 1000
#: Different words of a text whose pieces are held in one row.
LOT = 4096


def keyword_counts(docs: DataFrame, id_col: str, text_col: str, keywords: DataFrame, word_col: str = "keyword") -> DataFrame:
    """(id_col, keyword, n): how often each keyword occurs in each text's lower case, without overlaps, from the left, as
    `text.count(keyword)` does; only where it does at all. Keywords that repeat count once here. Ids tell texts apart.

    Up to HELD keywords go to the tasks, so a text is read once where it lies, nothing is shuffled, and rows without an id or
    with equal ids are counted each. Of more keywords, one with a word that has other characters of it on both sides ("no connect " has "connect") occurs only where that word
    does; such keywords meet texts by their rarest such word. Others may be parts of longer words ("pin", "rx"), or begin or end
    there ("out p" is the end of a word and the beginning of one): they meet pieces of the text's words, of the lengths that
    keywords have, each different piece once. So a text leaves its row only with what it may hold."""
    terms = keywords.select(F.col(word_col).alias("keyword")).where("keyword is not null and keyword <> ''").distinct()
    low = docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_low")).where("_low is not null")
    id_type = low.schema["_id"].dataType.simpleString()
    many, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0))).first()
    if many <= HELD and size <= HELD_BYTES:
        listed = sorted(r[0] for r in terms.collect())
        return low.mapInArrow(lambda batches: _found(listed, batches), f"_id {id_type}, keyword string, n int").withColumnRenamed("_id", id_col)
    own_words = F.array_distinct(F.regexp_extract_all("_low", F.lit(WORD), F.lit(0)))
    inner = F.regexp_extract_all("keyword", F.lit(f"(?<=[^{LETTERS}])({WORD})(?=[^{LETTERS}])"), F.lit(1))
    # Without an inner word there are two words at most, at the keyword's ends. The longer one counts, with a blank at the side
    # where the text's word ends with it.
    runs = F.regexp_extract_all("keyword", F.lit(f"(?:^|[^{LETTERS}])?{WORD}(?:[^{LETTERS}]|$)?"), F.lit(0))
    run = F.try_element_at(F.array_sort(F.transform(runs, lambda r: F.regexp_replace(r, f"[^{LETTERS}]", " ")), lambda a, b: F.length(b) - F.length(a)), F.lit(1))
    marked = terms.select("keyword", F.array_distinct(inner).alias("inner"), run.alias("part"))
    parts = marked.where(F.size("inner") == 0).select("keyword", "part")

    side = F.when(F.startswith("part", F.lit(" ")), "begin").when(F.endswith("part", F.lit(" ")), "end").otherwise("any")
    sizes = {"any": [], "begin": [], "end": []}
    for kind, n in sorted(map(tuple, parts.where("part is not null").select(side, F.length(F.btrim("part"))).distinct().collect())):
        sizes[kind].append(n)

    def cut(word: Column) -> Column:
        of = lambda kind, f: F.transform(F.filter(F.array(*map(F.lit, sizes[kind])), lambda k: k <= F.length(word)), f)
        found = [F.array().cast("array<string>")]
        if sizes["any"]:
            found.append(F.flatten(of("any", lambda k: F.transform(F.sequence(F.lit(1), F.length(word) - k + 1), lambda i: F.substring(word, i, k)))))
        if sizes["begin"]:
            found.append(of("begin", lambda k: F.concat(F.lit(" "), F.substring(word, F.lit(1), k))))
        if sizes["end"]:
            found.append(of("end", lambda k: F.concat(F.substring(word, F.length(word) - k + 1, k), F.lit(" "))))
        return F.concat(*found)

    # Long texts are cut into lots of different words, so a row holds the pieces of one lot only.
    lots = F.transform(F.sequence(F.lit(0), F.floor((F.size("_words") - 1) / LOT).cast("int")), lambda i: F.slice("_words", i * LOT + 1, F.lit(LOT)))
    held = low.select("_id", own_words.alias("_words")).where(F.size("_words") > 0)
    pieces = held.select("_id", F.explode(lots).alias("_lot")).select("_id", F.explode(F.array_distinct(F.flatten(F.transform("_lot", cut)))).alias("part"))
    pairs = pieces.join(parts.where("part is not null").groupBy("part").agg(F.collect_list("keyword").alias("some")), "part").select("_id", "some")
    if not marked.where(F.size("inner") > 0).isEmpty():
        words = held.select("_id", F.explode("_words").alias("word"))
        often = words.groupBy("word").agg(F.count("*").alias("often"))
        whole = marked.where(F.size("inner") > 0).select("keyword", F.explode("inner").alias("word")).join(often, "word", "left")
        anchor = whole.groupBy("keyword").agg(F.min_by("word", F.struct(F.coalesce("often", F.lit(0)), "word")).alias("word"))
        pairs = pairs.unionByName(words.join(anchor.groupBy("word").agg(F.collect_list("keyword").alias("some")), "word").select("_id", "some"))
    bare = [r[0] for r in parts.where("part is null").select("keyword").limit(MOST_BARE + 1).collect()]
    if len(bare) > MOST_BARE:
        raise ValueError(f"more than {MOST_BARE} keywords have no letter or digit")
    found = low.join(pairs.groupBy("_id").agg(F.array_distinct(F.flatten(F.collect_list("some"))).alias("some")), "_id", "left")
    some = F.concat(F.coalesce("some", F.array().cast("array<string>")), F.array(*map(F.lit, bare)).cast("array<string>"))
    counted = found.select("_id", "_low", some.alias("some")).mapInArrow(_counted, f"_id {id_type}, keyword string, n int")
    return counted.withColumnRenamed("_id", id_col)


def _found(keywords: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, keyword, n) of texts (_id, _low): the occurrences of all keywords."""
    finder, names = occurrences.Finder([k.encode() for k in keywords]), pa.array(keywords, pa.string())
    for batch in batches:
        data, edges = _bytes(batch.column(1))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + CHUNK, "right")) - 1)
            ids = batch.column(0).slice(first, last - first)
            row, which, n = finder.counts(data, edges[first : last + 1])
            for a in range(0, len(row), ROWS):
                part = slice(a, a + ROWS)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[part])), names.take(pa.array(which[part])), pa.array(n[part].astype(np.int32))], names=["_id", "keyword", "n"])
            first = last


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, and where each begins and the last ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    edges = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8), edges


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, keyword, n) of texts (_id, _low, some): the occurrences of each keyword that may be there. Searching a text over and
    over is all that is left to do, and Python's search is many times as fast as replacing and measuring."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            lists = part.column(2)
            keywords, size = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(part.num_rows), size)
            texts = part.column(1).to_pylist()
            n = np.fromiter((texts[r].count(w) for r, w in zip(row.tolist(), keywords.to_pylist())), np.int32, len(row))
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[hit])), keywords.take(pa.array(hit)), pa.array(n[hit])], names=["_id", "keyword", "n"])
