"""How filters interact: what each removes, alone and after others, in every order of applying them.

A document's outcome is a mask of the filters that it fails. With n filters, applied one after another, all that matters at a
step is which ones went before: a set S of them, and the next filter f, an edge of the lattice of subsets. There are
n * 2**(n-1) edges (80 of five filters), and every step of each of the n! orders (600 of 120) is one of them. So documents are
first summed by part and mask, each sum contributes to all edges, and the steps of an order look up their edges, which are
a path through the lattice from no filter to all of them.

Along an edge a document that fails f is removed if it fails nothing in S, else it is redundant; one that fails nothing in S
nor f is kept. A filter's `shapley` is what it removes, summed over all orders: by S, the number of orders that apply just S
before f is |S|! (n - 1 - |S|)!.

The five filters here: A under 200 words; B fewer distinct words than half of the words; C over 2 % of capital letters A-Z; D
any of # $ % & * |; E the same text as that of a smaller id. Words are runs of characters other than ASCII white space.

Texts are judged where they lie, in the JVM. What is shuffled of a document is its id, part, mask and a SHA-256 of its text.
Copies are summed before and after the shuffle by digest and ids, so that thousands of copies of one text are a few rows by
the time its least id is known; that join leaves the split of what remains to adaptive execution. Sums by part and mask are at
most 128 rows for each part and task. The only broadcast is the table of 600 steps.

Defined cases: a null text is the empty one; it has no words, so A fails and B and C pass. A null part is the part ''. A row
without id is never a copy and makes no other row one. Rows with equal ids and texts are copies of a smaller id or all of
none. Without labels, or with null ones, nothing is good or toxic; of repeated labels of an id the larger counts. Texts of any
length are judged whole. No documents give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable

#: The thresholds of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, "[#$%&*|]"
#: White space that parts words, as characters and as a pattern.
BLANKS = " \t\n\x0b\f\r"
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails A to D."""
    text = F.coalesce(text, F.lit(""))
    inner = F.btrim(text, F.lit(BLANKS))
    words = F.split(inner, "[\\x20\\x09-\\x0D]+")
    n = F.when(inner == "", 0).otherwise(F.size(words))
    distinct = F.when(inner == "", 0).otherwise(F.size(F.array_distinct(words)))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct < DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.char_length(text),
        "D": F.rlike(text, F.lit(MARKS)),
    }


def outcomes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents summed by which of A to E they fail; bit k of `mask` is filter k."""
    fails = text_failures(F.col(text_col))
    mask = sum((F.when(fails[f], 1 << k).otherwise(0) for k, f in enumerate("ABCD")), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest"))
    rows = rows.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(*(F.coalesce(F.max(F.col(c)) == 1, F.lit(False)).alias(c) for c in ("quality", "toxic")))
    # Rows without id have no labels; they are spread instead of meeting under one key.
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest", "part")).otherwise(0)
    marks = marks.withColumn("spread", F.lit(0).cast("long"))
    rows = rows.withColumn("spread", spread)
    same = (F.coalesce(F.col("id"), F.lit(0)) == F.col("of")) & (rows["spread"] == marks["spread"])
    known = F.col("id").isNotNull()
    good, toxic = (F.coalesce(known & F.col(c), F.lit(False)) for c in ("quality", "toxic"))
    rows = rows.join(marks, same, "left").select("id", "part", "mask", "digest", "n", good.alias("good"), toxic.alias("toxic"))
    groups = durable(
        rows.groupBy("digest", "part", "mask", "good", "toxic", F.col("id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"))
    )
    first = groups.where("not nameless").groupBy("digest").agg(F.min("least").alias("first"))
    met = groups.join(first, "digest", "left")
    copies = F.when(F.col("nameless"), 0).when(F.col("least") == F.col("first"), F.col("n") - F.col("at_least")).otherwise(F.col("n"))
    two = F.explode(F.array(F.struct((F.col("n") - copies).alias("n"), F.lit(0).alias("copy")), F.struct(copies.alias("n"), F.lit(1 << 4).alias("copy"))))
    return met.select("part", "mask", "good", "toxic", two.alias("x")).where("x.n > 0").groupBy("part", (F.col("mask") + F.col("x.copy")).alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def edges(outcomes: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, before, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each edge of each
    part. `before` is the mask of what is already applied, `next` the number of the filter that follows."""
    subset, k = F.col("before"), F.col("next")
    steps = [(s, f) for f in range(filters) for s in range(1 << filters) if not s >> f & 1]
    edge = F.explode(F.array(*(F.struct(F.lit(s).alias("before"), F.lit(f).alias("next")) for s, f in steps)))
    at = outcomes.select("*", edge.alias("e")).select("part", "mask", "good", "toxic", "n", "e.*")
    bit = F.call_function("shiftleft", F.lit(1), k)
    fails, earlier = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(subset) != 0
    total = lambda which, name: F.sum(F.when(which, F.col("n")).otherwise(0)).alias(name)
    counts = [~fails & ~earlier, fails & ~earlier, fails & earlier, F.col("mask") == bit, fails & ~earlier & F.col("good"), fails & ~earlier & F.col("toxic")]
    found = at.groupBy("part", "before", "next").agg(*(total(which, name) for which, name in zip(counts, COUNTS)))
    orders = F.element_at(F.array(*(F.lit(factorial(i) * factorial(filters - 1 - i)) for i in range(filters))), F.bit_count("before") + 1)
    weight = found.groupBy("part", "next").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    return found.join(weight, ["part", "next"])


def orders(spark, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, before, next): the steps of all orders."""
    rows = [("".join(filters[k] for k in p), i + 1, sum(1 << k for k in p[:i]), p[i]) for p in permutations(range(len(filters))) for i in range(len(filters))]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, next int")


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    found = edges(outcomes(docs, labels, id_col, text_col, part_col))
    return found.join(F.broadcast(orders(docs.sparkSession)), ["before", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")


ORACLE = """
with d as materialized (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, trim(coalesce(text, ''), e' \\t\\n\\x0B\\f\\r') as inner_ from documents
), w as (
    select *, case when inner_ = '' then [] else regexp_split_to_array(inner_, '[\\x20\\x09-\\x0D]+') end as words,
           min(doc_id) over (partition by text) as least
    from d
), marks as (
    select doc_id, max(quality) = 1 as good, max(toxic) = 1 as bad from labels where doc_id is not null group by doc_id
), f as materialized (
    select part, case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
           + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 4 else 0 end
           + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when w.doc_id > least then 16 else 0 end as mask,
           coalesce(good, false) as good, coalesce(bad, false) as bad
    from w left join marks using (doc_id)
), s as (
    select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (bad) as bad from f group by part, mask
), k as (select unnest(range(5)) as k
), steps as (
    select substr('ABCDE', a.k + 1, 1) || substr('ABCDE', b.k + 1, 1) || substr('ABCDE', c.k + 1, 1) || substr('ABCDE', e.k + 1, 1) || substr('ABCDE', g.k + 1, 1) as filter_order,
           unnest([1, 2, 3, 4, 5]) as step, unnest([a.k, b.k, c.k, e.k, g.k]) as f,
           unnest([0, 1 << a.k, (1 << a.k) + (1 << b.k), (1 << a.k) + (1 << b.k) + (1 << c.k), (1 << a.k) + (1 << b.k) + (1 << c.k) + (1 << e.k)]) as before_
    from k a, k b, k c, k e, k g where (1 << a.k) + (1 << b.k) + (1 << c.k) + (1 << e.k) + (1 << g.k) = 31
), counted as (
    select part, filter_order, step, f,
           sum(case when mask & (before_ | (1 << f)) = 0 then n else 0 end) as kept,
           sum(case when mask & before_ = 0 and mask & (1 << f) <> 0 then n else 0 end) as removed,
           sum(case when mask & before_ <> 0 and mask & (1 << f) <> 0 then n else 0 end) as redundant,
           sum(case when mask = 1 << f then n else 0 end) as unique_fails,
           sum(case when mask & before_ = 0 and mask & (1 << f) <> 0 then good else 0 end) as good_lost,
           sum(case when mask & before_ = 0 and mask & (1 << f) <> 0 then bad else 0 end) as toxic_lost
    from s, steps group by part, filter_order, step, f
)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) as shapley
from counted
"""
