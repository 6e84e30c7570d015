"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit b is 1 if it is set in over half the XXH64 hashes (seed 42) of the text's word
shingles. Two fingerprints link at `max_bits` (4 at most) or fewer differing bits.

Candidates come from the perfect binary Golay code (23, 12, 7). The fingerprint is cut into segments of 22, 21 and
21 bits, each padded with zeros to a 23-bit word. If two fingerprints differ in 4 bits or fewer, then by pigeonhole
some two of the three segments differ in at most 2 bits together. Words that differ in 2 bits or fewer always share a
codeword within distance 4 of both (checked exhaustively in the tests), and a word has just 1 or 6 such codewords.
So the keys of a fingerprint are, for each pair of segments, all pairs of 12-bit indices of nearby codewords: 24-bit
keys, about 84 for each distinct fingerprint. Rows that share a key are compared exactly.

Only distinct fingerprints are compared, so exact copies cost nothing. Within a key only a spanning forest of the
links is emitted, never all pairs. A key with more than `block` fingerprints goes another exact way: its rows are
dealt to pairs of blocks, each of bounded size. Components are found by `components.components`.

`components` gives every row its fingerprint and component. `keep_one` keeps one row of each group of near copies: texts
that share 0.8 or more of their five-word shingles. At that similarity fingerprints differ in 10 of 64 bits on average and
often in 15 or more, so no radius of the Golay keys is both whole and selective. The Golay links there lead to candidates,
which are verified on the whole sets of shingles, and pairs that they don't reach are found by the exact search in
`shingles`: first with neighbours and a few pivots under each key, then one by one where they are still apart.

Defined cases: null and empty texts, and texts of white space only, have fingerprint 0 and link like any other; as sets of
shingles they are copies of each other. Texts of any length are hashed whole, in pieces. Every input row gives one output
row of `components`, repeated ids too. Null ids are allowed and never become a component's id unless all its ids are null.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .components import components as connected
from .components import spanning
from .shared import arrow_rows, durable, gathered, tidy

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
BLOCK = 1 << 16
#: Texts, or what they give, in one task at most, about.
TEXTS = 1 << 14
#: Fixed value: the generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
GENERATOR = 0b110001110101


# --- fingerprints -----------------------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed long with the same bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [np.zeros(0, np.uint64)] + [shingles.fingerprint_bits(h, counts) for _, _, h, counts in shingles.hashed(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, fp long")


# --- Golay keys --------------------------------------------------------------------------------------------------


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parity of each 12-bit message, for each syndrome the error patterns of weight 4 or less, how many those are)."""
    message = np.arange(4096, dtype=np.int64)
    word = message << 11
    for i in range(22, 10, -1):
        word ^= ((word >> i) & 1) * (GENERATOR << (i - 11))
    parity = word  # the remainder: word of the code is message << 11 | parity
    patterns = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            s = int(parity[error >> 11] ^ (error & 2047))
            if count[s] < 6:
                patterns[s, count[s]] = error
            count[s] += 1
    return parity, patterns, count


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6 indices of codewords within distance 4 of each 23-bit word, how many of the six count)."""
    parity, patterns, count = golay()
    s = parity[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ patterns[s]) >> 11, count[s]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fp) for every key of every fingerprint."""
    u = fp.view(np.uint64)
    near = [near_codewords(((u >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64)) for at, size in SEGMENTS]
    keys, owners = [], []
    six = np.arange(6)
    for number, (a, b) in enumerate(PAIRS):
        both = (number << 24) | (near[a][0][:, :, None] << 12) | near[b][0][:, None, :]
        valid = (six < near[a][1][:, None])[:, :, None] & (six < near[b][1][:, None])[:, None, :]
        keys.append(both[valid])
        owners.append(np.nonzero(valid)[0])
    return np.concatenate(keys), np.concatenate(owners)


def keyed(distinct: DataFrame) -> DataFrame:
    """(key, fp). The fingerprints are few bytes and few partitions; they are dealt anew, as each gives dozens of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                keys, owner = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[owner])], names=["key", "fp"])

    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.select("fp").repartition(tasks, "fp").mapInArrow(tidy(run), "key int, fp long")


# --- links --------------------------------------------------------------------------------------------------------


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= max_bits


def forest(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: edges (fp, root) that span the links between rows of equal key."""
    n = len(key)
    head = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(head, n))
    live = np.flatnonzero(np.repeat((size > 1) & (size <= 64), size))
    stop = np.repeat(head + size, size)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lag = 1
    while len(live):
        live = live[live + lag < stop[live]]
        hit = live[_near(fp[live], fp[live + lag], max_bits)]
        left.append(hit)
        right.append(hit + lag)
        lag += 1
    for at, many in zip(head[size > 64].tolist(), size[size > 64].tolist()):
        rest = np.arange(at, at + many)
        while len(rest):  # breadth first: whatever is reached leaves the rows still to be compared
            root, frontier, rest = rest[0], [rest[0]], rest[1:]
            while frontier and len(rest):
                near = _near(fp[rest], fp[frontier.pop()], max_bits)
                found = rest[near]
                left.append(found)
                right.append(np.full(len(found), root))
                frontier += found.tolist()
                rest = rest[~near]
    child, root = spanning(np.concatenate(left), np.concatenate(right))
    return fp[child], fp[root]


def _edges(a, b, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind, pa.int8())], names=["a", "b", "kind"])


def links(distinct: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between fingerprints that have the same components as all links within max_bits; some may repeat."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the pigeonhole argument holds for 4 differing bits at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int32), np.zeros(0, np.int64)
        big, count = None, 0
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if big is not None:
                same = int(np.searchsorted(k, big, "right"))
                count += same
                k, f = k[same:], f[same:]
                if not len(k):
                    continue
                yield _edges([big], [count], [1])
                big = None
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            a, b = forest(key[:cut], fp[:cut], max_bits)
            yield _edges(a, b, np.zeros(len(a)))
            key, fp = key[cut:], fp[cut:]
            if len(key) > block:
                big, count = int(key[0]), len(key)
                key, fp = key[:0], fp[:0]
        if big is not None:
            yield _edges([big], [count], [1])
        a, b = forest(key, fp, max_bits)
        yield _edges(a, b, np.zeros(len(a)))

    rows = keyed(distinct)
    found = rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(tidy(run), "a long, b long, kind byte")
    found = durable(gathered(found, distinct.count(), TEXTS, True))
    edges = found.where("kind = 0").select("a", "b")
    if found.where("kind = 1").isEmpty():
        return edges

    # Keys with very many fingerprints: every pair of blocks of such a key is a task of bounded size.
    over = found.where("kind = 1").select(F.col("a").cast("int").alias("key"), F.ceil(F.col("b") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = rows.join(over, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def pair(rows: pa.Table) -> pa.Table:
        fp = rows.column("fp").to_numpy()
        a, b = forest(np.zeros(len(fp), np.int32), fp, max_bits)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    more = (
        dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
        .groupBy("key", "i", "j")
        .applyInArrow(pair, "a long, b long")
    )
    return durable(edges.unionByName(more))


# --- components ----------------------------------------------------------------------------------------------------


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(id_col, fp, component_id): fp as 16 hex digits; component_id is the smallest id reachable over links.

    A fingerprint may be that of a third of all rows, and a component may hold a third of all fingerprints. Both sides of
    the joins on them are written down before, so that AQE can split such a key; sums by key are partial before shuffles."""
    with arrow_rows(docs.sparkSession, shingles.TEXTS_AT_ONCE):
        many = docs.count()
        rows = durable(gathered(fingerprints(docs, id_col, text_col, shingle), many, TEXTS, True))
    distinct = durable(gathered(rows.groupBy("fp").agg(F.min("id").alias("least_id")), many))
    tree = connected(links(distinct, max_bits, block))
    few = 2 * tree.count()
    linked = tree.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(tree.select("v", "v").distinct())
    linked = durable(gathered(linked.join(distinct, "fp"), few))
    least = durable(gathered(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), few))
    named = linked.join(least, "root").select("fp", "component_id")
    named = durable(gathered(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")), many))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), "component_id")


def near_copies(docs: DataFrame, marks: DataFrame, text_col: str = "text", shingle: int = 5, block: int = shingles.BLOCK) -> DataFrame:
    """(u, v): every node u of `marks` that has near copies, with the smallest node v of its component, v itself left out.

    Components are those of all pairs of sets that share 0.8 of their union. `marks` is durable and from `shingles.marked`."""
    many = marks.count()
    nodes = durable(gathered(marks.where("n > 0 and prefix is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "n", "bits", "wide"))), many, TEXTS, True))
    fps = nodes.select("node", "fp")
    first = durable(gathered(fps.groupBy("fp").agg(F.min("node").alias("node")), many))
    near = links(first)
    near = near.join(first.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select("x", "y")
    alike = fps.withColumnRenamed("node", "x").join(first.withColumnRenamed("node", "y"), "fp").where("x <> y").select("x", "y")
    candidates = durable(gathered(near.union(alike).select(*shingles.ordered("x", "y")).distinct(), many))

    meeting = durable(gathered(shingles.met(marks), many, TEXTS, True))
    homes = durable(gathered(shingles.housed(meeting), many, TEXTS, True))
    judged, tree = None, None
    steps = (
        lambda: candidates.union(shingles.neighbours(meeting)).distinct(),
        lambda: shingles.apart(homes, nodes, tree, block, shingles.PIVOTS),
        lambda: shingles.apart(homes, nodes, tree, block, None),
    )
    for step in steps:
        pairs = step() if judged is None else step().join(judged.select("a", "b"), ["a", "b"], "left_anti")
        pairs = durable(gathered(pairs, many, TEXTS, True))
        if judged is None or not pairs.isEmpty():
            now = shingles.judged(docs, text_col, shingle, pairs, nodes)
            judged = now if judged is None else judged.union(now)
            tree = connected(judged.where("ok").select("a", "b"))
    return tree


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """All columns of one row of each component of near copies: that with its smallest id, nulls last, and then the
    smallest hash of the text.

    Rows are told apart by id and text, so repeated ids and null ids are rows like any other. Rows that repeat both are
    exact copies, of which any one stays."""
    named = [{id_col: "_row_id", text_col: "_row_text"}.get(c, f"_carried_{i}") for i, c in enumerate(docs.columns)]
    return _chosen(docs.toDF(*named), "_row_id", "_row_text", shingle).toDF(*docs.columns)


def _chosen(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    with arrow_rows(docs.sparkSession, shingles.TEXTS_AT_ONCE):
        marks = durable(gathered(shingles.marked(docs, id_col, text_col, shingle), docs.count(), TEXTS, True))
    roots = near_copies(docs, marks, text_col, shingle).select(F.col("u").alias("node"), F.col("v").alias("root"))
    row = F.struct(F.col("id").isNull().alias("last"), "id", "print")
    rooted = marks.groupBy("node").agg(F.min(row).alias("least")).join(roots, "node", "left")
    least = rooted.groupBy(F.coalesce("root", "node").alias("_root")).agg(F.min("least").alias("_least"))
    many = marks.count()
    least = durable(gathered(least.select(F.col("_least.id").alias("_id"), F.col("_least.print").alias("_print")), many))
    own = lambda d, i, p: d[i].eqNullSafe(F.col("_id")) & (d[p] == F.col("_print"))

    # Rows that go, and rows that repeat id and text, mark a bitmap of 1 MB. Rows whose place in it is empty stay as they are;
    # the others, few more than those that go, are compared exactly.
    going = marks.select("id", "print").join(least, own(marks, "id", "print"), "left_anti")
    repeated = durable(gathered(marks.groupBy("id", "print").count().where("count > 1").select("id", "print"), many))
    place = lambda i, p: F.pmod(F.xxhash64(i, p), F.lit(shingles.BITS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (c % 64).cast("int"))
    slots = going.union(repeated).select(place("id", "print").alias("slot"))
    words = slots.groupBy(F.floor(F.col("slot") / 64).alias("_word")).agg(F.bit_or(bit(F.col("slot"))).alias("_bits"))
    bitmap = durable(gathered(words, shingles.BITS // 64))

    seen = docs.withColumn("_print_of_text", F.xxhash64(text_col)).withColumn("_slot", place(id_col, "_print_of_text"))
    seen = seen.join(F.broadcast(bitmap), F.floor(seen["_slot"] / 64) == F.col("_word"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit(F.col("_slot"))) != 0, F.lit(False))
    open_ = seen.where(hit).select(*docs.columns, "_print_of_text")
    open_ = open_.join(least.hint("shuffle_hash"), own(open_, id_col, "_print_of_text"), "left_semi")
    open_ = gathered(open_, many, TEXTS, True)
    if not repeated.isEmpty():
        open_ = open_.dropDuplicates([id_col, "_print_of_text"])
    return seen.where(~hit).select(*docs.columns).union(open_.select(*docs.columns))
