"""What several operators of this subpackage need: tables, durable cuts of lineage, views of Arrow text columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint.

    The folder is the one the cluster names in spark.checkpoint.dir. All executors share it, so what is kept there
    survives the loss of any of them. Where it is unset, one on this machine's disk is made if Spark runs in this
    process alone; on a cluster that would lose data silently, so it is an error there.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leadframe-"))
    return df.checkpoint()


@lru_cache(1)
def _malloc_trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not this C library
        return None


def trim() -> None:
    """Give memory that is free within this process back to the system: workers live on, one task after another."""
    pa.default_memory_pool().release_unused()
    give_back = _malloc_trim()
    if give_back:
        give_back(0)


_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Workers live on from one operator to the next: what `owner` remembers between its tasks is forgotten by `forget` as
    soon as a task of another begins in the same worker."""
    _kept[owner] = forget


def tidy(run: Callable, owner: str = "") -> Callable:
    """A function for mapInArrow that gives free memory back now and then, and at the end of its task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [name for name in _kept if name != owner]
        for name in others:
            _kept.pop(name)()
        if others:
            trim()
        for n, out in enumerate(run(batches)):
            yield out
            if n % 64 == 63:
                trim()
        trim()

    return wrapped


def gathered(df: DataFrame, rows: int, per: int = 1 << 18, busy: bool = False) -> DataFrame:
    """`df`, which has about `rows` rows at most, in so many partitions that each has about `per`; without a shuffle, and
    never in more than before. Small tables behind wide shuffles are written to a few files this way. Where the work is
    dear, `busy` keeps twice as many partitions as there are cores, if there were as many."""
    least = 2 * df.sparkSession.sparkContext.defaultParallelism if busy else 1
    return df.coalesce(max(least, -(-rows // per)))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what is run (not only planned) within: for wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id written as text, modulo `of`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def bounded_labels(labels: DataFrame, label: str, value: int, rows: int, seed: int = 0) -> DataFrame:
    """At most `rows` ids that carry this label, in the order of a hash of the id, so the choice doesn't depend on storage."""
    return labels.where(F.col(label) == value).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows).select("doc_id", F.lit(value).alias("label"))


def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def spans(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of an Arrow string or binary column without copying; null rows are empty."""
    column = as_array(column)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:]
    if column.null_count:
        ends = np.where(column.is_valid().to_numpy(zero_copy_only=False), ends, starts)
    return data, starts, ends


def slices(starts: np.ndarray, ends: np.ndarray, limit: int):
    """Ranges (first, last) of rows whose bytes add up to about `limit`; one row may exceed it."""
    total = np.cumsum(ends - starts)
    first = 0
    while first < len(starts):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
        yield first, last
        first = last


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes put side by side, and the row boundaries in them (one more than rows)."""
    if len(starts) and bool((starts[1:] == ends[:-1]).all()):
        return data[starts[0] : ends[-1]], np.concatenate([starts, ends[-1:]]) - starts[0]
    lengths = ends - starts
    edge = np.concatenate([[0], np.cumsum(lengths)])
    return data[np.repeat(starts - edge[:-1], lengths) + np.arange(edge[-1])], edge


def map_texts(
    docs: DataFrame, judge: Callable[[np.ndarray, np.ndarray, np.ndarray], list[pa.Array]], added: str, id_col: str, text_col: str, carry: list[str] | None = None, keep_text: bool = False, chunk: int = 1 << 20
) -> DataFrame:
    """(id_col, text_col if kept, carried columns, added columns) of each row. `judge(bytes, starts, ends)` gives the added
    columns for some rows whose texts add up to about `chunk` bytes. The text goes through Python once, kept or not, and
    comes back in small batches, so what a task holds follows the batch and not the number of columns."""
    names, inner = list(docs.columns), []
    for name in ("_id", "_text"):
        while name in names:
            name += "_"
        names.append(name)
        inner.append(name)
    fields = docs.select(F.col(id_col).alias(inner[0]), F.col(text_col).alias(inner[1]), *(carry or []))
    kept = [k for k in range(len(fields.columns)) if k != 1 or keep_text]
    schema = ", ".join([f"`{fields.schema[k].name}` {fields.schema[k].dataType.simpleString()}" for k in kept] + [added])
    labels = [fields.columns[k] for k in kept] + [x.split()[0] for x in added.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = spans(batch.column(1))
            for a, b in slices(starts, ends, chunk):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + judge(data, starts[a:b], ends[a:b]), names=labels)

    out = fields.mapInArrow(tidy(run), schema)
    return out.withColumnsRenamed({inner[0]: id_col} | ({inner[1]: text_col} if keep_text else {}))


def clean_labels(labels: DataFrame, label: str, learn: Column, docs: DataFrame) -> DataFrame:
    """(doc_id, label): one row for each id that may be learned from, has a label 0 or 1 and occurs in `docs`; of contradicting
    labels the larger. Ids alone are compared, so the labels may be many more than the documents are."""
    fine = F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)
    clean = labels.where(fine).where(learn).groupBy("doc_id").agg(F.max(label).alias(label))
    return clean.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def label_counts(labels: DataFrame, label: str, learn: Column, docs: DataFrame) -> np.ndarray:
    """How many ids of documents have the label 0 and the label 1."""
    found = {int(r[0]): int(r[1]) for r in clean_labels(labels, label, learn, docs).groupBy(label).count().collect()}
    return np.array([found.get(0, 0), found.get(1, 0)], float)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, text_bytes: int, seed: int) -> pa.Table:
    """Bounded sample for fitting on the driver: (doc_id, text, lang, label), at most `rows` ids for each label 0 and 1.

    `learn` tells which ids may be learned from. Ids of documents are taken in hash order; texts over `text_bytes` and null texts
    are left to the scoring. The sample of ids is bounded, so it
    can be broadcast and the documents are not shuffled."""
    clean = clean_labels(labels, label, learn, docs)
    chosen = bounded_labels(clean, label, 0, rows, seed).unionByName(bounded_labels(clean, label, 1, rows, seed))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(F.octet_length("text") <= text_bytes).select("doc_id", "text", lang.alias("lang"))
    return texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "text").limit(4 * rows).toArrow()


def likely(rows: DataFrame, ids: DataFrame, many: int, seed: int = 0) -> DataFrame:
    """`rows` without most of those whose doc_id isn't among `ids`, which are about `many`; none of the others is lost.

    A broadcast bitmap of hashes, 64 bits a row, tells; it has at least 16 bits an id but never over 2**24 in all. Wide rows that
    a join would drop aren't shuffled for it."""
    words = 1 << min(18, max(1, many // 4).bit_length())
    place = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(64 * words))
    word, bit = F.shiftright(place, 6).alias("_word"), F.pmod(place, F.lit(64)).cast("int").alias("_bit")
    bits = ids.select(word, bit).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    seen = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word")
    return seen.where("shiftright(_bits, _bit) & 1L = 1L").drop("_word", "_bit", "_bits")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per: int, seed: int) -> DataFrame:
    """(doc_id, text, lang, label, hold): every row of `docs` whose id may be learned from and has a label 0 or 1, of any length,
    null texts as empty ones; `hold` marks a fifth of the ids.

    Written down in shards of about `per` ids, each in the order of a hash of the id, so what is learned from one shard after
    another doesn't depend on storage or on retries. `learn` is a condition on doc_id. Texts are shuffled once, and few but those
    with labels."""
    clean = clean_labels(labels, label, learn, docs).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col(label).alias("label"))
    clean = durable(clean)
    ids = clean.count()
    shards = max(1, -(-ids // per))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(learn).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    # Both sides lie in the shards already, so the join moves nothing.
    found = likely(texts, clean, ids, seed).repartition(shards, "doc_id").join(clean.repartition(shards, "doc_id").hint("merge"), "doc_id")
    order = F.xxhash64(F.lit(seed), "doc_id")
    found = found.withColumn("hold", F.pmod(order, F.lit(5)) == 0).coalesce(shards)
    return durable(found.sortWithinPartitions(order, "doc_id", "text"))


# --- keys of byte or character ranges: a polynomial in BASE, so prefix sums give that of any range ---------------------

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Fixed value: the inverse of BASE modulo 2**64.
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse. One pair of arrays is kept, as long as any call so far needed."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for k, x in enumerate((BASE, INVERSE)):
                _powers[k] = np.full(size, x)
                _powers[k][0] = 1
                np.cumprod(_powers[k], out=_powers[k])
        if size > 1 << 20:
            keeps("powers", _few_powers)
    return _powers[0][:n], _powers[1][:n]


def _few_powers() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, scale): (sums[end] - sums[start]) * scale[start] is a range's polynomial, wherever the range lies."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        terms = values.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up
        np.cumsum(terms, out=sums[1:])
    return sums, down
