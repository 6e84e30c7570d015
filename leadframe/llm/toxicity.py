"""Toxicity by a convolutional text classifier over hashed word embeddings.

Words are runs of letters, digits and non-ASCII bytes, folded to lower case (A-Z and Latin-1). A word's embedding is the
sum of those of three hash buckets: the word, its first four and its first six bytes, so unseen inflections share what
was learned of their stem. Filters of widths 1, 2 and 3 run over the words, their largest responses over the whole text
feed a softmax.

All labelled rows that may be learned from are learned from, whatever their number and length. They lie in shards of about
SHARD ids. In each of ROUNDS rounds every shard goes once over its rows (a small table several times), from the weights of
the round before; what the shards moved is summed by Spark and averaged, an embedding's row over the steps that touched it. Only the
network, whose size is fixed, passes through the driver. Words by language are counted over all rows too.

Thresholds are calibrated by language, on the fifth of the labelled ids that the network hasn't learned from; with fewer than
ENOUGH toxic rows in that fifth, on all rows, and all are learned from. The language of a
text is guessed from the text alone, by naive Bayes over the same word buckets; a language with ENOUGH toxic rows in that
fifth, and no less than one in MOST of them, has its own threshold, and all others, told apart as one, have the common one.
The tables of the guess are therefore bounded however many languages there are. All rows of the fifth count; only what they measure is
rounded, to one in GRID. The score is moved so that the threshold of the text's language lies at 0.5.

Defined cases: null and empty texts, and texts without words, get the score of the network's bias. Without labels of both
kinds to learn from every score is 0. Repeated rows are each scored. Labels, lang, source and ids are never inputs of a
score. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .convnet import Adam, ConvNet
from .langid import fold
from .shared import gather, labelled_rows, map_texts, prefix_sums, slices, spans, tidy

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
SHARD, ROUNDS, RATE, ENOUGH, MOST = 8192, 5, 0.01, 10, 50
PREFIXES = (4, 6)
BLOCK = 1 << 19  # words that a task learns from at a time
#: Moves are summed as whole numbers of this part, so their sum doesn't depend on the order of tasks; thresholds lie on a grid.
UNIT, GRID, FARTHEST = 2.0**-26, 1024, 64
CHUNK = 1 << 19  # bytes of text at a time
#: Words that were never seen stay near zero, so they neither trip nor hide a filter.
EMBED_SCALE = 0.02


#: Bytes of words in texts that aren't folded yet; those of non-ASCII characters are in words too.
_INSIDE = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def _bucket(total, down, starts, ends, salt: int) -> np.ndarray:
    h = (total[ends] - total[starts]) * down[starts]
    h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


def words(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words' three buckets, word boundaries of the rows) of rows data[edge[i]:edge[i+1]]."""
    data = fold(data)
    inside = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = edge[:-1][edge[:-1] < edge[1:]]
    begin[heads] = inside[heads]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    finish[edge[1:][edge[:-1] < edge[1:]] - 1] = inside[edge[1:][edge[:-1] < edge[1:]] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    sums, scale = prefix_sums(data)
    with np.errstate(over="ignore"):
        ids = [_bucket(sums, scale, starts, ends, 1)] + [_bucket(sums, scale, starts, np.minimum(ends, starts + k), k) for k in PREFIXES]
    return np.stack(ids, axis=1), np.searchsorted(starts, edge)


def words_of_long(data: np.ndarray, limit: int = CHUNK) -> np.ndarray:
    """Bucket ids of one row of any length, from pieces of about `limit` bytes that end where a word can't go on."""
    found, at = [], 0
    while at < len(data):
        cut = min(len(data), at + limit)
        while cut < len(data):
            part = data[cut : cut + (1 << 16)]
            ends = np.flatnonzero((part < 128) & ~_INSIDE[part])
            if len(ends):
                cut += int(ends[0])
                break
            cut = min(len(data), cut + (1 << 16))
        found.append(words(data[at:cut], np.array([0, cut - at]))[0])
        at = cut
    return np.concatenate(found) if found else np.zeros((0, 1 + len(PREFIXES)), np.int32)


def words_of_rows(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`words`, in pieces if it is one long row."""
    if len(edge) == 2 and len(data) > CHUNK:
        ids = words_of_long(data)
        return ids, np.array([0, len(ids)])
    return words(data, edge)


def segments(ids: np.ndarray, bounds: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' words with `padding` zero positions after each row; a row without words is one more of those."""
    size = np.diff(bounds)
    edge = np.append(0, np.cumsum(size + padding))
    out = np.zeros((edge[-1], ids.shape[1]), ids.dtype)
    out[np.repeat(edge[:-1] - bounds[:-1], size) + np.arange(bounds[0], bounds[-1])] = ids[bounds[0] : bounds[-1]]
    return out, edge


class ToxicityModel:
    def __init__(self, net: ConvNet | None, guess: np.ndarray | None = None, slope: float = 1.0, thresholds: np.ndarray | None = None):
        self.net, self.guess, self.slope, self.thresholds = net, guess, slope, thresholds

    def measure(self, data: np.ndarray, edge: np.ndarray, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """(largest filter responses, language evidence) of rows of text. Of a long row only the ids of its words are held
        beside it, 12 bytes for a word; filters go over them in steps of `chunk` words."""
        n = len(edge) - 1
        ids, bounds = words_of_rows(data, edge)
        top = np.full((n, self.net.filters * len(WIDTHS)), -np.inf, np.float32)
        evidence = np.zeros((n, self.guess.shape[1]), np.float32)
        reach = self.net.padding
        for a, b in slices(bounds[:-1], bounds[1:], chunk):
            if bounds[b] - bounds[a] <= chunk:
                top[a:b] = self.net.pooled(*segments(ids, bounds[a : b + 1], reach))
                full = a + np.flatnonzero(np.diff(bounds[a : b + 1]))
                if len(full):
                    evidence[full] = np.add.reduceat(self.guess[ids[bounds[a] : bounds[b], 0]], bounds[full] - bounds[a], axis=0)
                continue
            for first in range(bounds[a], bounds[b], chunk):  # one long row; the words that follow a piece are its tail
                last = min(bounds[b], first + chunk)
                piece = np.zeros((last - first + reach, ids.shape[1]), ids.dtype)
                taken = ids[first : min(bounds[b], last + reach)]
                piece[: len(taken)] = taken
                top[a] = np.maximum(top[a], self.net.pooled(piece, np.array([0, len(piece)]))[0])
                evidence[a] += self.guess[ids[first:last, 0]].sum(0)
        return top, evidence

    def margin(self, top: np.ndarray) -> np.ndarray:
        z = self.net.logits(top)
        return (z[:, 1] - z[:, 0]).astype(float)

    def language(self, evidence: np.ndarray) -> np.ndarray:
        """Without any word there is no guess, and the common threshold, the last, holds."""
        return np.where((evidence != 0).any(1), evidence.argmax(1), -1)

    def calibrated(self, top: np.ndarray, evidence: np.ndarray) -> np.ndarray:
        beyond = self.margin(top) - self.thresholds[self.language(evidence)]
        return 1 / (1 + np.exp(-np.clip(self.slope * beyond, -50, 50)))

    def scores(self, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        return self.calibrated(*self.measure(data, edge)) if self.net else np.zeros(len(edge) - 1)


def threshold(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The cut with the best F1; among equals, the middle of the widest gap between neighbouring scores. At each z there are `n`
    rows (one if not given), `y` of them toxic."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    n = np.ones(len(z), np.int64) if n is None else n[order]
    above = np.cumsum(y[::-1])[::-1]  # toxic rows at or above each place
    f1 = 2 * above / (np.cumsum(n[::-1])[::-1] + y.sum())
    gap = np.diff(z, prepend=z[0] - 1)
    best = np.flatnonzero((f1 >= f1.max() - 1e-9) & (gap > 0))
    at = best[gap[best].argmax()]
    return float(z[at] - gap[at] / 2)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, row boundaries), texts being the first column, about CHUNK bytes at a time."""
    for batch in batches:
        data, starts, ends = spans(batch.column(0))
        for a, b in slices(starts, ends, CHUNK):
            yield batch.slice(a, b - a), *gather(data, starts[a:b], ends[a:b])


def word_counts(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """How often each bucket's words occur in each of `languages`, and in all others together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts = {x: k for k, x in enumerate(languages)}, {}
        for part, data, edge in pieces(batches):
            ids, bounds = words_of_rows(data, edge)
            of = np.repeat([number.get(x, len(languages)) for x in part.column(1).to_pylist()], np.diff(bounds))
            for k in np.unique(of).tolist():
                counts[k] = counts.get(k, 0) + np.bincount(ids[of == k, 0], minlength=BUCKETS)
        for k, count in counts.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(count[at])], names=["of", "at", "n"])

    got = rows.select("text", "lang").mapInArrow(tidy(run), "of int, at int, n long").groupBy("of", "at").agg(F.sum("n")).toArrow()
    of, at, n = (c.to_numpy() for c in got.columns)
    out = np.zeros((BUCKETS, len(languages) + 1))
    out[at, of] = n
    return out


def learn_round(net: ConvNet, rows: DataFrame, weight: np.ndarray, rate: float, sweeps: int, seed: int) -> None:
    """Every shard of `rows` learns from all its rows, `sweeps` times from each block of them; `net` moves by their mean."""

    def blocks(batches):
        held, size = [], 0
        for part, data, edge in pieces(batches):
            ids, bounds = words_of_rows(data, edge)
            held.append((ids, np.diff(bounds), part.column(1).to_numpy().astype(np.int64)))
            size += len(ids)
            if size >= BLOCK:
                yield [np.concatenate(x) for x in zip(*held)]
                held, size = [], 0
        if held:
            yield [np.concatenate(x) for x in zip(*held)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, rng, seen = net.copy(), np.random.default_rng(seed), 0
        adam = Adam(mine)
        for ids, count, y in blocks(batches):
            padded, own = segments(ids, np.append(0, np.cumsum(count)), mine.padding)
            for _ in range(sweeps):
                mine.sweep(padded, own, y, weight, rng.permutation(len(y)), adam, rate)
            seen += len(y)
        if not seen:
            return
        touched = np.flatnonzero(adam.touches)
        rest = mine.rest() - net.rest()
        rest = np.append(rest, np.zeros(-len(rest) % DIM)).reshape(-1, DIM)
        moved = np.concatenate([mine.weights["embed"][touched] - net.weights["embed"][touched], rest]).astype(float)
        at = np.append(touched, BUCKETS + np.arange(len(rest)))
        times = np.append(adam.touches[touched], np.full(len(rest), seen))
        moved = np.rint(moved * times[:, None] / UNIT).astype(np.int64)
        for k in range(0, len(at), 1 << 15):
            one = slice(k, k + (1 << 15))
            yield pa.RecordBatch.from_arrays([pa.array(at[one].astype(np.int32)), pa.array(times[one]), *(pa.array(m) for m in moved[one].T)], names=names)

    names = ["at", "times", *(f"d{k}" for k in range(DIM))]
    moves = rows.select("text", "label").mapInArrow(tidy(run), "at int, " + ", ".join(f"{x} long" for x in names[1:]))
    got = moves.groupBy("at").agg(*(F.sum(x) for x in names[1:])).toArrow().sort_by("at")
    at, times, *moved = (c.to_numpy() for c in got.columns)
    moved = np.stack(moved, axis=1) * UNIT / times[:, None]
    embed = at < BUCKETS
    net.move(at[embed], moved[embed], moved[~embed].ravel())


def measures(model: ToxicityModel, rows: DataFrame) -> np.ndarray:
    """(guessed language, place on the grid, toxic rows, rows) of all `rows`, as many as there are different places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, edge in pieces(batches):
            top, evidence = model.measure(data, edge)
            place = np.rint(np.clip(model.margin(top), -FARTHEST, FARTHEST) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(model.language(evidence).astype(np.int32)), pa.array(place), part.column(1)], names=["of", "at", "y"])

    judged = rows.select("text", "label").mapInArrow(tidy(run), f"of int, at int, y {rows.schema['label'].dataType.simpleString()}")
    got = judged.groupBy("of", "at").agg(F.sum("y"), F.count("y")).toArrow()
    return np.stack([c.to_numpy() for c in got.columns], axis=1).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, learn: Column, seed: int = 0, shard: int = SHARD) -> ToxicityModel:
    """Fit on all labelled rows of `docs` for whose doc_id `learn` holds."""
    rows = labelled_rows(docs, labels, "toxic", learn, shard, seed)
    found = np.zeros((2, 2), np.int64)  # by whether held back, by label
    for hold, label, n in rows.groupBy("hold", "label").count().collect():
        found[int(hold), int(label)] = n
    if not found.sum(0).all():
        return ToxicityModel(None)
    # A cut through fewer toxic rows would be one of chance: then none is held back, and all are learned from and calibrate.
    apart = found[1, 1] >= ENOUGH and found[1, 0] > 0 and found[0].all()
    held, fit = (rows.where("hold"), rows.where("not hold")) if apart else (rows, rows)
    judging, share = (found[1], found[0]) if apart else (found.sum(0), found.sum(0))
    enough = max(ENOUGH, -(-int(judging[1]) // MOST))
    toxic = held.where("lang <> ''").groupBy("lang").agg(F.sum("label").alias("toxic"), F.count("label").alias("n"))
    languages = sorted(r["lang"] for r in toxic.where((F.col("toxic") >= enough) & (F.col("toxic") < F.col("n"))).collect())

    guess = word_counts(rows, languages) + 0.5
    guess = np.log(guess / guess.sum(0)).astype(np.float32)
    guess -= guess.mean(1, keepdims=True)

    net = ConvNet(BUCKETS, DIM, WIDTHS, FILTERS, 2, seed, embed_scale=EMBED_SCALE)
    sweeps = int(np.clip(4000 // min(share.sum(), shard), 1, 32))  # shards are averaged, so each has to get somewhere by itself
    for k in range(ROUNDS):
        learn_round(net, fit, 0.5 * share.sum() / share, RATE * (1 - k / ROUNDS), sweeps, seed + k)

    model = ToxicityModel(net, guess)
    of, at, y, n = measures(model, held).T
    z = at / GRID
    common = threshold(*summed(z, y, n))
    mine = [summed(z[m], y[m], n[m]) for m in (of == k for k in range(len(languages)))]
    own_cut = [threshold(*x) if ENOUGH <= x[1].sum() < x[2].sum() else common for x in mine]
    model.thresholds = np.array([*own_cut, common, common])  # of the other languages, and without any word
    spread = (np.abs(z - common) * n).sum() / n.sum()
    model.slope = float(3 / spread) if spread > 0 else 1.0  # a typical row scores 0.05 or 0.95
    return model


def summed(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different z in ascending order, with the sums of y and n."""
    z, where = np.unique(z, return_inverse=True)
    return z, np.bincount(where, y, len(z)).astype(np.int64), np.bincount(where, n, len(z)).astype(np.int64)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """(id_col, text_col if kept, carried columns, score, predicted) for each row."""

    def judge(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        return [pa.array(model.scores(*gather(data, starts, ends)))]

    scored = map_texts(docs, judge, "score double", id_col, text_col, carry, keep_text, CHUNK)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
