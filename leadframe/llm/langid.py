"""Language identification by a byte convolutional network.

Texts are folded to lower case (A-Z and Latin-1 letters) and cut, whole, into windows of WINDOW bytes that overlap by the
widest filter less one, so every byte sequence a filter can see lies in exactly one window. Each window gives class
probabilities; a document's are their mean, weighted by the letters in each window. Training takes, of a bounded number
of rows for each language (about ROWS, never over twice as many, of texts up to TEXT_BYTES long; longer ones aren't learned
from), up to WINDOWS windows spread evenly over the row. Every language that occurs is learned: the sample and the table of
their counts grow with the number of languages.

Filters are applied through tables: the response of all filters to a pair of bytes is looked up, not computed.

Defined cases: a null text and one without any letter are `und` with score 0. With no row to learn from, every text is
`und`. With one language, that is everything's language. Repeated rows are each scored. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .convnet import ConvNet
from .shared import gather, map_texts, spans

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8
STRIDE = WINDOW - max(WIDTHS) + 1
ROWS, TEXT_BYTES, WINDOWS = 400, 1 << 16, 4
UNKNOWN = "und"


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the upper-case Latin-1 letters in lower case."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    out = low[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
    out[upper + 1] += 32
    return out


def window_counts(edge: np.ndarray) -> np.ndarray:
    """Windows of each row data[edge[i]:edge[i+1]]; empty rows have none."""
    size = np.diff(edge)
    return np.where(size > 0, np.maximum(1, -(-(size - WINDOW + STRIDE) // STRIDE)), 0)


def windows(data: np.ndarray, edge: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, padded with 0; the row of each), for the windows from `first` up to `last`."""
    upto = np.cumsum(window_counts(edge))
    index = np.arange(first, (int(upto[-1]) if len(upto) else 0) if last is None else last)
    row = np.searchsorted(upto, index, "right")
    nth = index - np.append(0, upto)[row]
    take = (edge[:-1][row] + nth * STRIDE)[:, None] + np.arange(WINDOW)
    inside = take < edge[1:][row][:, None]
    return np.where(inside, data[np.minimum(take, max(0, len(data) - 1))], 0), row


def letters(cut: np.ndarray) -> np.ndarray:
    """How many bytes of each window belong to letters, roughly: a-z and all of non-ASCII characters."""
    return (((cut >= 97) & (cut <= 122)) | (cut >= 128)).sum(1)


class LanguageModel:
    """Fitted languages, and the tables of the network."""

    def __init__(self, languages: list[str], net: ConvNet | None):
        self.languages = languages
        if net is None:
            return
        e = net.weights["embed"]
        at = {w: [e @ net.weights[f"conv{w}"][k] for k in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, -1)
        self.first = np.concatenate([pair(at[2][0], at[2][1]), pair(at[3][0], at[3][1]), pair(at[4][0], at[4][1])], axis=1)
        self.third, self.last = at[3][2], pair(at[4][2], at[4][3])
        self.net = net

    def least(self, margin: float) -> float:
        """The score over which a text counts as being in some language: this part of the way from a blind guess to certainty.
        It means the same for any number of languages; with one language a text has nothing to be told apart from."""
        blind = 1 / max(1, len(self.languages))
        return blind + margin * (1 - blind)

    def probabilities(self, cut: np.ndarray) -> np.ndarray:
        """Class probabilities of each window."""
        if len(self.languages) == 1:
            return np.ones((len(cut), 1), np.float32)
        out = np.empty((len(cut), len(WIDTHS) * FILTERS), np.float32)
        for at in range(0, len(cut), 64):
            part = cut[at : at + 64].astype(np.int64)
            both = part[:, :-1] << 8 | part[:, 1:]
            response = self.first[both[:, : WINDOW - 3]]
            response[:, :, FILTERS : 2 * FILTERS] += self.third[part[:, 2 : WINDOW - 1]]
            response[:, :, 2 * FILTERS :] += self.last[both[:, 2 : WINDOW - 1]]
            out[at : at + 64] = response.max(1)
        score = self.net.logits(out)
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def rows(self, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Mean probabilities of each row, weighted by letters; rows without windows have zeros."""
        n, data = len(edge) - 1, fold(data)
        many = int(window_counts(edge).sum())
        total, weights = np.zeros((n, len(self.languages))), np.zeros(n)
        for at in range(0, many, 4096):
            cut, row = windows(data, edge, at, min(many, at + 4096))
            weight = letters(cut) + 1e-6
            head = np.flatnonzero(np.diff(row, prepend=-1))
            total[row[head]] += np.add.reduceat(self.probabilities(cut) * weight[:, None], head, axis=0)
            weights[row[head]] += np.add.reduceat(weight, head)
        return total / np.maximum(weights, 1e-9)[:, None]


def sample(docs: DataFrame, learn: Column, rows: int, text_bytes: int) -> pa.Table:
    """(text, lang): about `rows` of each language and never over twice as many; chosen by a hash of the id."""
    fit = docs.where(learn & F.col("lang").isNotNull() & (F.octet_length("text") <= text_bytes))
    counts = fit.groupBy("lang").count().collect()
    if not counts:
        return pa.table({"text": pa.array([], pa.string()), "lang": pa.array([], pa.string())})
    # A hash below the language's share: one pass, no shuffle, however unequal the languages are.
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.5 * rows / r["count"])))))[F.col("lang")]
    uniform = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1_000_003)) / F.lit(1_000_003)
    return fit.where(uniform < share).orderBy(F.xxhash64(F.lit(4), "doc_id"), "doc_id", "text").limit(2 * rows * len(counts)).select("text", "lang").toArrow()


def train(docs: DataFrame, learn: Column, rows: int = ROWS, text_bytes: int = TEXT_BYTES, seed: int = 0) -> LanguageModel:
    """Fit on rows of `docs` (doc_id, text, lang) for which `learn` holds."""
    got = sample(docs, learn, rows, text_bytes)
    languages = sorted(set(got.column("lang").to_pylist()))
    if len(languages) < 2:
        return LanguageModel(languages, None)
    data, starts, ends = spans(got.column("text"))
    data, edge = gather(data, starts, ends)
    cut, row = windows(fold(data), edge)
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    count = np.bincount(row, minlength=len(edge) - 1)[row]
    keep = (letters(cut) > 0) & ((nth * WINDOWS) // count != ((nth - 1) * WINDOWS) // count)
    cut, row = cut[keep], row[keep]
    label = np.array([languages.index(x) for x in got.column("lang").to_pylist()])[row]
    net = ConvNet(256, DIM, WIDTHS, FILTERS, len(languages), seed)
    size = WINDOW + net.padding
    ids = np.zeros((len(cut), size), np.int64)
    ids[:, :WINDOW] = cut
    share = np.bincount(label, minlength=len(languages)) / len(label)
    epochs = int(np.clip(15_000 // len(label), 3, 12))
    net.fit(ids.reshape(-1, 1), np.arange(len(cut) + 1) * size, label, 1 / np.maximum(share * len(languages), 1e-3), epochs, seed=seed)
    return LanguageModel(languages, net)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """(id_col, text_col if kept, carried columns, lang_pred, score) for each row."""

    def judge(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        own, edge = gather(data, starts, ends)
        p = model.rows(own, edge) if model.languages else np.zeros((len(starts), 1))
        ascii_letter = ((own | 32) >= 97) & ((own | 32) <= 122)
        seen = np.diff(np.append(0, np.cumsum(ascii_letter))[edge]) > 0
        for i in np.flatnonzero(~seen & (np.diff(edge) > 0)).tolist():
            seen[i] = any(map(str.isalpha, own[edge[i] : edge[i + 1]].tobytes().decode()))
        known = seen & bool(model.languages)
        best = np.where(known, p.argmax(1), -1)
        label = pa.array([UNKNOWN if i < 0 else model.languages[i] for i in best.tolist()], pa.string())
        return [label, pa.array(np.clip(np.where(known, p.max(1), 0.0), 0, 1).astype(float))]

    return map_texts(docs, judge, "lang_pred string, score double", id_col, text_col, carry, keep_text)
