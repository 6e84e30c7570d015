"""Occurrences of many keywords in texts, of all keywords in one pass over the bytes.

A keyword is told by the 8-byte words that cover it. At each byte of a text the first four bytes tell, by a table, which lengths
of keywords may begin there; for each such length the words are looked up among the keywords of that length. Only equal bytes
count. Work follows the text and what is found in it, and hardly the number of keywords.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text looked at together, and occurrences held until they are summed.
WINDOW, HELD = 1 << 18, 1 << 22
#: Counters are an array up to so many; beyond, what was found is sorted.
DENSE = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slot(words: np.ndarray) -> np.ndarray:
    return ((words * _MIX) >> np.uint64(48)).astype(np.intp)


def _words(data: np.ndarray, size: int) -> np.ndarray:
    """The little-endian 8-byte words that begin at the first `size` bytes; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(size + 8 - len(data), np.uint8)])
    return np.ndarray(size, "<u8", padded, strides=(1,)).astype(np.uint64)


class _Length:
    """Keywords of one length."""

    def __init__(self, size: int, keywords: list[bytes], index: list[int]):
        self.size = size
        self.offsets = [0] if size <= 8 else [*range(0, size - 8, 8), size - 8]
        self.mask = np.uint64((1 << 8 * min(size, 8)) - 1)
        table = np.frombuffer(b"".join(k.ljust(8, b"\0") for k in keywords), np.uint8).reshape(len(keywords), -1)
        words = [np.ascontiguousarray(table[:, at : at + 8]).view("<u8")[:, 0] for at in self.offsets]
        for seed in range(100):
            self.factors = np.random.default_rng(seed).integers(1, 1 << 63, len(words), np.uint64) | np.uint64(1) if len(words) > 1 else np.ones(1, np.uint64)
            keys = self._key(words)
            if len(np.unique(keys)) == len(keys):  # else two keywords would be one
                break
        else:
            raise AssertionError("keywords repeat")
        order = np.argsort(keys)
        self.keys, self.words, self.index = keys[order], [w[order] for w in words], np.array(index)[order]
        self.first = words[0]
        self.some = np.zeros(1 << 16, bool)
        self.some[_slot(self.first)] = True

    def _key(self, words: list[np.ndarray]) -> np.ndarray:
        key = words[0] * self.factors[0]
        for word, factor in zip(words[1:], self.factors[1:]):
            key += word * factor
        return key

    def find(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, keywords): which of the places `at` are the beginning of one."""
        first = text[at] & self.mask
        may = self.some[_slot(first)]
        at = at[may]
        own = [first[may], *(text[at + k] for k in self.offsets[1:])]
        key = self._key(own)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[place] == key
        if len(own) > 1:
            for mine, theirs in zip(own, self.words):
                same &= mine == theirs[place]
        return at[same], self.index[place[same]]


class Finder:
    """Counts of a list of different, non-empty keywords (bytes) in texts."""

    def __init__(self, keywords: list[bytes]):
        self.keywords = keywords
        self.sizes = np.array([len(k) for k in keywords], np.int64)
        self.most = int(self.sizes.max(initial=0))
        # One that ends as it begins may overlap itself.
        self.bordered = np.array([any(k.startswith(k[p:]) for p in range(1, len(k))) for k in keywords], bool)
        by: dict[int, list[int]] = {}
        for i, k in enumerate(keywords):
            by.setdefault(len(k), []).append(i)
        self.lengths = [_Length(n, [keywords[i] for i in some], some) for n, some in sorted(by.items())]
        self.short = [x for x in self.lengths if x.size < 4]
        self.long = [(x, np.uint64(1 << k % 64)) for k, x in enumerate(x for x in self.lengths if x.size >= 4)]
        self.heads = np.zeros(1 << 16, np.uint64)
        for x, bit in self.long:
            self.heads[_slot(x.first & np.uint64(0xFFFFFFFF))] |= bit

    def _places(self, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, keywords) in the first `n` of the words of a text."""
        found = []
        for x in self.short:
            found.append(x.find(text, np.arange(n)))
        if self.long:
            heads = self.heads[_slot(text[:n] & np.uint64(0xFFFFFFFF))]
            some = np.flatnonzero(heads)
            heads = heads[some]
            for x, bit in self.long:
                at = some[(heads & bit) != 0]
                if len(at):
                    found.append(x.find(text, at))
        return tuple(np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def counts(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, keyword, n): how often each keyword occurs in each row, data[edges[i]:edges[i + 1]], from the left and without
        overlaps; only where it does."""
        rows, many = len(edges) - 1, len(self.keywords)
        total, held, size, bordered = None, [], 0, []
        for a in range(int(edges[0]), int(edges[-1]), WINDOW):
            b = min(a + WINDOW, int(edges[-1]))
            at, which = self._places(_words(data[a : min(b + self.most, int(edges[-1]))], b - a + self.most), b - a)
            row = np.repeat(np.arange(rows), np.diff(np.clip(edges, a, b)))[at]
            at = at + a
            inside = at + self.sizes[which] <= edges[row + 1]
            at, which, row = at[inside], which[inside], row[inside]
            code = row * many + which
            mine = self.bordered[which]
            if mine.any():
                bordered.append((code[mine], at[mine]))
            held.append(code)
            size += len(code)
            if size > HELD:
                total, held, size = _summed(total, held, rows * many), [], 0
        code, n = total = _summed(total, held, rows * many)
        if bordered:
            own, at = (np.concatenate(x) for x in zip(*bordered))
            order = np.lexsort((at, own))
            own, at = own[order], at[order]
            near = (own[1:] == own[:-1]) & (at[1:] - at[:-1] < self.sizes[own[1:] % many])
            for c in np.unique(own[1:][near]).tolist():
                text = data[edges[c // many] : edges[c // many + 1]].tobytes()
                n[np.searchsorted(code, c)] = text.count(self.keywords[c % many])
        return code // many, code % many, n


def _summed(total: tuple[np.ndarray, np.ndarray] | None, codes: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes in order, how often), with what was summed before."""
    codes = np.concatenate([np.zeros(0, np.int64), *codes])
    if most <= DENSE:
        n = np.bincount(codes, minlength=1)
        code = np.flatnonzero(n)
        n = n[code]
    else:
        code, n = np.unique(codes, return_counts=True)
    if total is None:
        return code, n
    both, place = np.unique(np.concatenate([total[0], code]), return_inverse=True)
    return both, np.bincount(place, np.concatenate([total[1], n])).astype(np.int64)
