"""Splitting text for byte-level BPE over whole batches in numpy, and a lexicon that encodes each new word once.

The split equals the findall of this pattern, which the public rank files are made for:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Texts are UTF-8. Rows longer than a chunk are cut before a space that follows a printable ASCII character, where the
pattern always starts a new match, so memory follows the chunk and not the longest text (a row that has no such place
stays in one piece).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from .shared import prefix_sums

CHUNK = 1 << 20
LETTER, NUMBER, SPACE = 1, 2, 3
#: Words beyond this many characters are told apart by a cryptographic digest, shorter ones by a polynomial.
POLYNOMIAL_UPTO = 64
#: Bytes of remembered words, at most, but for a single block that has more.
MOST_TEXT = 1 << 26


@lru_cache(1)
def classes() -> np.ndarray:
    """For each code point: LETTER, NUMBER, SPACE or 0, as the regular expressions of the tiktoken library class it.

    A test holds the classes of the tokenizers library to be the same; Python's own tables follow another Unicode."""
    import tiktoken

    out = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        # With a vocabulary of the 256 bytes, what comes back is just what the pattern matches.
        matched = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = np.frombuffer(bytes(matched.encode_ordinary(everything)).decode().encode("utf-32-le"), "<u4")
        out[found] = kind
    return out


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of (row, start, end) arrays of about `limit` bytes; a row may be in several, in order."""
    rows, heads, tails, held = [], [], [], 0
    for row, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        while True:
            cut = b
            if b - a > limit:
                at = a + limit
                window = data[at - 1 : b]
                fits = np.flatnonzero((window[1 : limit + 1] == 32) & (window[:limit][: len(window[1 : limit + 1])] > 32) & (window[:limit][: len(window[1 : limit + 1])] < 127))
                cut = at + int(fits[0]) if len(fits) else b
            if held and held + cut - a > limit:
                yield np.array(rows), np.array(heads), np.array(tails)
                rows, heads, tails, held = [], [], [], 0
            rows.append(row)
            heads.append(a)
            tails.append(cut)
            held += cut - a
            a = cut
            if a >= b:
                break
    if rows:
        yield np.array(rows), np.array(heads), np.array(tails)


def split(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where matches begin, for rows points[edge[i]:edge[i+1]] of code points."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    head = np.zeros(n + 1, bool)
    head[edge] = True
    tail = head[1:].copy()  # the last character of a row
    head = head[:-1]
    run = head.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank = points == 32
    begin = run.copy()
    begin[1:] &= ~(blank[:-1] & ~space[1:] & ~head[1:])  # one space belongs to what follows it
    last = space & ~tail
    last[:-1] &= ~space[1:]
    begin |= last  # the last character of white space stays for what follows, unless the row ends
    quote = np.flatnonzero(begin & (points == 39) & ~tail)
    if len(quote):
        width = _contraction(points, tail, quote)
        quote, width = quote[width > 0], width[width > 0]
        begin[quote + 1] = False
        after = quote + width
        begin[after[after < n]] = True
    return np.flatnonzero(begin)


def _contraction(points: np.ndarray, tail: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length of the contraction that begins with the apostrophe at each place, or 0."""
    n = len(points)
    one = points[at + 1]
    more = ~tail[at + 1]
    two = np.where(more, points[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    return np.where(short, 2, np.where(long, 3, 0))


class Lexicon:
    """Ids of words by a 64-bit key of the word. At most `capacity` words are remembered; what is forgotten is
    encoded again, so the bound costs time and never changes a result.

    The bytes of remembered words are kept, and all of a block's text is compared with them. A block in which two words
    share a key, by accident or made so on purpose, is looked up by the words themselves."""

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], capacity: int = 1 << 20):
        self.encode, self.capacity = encode, capacity
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.text, self.text_at, self.text_size = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def lookup(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, row boundaries in them) for rows data[edge[i]:edge[i+1]] of UTF-8."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(edge), np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        row = np.searchsorted(lead, edge)
        begin = split(points, row)
        end = np.append(begin[1:], len(points))
        byte = np.append(lead, len(data))
        keys = self._keys(points, begin, end, data, byte)
        order = np.argsort(keys)
        ranked = keys[order]
        fresh = np.append(True, ranked[1:] != ranked[:-1])
        words, first = ranked[fresh], order[fresh]
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(fresh) - 1
        slot = self._slots(words, first, data, byte[begin], byte[end])
        slot = slot[which]
        if self._spelled(slot, data, byte[end] - byte[begin]):
            at, size, found = self.at[slot], self.size[slot], self.ids
        else:
            self.forget()
            at, size, found = self._word_by_word(data, byte[begin], byte[end])
        stop = np.cumsum(size, dtype=np.int64)
        ids = found[np.repeat(at - stop + size, size) + np.arange(stop[-1])]
        bounds = np.append(0, stop)[np.searchsorted(begin, row)]
        return ids, bounds

    def _keys(self, points, begin, end, data, byte) -> np.ndarray:
        sums, scale = prefix_sums(points)
        with np.errstate(over="ignore"):
            keys = (sums[end] - sums[begin]) * scale[begin]
            keys ^= keys >> np.uint64(29)
            keys *= np.uint64(0xBF58476D1CE4E5B9)
            keys ^= keys >> np.uint64(32)
        for i in np.flatnonzero(end - begin > POLYNOMIAL_UPTO).tolist():
            from hashlib import blake2b

            keys[i] = int.from_bytes(blake2b(data[byte[begin[i]] : byte[end[i]]].tobytes(), digest_size=8).digest(), "little")
        return keys

    def _spelled(self, slot: np.ndarray, data: np.ndarray, size: np.ndarray) -> bool:
        """Whether the remembered words in these slots, one after another, are the data; `size` is of the data's words."""
        if not (self.text_size[slot] == size).all():
            return False
        stop = np.cumsum(size)
        return bool((self.text[np.repeat(self.text_at[slot] - stop + size, size) + np.arange(len(data))] == data).all())

    def _word_by_word(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place and number of each word's ids, ids), without keys."""
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        place = {word: i for i, word in enumerate(dict.fromkeys(words))}
        edge = np.append(0, np.cumsum([len(word) for word in place]))
        ids, bounds = self.encode(np.frombuffer(b"".join(place), np.uint8), edge)
        which = np.array([place[word] for word in words])
        return bounds[:-1][which], np.diff(bounds)[which], ids.astype(np.uint32)

    def _slots(self, words, first, data, starts, ends) -> np.ndarray:
        at = np.searchsorted(self.keys, words)
        known = self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == words if len(self.keys) else np.zeros(len(words), bool)
        if known.all():
            return at
        full = len(self.keys) + int((~known).sum()) > self.capacity or len(self.text) + len(data) > MOST_TEXT
        if full and len(self.keys):
            self.forget()
            return self._slots(words, first, data, starts, ends)
        new = first[~known]
        a, b = starts[new], ends[new]
        size = b - a
        edge = np.append(0, np.cumsum(size))
        spelled = data[np.repeat(a - edge[:-1], size) + np.arange(edge[-1])]
        ids, bounds = self.encode(spelled, edge)
        put = at[~known]
        self.text_at = np.insert(self.text_at, put, edge[:-1] + len(self.text))
        self.text_size = np.insert(self.text_size, put, size)
        self.text = np.concatenate([self.text, spelled])
        self.keys = np.insert(self.keys, put, words[~known])
        self.at = np.insert(self.at, put, bounds[:-1] + len(self.ids))
        self.size = np.insert(self.size, put, np.diff(bounds))
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        return np.searchsorted(self.keys, words)
