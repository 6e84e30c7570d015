"""Tokens, packing and fingerprints against brute force, and on awkward rows."""

import base64
from hashlib import sha256
from itertools import combinations
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from leadframe.llm import bpe, packing, pretokens, shingles, simhash
from leadframe.llm import components as connected
from leadframe.llm.shared import gather, spans
from leadframe.llm.xxh64 import hash_ranges

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
AWKWARD = [None, "", " ", "\n\t", "a", "a a a", "Hello world, it's me's 12", "ß é 日本  x y", "x" * 3000, "word " * 4000, "<|endoftext|> a", "a\x1cb", "''s '' 'll", "tie", "tie"]


def docs(spark, texts=AWKWARD, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    # names that operators use inside, as columns of their own
    return frame.select("*", *(F.lit("x").alias(c) for c in ("id", "ids", "fp", "key", "score", "offset", "start")))


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts, chunk=pretokens.CHUNK):
    out = [[] for _ in texts]
    data, starts, ends = spans(pa.array(texts, pa.string()))
    for rows, a, b in pretokens.pieces(data, starts, ends, chunk):
        ids, bounds = bpe.lexicon(RANKS).lookup(*gather(data, a, b))
        for i, row in enumerate(rows.tolist()):
            out[row] += ids[bounds[i] : bounds[i + 1]].tolist()
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("abst'rveldm  \n\t\r19!?")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=8))
def test_merge_replay_equals_tiktoken(texts):
    ranks = bpe.ranks(RANKS).rank
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert encoded(texts) == [reference.encode_ordinary(t) for t in texts]


def test_every_character_splits_as_both_libraries_do(encoder):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}'s {chr(c)}1" for c in points]
    assert encoded(texts) == [encoder.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    some = texts[::7]
    assert encoded(some) == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]


def test_long_rows_are_cut_without_a_trace(encoder):
    texts = ["it's we'll " * 500, "x" * 5000, "", "a  b \n c. " * 300]
    assert encoded(texts, 200) == [encoder.encode_ordinary(t) for t in texts]


def test_forgetting_words_changes_nothing(encoder):
    small = pretokens.Lexicon(bpe.ranks(RANKS).replay, capacity=3)
    for text in ("a b c d e f g", "a b x y z", "a"):
        ids, _ = small.lookup(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == encoder.encode_ordinary(text)


def test_words_with_the_same_key_are_told_apart(encoder, monkeypatch):
    text = "one two three  ones it's one" * 3
    data = np.frombuffer(text.encode(), np.uint8)
    lexicon = pretokens.Lexicon(bpe.ranks(RANKS).replay)
    real = pretokens.Lexicon._keys
    for mask in (0, 1, 3):  # all words share a few keys
        monkeypatch.setattr(pretokens.Lexicon, "_keys", lambda self, *a, mask=mask: real(self, *a) & np.uint64(mask))
        assert lexicon.lookup(data, np.array([0, len(data)]))[0].tolist() == encoder.encode_ordinary(text)
    monkeypatch.setattr(pretokens.Lexicon, "_keys", real)
    assert lexicon.lookup(data, np.array([0, len(data)]))[0].tolist() == encoder.encode_ordinary(text)


def test_added_tokens_are_as_the_library_has_them():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    texts = ["<|endoftext|> a", "a<|endoftext|><|endoftext|>", "plain", "", " <|endoftext|", "é<|endoftext|>é <|endoftext|> "]
    data, starts, ends = spans(pa.array(texts))
    ids, bounds = packing.encoder(JSON).ids(*gather(data, starts, ends))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert library.encode("<|endoftext|> a", add_special_tokens=False).ids == [50256, 257]


def test_digests_of_awkward_rows(spark, encoder):
    got = {r.doc_id: r for r in bpe.digests(docs(spark), RANKS).collect()}
    assert len(got) == len(AWKWARD)
    for i, text in enumerate(AWKWARD):
        ids = encoder.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == sha256((text or "").encode()).hexdigest()
    empty = docs(spark).where("false")
    assert bpe.digests(empty, RANKS).count() == 0


def test_encode_and_decode_round_trip(spark):
    ids = bpe.encode(docs(spark), RANKS)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(AWKWARD)}


def packed_rows_are_sound(rows, ids_of, capacity=1024, segments=packing.SEGMENTS):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        ids, at = ids_of[doc], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and len(pieces) <= segments
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_places_every_token_once(spark, encoder):
    rows = packing.pack_texts(docs(spark), JSON).collect()
    assert {r.doc_id for r in rows} == set(range(len(AWKWARD)))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    padding = packed_rows_are_sound(rows, [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in AWKWARD])
    assert padding == 0
    assert packing.pack_texts(docs(spark).where("false"), JSON).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=120), st.integers(2, 64), st.integers(1, 6), st.integers(1, 40))
def test_packer_with_cuts(sizes, capacity, segments, window):
    packer = packing.Packer(capacity, segments, None, True, window)
    for i, n in enumerate(sizes):
        packer.add(i, n, 0)
    packer.finish()
    placed, sequences = {}, {}
    for handle, start, n, sequence, offset, oversize in packer.placed:
        assert n > 0 and not oversize
        placed.setdefault(handle, []).append((start, n))
        sequences.setdefault(sequence, []).append((offset, n))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(placed[i]):
            assert start == at
            at += length
        assert at == n
    for pieces in sequences.values():
        assert len(pieces) <= segments and sum(n for _, n in pieces) <= capacity


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=80))
def test_packer_of_whole_examples_keeps_all_three_limits(examples):
    packer = packing.Packer(40, 3, 20, False, 16)
    for i, (tokens, loss) in enumerate(examples):
        packer.add(i, tokens, min(loss, tokens))
    packer.finish()
    assert sorted(p[0] for p in packer.placed) == list(range(len(examples)))
    sequences = {}
    for handle, start, tokens, sequence, offset, oversize in packer.placed:
        assert oversize == (tokens > 40 or min(examples[handle][1], tokens) > 20)
        sequences.setdefault(sequence, []).append((tokens, min(examples[handle][1], tokens), oversize))
    for pieces in sequences.values():
        if len(pieces) > 1 or not pieces[0][2]:
            assert len(pieces) <= 3 and sum(p[0] for p in pieces) <= 40 and sum(p[1] for p in pieces) <= 20


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 30_001])
def test_what_waits_holds_no_more_than_its_own_tokens(n):
    ids = np.arange(n, dtype=np.uint32)
    parts = list(packing.full_and_rest("doc", ids, 1024))
    assert [(tokens, start) for _, tokens, start in parts] == [x for x in ((n // 1024 * 1024, 0), (n % 1024, n // 1024 * 1024)) if x[0]]
    for (name, own, base, total), tokens, start in parts:
        assert (name, base, total, own.tolist()) == ("doc", start, n, ids[start : start + tokens].tolist())
    (_, waiting, _, _), tokens, _ = parts[-1]
    assert n < 1024 or n % 1024 == 0 or (waiting.base is None and waiting.nbytes == 4 * tokens)


def test_pack_examples_frame(spark):
    rows = spark.createDataFrame([(1, 5, 2), (2, None, None), (3, 2000, 10), (3, 7, 7)], "id long, tokens int, loss int")
    got = packing.pack_examples(rows, "id", "tokens", "loss").collect()
    assert sorted((r.id, r.tokens, r.oversize) for r in got) == [(1, 5, False), (2, 0, False), (3, 7, False), (3, 2000, True)]
    with pytest.raises(ValueError):
        packing.Packer(capacity=10, loss=5, cut=True)


# --- fingerprints --------------------------------------------------------------------------------------------------


def brute_fingerprint(text, shingle=4):
    words = (text or "").encode().translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, max_bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= max_bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, f in enumerate(range(len(fps))):
        least[find(f)] = min(least.get(find(f), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_vectorised_hash():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts, lengths = rng.integers(0, 2700, 500), rng.integers(0, 200, 500)
    want = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(starts, lengths)]
    assert hash_ranges(data, starts, lengths, 42).tolist() == want


def test_golay_keys_meet_within_two_bits():
    parity, patterns, count = simhash.golay()
    assert sorted(set(count.tolist())) == [1, 6]
    leaders = np.array([sum(1 << p for p in c) for k in range(4) for c in combinations(range(23), k)])
    flips = np.array([sum(1 << p for p in c) for k in range(3) for c in combinations(range(23), k)])
    index, size = simhash.near_codewords(leaders)
    mine = np.where(np.arange(6) < size[:, None], index, -1)
    for flip in flips:  # by linearity the leaders of all cosets stand for all words
        other, n = simhash.near_codewords(leaders ^ flip)
        theirs = np.where(np.arange(6) < n[:, None], other, -2)
        assert (mine[:, :, None] == theirs[:, None, :]).any((1, 2)).all()


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_components_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(list("abcdefghij"), 60)) for _ in range(12)]
    texts = list(AWKWARD) + base + base[:3]
    for t in base[:6]:
        words = t.split()
        for k in range(12):
            words[int(rng.integers(60))] = "zz"
            texts.append(" ".join(words))
    fps = [brute_fingerprint(t) for t in texts]
    got = {r.doc_id: r for r in simhash.components(docs(spark, texts), block=block).collect()}
    assert [int(got[i].fp, 16) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == brute_components(list(range(len(texts))), fps)


def test_close_fingerprints_in_one_bucket_are_all_linked():
    rng = np.random.default_rng(2)
    fps = [int(rng.integers(1 << 62))]
    for _ in range(400):
        fps.append(fps[int(rng.integers(len(fps)))] ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    fps = sorted(set(fps))
    array = np.array(fps, np.uint64).view(np.int64)
    a, b = simhash.forest(np.zeros(len(fps), np.int32), array, 4)
    parent = {f: f for f in fps}
    for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist()):
        parent[x] = y
    want = brute_components(list(range(len(fps))), fps)
    groups = {}
    for f, w in zip(fps, want):
        groups.setdefault(w, set()).add(parent[f])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_nothing_and_of_null_ids(spark):
    assert simhash.components(docs(spark).where("false")).count() == 0
    rows = spark.createDataFrame([(None, "same words here now"), (7, "same words here now"), (7, "same words here now"), (None, "other words over there")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.components(rows).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7)]
    kept = simhash.keep_one(rows.withColumn("rows", rows.text)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "other words over there"), (7, "same words here now")]


@pytest.mark.parametrize("few", [1 << 20, 10])
def test_components_of_edges_both_ways(spark, few):
    """Long chains, a star, a cycle, loops and repeats: united by one task, or by star steps in Spark."""
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(100, 260)]
    star = [(1000, x) for x in range(1001, 1060)]
    edges = chain + star + [(7, 8), (8, 9), (9, 7), (5, 5), (7, 8), (-4, 1 << 60)]
    edges = [edges[i] for i in rng.permutation(len(edges))]
    got = connected.components(spark.createDataFrame(edges, "u long, v long").repartition(5), few=few).collect()
    want = {(x, 100) for x in range(101, 261)} | {(x, 1000) for x in range(1001, 1060)} | {(8, 7), (9, 7), (1 << 60, -4)}
    assert sorted(map(tuple, got)) == sorted(want)
    assert connected.components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=80), st.integers(2, 60))
def test_forest_in_bounded_memory_keeps_components(edges, limit):
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    forest, sent = connected.Forest(limit), []
    for i in range(0, len(edges), 3):
        full = forest.add(a[i : i + 3], b[i : i + 3])
        assert forest.size < limit
        sent += [] if full is None else [full]
    sent.append(forest.take())
    u, v = (np.concatenate([s[k] for s in sent]) for k in (0, 1))
    assert list(map(sorted, zip(*map(np.ndarray.tolist, connected.spanning(u, v))))) == list(map(sorted, zip(*map(np.ndarray.tolist, connected.spanning(a, b)))))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB\t\n é", max_size=40), max_size=12), st.integers(1, 6), st.integers(1, 30))
def test_long_rows_are_hashed_in_pieces_without_a_trace(parts, shingle, limit):
    data = np.frombuffer(" ".join(parts).encode(), np.uint8)
    whole, counts = shingles.hashes(data, np.array([0, len(data)]), shingle)
    assert shingles.hashes_of_long(data, shingle, limit).tolist() == whole.tolist() and counts.sum() == len(whole)


def test_a_very_long_text_takes_bounded_memory():
    """64 MB of words: besides the text only its hashes are held, in a process of its own."""
    code = """
import resource
import numpy as np
from leadframe.llm import shingles
data = np.frombuffer(b"some words of a very long document " * (64 * 1024 * 1024 // 35), np.uint8)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
h = shingles.hashes_of_long(data, 4)
shingles.fingerprint_bits(h, np.array([len(h)]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    import subprocess
    import sys

    used = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert used < 600  # 13 million words: 107 MB of hashes, twice while they are put together, and the rows they belong to
