"""Near copies of the pipeline's stage against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadframe.llm import shingles, simhash


def shingles_of(text):
    words = [w for w in re.split("[ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(sets):
    """For each set the smallest place of its component; all pairs are compared."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def corpus(seed=1):
    """Texts with copies edited in a word of every 20 to 200, chains of edits, one hot passage and awkward rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    hot = rng.choices(words, k=40)
    texts = [None, "", " \n", "a", "A", "a b", "a b c d e", "A b  c d e", "ß é 日本  x y"]
    for base in range(30):
        text = rng.choices(words, k=rng.choice([6, 12, 60, 200, 400])) + (hot if base % 3 == 0 else [])
        texts.append(" ".join(text))
        for _ in range(rng.choice([0, 1, 4, 12])):
            copy = list(text)
            for _ in range(rng.choice([0, len(text) // 200, len(text) // 100, len(text) // 50, len(text) // 20])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            text = copy if rng.random() < 0.5 else text
    base = rng.choices(words, k=100)
    for _ in range(60):  # one large group, whose members are often a little under 0.8 from each other
        copy = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            copy[rng.randrange(100)] = rng.choice(words)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,block", [(1, shingles.BLOCK), (2, 5)])
def test_components_are_those_of_all_pairs(spark, seed, block):
    texts = corpus(seed)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marks = simhash.durable(shingles.marked(frame, "doc_id", "text", 5))
    roots = simhash.near_copies(frame, marks, "text", 5, block).toDF("node", "root")
    got = marks.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root")).collect()
    least = {}
    for row in sorted(got):
        least.setdefault(row.root, row.id)
    assert [least[row.root] for row in sorted(got)] == components([shingles_of(t) for t in texts])


def test_stage_keeps_the_smallest_id_of_each_component(spark):
    texts = corpus(3)
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components([shingles_of(t) for t in texts])))


def test_stage_on_an_empty_table(spark):
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_stage_tells_rows_apart_by_id_and_text(spark):
    a, b, c, d = ("one two three four five six", "all of these words are others", "a text of its own here", "and yet another text than those")
    rows = [(3, a), (7, a), (7, b), (9, b), (5, c), (5, d), (None, a), (None, "only without an id at all"), (None, "only without an id at all"), (None, None)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(3, a), (7, b), (5, c), (5, d), (None, "only without an id at all"), (None, None)]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_pairs_under_many_large_keys_are_given_out_once(spark):
    """The texts share forty keys; each pair is met under all of them, in one batch or several."""
    nodes, keys = list(range(1, 11)), list(range(40))
    bits = np.full(shingles.PLACES // 8, 255, np.uint8).tobytes()
    rows = [{"home": home, "i": 0, "j": 0, "node": x, "n": 1000 + x, "root": x, "mine": 0, "bits": bits, "keys": keys} for home in (1, 2) for x in nodes]
    schema = pa.schema([(c, pa.int64()) for c in ("home", "i", "j", "node", "n", "root", "mine")] + [("bits", pa.binary()), ("keys", pa.list_(pa.int64()))])
    batches = [pa.RecordBatch.from_pylist(rows[at : at + 7], schema) for at in range(0, len(rows), 7)]
    got = [(a, b) for out in shingles._by_group(iter(batches), None) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert sorted(got) == [(a, b) for a in nodes for b in nodes if a < b]


def test_keys_of_the_same_nodes_meet_at_one_home(spark):
    marks = spark.createDataFrame([(x, 100, [1, 2, 3, 10 + x]) for x in (7, 3, 5, 9)], "node long, n int, prefix array<long>")
    homes = shingles.housed(shingles.met(marks)).collect()
    assert sorted((r.home, r.node, r.n, sorted(r["keys"])) for r in homes) == [(3, x, 100, [1, 2, 3]) for x in (3, 5, 7, 9)]
