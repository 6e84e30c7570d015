"""Classifiers on held-out rows of the small tables, against plain forward passes, and on awkward rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadframe.llm import langid, quality, toxicity
from leadframe.llm.queries import QUERIES
from leadframe.llm.shared import BASE, gather, remainder, spans

DIR = "/root/testdata/sf0.01"
AWKWARD = [(None, None), (1, ""), (2, "  \n"), (3, "123 !!"), (4, "the " * 60000), (4, "the"), (5, "日本語"), (6, "É")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumns({"lang": F.lit("xx"), "score": F.lit(1), "lang_pred": F.lit("x"), "predicted": F.lit(7), "held_out": F.lit(2), "_label": F.lit(0)})


def test_language_accuracy_and_windows(spark, tables, odd):
    docs, _ = tables
    got = QUERIES["op4_langid_convnet"](spark, DIR)
    right = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] and right[2] <= 1
    model = langid.train(docs, F.lit(True))
    rows = langid.identify(odd, model).collect()
    by_text = {r.doc_id: r for r in rows}
    assert len(rows) == len(AWKWARD)
    assert all(by_text[i].lang_pred == "und" and by_text[i].score == 0 for i in (None, 1, 2, 3))
    assert all(by_text[i].lang_pred in model.languages and by_text[i].score > 0 for i in (4, 5, 6))
    assert langid.identify(odd.where("false"), model).count() == 0


def test_language_without_anything_to_learn(spark, odd):
    assert {r.lang_pred for r in langid.identify(odd, langid.train(odd, F.lit(False))).collect()} == {"und"}
    one = langid.identify(odd, langid.train(odd, F.lit(True))).where("doc_id = 6").first()
    assert (one.lang_pred, one.score) == ("xx", 1.0)


def test_windows_hold_every_byte_sequence_once():
    data = np.arange(1, 1001).astype(np.uint8)
    edge = np.array([0, 0, 3, 256, 700, 1000])
    cut, row = langid.windows(data, edge)
    for i in range(5):
        mine = cut[row == i]
        whole = data[edge[i] : edge[i + 1]]
        back = np.concatenate([mine[0], *(w[langid.WINDOW - langid.STRIDE :] for w in mine[1:])])[: len(whole)] if len(mine) else whole[:0]
        assert (back == whole).all()


def test_tables_respond_like_the_network(tables):
    docs, _ = tables
    model = langid.train(docs, F.lit(True), rows=20)
    rng = np.random.default_rng(0)
    cut = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    ids = np.zeros((5, langid.WINDOW + 3), np.int64)
    ids[:, : langid.WINDOW] = cut
    embedded, response = model.net.responses(ids.reshape(-1, 1))
    inside = response.reshape(5, -1, response.shape[1])[:, : langid.WINDOW - 3].max(1)
    score = model.net.logits(inside)
    score = np.exp(score - score.max(1, keepdims=True))
    assert np.allclose(model.probabilities(cut), score / score.sum(1, keepdims=True), atol=1e-4)


def test_toxicity(spark, tables, odd):
    docs, labels = tables
    got = QUERIES["op1_toxicity_convnet"](spark, DIR)
    judged = got.join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted")).collect()
    rate = {r[0]: r[1] for r in judged}
    assert rate[1] >= 0.5 and rate[0] < 0.1  # six toxic rows at this scale; the next test has enough of them
    model = toxicity.train(docs, labels, F.lit(True))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score(odd.where("false"), model).count() == 0
    nothing = toxicity.train(docs, labels, F.lit(False))
    assert {(r.score, r.predicted) for r in toxicity.score(odd, nothing).collect()} == {(0.0, 0)}


def test_toxicity_on_held_out_rows_of_the_larger_table(spark):
    big = "/root/testdata/sf0.1"
    got = QUERIES["op1_toxicity_convnet"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    both, said, toxic = got.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert toxic > 50 and both / said >= 0.85 and both / toxic >= 0.8


def plain_fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("\u00c0" <= c <= "\u00de" and c != "\u00d7") else c for c in text or "")


def plain_toxicity(model, text):
    """Word by word and filter by filter, in plain Python but for the dot products."""
    words = re.findall(rb"[a-z0-9\x80-\xff]+", plain_fold(text).encode())

    def bucket(word, salt):
        h = sum((b + 1) * pow(int(BASE), i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)
        return ((((h ^ salt) * 0xBF58476D1CE4E5B9) % (1 << 64)) >> 40) % (toxicity.BUCKETS - 1) + 1

    ids = [[bucket(w, 1)] + [bucket(w[:k], k) for k in toxicity.PREFIXES] for w in words]
    w = model.net.weights
    rows = [sum(w["embed"][i].astype(float) for i in three) for three in ids] + [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
    top = []
    for width in toxicity.WIDTHS:
        at = [sum(rows[p + k] @ w[f"conv{width}"][k] for k in range(width)) for p in range(len(ids))]
        top.append(np.max(at, axis=0) if at else np.zeros(toxicity.FILTERS))
    hidden = np.maximum(np.concatenate(top) + w["bias"], 0)
    z = hidden @ w["out"].astype(float) + w["prior"]
    evidence = sum(model.guess[three[0]].astype(float) for three in ids) if ids else np.zeros(model.guess.shape[1])
    language = int(np.argmax(evidence)) if ids and np.any(evidence != 0) else -1
    return 1 / (1 + math.exp(-model.slope * (z[1] - z[0] - model.thresholds[language])))


def test_toxicity_scores_equal_a_plain_forward_pass(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels, remainder("doc_id", 5) != 0)
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 40 = 0").collect()}
    got = {r.doc_id: r.score for r in QUERIES["op1_toxicity_convnet"](spark, DIR).where("doc_id % 40 = 0").collect()}
    assert len(got) == len(texts) > 20
    assert all(abs(got[i] - plain_toxicity(model, texts[i])) < 1e-3 for i in texts)


def plain_language(model, text):
    data = plain_fold(text).encode()
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    w, total, weights = model.net.weights, np.zeros(len(model.languages)), 0.0
    starts = [0]
    while starts[-1] + langid.WINDOW < len(data):
        starts.append(starts[-1] + langid.STRIDE)
    for start in starts:
        window = data[start : start + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        rows = [w["embed"][b].astype(float) for b in window]
        top = [np.max([sum(rows[p + k] @ w[f"conv{width}"][k] for k in range(width)) for p in range(langid.WINDOW - 3)], axis=0) for width in langid.WIDTHS]
        z = np.maximum(np.concatenate(top) + w["bias"], 0) @ w["out"].astype(float) + w["prior"]
        p = np.exp(z - z.max())
        weight = sum(97 <= b <= 122 or b >= 128 for b in window) + 1e-6
        total += weight * p / p.sum()
        weights += weight
    return model.languages[int(total.argmax())], float(total.max() / weights)


def test_language_scores_equal_a_plain_forward_pass(spark, tables):
    docs, _ = tables
    model = langid.train(docs, remainder("doc_id", 4) != 2)
    chosen = docs.where("doc_id % 100 = 0 and length(text) < 6000")
    texts = {r.doc_id: r.text for r in chosen.collect()}
    got = {r.doc_id: r for r in QUERIES["op4_langid_convnet"](spark, DIR).join(chosen.select("doc_id"), "doc_id").collect()}
    assert len(got) == len(texts) > 5
    for i, text in texts.items():
        label, score = plain_language(model, text)
        assert got[i].lang_pred == label and abs(got[i].score - score) < 1e-4


def test_quality_scores_equal_a_loop_over_texts(spark, tables):
    import zstandard

    docs, labels = tables
    model = quality.train(docs, labels, remainder("doc_id", 3) != 1)
    made = []
    for content in model.dictionaries:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=quality.LEVEL)
        made.append(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=dictionary, write_content_size=False))
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 10 = 0").collect()}
    got = {r.doc_id: r.score for r in QUERIES["op6_quality_compression"](spark, DIR).where("doc_id % 10 = 0").collect()}
    for i, text in texts.items():
        raw = (text or "").encode()
        good, bad = (len(c.compress(raw)) for c in made)
        difference, length = (bad - good) / (len(raw) + 16), math.log(len(raw) + 16)
        hats = [float(np.interp(length, model.knots, np.eye(len(model.knots))[k])) for k in range(len(model.knots))]
        x = np.array([*hats[1:], *(h * difference for h in hats)])
        z = model.weights[0] + ((x - model.mean) / model.scale) @ model.weights[1:]
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_length_alone_says_little_about_quality(spark):
    """The ablation of the README: without the difference the bands of length are no better than the commoner label."""
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = QUERIES["op6_quality_compression"](spark, big).join(labels, "doc_id").where("held_out")
    right, share = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.avg("quality")).first()
    assert right > 0.98
    rows = docs.join(labels, "doc_id").where(F.col("quality").isin(0, 1)).select("doc_id", F.octet_length("text").alias("n"), "quality", (remainder("doc_id", 3) == 1).alias("hold")).toPandas()
    length = np.log(rows.n.to_numpy() + 16.0)
    knots = np.unique(np.quantile(length, np.linspace(0, 1, quality.KNOTS)))
    x = quality.features(np.zeros(len(rows)), length, knots)[:, : len(knots) - 1]
    y, hold = rows.quality.to_numpy(float), rows.hold.to_numpy(bool)
    w = quality.logistic(x[~hold], y[~hold], np.ones((~hold).sum()))
    alone = ((w[0] + x[hold] @ w[1:] > 0) == y[hold]).mean()
    assert alone < max(share, 1 - share) + 0.02


def test_classifiers_on_empty_tables(spark, tables):
    docs, labels = tables
    none, no_labels = docs.where("false"), labels.where("false")
    for module in (toxicity, quality):
        assert module.score(none, module.train(docs, labels, F.lit(True))).count() == 0
        assert module.score(docs.limit(3), module.train(none, no_labels, F.lit(True))).count() == 3


def test_toxicity_of_a_long_text_in_pieces(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels, F.lit(True))
    text = " ".join(r.text for r in docs.limit(30).collect())
    data = np.frombuffer(text.encode(), np.uint8)
    edge = np.array([0, len(data) // 2, len(data), len(data)])
    whole = model.measure(data, edge, 1 << 30)
    pieces = model.measure(data, edge, 97)
    assert np.allclose(whole[0], pieces[0], atol=1e-4) and np.allclose(whole[1], pieces[1], rtol=1e-3, atol=1e-2)
    for limit in (1, 50, 1000):
        assert (toxicity.words_of_long(data, limit) == toxicity.words(data, np.array([0, len(data)]))[0]).all()


def test_threshold_lies_in_the_widest_gap():
    assert toxicity.threshold(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1])) == 3.0


def test_quality(spark, tables, odd):
    docs, labels = tables
    got = QUERIES["op6_quality_compression"](spark, DIR).join(labels, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.9
    model = quality.train(docs, labels, F.lit(True))
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score
    assert {r.score for r in quality.score(odd, quality.train(docs, labels, F.lit(False))).collect()} == {0.5}


def test_scores_do_not_depend_on_labels_or_columns(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels, remainder("doc_id", 5) != 0)
    plain = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": F.col("doc_id") + 1})
    assert {r.doc_id - 1: r.score for r in toxicity.score(other, model).collect()} == plain


def test_labels_that_repeat_contradict_or_lack_a_document(spark, tables):
    docs, _ = tables
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, None), (None, 1), (10**9, 1), (3, 5)], "doc_id long, toxic int")
    from leadframe.llm.shared import labelled_sample

    got = labelled_sample(docs, labels, "toxic", F.lit(True), 10, 1 << 20, 0)
    assert sorted(zip(got.column("doc_id").to_pylist(), got.column("label").to_pylist())) == [(0, 1), (1, 0)]
    assert [len(x) for x in spans(got.column("text"))[1:]] == [2, 2] and gather(*spans(got.column("text")))[1][0] == 0


def test_the_sample_is_of_ids_that_have_documents(spark, tables):
    docs, _ = tables
    ids = docs.select("doc_id").distinct().count()
    labels = spark.range(100 * ids).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")  # documents are 1 % of the ids
    from leadframe.llm.shared import label_counts, labelled_sample

    got = labelled_sample(docs, labels, "toxic", F.lit(True), 50, 1 << 30, 0)
    assert got.num_rows == 100 and sum(got.column("label").to_pylist()) == 50
    assert label_counts(labels, "toxic", F.lit(True), docs).sum() == ids


def test_toxicity_learns_from_rows_of_any_number_and_length(spark):
    from leadframe.llm.shared import labelled_rows

    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('word', id % 7, ' other') as text", "if(id % 2 = 0, 'en', null) as lang")
    docs = docs.unionByName(spark.sql("select -1L as doc_id, repeat('long ', 200000) as text, 'en' as lang union all select 12000L, null, 'en'"))
    labels = spark.range(-1, 12_001).selectExpr("cast(id as int) as doc_id", "cast(id % 3 = 0 as int) as toxic")
    rows = labelled_rows(docs, labels, "toxic", F.col("doc_id") != 5, 3000, 0)
    assert rows.rdd.getNumPartitions() == 5 and rows.agg(F.count("*"), F.countDistinct("doc_id")).first() == (12_001, 12_001)
    assert rows.where("label = cast(doc_id % 3 = 0 as int)").count() == 12_001 and 2_000 < rows.where("hold").count() < 2_800
    counts = toxicity.word_counts(rows, ["en"])
    assert counts.sum(0).tolist() == [12_000 + 200_000, 11_998]  # (6,000 even ids, two words each) and (5,999 odd ones but 5)
    # Only long texts are toxic here, and one word of each gives them away.
    clean = spark.range(60).selectExpr("id as doc_id", "'all is well here' as text", "'en' as lang")
    toxic = spark.range(60, 90).selectExpr("id as doc_id", "concat(repeat('all is well here ', 5000), ' vile') as text", "'en' as lang")
    both = clean.unionByName(toxic)
    model = toxicity.train(both, both.selectExpr("doc_id", "cast(doc_id >= 60 as int) as toxic"), F.lit(True))
    assert {(r.doc_id >= 60, r.predicted) for r in toxicity.score(both, model).collect()} == {(False, 0), (True, 1)}


def test_shards_move_the_network_by_their_mean(spark):
    nets = []
    for shards in (1, 2):  # the second shard learns the same as the first
        rows = spark.range(0, 90 * shards, 1, shards).selectExpr("concat(if(id % 3 = 0, 'vile ', 'mild '), 'w', id % 90) as text", "cast(id % 3 = 0 as int) as label")
        assert rows.rdd.getNumPartitions() == shards
        net = toxicity.ConvNet(toxicity.BUCKETS, toxicity.DIM, toxicity.WIDTHS, toxicity.FILTERS, 2, 0)
        before = net.copy()
        toxicity.learn_round(net, rows, np.ones(2), 0.01, 2, 0)
        nets.append(net)
    assert all(np.allclose(nets[0].weights[k], nets[1].weights[k], atol=1e-6) and not np.allclose(nets[0].weights[k], before.weights[k]) for k in before.weights)


def test_learning_from_a_long_segment_in_pieces():
    rng = np.random.default_rng(1)
    net = toxicity.ConvNet(50, 8, (1, 2, 3), 4, 2)
    ids, own = toxicity.segments(rng.integers(1, 50, (400, 3)), np.array([0, 0, 300, 310, 400]), net.padding)
    whole = net.winners(ids, own)
    for limit in (7, 64):
        top, made_of = net.winners(ids, own, limit)
        assert np.allclose(top, whole[0], atol=1e-6)
        for j, w in enumerate(net.widths):
            mine = slice(j * net.filters, (j + 1) * net.filters)
            assert (made_of[:, mine, :w] == whole[1][:, mine, :w]).all()


def test_threshold_counts_rows_at_equal_places():
    z, y = np.array([0.0, 0.0, 0.0, 1.0, 5.0, 5.0, 6.0]), np.array([0, 0, 0, 1, 1, 0, 1])
    assert toxicity.threshold(*toxicity.summed(z, y, np.ones(7))) == 0.5
