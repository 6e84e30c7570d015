"""Every stage of the pipeline, and all of it, against brute force on a small fixture with planted rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadframe.llm import langid, toxicity
from leadframe.llm.shared import durable

from .test_models import plain_language, plain_toxicity
from .test_neardup import components, shingles_of
from .test_text_operators import JSON, packed_rows_are_sound

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Some documents with planted copies, toxic texts under other ids, texts without letters, and awkward rows, beside all
    labels; their place; columns whose names operators use."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    some = [tuple(r) for r in docs.where("length(text) < 2500 and doc_id % 4 = 0").limit(120).collect()]
    bad = [tuple(r) for r in docs.where("length(text) < 2500").join(labels.where("toxic = 1"), "doc_id", "left_semi").limit(8).collect()]
    rows, at = list(some + bad), 10_000
    for text in [some[3][1], some[3][1], some[5][1] + " more", " ".join(["odd", *some[9][1].split()[1:]]), bad[0][1], "123 456 !!", "", " ", None, None]:
        rows.append((at, text, "en", "planted", None))
        at += 1
    rows += [(None, some[7][1], "en", None, None), (None, "1 2 3", None, None, None), (some[11][0], "words of another text under an id that is taken", "en", None, None)]
    folder = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame(rows, docs.schema).repartition(3)
    frame.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def clashing(docs):
    return docs.withColumns({"score": F.lit("s"), "predicted": F.lit("p"), "lang_pred": F.lit("l"), "_id": F.lit(1), "_text": F.lit(2), "node": F.lit(3), "_print_of_text": F.lit(4), "dotted.name": F.lit(5)})


def key(row):
    return repr((row.doc_id, row.text))


def kept_languages(docs):
    model = langid.train(docs, F.lit(True))
    said = {r.text: plain_language(model, r.text) for r in docs.select("text").distinct().collect()}
    return sorted(key(r) for r in docs.collect() if said[r.text][0] != "und" and said[r.text][1] >= model.least(corpus_pipeline.MARGIN))


def kept_clean(docs, labels):
    model = toxicity.train(docs, labels, F.lit(True))
    return sorted(key(r) for r in docs.collect() if plain_toxicity(model, r.text) < 0.5)


def kept_once(docs):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    roots = components([shingles_of(r.text) for r in rows])
    return sorted(key(rows[i]) for i in sorted(set(roots)))


def keys(frame):
    return sorted(map(key, frame.collect()))


def test_each_stage_and_all_of_them(spark, fixture):
    labels = spark.read.parquet(f"{fixture}/labels.parquet")
    docs = spark.read.parquet(f"{fixture}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "toxicity", "near_duplicates", "packing"]

    first = durable(stages["language"](spark, docs, fixture))
    assert first.columns == columns and keys(first) == kept_languages(docs)
    assert not any(r.text is None or not any(map(str.isalpha, r.text)) for r in first.collect())

    second = durable(stages["toxicity"](spark, first, fixture))
    assert second.columns == columns and keys(second) == kept_clean(first, labels)
    assert 0 < first.count() - second.count() < 40

    third = durable(stages["near_duplicates"](spark, second, fixture))
    assert third.columns == columns and keys(third) == kept_once(second)
    assert third.count() < second.count()

    def sound(pieces, kept):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(JSON)
        ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in kept.where("doc_id is not null").collect()}
        rows = pieces.where("doc_id is not null").collect()
        assert {r.doc_id for r in rows} == set(ids)
        return packed_rows_are_sound(pieces.collect(), ids | {None: next(([*library.encode(r.text, add_special_tokens=False).ids, 0] for r in kept.where("doc_id is null").collect()), [0])})

    whole = third.groupBy("doc_id").count().where("count > 1").count() == 0
    last = stages["packing"](spark, third, fixture)
    assert not whole or sound(last, third) == 0
    run = corpus_pipeline.run(spark, fixture)
    assert run.columns == last.columns
    name = ["doc_id", "start", "length", "ids_crc32"]
    assert run.groupBy("doc_id").agg(F.sum("length")).count() == last.groupBy("doc_id").agg(F.sum("length")).count()
    assert sorted(map(repr, run.groupBy(name[0]).agg(F.sum("length"), F.max("doc_tokens")).collect())) == sorted(map(repr, last.groupBy(name[0]).agg(F.sum("length"), F.max("doc_tokens")).collect()))


def test_stages_with_clashing_names_and_on_empty_tables(spark, fixture):
    docs = spark.read.parquet(f"{fixture}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), fixture)
        assert empty.count() == 0
        if name != "packing":
            assert empty.columns == docs.columns
            odd = clashing(docs)
            got = stage(spark, odd, fixture)
            assert got.columns == odd.columns and keys(got) == keys(stage(spark, docs, fixture))
            assert {r["dotted.name"] for r in got.collect()} == {5}
