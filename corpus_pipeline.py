"""A training corpus from raw documents: language ID, toxicity, near-duplicates, packing.

Each stage takes all that its predecessor kept and returns the columns of documents, but for the last, which returns the
pieces of packed sequences. Stages learn only from the documents they are given and the labels beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe.llm import langid, packing, simhash, toxicity
from leadframe.llm.queries import tokenizer
from leadframe.llm.shared import durable, table

#: A document is in some learned language if its best mean probability is this part of the way from a blind guess to 1.
MARGIN = 0.1


#: Rows in an Arrow batch. Documents are wide; both sides of the pipe to Python hold a batch or two for each task.
ARROW_ROWS = 2048


def _session(spark: SparkSession) -> None:
    """The pipeline is an application of its own, so it may set what its session needs; all else is left to the cluster."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _carried(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """`docs` with names that clash with nothing for all but doc_id and text, and those names."""
    names = [c if c in ("doc_id", "text") else f"_carried_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [n for n in names if n not in ("doc_id", "text")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language; those without letters, and those in none, go. `lang` stays as it came.

    Null, empty and letterless texts go. Rows without id or language are judged like any other; only rows with a language
    are learned from. Texts of any length are judged whole; repeated rows are judged each. Other columns are carried, whatever
    their names. No row with a language, as in an empty table, means that nothing is kept; with one language only, every text
    with a letter stays."""
    _session(spark)
    model = langid.train(docs, F.lit(True))
    plain, others = _carried(docs)
    judged = langid.identify(plain, model, carry=others, keep_text=True)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= model.least(MARGIN))).select(*plain.columns).toDF(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic.

    Null and empty texts, and texts without words, are scored by the network's bias, like any other. Rows without id are
    judged and never learned from; repeated rows are judged each. Texts of any length are judged whole. Without labels of
    both kinds everything stays; an empty table gives an empty one. Other columns are carried, whatever their names."""
    _session(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    plain, others = _carried(docs)
    return toxicity.score(plain, model, carry=others, keep_text=True).where("predicted = 0").select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 or more of their 5-word shingles: that with the smallest id.

    Null, empty and white-space texts are copies of each other. Null ids come after all others; of rows with equal ids and
    different texts each counts by itself, and of rows with equal ids and texts any one stays. Texts of any length are
    compared whole. An empty table gives an empty one. Other columns are carried, whatever their names."""
    _session(spark)
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens.

    A null or empty text is one token, the closing one. Repeated rows are packed each; null ids stay null. Texts of any
    length are cut. An empty table gives no pieces. Other columns are left behind."""
    _session(spark)
    return packing.pack_texts(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Trained networks and tokenizers can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
