"""The registered query of each operator of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, decontaminate, langid, linkgraph, packing, quality, simhash, stamps, toolcalls, topk, toxicity
from .shared import remainder, table


#: (host, path prefix, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file, the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(df: DataFrame, of: int, at: int) -> DataFrame:
    """`held_out` after the id; an id that is null is not held out (and never learned from)."""
    rest = [c for c in df.columns if c != "doc_id"]
    return df.select("doc_id", F.coalesce(remainder("doc_id", of) == at, F.lit(False)).alias("held_out"), *rest)


def op1_toxicity_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return _held_out(toxicity.score(docs, model), 5, 0)


def op3_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_langid_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _held_out(langid.identify(docs, langid.train(docs, remainder("doc_id", 4) != 2)), 4, 2)


def op5_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return _held_out(quality.score(docs, model), 3, 1)


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.format_conversations(table(spark, sf_dir, "conversations"))


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents")).withColumnRenamed("fp", "fingerprint")


def op11_stamp_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps.normalise(table(spark, sf_dir, "stamps")).select("stamp_id", "utc_us", "rule", "ambiguous")


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op13_filter_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity_convnet,
        op2_vector_packing,
        op3_multiprobe_ann,
        op4_langid_convnet,
        op5_link_graph,
        op6_quality_compression,
        op7_exact_topk,
        op8_byte_bpe,
        op9_tool_calls,
        op10_simhash_golay,
        op11_stamp_automaton,
        op12_winnowing,
        op13_filter_lattice,
    )
}

ORACLES: dict[str, str] = {
    "op5_link_graph": linkgraph.oracle(URL_RULES),
    "op9_tool_calls": toolcalls.ORACLE,
    "op11_stamp_automaton": stamps.ORACLE,
    "op12_winnowing": decontaminate.ORACLE,
    "op13_filter_lattice": audit.ORACLE,
    "op7_exact_topk": """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as w
    from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id,
           cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) as bigint) as score
    from v q join v c on c.vec_id <> q.vec_id and len(c.w) = len(q.w)
    where q.vec_id % 100 = 0
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) t
where rank <= 10
""",
}
