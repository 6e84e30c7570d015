"""Page scoring of documents as their files arrive: an extension, the batch operators run unchanged on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text as T
from ..operators import pages
from ..sources.providers import PageSource, decoded


def arriving(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of files as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def text_scores(stream: DataFrame, source: PageSource) -> DataFrame:
    """Stateless scores of arriving pages: what depends on the text and the position alone."""
    rows = decoded(stream, source)
    text = T.text_or_empty(F.col("text"))
    heading = pages.heading_pattern(text)
    dense = F.coalesce(F.try_divide(pages.keyword_count(text).cast("double"), T.word_count(text).cast("double")) * 100 >= 2, F.lit(False))
    points = F.when(heading.isNotNull(), 3).otherwise(0) + F.when(dense, 2).otherwise(0) + pages.in_position(F.col("page_number"), F.col("total_pages")).cast("int")
    return rows.select("doc", "page_number", heading.alias("heading"), points.alias("score"))


def into(scores: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    return scores.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
