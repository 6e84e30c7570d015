"""Summaries of runs that can be merged: what a run leaves behind is small, and totals over many runs never read the runs again.

A run's rows (status, item, cost) become partial states, in two tables below a folder:

* `states`, a row for each status: the number of rows, least and greatest cost, a sketch of the quantiles of costs, and a
  sketch of distinct items;
* `bits`, for items with whole numbers: a bitmap of 32,768 items in each row, by status, from which distinct items are counted
  exactly, however many runs saw them.

States are kept by run: a run that is summarised again replaces its own. Counts, extremes and bitmaps merge exactly; the sketch of
distinct items is off by 1.6 % (one standard deviation, at 2**12 buckets), that of quantiles by 1.33 % of the rank (at k = 200,
with a confidence of 99 %), whatever the number of rows and of merges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = "status string, n bigint, low double, high double, items binary, costs binary, run string"
BITS = "status string, bucket bigint, bits binary, run string"
#: Sizes of the sketches.
BUCKETS, QUANTILES = 12, 200


class Summaries:
    """The summaries below `folder`, which all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, rows: DataFrame, run: str = "run") -> None:
        """Summarise `rows` (run, status, item, cost), of one run or many, and keep what they come to by run.

        Null statuses are a status of their own; null items and costs count as rows only, and a cost that is not a number as none.
        Rows that repeat count each. A run without a name is named by the empty text. No rows change nothing."""
        cost = F.col("cost").cast("double")
        named = rows.select(F.coalesce(F.col(run).cast("string"), F.lit("")).alias("run"), "status", F.col("item").cast("bigint").alias("item"), F.when(~F.isnan(cost), cost).alias("cost"))
        states = named.groupBy("run", "status").agg(
            F.count("*").alias("n"),
            F.min("cost").alias("low"),
            F.max("cost").alias("high"),
            F.hll_sketch_agg("item", F.lit(BUCKETS)).alias("items"),
            F.kll_sketch_agg_double("cost", F.lit(QUANTILES)).alias("costs"),
        )
        # Null items have an empty bitmap, so each run writes its part and leaves nothing of an earlier summary.
        bits = named.groupBy("run", "status", F.bitmap_bucket_number("item").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("item")).alias("bits"))
        # Bitmaps first: a run counts once its state is there.
        for frame, name, schema in ((bits, "bits", BITS), (states, "states", STATES)):
            columns = [c.split()[0] for c in schema.split(", ")]
            frame.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{self.folder}/{name}")

    def _read(self, name: str, schema: str, runs: list[str] | None) -> DataFrame:
        self.spark.createDataFrame([], schema).write.mode("ignore").partitionBy("run").parquet(f"{self.folder}/{name}")  # so that there is a table
        kept = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        named = kept.withColumn("run", F.coalesce("run", F.lit("")))
        return named if runs is None else named.where(F.col("run").isin(runs))

    def states(self, runs: list[str] | None = None) -> DataFrame:
        return self._read("states", STATES, runs)

    def bits(self, runs: list[str] | None = None) -> DataFrame:
        """Only of runs whose state is there."""
        return self._read("bits", BITS, runs).join(self.states(runs).select("run").distinct(), "run", "left_semi")

    def totals(self, runs: list[str] | None = None) -> DataFrame:
        """(status, n_runs, n, low, high, n_items, n_items_sketched, median): all runs together, or those that are named."""
        merged = self.states(runs).groupBy("status").agg(
            F.count("*").alias("n_runs"),
            F.sum("n").alias("n"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.hll_sketch_estimate(F.hll_union_agg("items")).alias("n_items_sketched"),
            F.kll_merge_agg_double("costs", F.lit(QUANTILES)).alias("costs"),
        )
        united = self.bits(runs).groupBy("status", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        exact = united.groupBy(F.col("status").alias("_status")).agg(F.sum(F.bitmap_count("bits")).alias("n_items"))
        joined = merged.join(exact, merged["status"].eqNullSafe(exact["_status"]), "left")
        some = F.kll_sketch_get_n_double("costs") > 0
        return joined.select("status", "n_runs", "n", "low", "high", F.coalesce("n_items", F.lit(0)).alias("n_items"), "n_items_sketched", F.when(some, F.kll_sketch_get_quantile_double("costs", F.lit(0.5))).alias("median"))
