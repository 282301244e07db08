"""Arriving sorts: per-statement running sums with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SORT_EVENTS = "study_id string, participant string, p_idx int, stmt_num int, value double, ts timestamp"


def sort_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SORT_EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def statement_sums(stream: DataFrame, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """Per study, statement and period of arrival: count, mean, and counts above and below zero.

    A cell that arrives again within ``late`` counts once; state older than that is dropped.
    """
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["study_id", "participant", "stmt_num"])
    return once.groupBy("study_id", "stmt_num", F.window("ts", every)).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.count_if(F.col("value") > 0).alias("n_above"), F.count_if(F.col("value") < 0).alias("n_below"))


def upsert_sorts(stream: DataFrame, target: str, checkpoint: str):
    """Appends each micro-batch once: a batch is a folder named by its number, so a retry overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
