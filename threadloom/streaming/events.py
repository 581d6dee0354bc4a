"""Structured Streaming variants: append-only logs, daily counters, high-water marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 1000) -> DataFrame:
    """A folder of files as a stream; new files only, by the query's checkpoint."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)


def append_log(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Append what is there to ``path``, once for each file, and stop."""
    return stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def daily_counts(stream: DataFrame, late: str = "3 days") -> DataFrame:
    """Questions of each user and day; a day closes ``late`` after its end."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "user_id", "n")


def upsert_counts(stream: DataFrame, path: str, checkpoint: str):
    """Daily counts by key, one folder a day: each batch brings the counts that it changed, and only the days of those are written
    anew, with the other users of the day as they were. Days that closed keep no state. Runs once over what is there."""

    def write(batch: DataFrame, number: int) -> None:
        from threadloom.sources.tables import _exists, upsert
        from threadloom.storage import written

        spark = batch.sparkSession
        changed = written(batch, "daily-counts")
        days = [x["day"] for x in changed.select("day").distinct().collect()]  # at most the days that are open
        if not days:
            return
        if _exists(spark, path):
            old = spark.read.parquet(path).select(F.to_date("day").alias("day"), "user_id", "n").where(F.col("day").isin(days))
            changed = written(upsert(old, changed, ["day", "user_id"]), "daily-counts")
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return daily_counts(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
