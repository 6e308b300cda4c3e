"""Grading of generations as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from longspan.operators.grade import grade


def read_generations(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def grade_once(stream: DataFrame, watermark: str = "1 hour", event_time: str = "loaded_at") -> DataFrame:
    """Grades each ``gen_id`` once; repeats within the watermark of ``event_time`` are dropped, so the state stays bounded."""
    return grade(stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["gen_id"])).select("gen_id", "exp_name", "ds_name", event_time, "score")


def mean_by_window(graded: DataFrame, size: str = "1 day", event_time: str = "loaded_at") -> DataFrame:
    """Mean score by dataset over tumbling windows of the event time."""
    return graded.groupBy(F.window(event_time, size), "ds_name").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def start(graded: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there and appends to ``out``."""
    return graded.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_updates(windows: DataFrame, out: str, checkpoint: str) -> None:
    """Runs over what is there; each batch appends the windows that it changed, with its number, so the highest number of a window is its last state."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    windows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_state(updates: DataFrame, key: list[str]) -> DataFrame:
    """The latest row of each window."""
    row = F.struct("batch", *[c for c in updates.columns if c not in (*key, "batch")])
    return updates.groupBy(*key).agg(F.max(row).alias("r")).select(*key, "r.*").drop("batch")
