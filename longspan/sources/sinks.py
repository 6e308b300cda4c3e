"""Sinks of runs: tables by stage, appended lines, reports, and results read back as they were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.sources.tables import materialise


def write_stage(df: DataFrame, folder: str, stage: str, by: list[str] | None = None) -> DataFrame:
    """Writes a stage's table and reads it back: with ``by`` only the partitions that ``df`` holds are replaced, without it the whole table is."""
    path = f"{folder}/{stage}.parquet"
    w = df.write.mode("overwrite")
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(*by) if by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def upsert(df: DataFrame, folder: str, stage: str, key: list[str]) -> DataFrame:
    """Rows of ``df`` replace those of the stage's table with their key, and further keys are added; of several rows of one key in ``df`` any stands.

    The merged table is written to the shared folder first, since the old one is read for it, and then takes its place.
    """
    new = df.dropDuplicates(key)
    if not stage_exists(df.sparkSession, folder, stage):
        return write_stage(new, folder, stage)
    old = df.sparkSession.read.parquet(f"{folder}/{stage}.parquet")
    kept = old.join(new.select(*key), [old[k].eqNullSafe(new[k]) for k in key], "left_anti")
    return write_stage(materialise(kept.unionByName(new, allowMissingColumns=True), "merged"), folder, stage)


def stage_exists(spark: SparkSession, folder: str, stage: str) -> bool:
    """The table was written whole: it holds the success mark."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{stage}.parquet/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def read_or_compute(spark: SparkSession, folder: str, stage: str, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """A stage's table if it was written whole (it holds the success mark), else computed and written."""
    if not force and stage_exists(spark, folder, stage):
        return spark.read.parquet(f"{folder}/{stage}.parquet")
    return write_stage(compute(), folder, stage)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("append").option("header", header).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report: small, so one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def to_document(df: DataFrame, key: list[str], alias: str = "document") -> DataFrame:
    """Each row as one JSON text beside its key."""
    return df.select(*key, F.to_json(F.struct(*[c for c in df.columns if c not in key])).alias(alias))


def from_document(df: DataFrame, key: list[str], schema: str, column: str = "document") -> DataFrame:
    return df.select(*key, F.from_json(column, schema, {"mode": "FAILFAST"}).alias("_d")).select(*key, "_d.*")
