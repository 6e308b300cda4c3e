"""Table scans by directory, and the shared folder for tables that cut a plan's lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Session setting: into how many partitions scans for work on whole texts are dealt out. Unset, a scan keeps its splits.
TEXT_PARTITIONS = "longspan.textPartitions"
#: Tables that a session has written to the shared folder.
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan ``{sf_dir}/{name}.parquet``; naming columns prunes the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out over as many partitions as the session's ``longspan.textPartitions`` says; unchanged where it says nothing.

    For stages of much work a row over files of few row groups. The setting is the caller's: no plan changes by the size of its input.
    """
    n = scan.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return scan.repartition(int(n)) if n else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir`` of the session. A local session has its own scratch folder instead; a cluster without one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("no shared folder: set spark.checkpoint.dir to one that every executor sees")
    return "file://" + spark.conf.get("spark.local.dir", "/tmp").split(",")[0].rstrip("/") + "/longspan-shared"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage and fixes the rows: a lost executor costs no recomputation of what lies before, and a
    result that is used several times is computed once. The table goes when the session's process ends, or with ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep_until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """The file system deletes the folder when the driver's process ends."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)


def release(spark: SparkSession) -> int:
    """Deletes all that this session has written to the shared folder, for sessions that run many queries; tells how many tables there were. Results that read them must be kept elsewhere by then."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    return len(paths)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most so many rows, for stages that turn each row into many Python objects; an empty batch passes as it is."""
    for b in batches:
        for lo in range(0, max(b.num_rows, 1), rows):
            yield b.slice(lo, rows)
