"""Scans of the formats that runs are kept in. Every scan has an explicit schema, and malformed input fails."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "ds_name string, q_index int, input string, context string, answers array<string>"
TARGETS = "q_index int, ds_name string, model_name string, target_sentences array<string>"
ALIGNMENT = (
    "n_tokens int, sentence_quant_indices array<int>, target_sentences array<string>, sentences array<string>, n_sentence int, n_sentence_quant_success int, "
    "success_rate double, ds_name string, q_index int, model_name string, git_hash string, mean_dist double, non_zero_mean_dist double"
)
REQUEST = "q_index int, ds_name string, query string, truth array<string>, prompt string"
RESULT = "elapsed_time double, num_requests int, total_num_tokens int, requests_per_second double, tokens_per_second double, generated array<string>, truth array<array<string>>"
GRADE = "model_name string, ds_name string, q_index int, type string, grader string, scores array<double>, score double"


@dataclass(frozen=True)
class RunConfig:
    """Configuration of a run, a driver-side value."""

    model_name: str = "default"
    model_path: str = ""
    dtype: str = "float32"
    seed: int = 42
    git_hash: str = ""
    chunker: dict = field(default_factory=dict)
    retriever: dict = field(default_factory=dict)
    augmenter: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict) -> RunConfig:
        return cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__})

    @classmethod
    def from_file(cls, path: str) -> RunConfig:
        return cls.from_dict(json.loads(Path(path).read_text()))

    def to_dict(self) -> dict:
        return asdict(self)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2, sort_keys=True))


def git_hash(folder: str = ".") -> str:
    """Commit that a checkout stands at, read from its files; empty outside of one."""
    git = Path(folder) / ".git"
    if not (git / "HEAD").exists():
        return ""
    head = (git / "HEAD").read_text().strip()
    if not head.startswith("ref: "):
        return head
    ref = head[5:]
    if (git / ref).exists():
        return (git / ref).read_text().strip()
    packed = (git / "packed-refs").read_text().splitlines() if (git / "packed-refs").exists() else []
    return next((x.split()[0] for x in packed if x.endswith(" " + ref)), "")


def with_run(df: DataFrame, config: RunConfig) -> DataFrame:
    """Columns that tell the run: model, seed, commit and time."""
    return df.withColumns({"model_name": F.lit(config.model_name), "seed": F.lit(config.seed), "git_hash": F.lit(config.git_hash), "run_at": F.current_timestamp()})


def spark_type(dtype: str) -> str:
    """Spark's name of a numeric type; half types become float."""
    known = {"float16": "float", "bfloat16": "float", "float32": "float", "float64": "double", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint"}
    if dtype not in known:
        raise ValueError(f"no type named {dtype!r}")
    return known[dtype]


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file (``.json``) or JSON lines (``.jsonl``); other endings are refused."""
    if not path.rstrip("/").endswith((".json", ".jsonl")):
        raise ValueError(f"neither .json nor .jsonl: {path}")
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", path.endswith(".json")).json(path)


def read_corpus(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Union of one file for each dataset; the index is that of the rows' own column."""
    out = None
    for name, path in sorted(paths.items()):
        one = (spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_json(spark, path, CORPUS)).withColumn("ds_name", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no datasets")
    return out


def read_dictionary(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A small JSON object as a two-column dimension table."""
    d = json.loads(Path(path).read_text())
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(d.items())], f"`{key}` string, `{value}` string")


def read_results(spark: SparkSession, glob: str) -> DataFrame:
    """Result files ``MODEL/TYPE/DATASET.json``, one row an answer: parallel arrays are zipped by position."""
    raw = spark.read.schema(RESULT).option("multiLine", True).option("mode", "FAILFAST").json(glob).withColumn("_f", F.input_file_name())
    part = F.split("_f", "/")
    named = raw.select(F.element_at(part, -3).alias("model_name"), F.element_at(part, -2).alias("type"), F.regexp_replace(F.element_at(part, -1), r"\.json$", "").alias("ds_name"), F.arrays_zip("generated", "truth").alias("z"))
    return named.select("model_name", "type", "ds_name", F.posexplode("z").alias("q_index", "r")).select("model_name", "type", "ds_name", "q_index", "r.generated", "r.truth")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Files ``DATASET.json``, each an object of question index to a list of evidence strings."""
    raw = spark.read.option("wholetext", True).text(folder).withColumn("_f", F.input_file_name())
    entries = F.explode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("e")
    return raw.select(F.regexp_extract("_f", r"([^/]+)\.json$", 1).alias("ds_name"), entries).select("ds_name", F.col("e.key").cast("int").alias("q_index"), F.col("e.value").alias("evidence"))
