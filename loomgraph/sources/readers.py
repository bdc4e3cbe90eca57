"""Sources, each with an explicit schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from loomgraph.schema import CLAIM, ENTITY, EXTRACTION, FUZZY, MAIL_RAW, MIN_CONFIDENCE


@dataclass(frozen=True)
class Config:
    """Settings of a run; ``from_env`` reads LOOM_* variables."""

    min_confidence: float = MIN_CONFIDENCE
    fuzzy_threshold: float = FUZZY
    max_retries: int = 3
    workers: dict = field(default_factory=lambda: {"remote": 10, "local": 1})

    @classmethod
    def from_env(cls, env: dict) -> Config:
        return cls(float(env.get("LOOM_MIN_CONFIDENCE", MIN_CONFIDENCE)), float(env.get("LOOM_FUZZY", FUZZY)), int(env.get("LOOM_RETRIES", 3)))


def mail_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Quoted multi-line CSV of (file, message); ``limit`` is the first rows, for trials."""
    df = spark.read.schema(MAIL_RAW).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df if limit is None else df.limit(limit)


def mail_count(spark: SparkSession, path: str) -> int:
    """Rows, reading one column."""
    return mail_csv(spark, path).select("file").count()


def extractions(spark: SparkSession, folder: str) -> DataFrame:
    """JSON documents of a folder, other files left out; ``ordinal`` orders them by file name."""
    df = spark.read.schema(EXTRACTION).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return df.withColumn("ordinal", F.col("_metadata.file_name"))


def flatten_extractions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, raw claims), each child with its parent and place."""
    m = docs.select("artifact_id", F.posexplode("entities").alias("pos", "e")).select("artifact_id", "pos", "e.*")
    c = docs.select("artifact_id", "date", F.posexplode("claims").alias("pos", "c")).select("artifact_id", "date", "pos", "c.*")
    return m, c


GRAPH = StructType([StructField("schema_version", StringType()), StructField("dedup_version", StringType()), StructField("created_at", StringType()), StructField("entities", ArrayType(ENTITY)), StructField("claims", ArrayType(CLAIM))])


def graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, claims) of one graph document."""
    doc = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    return doc.select(F.inline("entities")), doc.select(F.inline("claims"))


def resolved_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, claims, document) as ``writers.graph_document`` stores them."""
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/claims"), spark.read.json(f"{path}/document")


CHECKPOINT = StructType([StructField(n, ArrayType(StringType())) for n in ("processed_ids", "failed_ids")] + [StructField("version", StringType())])


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(message_id, status) of a checkpoint document, or of its ``.bak`` where it is broken; nothing where there is none. Missing keys are empty."""
    for place in (path, f"{path}.bak"):
        try:
            doc = spark.read.schema(CHECKPOINT).option("multiLine", True).option("mode", "FAILFAST").json(place)
            ids = lambda c, s: doc.select(F.explode(c).alias("message_id"), F.lit(s).alias("status"))
            out = ids("processed_ids", "processed").unionByName(ids("failed_ids", "failed"))
            out.isEmpty()
            return out
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) and place == path:
                break
            if not any(k in str(e) for k in ("PATH_NOT_FOUND", "MALFORMED_RECORD", "FAILED_READ_FILE")):
                raise
    return spark.createDataFrame([], "message_id string, status string")


def cached(spark: SparkSession, path: str, compute) -> DataFrame:
    """A stored table, or ``compute()`` where there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return compute()
