"""Dataset manifests and experiment registries as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "id string, dataset_type string, path_or_value string, label string, split string, source string, "
    "ground_truth_source string, metadata map<string,string>"
)
MANIFEST = f"name string, version string, created_at string, notes string, records array<struct<{RECORD.replace(' string', ':string').replace('metadata map', 'metadata:map')}>>"
FUSION_KEYS = ["document_result", "phishing_result", "upi_result"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with the manifest's name and version; the schema is explicit, nothing is inferred."""
    doc = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return doc.select(F.col("name").alias("manifest"), "version", F.inline("records"))


def write_records(df: DataFrame, path: str) -> None:
    """Records as a Parquet table by split. Large manifests stay tables rather than one JSON document."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def validate_manifest(records: DataFrame, key: str = "id", value: str = "path_or_value") -> DataFrame:
    """Rows (problem, id, n): repeated ids and blank values."""
    dup = records.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(
        F.lit("duplicate_id").alias("problem"), F.col(key).alias("id"), "n")
    blank = records.where(F.coalesce(F.trim(value), F.lit("")) == "").select(
        F.lit("blank_value").alias("problem"), F.col(key).alias("id"), F.lit(1).cast("long").alias("n"))
    return dup.unionByName(blank)


def route(records: DataFrame) -> DataFrame:
    """Append module: fusion when the metadata carries any per-module result, else by dataset type."""
    has_results = F.exists(F.map_keys("metadata"), lambda k: k.isin(FUSION_KEYS))
    kind = (
        F.when(F.coalesce(has_results, F.lit(False)), "fusion").when(F.col("dataset_type") == "URL", "url")
        .when(F.col("dataset_type") == "DOCUMENT", "document").when(F.col("dataset_type") == "UPI_SCREENSHOT", "upi")
        .otherwise("fusion")
    )
    return records.withColumn("module", kind)


def registry_checks(experiments: DataFrame, key: str = "experiment_id", path: str = "manifest_path") -> DataFrame:
    """Per module: experiments, rows that share an id with another row, blank paths.

    Ids are aggregated before the join, so a heavily repeated id is one row on the right side.
    """
    repeated = experiments.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    joined = experiments.join(repeated, key, "left")
    return joined.groupBy("module").agg(
        F.count("*").alias("experiments"), F.count_if(F.col("_n").isNotNull()).alias("duplicate_ids"),
        F.count_if(F.coalesce(F.trim(path), F.lit("")) == "").alias("blank_paths"))
