"""Sinks and lookups: event store, training tables, experiments, metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_events(events: DataFrame, path: str) -> None:
    """Append events to a Parquet table partitioned by day, so that timelines read only their days."""
    events.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").option(
        "parquet.bloom.filter.enabled#doc_id", "true").parquet(path)


def read_events(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def find_by_document(events: DataFrame, doc_id: str) -> DataFrame:
    """Events of a document; the filter reaches the scan, where each file's bloom filter on doc_id drops row groups."""
    return events.where(F.col("doc_id") == doc_id)


def write_training_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def append_experiment(rollup: DataFrame, path: str, run_id: str) -> None:
    """One row per module and run, as JSON lines."""
    rollup.withColumn("run_id", F.lit(run_id)).write.mode("append").json(path)


def write_metrics(long_metrics: DataFrame, path: str) -> None:
    long_metrics.write.mode("overwrite").option("header", True).csv(path)
