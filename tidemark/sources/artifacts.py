"""Artifact sink: the documents of a run as JSON, one folder for each run; writing a run again replaces that run alone."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write(rows: DataFrame, path: str, run_col: str = "run_id") -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_col).json(path)


def read(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
