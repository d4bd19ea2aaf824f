"""Event streams: tolerant ingest of JSON lines and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def windowed_counts(events: DataFrame, at: str, kind: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    counted = events.withWatermark(at, late).groupBy(F.window(at, every), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), kind, "n")
