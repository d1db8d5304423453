"""Reports as a stream: extraction keeps no state, so files are taken up as they come and results are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import pipeline

SCHEMA = "report_id string, text string"


def incoming(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def fields(reports: DataFrame, method: str = "evidence_first") -> DataFrame:
    """Fields of the reports of a stream, without the text."""
    return pipeline.fields(reports, method).select("report_id", "method", "variable_name", "extracted_value", "documentation_status", "evidence", "alternatives", "notes")


def appended(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of fields or audit records to a folder; a restart goes on after the last full batch."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(stream: DataFrame, event_time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Fields by status in event-time windows; later rows than the watermark allows are left out of closed windows."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, window), "documentation_status").count()
