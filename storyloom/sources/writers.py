"""Writers of the narrative, the consolidation log and the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.operators.evaluate import metrics_table

# The fields of the log's CSV form, which leaves the input text out.
LOG_FIELDS = ("event_id", "description", "day", "num_sources", "source_docs", "method", "input_chars", "output_chars", "consolidated_text")


def write_text(df: DataFrame, path: str, column: str = "narrative") -> None:
    """One file: for narratives, which are single rows."""
    df.select(column).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_log_csv(log: DataFrame, path: str) -> None:
    log.select(*LOG_FIELDS).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_metrics(spark: SparkSession, values: dict[str, object], path: str) -> DataFrame:
    """Writes the table Metric, Measure, Value as CSV and returns it."""
    rows = spark.createDataFrame(metrics_table(values), "Metric string, Measure string, Value string")
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    return rows
