"""Annotation of a stream of verses.

What a verse tells by itself is a projection, so it runs on a stream as on a table, without state. Counts by time window
take a watermark. Links between verses need the order of a whole document and stay in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyloom.functions import text as tx
from storyloom.functions import timex
from storyloom.operators import annotate


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def annotate_verses(verses: DataFrame) -> DataFrame:
    """verses with polarity, times and signals as arrays: a stateless projection of any stream or table."""
    times = F.concat(*(F.transform(tx.places("text", "(?iU)" + p), lambda s, k=k: F.struct(s["text"].alias("text"), F.lit(k).alias("timex3_type"), timex.normalise(s["text"]).alias("value"))) for p, k in timex.TIMEX_PATTERNS))
    return verses.withColumn("polarity", tx.polarity("text")).withColumn("times", times).withColumn("signals", tx.places("text", "(?iU)" + timex.SIGNAL_PATTERN))


def windowed_counts(events: DataFrame, time_col: str, kind_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start and end, kind, n: counts of a stream by tumbling window; rows later than the watermark are dropped."""
    rows = events.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), kind_col).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col(kind_col).alias("kind"), "n")


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes a stream to Parquet until what is there has been read."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
