"""Readers of verse XML, timetables and texts. Every reader has a fixed schema, so nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text as tx

# The fields of a timetable event, and the columns of its CSV form.
EVENT_FIELDS = ("day", "description", "when_where", "matthew", "mark", "luke", "john")
CSV_COLUMNS = {"Category": "day", "Event": "description", "When and Where": "when_where", "Matthew": "matthew", "Mark": "mark", "Luke": "luke", "John": "john", "Page": "page"}
_CHAPTER = "_number string, verse array<struct<_number: string, _VALUE: array<string>>>"


def read_verses(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """doc_id, verse_idx, chapter, verse, text of each document's file: verses below chapters at any depth.

    A verse without a number has 0; one without text, or of white space alone (which Spark's reader doesn't tell from
    none), is left out; of mixed content the text before the first element counts.
    """
    out = None
    for doc, path in paths.items():
        rows = spark.read.format("xml").option("rowTag", "chapter").option("ignoreSurroundingSpaces", "false").schema(_CHAPTER).load(path)
        rows = rows.withColumn("_at", F.monotonically_increasing_id()).select(F.lit(doc).alias("doc_id"), "_at", F.col("_number").alias("_chapter"), F.posexplode("verse").alias("_pos", "_v"))
        text = F.get(F.col("_v._VALUE"), F.lit(0))
        rows = rows.filter(F.length(text) > 0)
        order = Window.partitionBy("doc_id").orderBy("_at", "_pos")
        number = lambda c: F.coalesce(F.expr(f"try_cast(trim({c}) as int)"), F.lit(0))
        rows = rows.select("doc_id", (F.row_number().over(order) - 1).alias("verse_idx"), number("_chapter").alias("chapter"), number("_v._number").alias("verse"), tx.strip(text).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_timetable_xml(spark: SparkSession, path: str) -> DataFrame:
    """chronology_index, id, and the fields of each event of a timetable, in the order of the file."""
    schema = "_id string, " + ", ".join(f"{f} string" for f in EVENT_FIELDS)
    rows = spark.read.format("xml").option("rowTag", "event").schema(schema).load(path).withColumn("_at", F.monotonically_increasing_id())
    index = F.row_number().over(Window.orderBy("_at")) - 1  # as many rows as the timetable
    return rows.select(index.alias("chronology_index"), F.col("_id").alias("id"), *EVENT_FIELDS)


def read_timetable_csv(spark: SparkSession, path: str) -> DataFrame:
    """chronology_index and the columns of a timetable in CSV form, quotes doubled within quotes, named as in XML."""
    schema = ", ".join(f"`{c}` string" for c in CSV_COLUMNS)
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema=schema).withColumn("_at", F.monotonically_increasing_id())
    index = F.row_number().over(Window.orderBy("_at")) - 1  # as many rows as the timetable
    return rows.select(index.alias("chronology_index"), *(F.col(f"`{c}`").alias(n) for c, n in CSV_COLUMNS.items()))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """text: one row a file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
