"""Readers, writers and streams over small files of invented text."""

import sys

import pytest
from pyspark.sql import functions as F

from storyloom.operators import evaluate
from storyloom.sources import readers, writers
from storyloom.streaming import annotate as stream

VERSES = """<bible><testament><book name="X"><chapter number="1"><verse number="1"> One &amp; two </verse><verse number="2"></verse><verse>head <i>mid</i> tail</verse><verse number="4">   </verse></chapter>
<part><chapter number="2"><verse number="1">Three</verse></chapter></part></book></testament></bible>"""
EVENTS = """<table><event id="7"><day>Monday</day><description>First</description><matthew>1:1</matthew></event>
<group><event id="8"><description>Second "quoted"</description><luke>2:1-3</luke></event></group></table>"""
CSV = '''"Category","Event","When and Where","Matthew","Mark","Luke","John","Page"
"Monday","He said ""go""","there","1:1","","2:1a","","5"
"Tuesday","Two
lines","","","1:2","","","6"'''


def test_verses(spark, tmp_path):
    (tmp_path / "x.xml").write_text(VERSES)
    rows = readers.read_verses(spark, {"x": f"file://{tmp_path}/x.xml", "y": f"file://{tmp_path}/x.xml"}).collect()
    got = sorted((r.verse_idx, r.chapter, r.verse, r.text) for r in rows if r.doc_id == "x")
    assert got == [(0, 1, 1, "One & two"), (1, 1, 0, "head"), (2, 2, 1, "Three")] and len(rows) == 6


def test_timetables(spark, tmp_path):
    (tmp_path / "t.xml").write_text(EVENTS)
    rows = readers.read_timetable_xml(spark, f"file://{tmp_path}/t.xml").orderBy("chronology_index").collect()
    assert [(r.chronology_index, r.id, r.day, r.description, r.matthew, r.luke) for r in rows] == [(0, "7", "Monday", "First", "1:1", None), (1, "8", None, 'Second "quoted"', None, "2:1-3")]
    (tmp_path / "t.csv").write_text(CSV)
    rows = readers.read_timetable_csv(spark, f"file://{tmp_path}/t.csv").orderBy("chronology_index").collect()
    assert [(r.day, r.description, r.mark, r.luke, r.page) for r in rows] == [("Monday", 'He said "go"', None, "2:1a", "5"), ("Tuesday", "Two\nlines", "1:2", None, "6")]


def test_text_and_json(spark, tmp_path):
    df = spark.createDataFrame([("A story.",)], "narrative string")
    writers.write_text(df, f"file://{tmp_path}/n")
    assert readers.read_text(spark, f"file://{tmp_path}/n").first().text == "A story.\n"
    rows = spark.createDataFrame([("a", None, 2)], "x string, y string, n int")
    writers.write_json(rows, f"file://{tmp_path}/j")
    assert spark.read.schema(rows.schema).json(f"file://{tmp_path}/j").collect() == rows.collect()


def test_log_csv_leaves_the_input_out(spark, tmp_path):
    log = spark.createDataFrame([("m0", 'd "q"', "Monday", 2, "a, b", "PRIMERA", 9, 4, "in", "out, put")], "event_id string, description string, day string, num_sources int, source_docs string, method string, input_chars int, output_chars int, input_text string, consolidated_text string")
    writers.write_log_csv(log, f"file://{tmp_path}/l")
    back = spark.read.csv(f"file://{tmp_path}/l", header=True, quote='"', escape='"')
    assert back.columns == list(writers.LOG_FIELDS) and back.first().description == 'd "q"' and back.first().consolidated_text == "out, put"


def test_metrics(spark, tmp_path):
    rows = evaluate.metrics_table({"rouge1_f1": 0.123456, "kendalls_tau_n": 7, "adjacent_pair_correct": 3, "adjacent_pair_total": 4})
    assert len(rows) == 20 and ("ROUGE-1", "F1", "0.1235") in rows and ("Kendall's Tau", "N events", "7") in rows and ("Adj. Pair Accuracy", "Correct / Total", "3/4") in rows and ("METEOR", "Score", "") in rows
    assert writers.write_metrics(spark, {"meteor": 0.5}, f"file://{tmp_path}/m").filter("Metric = 'METEOR'").first().Value == "0.5000"


def test_streams_give_what_tables_give(spark, tmp_path):
    rows = [("d", i, t) for i, t in enumerate(["After three days he did not go.", "Then, at noon, they came."])]
    table = spark.createDataFrame(rows, "doc_id string, verse_idx int, text string")
    table.repartition(2).write.parquet(f"file://{tmp_path}/in")
    live = stream.annotate_verses(stream.read_stream(spark, f"file://{tmp_path}/in", "doc_id string, verse_idx int, text string", 1))
    stream.write_stream(live, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("verse_idx").collect()
    assert got == stream.annotate_verses(table).orderBy("verse_idx").collect()
    assert got[0].polarity == "NEG" and got[0].times[0].value == "P3D" and [s.text for s in got[1].signals] == ["Then"]


def test_windows_drop_what_is_late(spark, tmp_path):
    schema = "ts timestamp, kind string"
    for n, rows in enumerate([["2024-01-01 00:10:00", "2024-01-01 00:20:00"], ["2024-01-01 05:00:00"], ["2024-01-01 00:30:00", "2024-01-01 05:30:00"], ["2024-01-01 09:00:00"]]):
        spark.createDataFrame([(t, "a") for t in rows], "t string, kind string").select(F.to_timestamp("t").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/n={n}")
        live = stream.windowed_counts(stream.read_stream(spark, f"file://{tmp_path}/in/*", schema, 1), "ts", "kind")
        stream.write_stream(live, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    got = {(str(r.start), r.n) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {("2024-01-01 00:00:00", 2), ("2024-01-01 05:00:00", 2)}


def test_the_entry_module_without_what_training_text_needs(monkeypatch):
    import __spark_entry__ as entry
    from storyloom.plans import oracle, registry

    monkeypatch.setitem(sys.modules, "storyloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", ["entry", "queries", "oracle_sql"])
def test_the_entry_module(name):
    import __spark_entry__ as entry

    if name == "queries":
        assert set(entry.oracle_sql()) <= set(entry.queries())
    else:
        assert callable(getattr(entry, name))
