"""Consolidation: a timetable of references joined with the verses they cover, one macro-event a row.

References become ranges within chapters, ranges become verses by `sequence`, and verses are found by an equi-join on
(document, chapter, verse): no join on inequalities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import refs
from storyloom.functions import text as tx

SEPARATOR = f" {tx.DOC_SEP} "
# The types an edge may have, in order of their numbers.
EDGE_TYPES = ("INTRA_BEFORE", "INTRA_AFTER", "INTRA_INCLUDES", "SAME_EVENT", "INTER_BEFORE", "INTER_AFTER", "INTER_SIMULTANEOUS", "CONFLICT_DETAIL", "BEFORE")


def verse_texts(verses: DataFrame) -> DataFrame:
    """doc_id, chapter, verse, text: of verses with the same number the last; without number or text none."""
    rows = verses.filter((F.col("chapter") != 0) & (F.col("verse") != 0)).withColumn("text", tx.strip("text")).filter("text <> ''")
    return rows.groupBy("doc_id", "chapter", "verse").agg(F.max_by("text", "verse_idx").alias("text"))


def unpivot_references(timetable: DataFrame, documents: list[str]) -> DataFrame:
    """chronology_index, doc_id, doc_ord, ref: the non-blank references of a timetable with a column for each document."""
    cells = F.array(*(F.struct(F.lit(d).alias("doc_id"), F.lit(i).alias("doc_ord"), F.col(d).alias("ref")) for i, d in enumerate(documents)))
    rows = timetable.select("chronology_index", F.explode(cells).alias("c")).select("chronology_index", "c.*")
    return rows.filter(F.length(tx.strip("ref")) > 0)


def reference_ranges(references: DataFrame) -> DataFrame:
    """references with the parsed reference (p) and a row for each (part, chapter, v_start, v_end) that it covers."""
    rows = references.withColumn("p", refs.parse_ref(F.col("ref"))).filter("p is not null")
    rows = rows.select("*", F.posexplode(refs.expand_ref(F.col("p"))).alias("range_no", "r"))
    return rows.select(*references.columns, "p", "range_no", "r.chapter", "r.v_start", "r.v_end")


def covered_verses(references: DataFrame, events: DataFrame) -> DataFrame:
    """references, p, range_no, chapter, verse: each verse covered; an open end goes to the chapter's last event."""
    last = events.filter("chapter <> 0 and verse <> 0").groupBy("doc_id", "chapter").agg(F.max("verse").alias("_last"))
    rows = reference_ranges(references).join(last, ["doc_id", "chapter"], "left")
    end = F.when(F.col("v_end") == refs.OPEN_END, F.coalesce("_last", "v_start")).otherwise(F.col("v_end"))
    rows = rows.withColumn("_end", end).filter("v_start <= _end")
    return rows.withColumn("verse", F.explode(F.sequence("v_start", "_end"))).select(*references.columns, "p", "range_no", "chapter", "verse")


def _part(text: Column) -> Column:
    """The text of a verse after the reference's parts: a or b at its start, its end, or of its only verse."""
    p, at = F.col("p"), lambda c, v: (F.col("chapter") == F.col("p")[c]) & (F.col("verse") == F.col("p")[v])
    alone = (p["sc"] == p["ec"]) & (p["sv"] == p["ev"])
    either = F.coalesce(p["sp"], p["ep"])
    head = F.when(at("sc", "sv"), tx.slice_part(text, p["sp"])).otherwise(text)
    both = F.when(at("ec", "ev"), tx.slice_part(head, p["ep"])).otherwise(head)
    return F.when(alone & either.isNotNull(), tx.slice_part(text, either)).otherwise(both)


def accounts(references: DataFrame, events: DataFrame, texts: DataFrame) -> DataFrame:
    """chronology_index, doc_id, doc_ord, text, event_ids: what each document tells for each row, in order of verses."""
    rows = covered_verses(references, events)
    told = rows.join(texts, ["doc_id", "chapter", "verse"]).withColumn("t", tx.strip(_part(F.col("text")))).filter("t <> ''")
    keys = ["chronology_index", "doc_id", "doc_ord"]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "verse", "t"))), lambda s: s["t"]), " ")
    told = told.groupBy(*keys).agg(joined.alias("text"))
    had = rows.join(events.select("doc_id", "chapter", "verse", "id", "seq"), ["doc_id", "chapter", "verse"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("range_no", "verse", "seq", "id"))), lambda s: s["id"])
    had = had.groupBy(*keys).agg(ids.alias("event_ids"))
    none = F.expr("cast(array() as array<string>)")
    return told.join(had, keys, "full").select(*keys, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("event_ids", none).alias("event_ids"))


def macro_events(timetable: DataFrame, documents: list[str], events: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each row of the timetable that some document tells: its accounts joined by the separator.

    timetable: chronology_index, description, day, a column for each document. A row's longest account names chosen_doc, of
    equal ones the first document's.
    """
    told = accounts(unpivot_references(timetable, documents), events, texts)
    one = F.array_sort(F.collect_list(F.struct("doc_ord", "doc_id", "text", "event_ids")))  # a document once a row
    rows = told.groupBy("chronology_index").agg(one.alias("a"))
    rows = rows.withColumn("has", F.filter("a", lambda x: x["text"] != "")).filter(F.size("has") > 0)
    longest = F.array_max(F.transform("has", lambda x: F.struct(F.length(x["text"]).alias("n"), (-x["doc_ord"]).alias("o"), x["doc_id"].alias("d"))))
    rows = rows.join(timetable.select("chronology_index", "description", "day"), "chronology_index")
    return rows.select(
        F.concat(F.lit("macro_"), F.col("chronology_index").cast("string")).alias("id"), F.array_join(F.transform("has", lambda x: x["text"]), SEPARATOR).alias("text"), "description",
        F.flatten(F.transform("a", lambda x: x["event_ids"])).alias("original_events"), "chronology_index", F.size("has").alias("num_source_texts"),
        F.transform("has", lambda x: x["doc_id"]).alias("source_docs"), longest["d"].alias("chosen_doc"), "day",
    )


def chain_edges(macro: DataFrame) -> DataFrame:
    """src, dst, etype: each macro-event before the next one there is."""
    rows = macro.select(F.col("id").alias("src"), F.lead("id").over(Window.orderBy("chronology_index")).alias("dst"))  # as many rows as the timetable
    return rows.filter("dst is not null").withColumn("etype", F.lit("BEFORE"))


def detail_edges(tlinks: DataFrame, alignments: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """src, dst, etype between events: links within documents, aligned events, contradictions."""
    inner = {"BEFORE": "INTRA_BEFORE", "AFTER": "INTRA_AFTER", "INCLUDES": "INTRA_INCLUDES"}
    table = F.create_map(*(F.lit(x) for p in inner.items() for x in p))
    links = tlinks.filter("related_to_event is not null").select(F.col("event_id").alias("src"), F.col("related_to_event").alias("dst"), F.element_at(table, F.col("rel_type")).alias("etype"))
    same = alignments.select(F.col("ev_a").alias("src"), F.col("ev_b").alias("dst"), F.lit("SAME_EVENT").alias("etype"))
    out = links.filter("etype is not null").unionByName(same)
    if conflicts is not None:
        out = out.unionByName(conflicts.select(F.col("event_a").alias("src"), F.col("event_b").alias("dst"), F.lit("CONFLICT_DETAIL").alias("etype")))
    return out.distinct()


def across_edges(tlinks: DataFrame, alignments: DataFrame) -> DataFrame:
    """src, dst, etype between events of two documents: a link of an event holds for the event aligned with it."""
    kinds = {"BEFORE": "INTER_BEFORE", "AFTER": "INTER_AFTER", "SIMULTANEOUS": "INTER_SIMULTANEOUS"}
    table = F.create_map(*(F.lit(x) for p in kinds.items() for x in p))
    pairs = alignments.select(F.col("ev_a").alias("event_id"), F.col("ev_b").alias("src"))
    pairs = pairs.unionByName(alignments.select(F.col("ev_b").alias("event_id"), F.col("ev_a").alias("src")))
    rows = tlinks.filter("related_to_event is not null").join(pairs, "event_id")
    rows = rows.select("src", F.col("related_to_event").alias("dst"), F.element_at(table, F.col("rel_type")).alias("etype"))
    return rows.filter("etype is not null and src <> dst").distinct()


def index_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src_no, dst_no, type_no: edges by number; an unknown type is 0, a missing one BEFORE; without edges, loops of type 0."""
    table = F.create_map(*(F.lit(x) for p in ((t, i) for i, t in enumerate(EDGE_TYPES)) for x in p))
    kind = F.coalesce(F.element_at(table, F.coalesce("etype", F.lit("BEFORE"))), F.lit(0))
    a, b = nodes.select(F.col("id").alias("src"), F.col("no").alias("src_no")), nodes.select(F.col("id").alias("dst"), F.col("no").alias("dst_no"))
    rows = edges.join(a, "src").join(b, "dst").select("src_no", "dst_no", kind.alias("type_no"))
    loops = nodes.select(F.col("no").alias("src_no"), F.col("no").alias("dst_no"), F.lit(0).alias("type_no"))
    return loops if rows.isEmpty() else rows


def number_nodes(nodes: DataFrame, order_col: str) -> DataFrame:
    """id, no: nodes numbered from 0 in an order."""
    return nodes.select("id", (F.row_number().over(Window.orderBy(order_col)) - 1).alias("no"))  # as many rows as the timetable
