"""Segments of the narrative by day, and the topological order of its graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.operators.tables import settle

# The days in their order, by which segments are found and ranked.
DAYS = ("Saturday", "Palm Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday (Rest)", "Sunday")
_REST = 100
#: Rows among which a task follows chains.
_AT_ONCE = 100_000


def segment(macro: DataFrame) -> DataFrame:
    """macro with seg_rank, label and day_key: each day is a segment, ranked by the first label that it begins with.

    What begins with no label follows in the order of first appearance, under its own name. Days with the same label keep
    that order, too.
    """
    rows = macro.withColumn("day_key", tx.or_unknown("day"))
    stems = [d.lower().split(" (")[0] for d in DAYS]
    ranks = F.filter(F.array(*(F.when(F.startswith(F.lower("day_key"), F.lit(s)), F.lit(i)) for i, s in enumerate(stems))), lambda i: i.isNotNull())
    days = rows.groupBy("day_key").agg(F.min("chronology_index").alias("_first"))
    days = days.withColumn("_rank", F.coalesce(F.array_min(ranks), F.lit(_REST)))
    label = F.when(F.col("_rank") < _REST, F.element_at(F.array(*(F.lit(d) for d in DAYS)), F.least(F.col("_rank") + 1, F.lit(len(DAYS))))).otherwise(F.col("day_key"))
    days = days.select("day_key", label.alias("label"), F.row_number().over(Window.orderBy("_rank", "_first")).alias("seg_rank"))  # a row a day
    return rows.join(days, "day_key")


def segment_runs(macro: DataFrame) -> DataFrame:
    """macro with seg_rank, label: neighbours of the same day are a segment, so the order of the narrative is kept."""
    rows = macro.withColumn("day_key", tx.or_unknown("day"))
    order = Window.orderBy("chronology_index")  # as many rows as the timetable
    new = F.when(F.col("day_key").eqNullSafe(F.lag("day_key").over(order)), 0).otherwise(1)
    rows = rows.withColumn("_new", new)
    return rows.withColumn("seg_rank", F.sum("_new").over(order).cast("int")).withColumn("label", F.col("day_key")).drop("_new")


def _steps_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, up, at, head of _chains() for nodes (id, up), as far as a chain can be followed among _AT_ONCE rows or so."""

    def follow(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, ups = ([x for p in parts for x in p.column(i).to_pylist()] for i in (0, 1))
        place, state = {x: k for k, x in enumerate(ids)}, bytearray(len(ids))
        up, at, head = list(ups), [0 if u is None else 1 for u in ups], [i if u is None else u for i, u in zip(ids, ups, strict=True)]
        for k in range(len(ids)):
            path = []
            while k is not None and not state[k]:
                state[k] = 1
                path.append(k)
                k = place.get(ups[k])  # none: behind another node, or the first of all
            if k is not None and state[k] == 1:  # a ring, and what is behind it: every step stays as it is
                k = None
                for i in path:
                    state[i] = 2
                continue
            for i in reversed(path):
                if k is not None:
                    up[i], at[i], head[i] = up[k], at[k] + 1, head[k]
                state[i], k = 2, i
        kind = parts[0].schema.field(0).type
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(up, kind), pa.array(at, pa.int64()), pa.array(head, kind)], names=["id", "up", "at", "head"])

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= _AT_ONCE:
            yield follow(held)
            held, n = [], 0
    if n:
        yield follow(held)


def _chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, head, at: the first node of each node's chain and its place behind it, by doubling the step along the chain.

    links (src, dst): no node has two before it or two behind it. Nodes of a ring have no first one and are left out. Chains
    are first followed within ranges of identifiers: where neighbours have identifiers near each other, as in a timetable,
    a step then begins as long as a range, and the rounds depend on the number of ranges.
    """
    rows = nodes.join(links.select(F.col("dst").alias("id"), F.col("src").alias("up")), "id", "left").select("id", "up")
    kind = rows.schema["id"].dataType.simpleString()
    rows = settle(rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(_steps_within, f"id {kind}, up {kind}, at long, head {kind}"))
    rounds = max(1, rows.count()).bit_length()
    for _ in range(rounds):
        if rows.filter("up is not null").isEmpty():
            break
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("at").alias("_at"), F.col("head").alias("_head"))
        rows = rows.join(above, "up", "left")
        rows = settle(rows.select("id", F.col("_up").alias("up"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"), F.coalesce("_head", "head").alias("head")))
    return rows.filter("up is null").select("id", "head", "at")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, level: the length of the longest path to each node; nodes on or behind a cycle none.

    Chains, along which nothing else joins or leaves, are numbered within ranges of identifiers and then by pointer doubling;
    what is left are rounds over the chains that have no open predecessors. A chain of n nodes takes log2(n) rounds at most.
    """
    nodes = settle(nodes.select("id").distinct())
    edges = edges.select("src", "dst").filter("src <> dst").distinct()
    edges = settle(edges.join(nodes.select(F.col("id").alias("src")), "src").join(nodes.select(F.col("id").alias("dst")), "dst").select("src", "dst"))
    lone_out = edges.groupBy("src").agg(F.count("*").alias("n")).filter("n = 1").select("src")
    lone_in = edges.groupBy("dst").agg(F.count("*").alias("n")).filter("n = 1").select("dst")
    links = settle(edges.join(lone_out, "src").join(lone_in, "dst").select("src", "dst"))
    chains = settle(_chains(nodes, links))
    begins, ends = chains.select(F.col("id").alias("src"), F.col("head").alias("a"), F.col("at").alias("_at")), chains.select(F.col("id").alias("dst"), F.col("head").alias("b"))
    across = edges.join(links, ["src", "dst"], "left_anti").join(begins, "src").join(ends, "dst")
    across = settle(across.select("a", "b", (F.col("_at") + 1).alias("step")).distinct())
    left, open_steps, reached, done = settle(chains.select("head").distinct()), across, None, None
    while True:
        ready = left.join(open_steps.select(F.col("b").alias("head")), "head", "left_anti")
        if reached is None:
            ready = ready.withColumn("level", F.lit(0).cast("long"))
        else:
            ready = ready.join(reached.groupBy("head").agg(F.max("level").alias("level")), "head")
        ready = settle(ready)
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = settle(left.join(ready.select("head"), "head", "left_anti"))
        more = open_steps.join(ready.withColumnRenamed("head", "a"), "a").select(F.col("b").alias("head"), (F.col("level") + F.col("step")).alias("level"))
        reached = settle(more if reached is None else reached.join(ready.select("head"), "head", "left_anti").unionByName(more))
        open_steps = settle(open_steps.join(ready.select(F.col("head").alias("a")), "a", "left_anti"))
    if done is None:
        return nodes.select("id", F.lit(0).cast("long").alias("level")).limit(0)
    return chains.join(done, "head").select("id", (F.col("level") + F.col("at")).alias("level"))


def narrative_order(nodes: DataFrame, edges: DataFrame, order_col: str) -> DataFrame:
    """id, position: nodes in topological order, ties by order_col; on a cycle, all nodes in that order alone."""
    nodes = settle(nodes.select("id", order_col))
    levels = settle(topological_levels(nodes, edges))
    whole = levels.count() == nodes.count()
    rows = nodes.join(levels, "id", "left")
    keys = ["level", order_col] if whole else [order_col]
    return rows.select("id", F.row_number().over(Window.orderBy(*keys)).alias("position"))  # as many rows as the narrative
