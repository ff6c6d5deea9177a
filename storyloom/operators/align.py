"""Alignment of events across documents.

An event's partner in another document is the one with the highest

    w_sem * cosine + w_ent * entity overlap + w_prox * proximity

above a threshold. This compares all pairs by nature. Events are packed (a bag of WIDTH counts, the entities) and dealt into
tiles of rows; a pair of tiles is one task, which returns each row's best of the tile only, so memory is bounded by the tile,
whatever a document's length. In a task a product of 32-bit numbers says how near each pair is to within SLACK, and only
pairs that may be a row's best are scored, from whole counts: the rows are those of scoring every pair. Equal events of a tile
are compared once.

By index, the shorter lists of a tile's buckets are walked instead of multiplied. Events that share no bucket and no entity
score w_prox * proximity at most: where that reaches the threshold, an index has no answer and refuses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.functions import vectors as vx
from storyloom.operators.tables import settle

WEIGHTS, THRESHOLD, NEUTRAL, FAR = (0.45, 0.30, 0.25), 0.35, 0.5, 50
TILE_ROWS = 16_384
#: Rows of a tile that are multiplied at once, left and right; tasks at most; by how much a product of 32-bit numbers may be off.
_LEFT, _RIGHT, _TASKS, SLACK = 256, 2048, 4096, 1e-4
_FEW_PAIRS = 10_000  # of documents, which a broadcast may hold
# Relations that contradict each other, first document's first.
CONTRADICTIONS = (("BEFORE", "AFTER"), ("AFTER", "BEFORE"), ("SIMULTANEOUS", "BEFORE"), ("SIMULTANEOUS", "AFTER"), ("BEGINS", "ENDS"), ("ENDS", "BEGINS"))


def document_order(events: DataFrame) -> DataFrame:
    """doc_id, doc_ord: documents numbered by name."""
    return events.select("doc_id").distinct().withColumn("doc_ord", F.row_number().over(Window.orderBy("doc_id")))  # a row a document


def document_pairs(documents: DataFrame) -> DataFrame:
    """doc_a, doc_b: each pair of documents (doc_id, doc_ord) once, in their order."""
    a, b = documents.toDF("doc_a", "ord_a"), documents.toDF("doc_b", "ord_b")
    return a.join(b, F.col("ord_a") < F.col("ord_b")).select("doc_a", "doc_b")


def parallel_pericopes(timetable: DataFrame, documents: list[str], name_col: str = "Event") -> DataFrame:
    """chrono_idx, event_name, doc_refs map: rows of the timetable that two documents or more tell.

    timetable: chronology_index and a column for each document, whatever the case of its name.
    """
    columns = {c.lower(): c for c in timetable.columns}
    refs = [F.when(F.length(tx.strip(columns[d.lower()])) > 0, F.struct(F.lit(d), tx.strip(columns[d.lower()]))) for d in documents if d.lower() in columns]
    told = F.filter(F.array(*refs), lambda r: r.isNotNull())
    rows = timetable.select(F.col("chronology_index").alias("chrono_idx"), F.col(columns[name_col.lower()]).alias("event_name"), told.alias("_r"))
    return rows.filter(F.size("_r") >= 2).select("chrono_idx", "event_name", F.map_from_entries("_r").alias("doc_refs"))


def last_by_name(pericopes: DataFrame) -> DataFrame:
    """Of pericopes with the same name the last."""
    order = Window.partitionBy("event_name").orderBy(F.desc("chrono_idx"))
    return pericopes.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def shared_documents(pericopes: DataFrame) -> DataFrame:
    """doc_a, doc_b: ordered pairs of documents that some pericope has in common."""
    keys = pericopes.select(F.explode(F.map_keys("doc_refs")).alias("doc_a"), F.map_keys("doc_refs").alias("_k"))
    return keys.select("doc_a", F.explode("_k").alias("doc_b")).filter("doc_a <> doc_b").distinct()


def proximity(distance: Column) -> Column:
    """1 for the same pericope down to 0 at FAR; NEUTRAL where the distance isn't known."""
    return F.when(distance.isNull(), NEUTRAL).otherwise(F.greatest(F.lit(0.0), 1 - distance / FAR))


def _pairs_with_proximity(events: DataFrame, pericopes: DataFrame | None) -> DataFrame:
    pairs = document_pairs(document_order(events))
    if pericopes is None:
        return pairs.withColumn("prox", F.lit(NEUTRAL))
    near = shared_documents(last_by_name(pericopes)).withColumn("_d", F.lit(0))
    return pairs.join(near, ["doc_a", "doc_b"], "left").select("doc_a", "doc_b", proximity(F.col("_d")).alias("prox"))


def _best(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_a", "ev_a", "doc_b").orderBy(F.desc("score"), "_seq")
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("doc_a", "ev_a", "doc_b", "ev_b", "score")


def _packed(events: DataFrame) -> DataFrame:
    """id, doc_id, seq, ents, bag: counts by bucket, as WIDTH numbers of 1, 2 or 4 bytes."""
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    events = events.select("id", "doc_id", "seq", "text").repartition("id")  # numbered events come in a task a document
    rows = events.select("id", "doc_id", "seq", F.coalesce(tx.entities("text"), none("string")).alias("ents"), F.coalesce(F.transform(tx.words("text"), lambda w: vx.bucket(w)), none("int")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists, bags = part.column(4), []
                offsets, buckets = lists.offsets.to_numpy(), lists.values.to_numpy()
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    counts = np.bincount(buckets[a:b], minlength=vx.WIDTH)
                    top = counts.max()
                    bags.append(counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(bags, pa.binary())], names=["id", "doc_id", "seq", "ents", "bag"])

    return rows.mapInArrow(run, "id string, doc_id string, seq int, ents array<string>, bag binary")


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
    """Of a tile's different events: the row with the smallest seq and the counts; their entities; each row's number among them."""
    seq, bags, ents = table["seq"].to_numpy(), table["bag"].to_pylist(), [tuple(sorted(e)) for e in table["ents"].to_pylist()]
    order, seen, of = np.argsort(seq, kind="stable"), {}, np.empty(len(seq), int)
    for i in order:
        of[i] = seen.setdefault((bags[i], ents[i]), len(seen))
    first = np.array([0] * len(seen))
    first[of[order[::-1]]] = order[::-1]
    counts = np.array([np.frombuffer(bags[i], f"<u{len(bags[i]) // vx.WIDTH}") for i in first]).reshape(len(first), vx.WIDTH)
    return first, counts, [ents[i] for i in first], of


def _lists(sets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and members of sets, as two arrays."""
    sizes = [len(s) for s in sets]
    return np.repeat(np.arange(len(sets)), sizes), np.fromiter((x for s in sets for x in s), int, sum(sizes))


class _Product:
    """Sums over what rows share: columns with long lists are multiplied, those with short lists walked.

    Left and right are rows, columns and values of sparse tables.
    """

    def __init__(self, left: tuple, right: tuple, n: tuple[int, int], width: int, long: float):
        lists = np.bincount(right[1], minlength=width) if len(right[1]) else np.zeros(width, int)
        used = np.bincount(left[1], minlength=width) if len(left[1]) else np.zeros(width, int)
        often = (lists > long) & (used > 0)
        self.dense = []
        place = np.cumsum(often) - 1
        for (rows, cols, values), size in zip((left, right), n, strict=True):
            at, x = often[cols], np.zeros((size, int(often.sum())), np.float32)
            x[rows[at], place[cols[at]]] = values[at]
            self.dense.append(x)
        rows, cols, values = left
        at = ~often[cols] & (lists[cols] > 0)
        self.rows, self.cols, self.values = rows[at], cols[at], values[at]
        rows, cols, values = right
        at = ~often[cols] & (used[cols] > 0)
        order = np.lexsort((rows[at], cols[at]))
        self.right_rows, self.right_values, self.width = rows[at][order], values[at][order], width
        # where each column's list begins for a right row: lists are in order of rows, so a range of rows is a slice
        self.keys = cols[at][order].astype(np.int64) * (n[1] + 1) + self.right_rows
        self.stride = n[1] + 1

    def block(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        """The sums of left rows a to b with right rows c to d."""
        out = self.dense[0][a:b] @ self.dense[1][c:d].T
        first, last = np.searchsorted(self.rows, (a, b))
        if first < last and len(self.keys):
            rows, cols, values = self.rows[first:last] - a, self.cols[first:last].astype(np.int64), self.values[first:last]
            begin, end = np.searchsorted(self.keys, cols * self.stride + c), np.searchsorted(self.keys, cols * self.stride + d)
            sizes = end - begin
            if total := int(sizes.sum()):
                at = np.arange(total) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
                np.add.at(out.reshape(-1), np.repeat(rows, sizes) * out.shape[1] + self.right_rows[at] - c, (np.repeat(values, sizes) * self.right_values[at]).astype(np.float32))
        return out


def _tile(threshold: float, weights: tuple[float, float, float], by_index: bool):
    """A pair of tiles: each left event's best right event above the threshold."""
    slack = SLACK * max(1.0, sum(map(abs, weights)))

    def sparse(counts: np.ndarray, norms: np.ndarray) -> tuple:
        rows, cols = np.nonzero(counts)
        return rows, cols, counts[rows, cols] / np.sqrt(norms)[rows]

    def pairs_of(left: pa.Table, right: pa.Table) -> list[tuple]:
        (first_a, x, ents_a, of_a), (first_b, y, ents_b, _) = _distinct(left), _distinct(right)
        n = len(x), len(y)
        nx, ny = (np.square(z.astype(float)).sum(axis=1) for z in (x, y))
        vocabulary: dict[str, int] = {}
        sets = [[[vocabulary.setdefault(e, len(vocabulary)) for e in row] for row in t] for t in (ents_a, ents_b)]
        size = [np.array([len(s) for s in t], np.float32) for t in sets]
        has = [(*_lists(t), np.ones(sum(map(len, t)), np.float32)) for t in sets]
        words = _Product(sparse(x, nx), sparse(y, ny), n, vx.WIDTH, n[1] / 32 if by_index else 0)
        shared = _Product(*has, n, len(vocabulary), n[1] / 64)
        members = [[frozenset(s) for s in t] for t in sets]
        prox = weights[2] * left["prox"][0].as_py()
        seq = right["seq"].to_numpy()[first_b]
        best, chosen = np.full(n[0], -np.inf), np.full(n[0], -1)
        for a in range(0, n[0], _LEFT):
            b = min(a + _LEFT, n[0])
            for c in range(0, n[1], _RIGHT):
                d = min(c + _RIGHT, n[1])
                near, both = words.block(a, b, c, d), shared.block(a, b, c, d)
                either = size[0][a:b, None] + size[1][None, c:d]
                either -= both
                np.maximum(either, 1, out=either)
                both /= either
                near *= weights[0]
                both *= weights[1]
                near += both
                top = near.max(axis=1).astype(float)
                least = np.maximum(np.maximum(best[a:b], threshold) - prox, top) - slack
                hopeful = np.flatnonzero(top >= least)
                for i in range(0, len(hopeful), 64):  # few rows at a time: where all are alike, all may be the best
                    some = hopeful[i : i + 64]
                    r, q = np.nonzero(near[some] >= (least[some, None] - slack).astype(np.float32))
                    for at in range(0, len(r), 32_768):
                        rows, cols = some[r[at : at + 32_768]] + a, q[at : at + 32_768] + c
                        norm = np.sqrt(nx[rows] * ny[cols])
                        dot = np.einsum("ij,ij->i", x[rows].astype(float), y[cols].astype(float))
                        cosine = np.divide(dot, norm, out=np.zeros_like(norm), where=norm > 0)
                        same = np.array([len(members[0][u] & members[1][v]) for u, v in zip(rows, cols, strict=True)], float)
                        union = size[0][rows] + size[1][cols] - same
                        entity = np.divide(same, union, out=np.zeros_like(same), where=same > 0)
                        score = np.round(weights[0] * cosine + weights[1] * entity + prox, 9)
                        order = np.lexsort((seq[cols], -score, rows))
                        lead = order[np.r_[True, rows[order][1:] != rows[order][:-1]]]
                        rows, cols, score = rows[lead], cols[lead], score[lead]
                        better = (score > best[rows]) | ((score == best[rows]) & (seq[cols] < seq[chosen[rows]]))
                        best[rows[better]], chosen[rows[better]] = score[better], cols[better]
        ids, doc_a, other, doc_b = left["id"].to_pylist(), left["doc_id"][0].as_py(), right["id"].to_pylist(), right["doc_id"][0].as_py()
        return [(doc_a, ids[i], doc_b, other[first_b[chosen[k]]], float(best[k]), int(seq[chosen[k]])) for i, k in enumerate(of_a) if best[k] > threshold]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pairs_of(left, right) if left.num_rows and right.num_rows else []
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_a", "ev_a", "doc_b", "ev_b", "score", "_seq"])

    return run


def best_matches_by_index(events: DataFrame, pericopes: DataFrame | None = None, threshold: float = THRESHOLD, weights: tuple[float, float, float] = WEIGHTS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_a, ev_a, doc_b, ev_b, score: as best_matches(), for weights by which events have to share something."""
    if weights[2] >= threshold:
        raise ValueError("proximity alone reaches the threshold: events need not share anything to match")
    return _matches(events, pericopes, threshold, weights, tile_rows, True)


def best_matches(events: DataFrame, pericopes: DataFrame | None = None, threshold: float = THRESHOLD, weights: tuple[float, float, float] = WEIGHTS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_a, ev_a, doc_b, ev_b, score: the partner of each event in each later document (scores to 9 digits)."""
    return _matches(events, pericopes, threshold, weights, tile_rows, False)


def _matches(events: DataFrame, pericopes: DataFrame | None, threshold: float, weights: tuple[float, float, float], tile_rows: int, by_index: bool) -> DataFrame:
    rows = settle(_packed(events)).withColumn("tile", F.floor(F.col("seq") / tile_rows).cast("int"))
    tiles = rows.groupBy("doc_id").agg(F.max("tile").alias("last"))
    left_last, right_last = tiles.toDF("doc_a", "last_a"), tiles.toDF("doc_b", "last_b")
    pairs = settle(_pairs_with_proximity(rows, pericopes).join(left_last, "doc_a").join(right_last, "doc_b"))
    # a task a pair of tiles, if not too many: by their size alone, Spark would put many into one
    n_pairs, n_tiles = pairs.agg(F.count("*"), F.sum((F.col("last_a") + 1) * (F.col("last_b") + 1))).first()
    tasks = max(1, min(_TASKS, n_tiles or 0))
    near = F.broadcast(pairs) if n_pairs <= _FEW_PAIRS else pairs  # else three documents are three tasks
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c)))
    names = ["id", "doc_id", "seq", "ents", "bag"]
    left = rows.join(near.withColumnRenamed("doc_a", "doc_id"), "doc_id").select(*names, "prox", F.col("doc_id").alias("ka"), F.col("doc_b").alias("kb"), F.col("tile").alias("i"), every("last_b").alias("j"))
    right = rows.join(near.withColumnRenamed("doc_b", "doc_id"), "doc_id").select(*names, F.col("doc_a").alias("la"), F.col("doc_id").alias("lb"), every("last_a").alias("m"), F.col("tile").alias("n"))
    left, right = left.toDF(*names, "prox", "ka", "kb", "i", "j"), right.toDF(*names, "la", "lb", "m", "n")
    left, right = left.repartition(tasks, "ka", "kb", "i", "j"), right.repartition(tasks, "la", "lb", "m", "n")
    found = left.groupBy("ka", "kb", "i", "j").cogroup(right.groupBy("la", "lb", "m", "n")).applyInArrow(_tile(threshold, weights, by_index), "doc_a string, ev_a string, doc_b string, ev_b string, score double, _seq int")
    return _best(settle(found))


def group_ids(matches: DataFrame, events: DataFrame) -> DataFrame:
    """matches with group_id, numbered by documents and then by the left event."""
    seq = events.select(F.col("id").alias("ev_a"), F.col("seq").alias("_seq"))
    order = Window.partitionBy("doc_a", "doc_b").orderBy("_seq")
    rows = matches.join(seq, "ev_a").withColumn("_n", F.row_number().over(order))
    sizes = rows.groupBy("doc_a", "doc_b").agg(F.count("*").alias("_size"))
    before = Window.orderBy("doc_a", "doc_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a pair of documents
    bases = sizes.select("doc_a", "doc_b", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, ["doc_a", "doc_b"]).select(F.concat(F.lit("align_"), (F.col("_base") + F.col("_n") - 1).cast("string")).alias("group_id"), "doc_a", "ev_a", "doc_b", "ev_b", "score")


def gather_links(alignments: DataFrame, tlinks: DataFrame) -> DataFrame:
    """The links of each alignment's events, each once, with the document they come from."""
    ends = alignments.select("group_id", F.col("ev_a").alias("ev")).unionByName(alignments.select("group_id", F.col("ev_b").alias("ev")))
    by = lambda c: ends.join(tlinks.withColumnRenamed(c, "ev"), "ev").withColumnRenamed("ev", c)
    cols = ["group_id", "id", "doc_id", "rel_type", "event_id", "related_to_event"]
    return by("event_id").select(*cols).unionByName(by("related_to_event").select(*cols)).distinct()


def conflicts(links: DataFrame, order_col: str = "ord") -> DataFrame:
    """Contradicting relations of two documents between the same events of a group.

    links: group_id, event_id, related_to_event, rel_type, doc_id and an order; of a document's relations the last counts,
    and documents come in the order of their first.
    """
    key = ["group_id", "event_id", "related_to_event"]
    told = links.groupBy(*key, "doc_id").agg(F.max_by("rel_type", order_col).alias("rel"), F.min(order_col).alias("at"))
    a, b = told.toDF(*key, "doc_1", "rel_a", "_a"), told.toDF(*key, "doc_2", "rel_b", "_b")
    pairs = a.join(b, key).filter("_a < _b")
    against = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in CONTRADICTIONS))
    pairs = pairs.filter(F.array_contains(against, F.struct(F.col("rel_a").alias("x"), F.col("rel_b").alias("y"))))
    return pairs.select("group_id", F.col("event_id").alias("event_a"), F.col("related_to_event").alias("event_b"), "rel_a", "rel_b", "doc_1", "doc_2")
