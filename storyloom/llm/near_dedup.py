"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on whole shingle sets.

1. Each text's set of word shingles, as 64-bit hashes, gives a digest (equal sets are one class, and only a class's
   smallest identifier goes on) and a MinHash signature.
2. The forest: TREES orders, each by DEPTH minima of its own. Rows are sorted by (tree, minima); rows that share at least
   the first minimum form a region, and their neighbours by longest common prefix are candidates. A region of more than
   REGION_ROWS goes down to the depth at which its parts are smaller, so copies in any number cost a bounded buffer; a
   shorter one is never cut. A region that is cut is gone through twice, with other cuts and other borders between tasks,
   so neighbours on both sides of one meet in the other; and its rows are compared once more, in the orders that start
   with each of their other minima, where those regions are short (FURTHER).
3. In a region, rows whose signatures agree enough (SIGMAS standard deviations below the threshold) are candidates: a
   maximum spanning forest and each row's nearest others, not all pairs. Their components are the clusters, outside of
   which no two texts can be linked.
4. A cluster that fits a task is settled there by the whole sets: each text's intersections with all others come from an
   inverted list. In a larger one, the candidates are confirmed first; then the rows outside its largest component meet
   all of its rows, in tiles of bounded size. Links are exact, and none that could join components is left out.

A pair of similarity s shares no first minimum in any tree with a chance of (1 - s) ** TREES: at 0.8, 3 in a million. If
it shares some, but only in regions that are cut, as those of a passage in very many texts are, it is missed if it shares
none of the other minima in a short region: with p of the pair's union in such passages, up to (1 - s + p) ** len(FURTHER),
less what the parts of cut regions still find. Where p is near s that is no bound, and the parts alone have to find it.

Edge cases: texts that are null, empty or white space have an empty set, are linked with nothing and kept; texts with
fewer words than a shingle are one shingle; rows with a null identifier are left out; repeated rows count once, and of
one identifier's different texts, that with the smallest digest counts; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import components, forget, fresh_names, maybe_in, tidy, written

TREES, DEPTH, MINIMA = 8, 8, 128
REGION_ROWS = 4096
#: The minima that start no tree's order: rows of regions that are too long are dealt by them too.
FURTHER = [j for j in range(TREES * DEPTH) if j % DEPTH]
#: Beside the spanning forest, each row's nearest others that are candidates.
NEAREST, SIGMAS = 2, 5
#: A cluster of up to so many texts and shingles is settled in one task; a tile of a larger one has so many rows.
CLUSTER_TEXTS, CLUSTER_SHINGLES, TILE_ROWS = 1024, 2_000_000, 512

#: Bytes of text that are hashed at a time; a longer text is hashed alone.
CHUNK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240601))
_BYTES = _RNG.integers(0, 1 << 64, 256, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_ODD = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 64, MINIMA, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of each word of the bytes: differences of a running polynomial."""
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    powers = np.full(len(data) + 1, _P)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers[:-1], out=total[1:])
    powers = np.full(len(data) + 1, _P_INVERSE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    return _mix((total[ends] - total[starts]) * powers[starts]), starts


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of so many words, A-Z lower-cased."""
    held, size = [], 0
    for t in texts:
        held.append((t or "").encode().lower())
        size += len(held[-1])
        if size > CHUNK:
            yield from _sets(held, words)
            held, size = [], 0
    yield from _sets(held, words)


def _sets(held: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not held:
        return
    hashes, starts = _word_hashes(np.frombuffer(b" ".join(held) + b" ", np.uint8))
    ends = np.cumsum([len(x) + 1 for x in held])
    last = np.searchsorted(starts, ends)  # words before the end of each text
    n = max(0, len(hashes) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled += hashes[i : i + n] * _ODD[i]
    rolled = _mix(rolled)
    a = 0
    for b in last.tolist():
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            yield _mix((hashes[a:b] * _ODD[: b - a]).sum(keepdims=True, dtype=np.uint64) + _ODD[63 - (b - a)])
        else:
            yield np.zeros(0, np.uint64)
        a = b


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of MINIMA hash functions over a set that isn't empty."""
    out = None
    for i in range(0, len(shingles), 1024):
        least = (shingles[None, i : i + 1024] * _A[:, None] + _B[:, None]).min(axis=1)
        out = least if out is None else np.minimum(out, least)
    return out


def _signature_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, digests, orders, marks = [], [], [], []
                for s in shingle_sets(part.column(1).to_pylist(), words):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if len(s):
                        minima = signature(s)
                        orders.append((minima[: TREES * DEPTH] >> np.uint64(32)).astype(">u4").tobytes())
                        marks.append((minima >> np.uint64(24)).astype(np.uint8).tobytes())
                    else:
                        orders.append(None)
                        marks.append(None)
                cols = [part.column(0), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, orders, marks))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "digest", "orders", "marks"])

    return run


def margin(share: float) -> float:
    """The share of minima that have to agree in a candidate, where links have this similarity or more."""
    return share - SIGMAS * (share * (1 - share) / MINIMA) ** 0.5


def candidates(firsts: DataFrame, least: float) -> DataFrame:
    """a, b: candidates of all regions. firsts: doc_id, orders, marks; least: the share of minima that have to agree."""
    size = 4 * TREES * DEPTH

    def dealt(rows: DataFrame, starts: list[int]) -> DataFrame:
        """rows in the orders that start with these minima; the others follow, from the first again after the last."""
        out = rows.withColumn("tree", F.explode(F.array(*(F.lit(j) for j in starts))))
        order = F.substring(F.concat("orders", "orders"), F.col("tree") * 4 + 1, F.lit(4 * DEPTH))
        return out.select("tree", order.alias("order"), "marks", "doc_id").withColumn("head", F.substring("order", 1, 4))

    def long(rows: DataFrame) -> DataFrame:
        """tree, head of the regions that are too long: one in REGION_ROWS of the rows at most."""
        return written(rows.groupBy("tree", "head").agg(F.count("*").alias("n")).filter(F.col("n") > REGION_ROWS).select("tree", "head"), "regions")

    def pairs(rows: DataFrame, shifted: bool = False) -> DataFrame:
        rows = rows.select("tree", "order", "marks", "doc_id").sortWithinPartitions("tree", "order", "doc_id")
        return rows.mapInArrow(tidy(_region_rows(least, shifted)), "a bigint, b bigint")

    firsts = firsts.select("doc_id", "orders", "marks").filter(F.length("orders") == size)
    tree = dealt(firsts, list(range(0, TREES * DEPTH, DEPTH)))
    cut = long(tree)
    if cut.isEmpty():
        return pairs(tree.repartition("tree", "head"))
    parts = written(tree.join(cut, ["tree", "head"], "left_semi"), "parts")  # read three times
    more = dealt(firsts.join(parts.select("doc_id").distinct(), "doc_id", "left_semi"), FURTHER)
    whole = tree.join(cut, ["tree", "head"], "left_anti").unionByName(more.join(long(more), ["tree", "head"], "left_anti"))
    n = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = pairs(parts.repartitionByRange(n, "tree", "order"))
    two = pairs(parts.repartitionByRange(2 * n + 1, "tree", "order"), shifted=True)  # other borders, other cuts
    return pairs(whole.repartition("tree", "head")).unionByName(one).unionByName(two)


def _near_pairs(ids: np.ndarray, marks: np.ndarray, least: float) -> set[tuple[int, int]]:
    """Of rows that share a prefix: the maximum spanning forest of like pairs and the nearest others of each row."""
    n = len(ids)
    best, source, left = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool)
    pairs, at = set(), 0
    for _ in range(n):
        left[at] = False
        like = (marks == marks[at]).mean(axis=1, dtype=np.float32)
        like[at] = -1
        near = np.flatnonzero(like >= least)
        if len(near) > NEAREST:
            near = near[np.lexsort((ids[near], -like[near]))[:NEAREST]]
        pairs.update((at, j) for j in near.tolist())
        closer = left & (like > best)
        best[closer], source[closer] = like[closer], at
        if not left.any():
            break
        at = int(np.argmax(np.where(left, best, -2.0)))
        if best[at] >= least:
            pairs.add((at, int(source[at])))
    names = ids.tolist()
    return {(min(names[a], names[b]), max(names[a], names[b])) for a, b in pairs}


def _region_rows(least: float, shifted: bool = False):
    """Rows sorted by tree and order: the candidates a < b of each region.

    shifted: the first part of a region that is cut is half as long, so its cuts lie elsewhere.
    """
    most = REGION_ROWS
    begun: tuple[int, int] | None = None  # the region that was cut last

    def cut(rows: tuple[np.ndarray, ...], final: bool) -> tuple[list, tuple[np.ndarray, ...]]:
        """Pairs of the regions that have ended, and the rows of the one that may go on."""
        nonlocal begun
        key, ids, marks = rows
        found: list[tuple[int, int]] = []
        starts = np.concatenate([[0], np.flatnonzero((key[1:, :2] != key[:-1, :2]).any(axis=1)) + 1, [len(ids)]]).tolist()
        for a, b in zip(starts, starts[1:], strict=False):
            while b - a > most:  # go down to the depth at which the part that is still open is shorter
                here = (int(key[a, 0]), int(key[a, 1]))
                c = a + (most // 2 if shifted and begun != here else most)
                begun = here
                width = next((d for d in range(3, key.shape[1] + 1) if (key[a, :d] != key[c, :d]).any()), 0)
                if width:
                    c = a + int(np.flatnonzero((key[a : c + 1, :width] != key[c, :width]).any(axis=1))[-1]) + 1
                found += _near_pairs(ids[a:c], marks[a:c], least)
                found.append((int(min(ids[c - 1], ids[c])), int(max(ids[c - 1], ids[c]))))
                a = c
            if b == len(ids) and not final:
                return found, tuple(x[a:] for x in rows)
            if b - a > 1:
                found += _near_pairs(ids[a:b], marks[a:b], least)
        return found, tuple(x[:0] for x in rows)

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH)
            key = np.column_stack([batch.column(0).to_numpy(zero_copy_only=False), order.astype(np.int64)])
            marks = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, MINIMA)
            now = (key, batch.column(3).to_numpy(zero_copy_only=False), marks)
            rows = now if rows is None else tuple(np.concatenate(x) for x in zip(rows, now, strict=True))
            found, rows = cut(rows, False)
            if found:
                yield batch_of(found)
        if rows is not None and len(rows[1]):
            found, _ = cut(rows, True)
            if found:
                yield batch_of(found)

    return run


def _set_rows(words: int):
    """doc_id, cluster, text -> doc_id, cluster, digest, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [s.tobytes() for s in shingle_sets(part.column(2).to_pylist(), words)]
                digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "cluster", "digest", "hashes"])

    return run


class _Lists:
    """The inverted lists of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        by = np.argsort(flat, kind="stable")
        self.owner = owner[by]
        self.hashes, self.starts = np.unique(flat[by], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))

    def like(self, one: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets whose similarity to `one` is enough."""
        at = np.searchsorted(self.hashes, one).clip(max=len(self.hashes) - 1)
        at = at[self.hashes[at] == one]
        counts = self.ends[at] - self.starts[at]
        total = np.cumsum(counts)
        places = np.repeat(self.starts[at] - (total - counts), counts) + np.arange(int(total[-1]) if len(total) else 0)
        both = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (100 * both >= percent * (self.sizes + len(one) - both)))


def _cluster_rows(percent: int):
    """Rows sorted by cluster: for each text the smallest number that it reaches in its cluster, as a link."""

    def settle(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        above = list(range(len(ids)))

        def top(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        if len(ids) > 1:
            lists = _Lists(sets)
            for i, s in enumerate(sets):
                for j in lists.like(s, percent).tolist():
                    a, b = top(i), top(j)
                    if a != b:
                        above[max(a, b)] = min(a, b)
        return [(ids[i], ids[top(i)]) for i in range(len(ids)) if top(i) != i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []
        for batch in batches:
            links = []
            for doc, cluster, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if cluster != at:
                    links += settle(ids, sets)
                    at, ids, sets = cluster, [], []
                ids.append(doc)
                sets.append(np.frombuffer(blob, np.uint64))
            yield _links(links)
        yield _links(settle(ids, sets))

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _link_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _tile_rows(percent: int):
    """A tile of rows outside the largest component and rows of the cluster: links between components."""

    def run(few: pa.Table, many: pa.Table) -> pa.Table:
        links = []
        if few.num_rows and many.num_rows:
            lists = _Lists([np.frombuffer(x, np.uint64) for x in many["hashes"].to_pylist()])
            ids, labels = many["doc_id"].to_pylist(), many["label"].to_pylist()
            for doc, label, blob in zip(few["doc_id"].to_pylist(), few["label"].to_pylist(), few["hashes"].to_pylist(), strict=True):
                reached = set()
                for j in lists.like(np.frombuffer(blob, np.uint64), percent).tolist():
                    if labels[j] != label and labels[j] not in reached:  # one link to a component is enough
                        reached.add(labels[j])
                        links.append((doc, ids[j]))
        return pa.Table.from_batches([_links(links)])

    return run


def _read_again(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts joined with wanted (doc_id, cluster, ...); a filter of bounded size spares most other texts the shuffle."""
    asked = maybe_in(texts, F.col("doc_id"), wanted.select("doc_id"), "_maybe").filter("_maybe")
    return asked.select("doc_id", "text").join(wanted, "doc_id")


def _large_links(pairs: DataFrame, sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) in clusters that don't fit a task. clusters: doc_id, cluster; sets: doc_id, hashes of their texts."""
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    own = pairs.join(clusters.select(F.col("doc_id").alias("a")), "a", "left_semi")
    both = own.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    first = written(both.mapInArrow(tidy(_link_rows(percent)), "a bigint, b bigint"), "links")
    labels = clusters.join(components(first).withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    labels = written(labels.select("doc_id", "cluster", F.coalesce("component", "doc_id").alias("label")), "labels")
    parts = labels.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("n").alias("main_n"), F.max_by("label", F.struct("n", "label")).alias("main"))
    sizes = sizes.filter("main_n < n")
    per = lambda c: F.ceil(F.col(c) / TILE_ROWS).cast("int")
    sizes = sizes.select("cluster", "main", per("n").alias("n_many"), F.ceil((F.col("n") - F.col("main_n")) / TILE_ROWS).cast("int").alias("n_few"))
    rows = labels.join(sizes, "cluster").join(sets, "doc_id")
    part = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    few = rows.filter("label <> main").select("doc_id", "label", "hashes", "cluster", part("n_few").alias("i"), every("n_many").alias("j"))
    many = rows.select("doc_id", "label", "hashes", "cluster", every("n_few").alias("i"), part("n_many").alias("j"))
    few, many = few.toDF("doc_id", "label", "hashes", "of", "at_i", "at_j"), many.toDF("doc_id", "label", "hashes", "in", "to_i", "to_j")
    more = few.groupBy("of", "at_i", "at_j").cogroup(many.groupBy("in", "to_i", "to_j")).applyInArrow(_tile_rows(percent), "a bigint, b bigint")
    return first.unionByName(more)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest identifier reachable by links), kept (it is that identifier).

    Texts are linked if their sets of shingles of so many words have a Jaccard similarity of `percent` or more.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    signed = written(texts.mapInArrow(tidy(_signature_rows(words)), "doc_id bigint, n_shingles bigint, digest binary, orders binary, marks binary"), "signatures")
    one = signed.groupBy("doc_id").agg(F.min(F.struct("digest", "n_shingles")).alias("s"))
    members = written(one.select("doc_id", "s.digest", "s.n_shingles"), "members")
    classes = members.filter("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles")).alias("s"))
    classes = written(classes.select("digest", "s.doc_id", "s.n_shingles"), "classes")
    repeats = signed.count() != members.count()
    firsts = signed.join(classes, ["doc_id", "digest"] if repeats else ["doc_id"], "left_semi")
    firsts = firsts.dropDuplicates(["doc_id"]) if repeats else firsts
    pairs = written(candidates(firsts, margin(percent / 100)), "candidates").distinct()

    clusters = components(pairs).select(F.col("doc").alias("doc_id"), F.col("component").alias("cluster"))
    clusters = clusters.join(classes, "doc_id").select("doc_id", "cluster", F.col("digest").alias("right"), "n_shingles")
    sizes = clusters.groupBy("cluster").agg((F.count("*") > CLUSTER_TEXTS).alias("n"), (F.sum("n_shingles") > CLUSTER_SHINGLES).alias("s"))
    clusters = written(clusters.join(sizes.select("cluster", (F.col("n") | F.col("s")).alias("large")), "cluster"), "clusters")

    def sets(large: bool) -> DataFrame:
        wanted = clusters.filter(F.col("large") == large).select("doc_id", "cluster", "right")
        out = _read_again(texts, wanted).select("doc_id", "cluster", "text", "right")
        if repeats:  # of an identifier's texts, the one whose digest counts, and that once
            made = out.select("doc_id", "cluster", "text").mapInArrow(tidy(_set_rows(words)), "doc_id bigint, cluster bigint, digest binary, hashes binary")
            made = made.join(wanted.select("doc_id", F.col("right").alias("digest")), ["doc_id", "digest"], "left_semi")
            return made.groupBy("doc_id", "cluster").agg(F.min("hashes").alias("hashes"))
        made = out.select("doc_id", "cluster", "text").mapInArrow(tidy(_set_rows(words)), "doc_id bigint, cluster bigint, digest binary, hashes binary")
        return made.select("doc_id", "cluster", "hashes")

    small = sets(False).repartition("cluster").sortWithinPartitions("cluster", "doc_id")
    links = written(small.mapInArrow(tidy(_cluster_rows(percent)), "a bigint, b bigint"), "links")
    large = clusters.filter("large")
    if not large.isEmpty():
        whole = written(sets(True).select("doc_id", "hashes"), "sets")
        links = links.unionByName(_large_links(pairs, whole, large.select("doc_id", "cluster"), percent))
    labels = components(links)
    of = classes.withColumnRenamed("doc_id", "doc").join(labels, "doc", "left").select("digest", F.coalesce("component", "doc").alias("component"))
    out = members.join(of, "digest", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    forget(signed)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near-duplicates that near_duplicates() doesn't keep; all columns as they are.

    Rows that repeat an identifier and its text stay once; rows with a null identifier stay.
    """
    found = written(near_duplicates(docs, words, percent, id_col, text_col), "found")
    name, maybe = fresh_names(docs.columns, "_gone", "_maybe")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(name))
    asked = maybe_in(docs, F.col(id_col).cast("long"), gone, maybe)  # spares the rows that stay the join's shuffle
    left = asked.filter(F.col(maybe)).join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
    out = asked.filter(~F.col(maybe)).select(*docs.columns).unionByName(left.select(*docs.columns))
    if docs.filter(F.col(id_col).isNotNull()).count() > found.count():
        null = out.filter(F.col(id_col).isNull())
        once = out.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col])
        out = once.unionByName(null)
    return out
