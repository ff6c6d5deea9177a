"""Metrics of links, narratives and orders, as DataFrames of one row or one row a group."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.functions import vectors as vx
from storyloom.operators.tables import settle

LEAST, REPEATED = 11, 0.85
#: Words whose buckets a worker remembers.
_WORDS_KEPT = 100_000
_PAIR = ["event_id", "related_to_event"]
_WORD = re.compile(r"\w+")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or unknown."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def _linked(links: DataFrame) -> DataFrame:
    return links.filter("event_id <> '' and related_to_event <> ''")


def ordering_accuracy(predicted: DataFrame, gold: DataFrame, order_col: str = "ord") -> DataFrame:
    """evaluated, correct, accuracy: of predicted links whose pair is in the gold; of a pair's gold links the last counts."""
    last = _linked(gold).groupBy(*_PAIR).agg(F.max_by("rel_type", order_col).alias("_gold"))
    rows = predicted.join(last, _PAIR)
    rows = rows.agg(F.count("*").alias("evaluated"), F.count_if(F.col("rel_type").eqNullSafe(F.col("_gold"))).alias("correct"))
    return rows.withColumn("accuracy", ratio(F.col("correct"), F.col("evaluated")))


def adjacent_pair_accuracy(predicted: DataFrame, gold: DataFrame, order_col: str = "ord") -> DataFrame:
    """ordering_accuracy() of links by narrative order."""
    return ordering_accuracy(predicted.filter("source = 'narrative_order'"), gold, order_col)


def temporal_f1(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of links as sets of (event, event, relation)."""
    key = [*_PAIR, "rel_type"]
    p, g = _linked(predicted).select(*key).distinct().withColumn("_p", F.lit(1)), _linked(gold).select(*key).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, key, "full")
    has, right = F.col("_p").isNotNull(), F.col("_g").isNotNull()
    rows = both.agg(F.count_if(has & right).alias("tp"), F.count_if(has & ~right).alias("fp"), F.count_if(~has & right).alias("fn"))
    rows = rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def entity_coverage(texts: DataFrame, narrative: DataFrame, by: list[str] | None = None, text_col: str = "text", narrative_col: str = "narrative") -> DataFrame:
    """by, n_entities, n_covered, coverage: entities of the texts that the narrative names; 1 without entities."""
    by = by or []
    gold = texts.select(*by, F.explode(tx.entities(text_col)).alias("_e")).distinct()
    told = narrative.select(*by, F.explode(tx.entities(narrative_col)).alias("_e")).distinct().withColumn("_in", F.lit(1))
    rows = gold.join(told, [*by, "_e"], "left").groupBy(*by).agg(F.count("*").alias("n_entities"), F.count("_in").alias("n_covered"))
    if by:
        rows = texts.select(*by).distinct().join(rows, by, "left").na.fill(0, ["n_entities", "n_covered"])
    return rows.withColumn("coverage", F.when(F.col("n_entities") > 0, F.col("n_covered") / F.col("n_entities")).otherwise(1.0))


def numbered_sentences(texts: DataFrame, id_cols: list[str], text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id_cols, seq, text: the sentences of each text that are long enough."""
    return texts.select(*id_cols, F.posexplode(tx.sentences(text_col, least)).alias("seq", "text"))


def coherence(texts: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols, coherence: the mean cosine of neighbouring sentences; 0 with fewer than two.

    A text's sentences are compared in its task: nothing is shuffled. A worker holds one text's at a time as objects.
    """

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets: dict[str, int] = {}

        def bag(sentence: str) -> tuple[Counter, int]:
            words = _WORD.findall(sentence.lower())
            if len(buckets) > _WORDS_KEPT:
                buckets.clear()
            for w in set(words).difference(buckets):
                buckets[w] = int(hashlib.md5(w.encode()).hexdigest(), 16) % vx.WIDTH
            counts = Counter(map(buckets.__getitem__, words))
            return counts, sum(n * n for n in counts.values())

        for arrays in batches:
            out = []
            for cell in arrays:
                found = cell.as_py()
                total, last = 0.0, None
                for sentence in [] if found is None else found:
                    now = bag(sentence)
                    if last and last[1] and now[1]:
                        small, large = sorted((last[0], now[0]), key=len)
                        total += sum(n * large[b] for b, n in small.items() if b in large) / math.sqrt(last[1] * now[1])
                    last = now
                out.append(total / (len(found) - 1) if found is not None and len(found) > 1 else 0.0)
            yield pa.array(out, pa.float64())

    return texts.select(*id_cols, F.round(run(tx.sentences(text_col, LEAST)), 9).alias("coherence"))


def redundancy_ratio(texts: DataFrame, id_cols: list[str], text_col: str = "text", threshold: float = REPEATED) -> DataFrame:
    """id_cols, n_sentences, n_repeated, ratio: sentences with a cosine of the threshold or more to an earlier one.

    A text's sentences are compared in its task, as a product of sparse counts row by row.
    """
    from storyloom.operators.generate import _bag

    @F.pandas_udf("struct<n_sentences:int,n_repeated:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for arrays in batches:
            out = []
            for found in arrays:
                n = 0 if found is None else len(found)
                repeated = 0
                if n >= 2:
                    bags = np.array([_bag(s) for s in found])
                    for a in range(0, n, 512):
                        like = np.tril(np.round(bags[a : a + 512] @ bags[: a + 512].T, 9), a - 1)
                        repeated += int((like >= threshold).any(axis=1).sum())
                out.append((n, repeated))
            yield pd.DataFrame(out, columns=["n_sentences", "n_repeated"])

    rows = texts.select(*id_cols, run(tx.sentences(text_col, LEAST)).alias("r")).select(*id_cols, "r.*")
    return rows.withColumn("ratio", F.when(F.col("n_sentences") >= 2, F.col("n_repeated") / F.col("n_sentences")).otherwise(0.0))


def ngrams(rows: DataFrame, id_cols: list[str], n: int, text_col: str = "text") -> DataFrame:
    """id_cols, gram, cnt: the n-grams of the lower-case words of each text."""
    words = rows.select(*id_cols, tx.words(text_col).alias("_w"))
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))
    long = words.filter(F.size("_w") >= n)
    return long.select(*id_cols, F.explode(grams).alias("gram")).groupBy(*id_cols, "gram").agg(F.count("*").alias("cnt"))


def ngram_redundancy(texts: DataFrame, id_cols: list[str], n: int = 3, text_col: str = "text") -> DataFrame:
    """id_cols, n_grams, n_distinct, ratio: 1 - different n-grams / n-grams; 0 without any. Nothing is shuffled."""
    rows = texts.select(*id_cols, tx.words(text_col).alias("_w"))
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))
    long = F.size("_w") >= n
    rows = rows.select(*id_cols, F.when(long, F.size("_w") - n + 1).otherwise(0).cast("long").alias("n_grams"), F.when(long, F.size(F.array_distinct(grams))).otherwise(0).cast("long").alias("n_distinct"))
    return rows.withColumn("ratio", F.when(F.col("n_grams") > 0, 1 - F.col("n_distinct") / F.col("n_grams")).otherwise(0.0))


def _prf(rows: DataFrame, id_cols: list[str], hits: Column, n_out: Column, n_ref: Column) -> DataFrame:
    rows = rows.select(*id_cols, F.coalesce(hits, F.lit(0)).alias("hits"), F.coalesce(n_out, F.lit(0)).alias("n_out"), F.coalesce(n_ref, F.lit(0)).alias("n_ref"))
    rows = rows.withColumn("precision", ratio(F.col("hits"), F.col("n_out"))).withColumn("recall", ratio(F.col("hits"), F.col("n_ref")))
    return rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def rouge_n(pairs: DataFrame, id_cols: list[str], n: int, out_col: str = "output", ref_col: str = "reference") -> DataFrame:
    """id_cols, hits, n_out, n_ref, precision, recall, f1: overlap of n-grams, each counted as often as in both."""
    out, ref = ngrams(pairs, id_cols, n, out_col), ngrams(pairs, id_cols, n, ref_col).withColumnRenamed("cnt", "_ref")
    hits = out.join(ref, [*id_cols, "gram"]).groupBy(*id_cols).agg(F.sum(F.least("cnt", "_ref")).alias("_hits"))
    size = lambda c, name: pairs.select(*id_cols, F.greatest(F.size(tx.words(c)) - n + 1, F.lit(0)).cast("long").alias(name))
    rows = size(out_col, "_o").join(size(ref_col, "_r"), id_cols).join(hits, id_cols, "left")
    return _prf(rows, id_cols, F.col("_hits"), F.col("_o"), F.col("_r"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by rows of bits: the cells of one row are one number."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        meet = row & places.get(w, 0)
        row = ((row + meet) | (row - meet)) & full
    return len(b) - row.bit_count()


def rouge_l(pairs: DataFrame, id_cols: list[str], out_col: str = "output", ref_col: str = "reference") -> DataFrame:
    """id_cols, hits, n_out, n_ref, precision, recall, f1: by the longest common subsequence of words."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")

    none = F.expr("cast(array() as array<string>)")
    rows = pairs.select(*id_cols, F.coalesce(tx.words(out_col), none).alias("_a"), F.coalesce(tx.words(ref_col), none).alias("_b"))
    rows = rows.select(*id_cols, run("_a", "_b").cast("long").alias("_h"), F.size("_a").cast("long").alias("_o"), F.size("_b").cast("long").alias("_r"))
    return _prf(rows, id_cols, F.col("_h"), F.col("_o"), F.col("_r"))


def meteor(pairs: DataFrame, id_cols: list[str], out_col: str = "output", ref_col: str = "reference") -> DataFrame:
    """id_cols, matches, chunks, meteor: exact words, matched left to right, harmonic mean of weight 9 to recall, and the
    penalty for chunks."""

    def align(a: list[str], b: list[str]) -> tuple[int, int]:
        places: dict[str, list[int]] = {}
        for i, w in enumerate(b):
            places.setdefault(w, []).append(i)
        used, at, chunks, matches, follows = set(), -2, 0, 0, False
        for w in a:
            free = [i for i in places.get(w, ()) if i not in used]
            if not free:
                follows = False
                continue
            i = at + 1 if at + 1 in free else free[0]
            chunks += not (follows and i == at + 1)
            used.add(i)
            at, follows, matches = i, True, matches + 1
        return matches, chunks

    @F.pandas_udf("struct<matches:int,chunks:int>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(list(x), list(y)) for x, y in zip(a, b, strict=True)], columns=["matches", "chunks"])

    none = F.expr("cast(array() as array<string>)")
    rows = pairs.select(*id_cols, F.coalesce(tx.words(out_col), none).alias("_a"), F.coalesce(tx.words(ref_col), none).alias("_b"))
    rows = rows.select(*id_cols, F.size("_a").alias("_o"), F.size("_b").alias("_r"), run("_a", "_b").alias("m")).select("*", "m.*").drop("m")
    p, r = F.col("matches") / F.col("_o"), F.col("matches") / F.col("_r")
    value = F.when(F.col("matches") > 0, 10 * p * r / (r + 9 * p) * (1 - 0.5 * F.pow(F.col("chunks") / F.col("matches"), 3))).otherwise(0.0)
    return rows.select(*id_cols, "matches", "chunks", value.alias("meteor"))


TILE_ROWS = 65_536


def _below(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many pairs of an item of a and one of b have the first smaller, and how many have it larger."""
    a = np.sort(a)
    return int(np.searchsorted(a, b, "left").sum()), int((len(a) - np.searchsorted(a, b, "right")).sum())


def _ties(*columns: np.ndarray) -> int:
    """Pairs that are alike in all columns."""
    if not len(columns[0]):
        return 0
    _, n = np.unique(np.column_stack(columns), axis=0, return_counts=True)
    return int((n * (n - 1) // 2).sum())


def pair_orders(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Concordant and discordant pairs among rows sorted by x: halves are counted across, then each by itself."""
    if len(x) < 2:
        return 0, 0
    if len(x) <= 32:
        before = x[:, None] < x[None]
        return int((before & (y[:, None] < y[None])).sum()), int((before & (y[:, None] > y[None])).sum())
    middle = len(x) // 2
    one, two = pair_orders(x[:middle], y[:middle]), pair_orders(x[middle:], y[middle:])
    across = _across(x[:middle], y[:middle], x[middle:], y[middle:])
    return one[0] + two[0] + across[0], one[1] + two[1] + across[1]


def _across(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[int, int]:
    """Concordant and discordant pairs of a row (x, y) and one (u, v), where no x is above a u."""
    up, down = _below(y, v)
    if x[-1] == u[0]:  # rows that are alike in x are no pairs
        same_up, same_down = _below(y[x == x[-1]], v[u == u[0]])
        up, down = up - same_up, down - same_down
    return up, down


def kendall_tau(ranks: DataFrame, by: list[str], x: str, y: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """by, n, concordant, discordant, tau (b), p_value: of two orders; p by the normal curve.

    x and y: numbers. Pairs that are alike in x or in y are neither concordant nor discordant; tau's denominator leaves them
    out of its order's pairs; it is 0 if an order has no other pairs. A group's rows are sorted by x and cut into tiles;
    pairs of rows are counted by pairs of tiles, by merging, so no group is one task's and no pair of rows is built.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = ranks.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    order = Window.partitionBy(*keys).orderBy("_x", "_y")
    tiled = rows.withColumn("_i", F.floor((F.row_number().over(order) - 1) / tile_rows).cast("int"))
    last = tiled.groupBy(*keys).agg(F.max("_i").alias("_last"), F.count("*").alias("n"))
    joined = tiled.join(last.drop("n"), keys) if keys else tiled.crossJoin(F.broadcast(last.drop("n")))  # one row
    both = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda t: F.struct(F.least("_i", t).alias("p"), F.greatest("_i", t).alias("q")))
    dealt = joined.select(*keys, "_i", "_x", "_y", F.explode(both).alias("_t")).select(*keys, "_i", "_x", "_y", F.col("_t.p").alias("_p"), F.col("_t.q").alias("_q"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select(*keys).schema)

    def count(table: pa.Table) -> pa.Table:
        tile, u, v = table["_i"].to_numpy(), table["_x"].to_numpy(), table["_y"].to_numpy()
        p, q = table["_p"][0].as_py(), table["_q"][0].as_py()
        at = np.lexsort((v, u, tile))
        tile, u, v = tile[at], u[at], v[at]
        cut = int((tile == p).sum())
        up, down = pair_orders(u, v) if p == q else _across(u[:cut], v[:cut], u[cut:], v[cut:])
        got = {"concordant": up, "discordant": down}
        return pa.table([*(table[k].slice(0, 1) for k in keys), *(pa.array([n], pa.int64()) for n in got.values())], names=[*keys, *got])

    sums = dealt.groupBy(*keys, "_p", "_q").applyInArrow(count, ", ".join([*([kinds] if kinds else []), "concordant long, discordant long"]))
    sums = sums.groupBy(*keys).agg(F.sum("concordant").alias("concordant"), F.sum("discordant").alias("discordant"))
    pairs = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))
    tied = lambda c, name: rows.groupBy(*keys, c).agg(F.count("*").alias("_c")).groupBy(*keys).agg(pairs("_c").alias(name))
    out = last.drop("_last")
    for part in (sums, tied("_x", "_tx"), tied("_y", "_ty")):
        out = out.join(part, keys, "left") if keys else out.crossJoin(F.broadcast(part))  # one row each
    out = out.na.fill(0, ["concordant", "discordant"])
    n = F.col("n").cast("double")
    whole = n * (n - 1) / 2
    size = F.sqrt((whole - F.col("_tx")) * (whole - F.col("_ty")))
    out = out.withColumn("tau", F.when(size > 0, (F.col("concordant") - F.col("discordant")) / size).otherwise(0.0))
    z = F.abs(F.col("tau")) / F.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1)))
    # 2 * (1 - normal(z)), by the approximation 7.1.26 of Abramowitz and Stegun's handbook
    t = 1 / (1 + 0.3275911 * z / F.sqrt(F.lit(2.0)))
    series = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    p_value = F.when(F.col("n") > 1, F.round(series * F.exp(-z * z / 2), 6)).otherwise(1.0)
    return out.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), "n", "concordant", "discordant", "tau", p_value.alias("p_value"))


def rank_pair_accuracy(ranks: DataFrame, by: list[str], predicted: str, gold: str) -> DataFrame:
    """by, total_pairs, correct_pairs, accuracy: neighbours in the predicted order that the gold orders the same way."""
    order = Window.partitionBy(*by).orderBy(predicted)
    rows = ranks.withColumn("_before", F.lag(gold).over(order)).filter("_before is not null")
    rows = rows.groupBy(*by).agg(F.count("*").alias("total_pairs"), F.count_if(F.col("_before") < F.col(gold)).alias("correct_pairs"))
    return rows.withColumn("accuracy", ratio(F.col("correct_pairs"), F.col("total_pairs")))


def greedy_matching(left: DataFrame, right: DataFrame, by: list[str], vector_col: str = "vec", baseline: Sequence[float] | None = None, tile_rows: int = 2048) -> DataFrame:
    """by, precision, recall, f1: each vector's best cosine on the other side, averaged; vectors come from any table.

    baseline: precision, recall and f1 of unrelated texts; each score is then rescaled so that its baseline becomes 0 and 1
    stays 1. Both sides are dealt into tiles, whose cosines are matrix products; a tile returns the best of its rows alone. A zero vector's cosines
    are 0; null vectors are left out, and groups that lack a side.
    """
    keys = [f"_k{i}" for i in range(len(by))]

    def numbered(rows: DataFrame) -> DataFrame:
        """Rows with their tile and how many tiles their group has."""
        rows = rows.filter(F.col(vector_col).isNotNull()).select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(vector_col).cast("array<double>").alias("_v"))
        rows = settle(rows.withColumn("_n", F.monotonically_increasing_id()))
        tiles = rows.groupBy(*keys).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("_tiles"))
        rows = rows.join(tiles, keys) if keys else rows.crossJoin(F.broadcast(tiles))  # one row
        return rows.withColumn("_tile", F.pmod(F.xxhash64("_n"), F.col("_tiles")).cast("int"))

    a, b = numbered(left), numbered(right)
    many = lambda rows, name: rows.groupBy(*keys).agg(F.first("_tiles").alias(name))
    meet = lambda rows, other: rows.join(other, keys) if keys else rows.crossJoin(F.broadcast(other))  # noqa: E731  one row
    every = F.explode(F.sequence(F.lit(0), F.col("_other") - 1))
    one = meet(a, many(b, "_other")).select(*keys, "_n", "_v", F.col("_tile").alias("_p"), every.alias("_q"))
    two = meet(b, many(a, "_other")).select(*keys, "_n", "_v", every.alias("_p"), F.col("_tile").alias("_q"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.select(*keys).schema)

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        names = [*keys, "_side", "_n", "_c"]
        if not x.num_rows or not y.num_rows:
            return pa.table([*(x[k].slice(0, 0) for k in keys), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        like = unit(x["_v"]) @ unit(y["_v"]).T
        firsts = [pa.concat_arrays([x[k].combine_chunks().slice(0, 1)] * (x.num_rows + y.num_rows)) for k in keys]
        side = pa.array(np.repeat(np.arange(2, dtype=np.int32), [x.num_rows, y.num_rows]))
        ids = pa.array(np.concatenate([x["_n"].to_numpy(), y["_n"].to_numpy()]))
        return pa.table([*firsts, side, ids, pa.array(np.concatenate([like.max(axis=1), like.max(axis=0)]))], names=names)

    tile = [*keys, "_p", "_q"]
    found = one.groupBy(*tile).cogroup(two.groupBy(*tile)).applyInArrow(best, ", ".join([*([kinds] if kinds else []), "_side int, _n long, _c double"]))
    found = found.groupBy(*keys, "_side", "_n").agg(F.max("_c").alias("_c"))
    mean = lambda side: F.avg(F.when(F.col("_side") == side, F.col("_c")))
    out = found.groupBy(*keys).agg(mean(0).alias("precision"), mean(1).alias("recall"))
    out = out.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), "precision", "recall").withColumn("f1", f1(F.col("precision"), F.col("recall")))
    if baseline is None:
        return out
    scaled = lambda c, at: ((F.col(c) - at) / (1 - at)).alias(c)
    return out.select(*by, *(scaled(c, at) for c, at in zip(("precision", "recall", "f1"), baseline, strict=True)))


def metrics_table(values: dict[str, object]) -> list[tuple[str, str, str]]:
    """Rows (metric, measure, value) of the summary; numbers with a point to four digits, what is missing empty."""
    names = [(f"ROUGE-{k}", m, f"rouge{k}_{f}") for k in ("1", "2", "L") for m, f in (("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"))]
    names += [("BERTScore", m, f"bertscore_{m.lower()}") for m in ("Precision", "Recall", "F1")]
    names += [("METEOR", "Score", "meteor"), ("Kendall's Tau", "Tau", "kendalls_tau"), ("Kendall's Tau", "p-value", "kendalls_tau_p_value"), ("Kendall's Tau", "N events", "kendalls_tau_n"), ("Adj. Pair Accuracy", "Accuracy", "adjacent_pair_accuracy")]
    say = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    rows = [(metric, measure, say(values.get(key))) for metric, measure, key in names]
    rows.append(("Adj. Pair Accuracy", "Correct / Total", f"{say(values.get('adjacent_pair_correct'))}/{say(values.get('adjacent_pair_total'))}"))
    rows += [("Redundancy (3-gram)", "Ratio", say(values.get("ngram_redundancy"))), ("Redundancy (sentence)", "Ratio", say(values.get("sentence_redundancy")))]
    return rows


def evaluate(events: DataFrame, tlinks: DataFrame, alignments: DataFrame, narrative: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """metric, value: all metrics of a run in one table; those that need gold links only if there are some."""
    spark = events.sparkSession
    parts: list[tuple[str, DataFrame, str]] = []
    if gold is not None:
        scores = temporal_f1(tlinks, gold)
        parts.append(("temporal_ordering_accuracy", ordering_accuracy(tlinks, gold), "accuracy"))
        parts += [(f"temporal_{m}", scores, m) for m in ("precision", "recall", "f1")]
        parts.append(("adjacent_pair_accuracy", adjacent_pair_accuracy(tlinks, gold), "accuracy"))
    one = narrative.select(F.lit(0).alias("id"), F.col("narrative").alias("text"))
    parts.append(("entity_coverage", entity_coverage(events, narrative), "coverage"))
    parts.append(("narrative_coherence_score", coherence(one, ["id"]), "coherence"))
    parts.append(("redundancy_ratio", redundancy_ratio(one, ["id"]), "ratio"))
    parts += [(f"total_{k}", df.agg(F.count("*").alias("n")), "n") for k, df in (("events", events), ("tlinks", tlinks), ("alignments", alignments))]
    out = spark.createDataFrame([], "metric string, value double")
    for name, df, column in parts:
        out = out.unionByName(df.select(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value")))
    return out
