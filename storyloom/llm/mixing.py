"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: the budget, a share of all words, goes to the sources by weight; a source takes LIMIT times its words at most,
   and what it can't take is shared among the others by weight, in rounds until none is above. Sources are numbered by
   ranges of their names, so hosts may be sources, too.
2. Blocks: each source's documents follow each other in the order of a digest; each BLOCK_WORDS words are a block. Where a
   document begins is a running sum, made per (source, range of the digest), so a hot source isn't one task.
3. Slots: point k is frac(k / golden ratio), in steps of 2 ** -32; after 2 ** 32 slots the points come again. It falls into
   the interval of a source, whose width is the source's number of blocks to take; its rank among the source's slots is the
   block it takes, over again once all are taken. Ranks that the points leave out follow behind; ranks beyond the target
   are dropped, and the last block is cut to it.
4. Slots join blocks; sums by document and pass say how much of a document the mix takes, and its first slot where.

Edge cases: null or blank text has no words and takes no part; a null source is a source of its own, the last; rows are
told apart even if they repeat; without any words all targets are 0, as is a target by weight 0; an empty table gives an
empty result; other columns, of any type, are kept by mix() and ignored by shares().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import numbered, running_before, written

BLOCK_WORDS = 64
BUDGET, LIMIT = 1.5, 2
#: The golden ratio's fraction of 2**32, an odd number, so that each of 2**32 points is met once.
_GOLDEN, _RANGE = 2654435769, 1 << 32
_CELLS = 4096
_SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """The number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float], budget: float = BUDGET, limit: float = LIMIT) -> DataFrame:
    """source, source_no, source_size, target: a row for each source of (source, size)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = numbered(totals, [F.col("source").asc_nulls_last()], "source_no")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    totals = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(limit))
    whole, free = totals.agg(F.sum("source_size"), F.sum("weight")).first()
    whole, free, full, n_full, level = (whole or 0) * float(budget), free or 0.0, (0.0, 0.0), 0, 0.0
    while free > full[1]:  # each round fills the sources that the level before was too high for
        level = (whole - full[0]) / (free - full[1])
        above = totals.filter(F.col("most") < F.col("weight") * level)
        n, most, used = above.agg(F.count("*"), F.sum("most"), F.sum("weight")).first()
        if n == n_full:
            break
        n_full, full = n, (most, used)
    target = F.least("most", F.col("weight") * level)
    return totals.select("source", "source_no", "source_size", target.alias("target"))


def point_of(slot: Column) -> Column:
    """The golden-ratio point of a slot, from 0 to below 1. Products are made of 16 bits at a time: they stay below 2**63."""
    k = slot % _RANGE
    high, low = F.shiftright(k, 16), k % 65536
    return (high * _GOLDEN % _RANGE * 65536 + low * _GOLDEN) % _RANGE / float(_RANGE)


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source_no, slot, pass, block, words: which block each slot of the mix takes, and how many of its words.

    plan: rows of targets(). The order of `slot` is the order of the mix.
    """
    spark = plan.sparkSession
    need = plan.filter("target >= 1 and source_size > 0")
    need = need.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    # passes that are whole, then blocks of the last
    passes, rest = F.floor(F.col("target") / F.col("source_size")), F.floor(F.col("target")) % F.col("source_size")
    need = need.withColumn("n_slots", (passes * F.col("n_blocks") + F.ceil(rest / block_words)).cast("long"))
    upto = F.sum("n_slots").over(Window.orderBy("source_no"))
    need = need.withColumn("high", upto).withColumn("low", F.col("high") - F.col("n_slots"))
    need = written(need.withColumn("total", F.sum("n_slots").over(Window.partitionBy(F.lit(0)))), "sources")
    total = need.agg(F.max("total")).first()[0] or 0
    points = spark.range(total).select(F.col("id").alias("slot"), point_of(F.col("id")).alias("point")).withColumn("cell", F.floor(F.col("point") * _CELLS).cast("int"))
    low, high = F.col("low") / F.col("total"), F.col("high") / F.col("total")
    cells = need.select("source_no", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.floor(low * _CELLS).cast("int"), F.least(F.floor(high * _CELLS), F.lit(_CELLS - 1)).cast("int"))).alias("cell"))
    mine = points.join(cells, "cell").filter("point >= low and point < high").select("source_no", "slot")
    spread = max(1, (1 << 62) // max(1, total) - 1)
    mine = running_before(mine.withColumn("_order", F.col("slot") * spread).withColumn("_one", F.lit(1)), "source_no", "_order", "_one", "rank", _buckets(total))
    mine = mine.select("source_no", "slot", F.col("rank").cast("long").alias("rank"))
    have = mine.groupBy("source_no").agg(F.count("*").alias("have"))
    short = need.join(have, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).filter("have < n_slots")
    late = short.select("source_no", F.explode(F.sequence("have", F.col("n_slots") - 1)).alias("rank"))
    late = late.select("source_no", (F.lit(total) + F.col("rank")).alias("slot"), "rank")
    slots = mine.unionByName(late).join(need.select("source_no", "source_size", "target", "n_blocks", "n_slots"), "source_no").filter("rank < n_slots")
    turn, block = F.floor(F.col("rank") / F.col("n_blocks")).cast("long"), F.col("rank") % F.col("n_blocks")
    slots = slots.withColumn("pass", turn).withColumn("block", block)
    left = F.floor(F.col("target")).cast("long") - F.col("pass") * F.col("source_size") - F.col("block") * block_words
    words = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words, left)
    return slots.select("source_no", "slot", "pass", "block", words.alias("words"))


def _buckets(rows: int) -> int:
    return min(1 << 16, max(16, rows // 10_000))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _key(docs: DataFrame) -> list[Column]:
    """128 bits of all columns of a row; columns with maps, which have no hash, count as JSON."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema]
    return [F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(1), *parts).alias("_k2")]


def order_of(id_col: str, source_col: str, text_col: str) -> Column:
    """60 bits of a digest, by which a source's documents follow each other, as a number below 2**62."""
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))]
    return F.conv(F.left(F.md5(F.concat(*parts)), F.lit(15)), 16, 10).cast("long") * 4


def _taken(docs: DataFrame, weights: Sequence[float], id_col: str, text_col: str, source_col: str, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and keys of the documents by row number; what is taken of each in each pass; the targets."""
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text).alias("size"), order_of(id_col, source_col, text_col).alias("order"), *_key(docs))
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    plan = written(targets(sized.select("source", "size"), weights), "targets")
    slots = schedule(plan, block_words)
    rows = sized.filter("size > 0").select("row", "source", "size", "order").join(plan.select(F.col("source").alias("_s"), "source_no"), F.col("source").eqNullSafe(F.col("_s")))
    rows = running_before(rows.select("row", "source_no", "size", "order"), "source_no", "order", "size", "start", _buckets(sized.count()))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = rows.select("row", "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    base = F.col("block") * block_words
    parts = parts.select("row", "source_no", "block", F.greatest(F.col("start") - base, F.lit(0)).alias("from"), F.least(F.col("start") + F.col("size") - base, F.lit(block_words)).alias("to"))
    met = parts.join(slots, ["source_no", "block"]).withColumn("n", F.least("to", "words") - F.col("from")).filter("n > 0")
    return sized, met.groupBy("row", "pass").agg(F.sum("n").cast("long").alias("taken"), F.min("slot").alias("slot")), plan


def shares(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken: words of each document that the mix takes, repeats counted."""
    sized, taken, plan = _taken(docs, weights, id_col, text_col, source_col, block_words)
    whole = taken.groupBy("row").agg(F.sum("taken").alias("taken"))
    out = sized.join(whole, "row", "left").join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, positions: bool = False) -> DataFrame:
    """docs as the mix takes them: a row for each pass over a document, its text cut to the words taken.

    positions adds mix_slot, the slot of the row's first block: the order of the mix. Texts are read again and joined by
    their rows' keys, not kept beside the sizes; rows that are alike in all columns share a key and are told apart by what
    is taken of each.
    """
    sized, taken, _ = _taken(docs, weights, id_col, text_col, source_col, block_words)
    parts = written(taken.join(sized.select("row", "size", "_k1", "_k2"), "row").select("_k1", "_k2", "size", "taken", "slot"), "taken")
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns), *_key(docs))
    if sized.count() > sized.select("_k1", "_k2").distinct().count():
        keyed = keyed.dropDuplicates(["_k1", "_k2"])
    text = F.col(f"in_{text_col}")
    words = F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != "")
    cut = F.when(F.col("taken") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), " ")).otherwise(text)
    out = keyed.join(parts, ["_k1", "_k2"])
    cols = [(cut if c == text_col else F.col(f"`in_{c}`")).alias(c) for c in docs.columns]
    return out.select(*cols, *([F.col("slot").alias("mix_slot")] if positions else []))


def oracle(weights: Sequence[float], table: str = "documents") -> str:
    """The rows of shares() for DuckDB, over a table of doc_id, text and source."""
    given = ", ".join(f"{float(w)!r}::double" for w in weights)
    n = BLOCK_WORDS
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(source, ''), ':', md5(coalesce(text, '')))), 1, 15)) AS BIGINT) AS spot FROM {table}),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY 1),
b AS (SELECT *, [{given}][CAST(no % {len(weights)} + 1 AS INT)] AS weight, source_size * {float(LIMIT)!r}::double AS most FROM a),
s AS (
  SELECT *, sum(source_size) OVER () * {BUDGET!r}::double AS budget, sum(weight) OVER () AS weights,
    coalesce(sum(most) OVER w, 0) AS before, coalesce(sum(weight) OVER w, 0) AS used FROM b
  WINDOW w AS (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most < weight * ((budget - before) / (weights - used)) AS capped FROM s),
l AS (SELECT (any_value(budget) - coalesce(sum(most) FILTER (capped), 0)) / nullif(any_value(weights) - coalesce(sum(weight) FILTER (capped), 0), 0) AS level FROM f),
plan AS (SELECT source, no, source_size, CASE WHEN capped THEN most ELSE least(most, weight * coalesce(level, 0)) END AS target FROM f, l),
need AS (
  SELECT *, sum(n_slots) OVER () AS total, sum(n_slots) OVER (ORDER BY no) AS high FROM (
    SELECT *, CAST(floor(target / source_size) * n_blocks + ceil((floor(target) % source_size) / {n}.0) AS BIGINT) AS n_slots
    FROM (SELECT *, CAST(ceil(source_size / {n}.0) AS BIGINT) AS n_blocks FROM plan WHERE target >= 1 AND source_size > 0))),
points AS (SELECT k, (k * {_GOLDEN} % {_RANGE}) / {float(_RANGE)!r}::double AS point FROM range(coalesce((SELECT CAST(max(total) AS BIGINT) FROM need), 0)) r(k)),
mine AS (
  SELECT no, k AS slot, row_number() OVER (PARTITION BY no ORDER BY k) - 1 AS rank
  FROM points JOIN need ON point >= (high - n_slots)::double / total::double AND point < high::double / total::double),
late AS (
  SELECT no, CAST(unnest(range(have, n_slots)) AS BIGINT) AS rank FROM (
    SELECT no, n_slots, (SELECT count(*) FROM mine m WHERE m.no = need.no) AS have FROM need) WHERE have < n_slots),
slots AS (
  SELECT no, rank // n_blocks AS pass, rank % n_blocks AS block,
    least({n}, source_size - (rank % n_blocks) * {n}, CAST(floor(target) AS BIGINT) - (rank // n_blocks) * source_size - (rank % n_blocks) * {n}) AS words
  FROM (SELECT no, rank FROM mine UNION ALL SELECT no, rank FROM late) JOIN need USING (no) WHERE rank < n_slots),
starts AS (
  SELECT row, no, d.size, sum(d.size) OVER (PARTITION BY no ORDER BY spot, row ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source WHERE d.size > 0),
parts AS (
  SELECT row, no, block, greatest(start - block * {n}, 0) AS low, least(start + size - block * {n}, {n}) AS high FROM (
    SELECT *, unnest(range(CAST(start // {n} AS BIGINT), CAST((start + size - 1) // {n} + 1 AS BIGINT))) AS block FROM starts)),
taken AS (SELECT row, CAST(sum(greatest(least(high, words) - low, 0)) AS BIGINT) AS taken FROM parts JOIN slots USING (no, block) GROUP BY 1)
SELECT doc_id, d.size AS size, source_size, target, coalesce(taken, 0) AS taken FROM d LEFT JOIN taken USING (row) LEFT JOIN plan ON d.source IS NOT DISTINCT FROM plan.source"""
