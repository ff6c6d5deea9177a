"""What the operators share: the shared work folder, cutting lineage, and sums that run over a hot key."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEPT: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="storyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it goes when the driver ends, or by drop_path()."""
    path = f"{work_dir(spark)}/storyloom/{what}-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _KEPT:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table written to the shared folder: lost executors do not lose it, and it is made once."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.storyloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    drop_path(df.sparkSession, df.storyloom_path)
    _KEPT[:] = [k for k in _KEPT if k[1] != df.storyloom_path]


def written_alone(make: Callable[[], DataFrame], what: str) -> DataFrame:
    """make() as a written table, without the tables that were written on the way to it."""
    before = len(_KEPT)
    out = written(make(), what)
    for spark, path in _KEPT[before:]:
        if path != out.storyloom_path:
            drop_path(spark, path)
    _KEPT[before:] = [(out.sparkSession, out.storyloom_path)]
    return out


def fresh_names(columns: list[str], *stems: str) -> list[str]:
    """A name for each stem that none of the columns has, in any case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def give_back() -> None:
    """Give freed memory back: Python workers live on, and what their allocators keep would add up over the stages of a long
    job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc keeps what it likes
        pass


def tidy(run: Callable) -> Callable:
    """run, a function of record batches, giving freed memory back when a task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def values(column: pa.Array, n: int = 256) -> Iterator:
    """A column's values as Python objects, some rows at a time."""
    for at in range(0, len(column), n):
        yield from column.slice(at, n).to_pylist()


def running_before(df: DataFrame, key: str, order: str, value: str, out: str, buckets: int) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same key that come before in `order` (a long from 0 up to 2**62).

    A hot key isn't gathered: rows are dealt by (key, range of `order`); the ranges' totals, at most `buckets` a key, are
    summed up apart. `order` should be spread evenly, as a hash is, and unique within a key.
    """
    width = (1 << 62) // buckets
    cut = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)).cast("long"))
    totals = cut.groupBy(key, "_bucket").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(key, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = cut.join(totals, [key, "_bucket"])
    return joined.withColumn(out, F.col("_base") + F.col("_within")).drop("_bucket", "_base", "_within")


#: Bits of a filter, in parts of 512 longs: 4 MB are broadcast, whatever the number of keys.
FILTER_BITS = 1 << 25


def _place(key) -> tuple:
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return F.shiftright(at, 15).cast("int"), (F.shiftright(at, 6) % 512).cast("int"), (at % 64).cast("int")


def maybe_in(rows: DataFrame, key, keys: DataFrame, flag: str) -> DataFrame:
    """rows with a column `flag`: false where `key` isn't in the only column of `keys`; true where it may be.

    key: a column or expression of the same type as that of keys. A broadcast of bounded size spares a join the shuffle of
    rows that have no partner; it lets more through as keys get many, but never loses one. Columns of rows may have any
    names but that of the flag.
    """
    at, cells = fresh_names([*rows.columns, flag], "_part", "_words")
    part, word, bit = _place(F.col(keys.columns[0]))
    words = keys.select(part.alias(at), word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_mask"))
    words = words.groupBy(at, "_word").agg(F.bit_or("_mask").alias("_mask"))
    parts = words.groupBy(at).agg(F.map_from_entries(F.collect_list(F.struct("_word", "_mask"))).alias("_m"))  # 512 entries at most
    filled = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0).cast("long")))
    parts = F.broadcast(parts.select(at, filled.alias(cells)))
    part, word, bit = _place(key)
    joined = rows.withColumn(at, part).join(parts, at, "left")
    return joined.withColumn(flag, F.coalesce(F.getbit(F.get(cells, word), bit) == 1, F.lit(False))).drop(at, cells)


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds `out`: a row's place, from 0, in the order of these columns, as a written table.

    Rows are counted by ranges of the order; the ranges' totals, a row a partition, are summed up apart.
    """
    at, base = fresh_names([*df.columns, out], "_at", "_base")
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranged")
    part, within = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))  # how Spark puts these numbers together
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base)).withColumnRenamed("_p", fresh_names(ranged.columns, "_p")[0])
    joined = ranged.join(F.broadcast(bases), part == F.col(bases.columns[0]))
    return joined.withColumn(out, (F.col(base) + within).cast("long")).select(*df.columns, out)


def components(links: DataFrame) -> DataFrame:
    """doc, component: the smallest identifier that each end of `links` (a, b; longs) reaches.

    Large-star and small-star steps by turns, as aggregates and joins. A hub's links go through joins on its identifier,
    whose hot keys adaptive execution splits; they are never one group in memory. It ends when a step changes no edge: the
    count and the sum of all edges' 64-bit hashes are the same. Each step is a written table.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.filter("u <> v").distinct(), "links")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        forget(edges)
        edges = after
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct())
