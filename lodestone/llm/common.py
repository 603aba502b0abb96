"""What the training-data operators share: work folders, words, keyed lookups that survive hot keys, components."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word pattern [^\x20\x09-\x0D]+ and the letters that lower-casing touches (fixed values).
SPACES = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the map that tells which rows have none of the keys asked for.
MARKS = 1 << 23
#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lodestone-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: the lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_staged(*frames: DataFrame) -> None:
    """Removes the files of staged frames that nothing reads any more."""
    for df in frames:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            drop_path(df.sparkSession, folder)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that Spark drops the shuffle files and broadcasts of jobs that are done; else they stay until it happens to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds of very long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, though lambdas inside body may name it again and again."""
    return F.transform(F.array(value), body)[0]


def words(text: Column, lower: bool = False) -> Column:
    """The matches of [^\\x20\\x09-\\x0D]+ in order; none for a null text."""
    flat = F.translate(F.coalesce(text, F.lit("")), (UPPER if lower else "") + SPACES, (LOWER if lower else "") + " " * len(SPACES))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def lookup(rows: DataFrame, table: DataFrame, key: str, values: Sequence[str], n: str, spread: Column, key_of: str | None = None) -> DataFrame:
    """rows left-joined with table (one row a key, in key_of if that has another name; n: how many of rows have it), adding values.

    Keys with over 1/HOT_SHARE of all rows, at most HOT_SHARE of them by count, come by a broadcast; rows that have one are
    dealt by spread in the shuffled join of the others, so that no task gets a hot group whole. A null key finds nothing."""
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    is_hot = F.col(n) * HOT_SHARE > total
    hot = table.where(is_hot).select(F.col(key_of or key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = table.where(~is_hot).select(F.col(key_of or key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), F.struct(*values).alias("_cold"))
    named = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    salt = F.when(F.col("_hot_key").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    out = named.withColumn("_salt", salt).join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    found = F.coalesce("_hot", "_cold")
    return out.select(*[F.col(c) for c in rows.columns], *[found[v].alias(v) for v in values])


def word_count(text: Column) -> Column:
    """The number of matches of [^\\x20\\x09-\\x0D]+; 0 for a null text. Texts with single spaces and line ends only aren't parted for it."""
    flat = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))

    def counted(t: Column) -> Column:
        odd = reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in ("  ", *SPACES)]) | F.startswith(t, F.lit(" ")) | F.endswith(t, F.lit(" "))
        plain = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "))) + 1
        return F.when(t == "", 0).when(odd, F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(plain)

    return counted(flat).cast("long")


def marked(rows: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with _maybe: false only where the columns by aren't among keys. A bitmap of MARKS bits, whatever the data's size, comes by a broadcast."""
    at = F.pmod(F.xxhash64(*by), F.lit(MARKS))
    slot, bit = F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")
    marks = keys.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_m"))
    told = rows.withColumns({"_at": slot, "_bit": bit}).join(F.broadcast(marks), F.col("_at") == F.col("_slot"), "left")
    return told.withColumn("_maybe", F.coalesce(F.getbit("_m", F.col("_bit")) == 1, F.lit(False))).drop("_at", "_bit", "_slot", "_m")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b: longs): component is the smallest node that links reach.

    Large-star and small-star rounds (Kiveris et al., 2014): each round is two keyed minima with their joins, written to
    the shared folder; rounds grow with the logarithm of the nodes. No edges give no rows."""
    e = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = staged(edges.where("a != b").select(*e).distinct(), name)
    mark = [F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 32))]
    seen = tuple(now.agg(*mark).first())
    while seen[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        inner = large.join(low, F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(inner.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), name)
        drop_staged(now, large)
        now, before = after, seen
        if before == (seen := tuple(now.agg(*mark).first())):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
