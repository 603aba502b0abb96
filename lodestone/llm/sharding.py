"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts)."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common as C

#: Parcels in a shard's capacity: groups smaller than a parcel travel in parcels, so the driver packs a bounded number of items.
PARCELS = 1024
#: Groups that one task packs into parcels, about.
PART_GROUPS = 100_000
#: Rows of a shard that one task numbers at once, about.
SLOT_ROWS = 500_000


class Bins:
    """Bins in an AA tree ordered by (remaining capacity, bin): the tightest bin that still takes an item is found in logarithmic time."""

    def __init__(self) -> None:
        self.root: list | None = None  # node: [key, level, left, right]

    def add(self, key: tuple[int, int]) -> None:
        def into(t: list | None) -> list:
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = into(t[side])
            return self._split(self._skew(t))

        self.root = into(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def out(t: list | None, key: tuple[int, int]) -> list | None:
            if t is None:
                return None
            if key != t[0]:
                side = 2 if key < t[0] else 3
                t[side] = out(t[side], key)
            elif t[2] is None or t[3] is None:
                return t[2] or t[3]
            else:
                next_up = t[3]
                while next_up[2]:
                    next_up = next_up[2]
                t[0] = next_up[0]
                t[3] = out(t[3], t[0])
            level = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
            if level < t[1]:
                t[1] = level
                if t[3] and t[3][1] > level:
                    t[3][1] = level
            t = self._skew(t)
            if t[3]:
                t[3] = self._skew(t[3])
                if t[3][3]:
                    t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            if t[3]:
                t[3] = self._split(t[3])
            return t

        self.root = out(self.root, key)

    @staticmethod
    def _skew(t: list) -> list:
        if t[2] and t[2][1] == t[1]:
            low = t[2]
            t[2], low[3] = low[3], t
            return low
        return t

    @staticmethod
    def _split(t: list) -> list:
        if t[3] and t[3][3] and t[3][3][1] == t[1]:
            high = t[3]
            t[3], high[2] = high[2], t
            high[1] += 1
            return high
        return t

    def tightest(self, size: int) -> tuple[int, int] | None:
        best, t = None, self.root
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def best_fit_decreasing(sizes: Iterable[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item; None if more than most bins would be needed. Items over capacity get a bin of their own. Ties go by position."""
    sizes = list(sizes)
    out, bins, n = [0] * len(sizes), Bins(), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        found = bins.tightest(size)
        if found is None:
            if most is not None and n == most:
                return None
            found, n = (max(capacity, size), n), n + 1
        else:
            bins.remove(found)
        out[i] = found[1]
        bins.add((found[0] - size, found[1]))
    return out


def smallest_capacity(sizes: list[int], bins: int) -> tuple[int, list[int]]:
    """The least capacity found by bisection at which best-fit-decreasing needs no more than bins bins, and each item's bin."""
    low = max([1, *sizes, -(-sum(sizes) // bins)])
    high, step = low, max(1, low // 4096)
    while (best := best_fit_decreasing(sizes, high, bins)) is None:
        low, high, step = high + 1, high + step, 2 * step
    while low < high:
        mid = (low + high) // 2
        if (got := best_fit_decreasing(sizes, mid, bins)) is None:
            low = mid + 1
        else:
            high, best = mid, got
    return high, best


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """(id, size, text_crc32, shard, slot, parcel): every row in one of the shards, whose sizes come out near equal.

    Size: UTF-8 bytes plus 1 (null: 1). Rows of equal text are one group, null a group of its own. A group goes whole into a
    shard; only one larger than a shard's fair share, which no shard could take, is cut by the hash of its ids. Groups of
    less than 1/PARCELS of a fair share are first packed into parcels of that size, inside each partition; parcels and
    larger groups, at most a small multiple of shards * PARCELS, are packed into the shards on the driver, at the smallest
    capacity that suffices. An empty table gives no rows; rows with one id are separate rows; slots are gapless from 0 in each shard."""
    spark = docs.sparkSession
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("_group"),
    )
    base = C.staged(base, "shard-base")
    sums = C.staged(base.groupBy("_group").agg(F.sum("size").alias("_size"), F.count("*").alias("_n")), "shard-groups")
    total, n_groups = sums.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    share = max(1, -(-total // shards))
    large = F.broadcast(sums.where(F.col("_size") > share).select(F.col("_group").alias("_g")))  # fewer than shards rows
    cut = F.when(F.col("_g").isNotNull(), F.pmod(F.xxhash64("_id"), F.lit(shards * PARCELS)).cast("int")).otherwise(-1)
    base = base.join(large, F.col("_group") == F.col("_g"), "left").withColumn("_key", F.concat_ws("-", "_group", cut)).drop("_g")
    groups = base.groupBy("_key").agg(F.sum("size").alias("_size"), F.count("*").alias("_n"))
    parcel = max(1, share // PARCELS)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_groups // PART_GROUPS)

    def parcels(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_key", ignore_index=True)
        bins = best_fit_decreasing(t["_size"].tolist(), parcel)
        return t.assign(_parcel=t["_part"].astype("int64") * (1 << 40) + pd.Series(bins, dtype="int64"))

    part = F.pmod(F.xxhash64("_key"), F.lit(n_parts)).cast("int")
    dealt = groups.withColumn("_part", part).repartition(n_parts, "_part").groupBy("_part")
    dealt = C.staged(dealt.applyInPandas(parcels, "_key string, _size long, _n long, _part int, _parcel long"), "shard-parcels")
    items = dealt.groupBy("_parcel").agg(F.sum("_size").alias("s")).orderBy("_parcel").collect()  # bounded by the parcels
    capacity, bins = smallest_capacity([r["s"] for r in items], shards)
    order = sorted(range(shards), key=lambda b: next((i for i, x in enumerate(bins) if x == b), len(bins)))
    number = {b: i for i, b in enumerate(order)}
    placed = spark.createDataFrame([(r["_parcel"], number[b]) for r, b in zip(items, bins, strict=True)] or [(0, 0)], "_parcel long, shard int")
    placed = dealt.join(placed, "_parcel").select("_key", "_n", "_parcel", "shard")
    rows = C.lookup(base, C.staged(placed, "shard-placed"), "_key", ["shard", "_parcel"], "_n", F.col("_id")).drop("_group")
    return with_slots(rows, total_rows=base).select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot", F.col("_parcel").alias("parcel"))


def with_slots(rows: DataFrame, total_rows: DataFrame) -> DataFrame:
    """A gapless slot from 0 in each shard: rows are numbered inside hash buckets, each moved on by the counts of those before it."""
    buckets = max(1, total_rows.count() // SLOT_ROWS) * 16
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_id", "size", "text_crc32")
    return rows.withColumn("_in", F.row_number().over(inside) - 1).join(first, ["shard", "_bucket"]).withColumn("slot", (F.col("_first") + F.col("_in")).cast("long"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sharding": op2_sharding}
SQL: dict[str, str] = {}
