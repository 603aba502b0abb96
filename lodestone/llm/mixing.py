"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common as C

#: Words left to the dynamic programme after whole rounds, proportional and largest-first takes.
BUDGET = 1 << 16
#: Hash buckets in which the documents of one source and length are ranked.
BUCKETS = 1024
SEED = 17
#: Sources times lengths up to which their limits are sent to every task; beyond, documents are shuffled to them.
MOST_SENT = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share of all sizes by weight; a source over most times its size stops there and its excess goes to the others by weight, until none is above."""
    out = [0.0] * len(sizes)
    budget, free = share * sum(sizes), list(range(len(sizes)))
    while free:
        each = budget / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * each > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * each
            break
        for i in over:
            out[i] = most * sizes[i]
            budget -= out[i]
        free = [i for i in free if out[i] == 0 and i not in set(over)]
    return out


def fit(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length to take, so that their words sum to the budget or as near below it as found.

    First the same fraction of every length, then the largest first down to BUDGET words, and a bounded-knapsack dynamic
    programme over the rest: reachable sums are bits of one integer, counts are split in powers of two, and it stops as
    soon as the budget is reached exactly."""
    take = [0] * len(lengths)
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if total <= budget:
        return [c if n > 0 else 0 for n, c in zip(lengths, counts, strict=True)]
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    for i in order:
        take[i] = counts[i] * budget // total
    rest = budget - sum(lengths[i] * take[i] for i in order)
    for i in order:
        more = min(counts[i] - take[i], max(0, (rest - BUDGET) // lengths[i]))
        take[i] += more
        rest -= more * lengths[i]
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for i in reversed(order):
        left, n = counts[i] - take[i], 1
        while left > 0 and not reach >> rest & 1:
            n = min(n, left)
            if n * lengths[i] > rest:
                break
            steps.append((reach, i, n))
            reach |= reach << n * lengths[i] & mask
            left, n = left - n, 2 * n
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for before, i, n in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * lengths[i]
    return take


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes of the document, repeats counted) and times.

    Sources by code point, null last, weigh as given, repeating. A target of q whole sources and a rest takes every
    document q times, and the rest from documents chosen once more: lengths are counted, fit() says how many of each
    length, and the seeded hash of id and text says which: those up to a limit for each source and length, so that texts
    needn't be sorted or shuffled. Rows with equal id and text have one hash; where a limit falls among such rows, they are
    numbered (which of them comes first isn't told: they differ in other columns at most).
    Documents without words, null texts among them, have size 0, times q and taken 0. Reruns agree. An empty table gives
    no rows; the names added here replace columns of docs that have them. The driver holds one row for each source."""
    if (whole := int(most)) != most:
        raise ValueError("most must be whole")
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "times")]
    source = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(F.col("text").cast("binary")))
    rows = docs.select(F.struct(*[F.col(c) for c in rest]).alias("row"), C.word_count(F.col("text")).alias("size"), source.alias("key"), hashed.alias("hash"))
    slim = C.staged(rows.select("key", "size", "hash", F.pmod("hash", F.lit(BUCKETS)).cast("int").alias("bucket")), "mix-sizes")
    counts = C.staged(slim.groupBy("key", "size", "bucket").agg(F.count("*").alias("n")), "mix-counts")
    sizes = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()
    sizes.sort(key=lambda r: (r["key"] == "-", r["key"]))
    goal = targets([r["s"] for r in sizes], [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    plan = []
    for r, t in zip(sizes, goal, strict=True):
        q = min(whole, int(t // r["s"])) if r["s"] else 0
        plan.append((r["key"], r["s"], t, q, 0 if q == whole else round(t - q * r["s"])))
    plan = spark.createDataFrame(plan, "key string, source_size long, target double, whole int, rest long")

    def fitted(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("size")
        return t[["key", "size"]].assign(take=fit(t["size"].tolist(), t["n"].tolist(), int(t["rest"].iloc[0])))

    lengths = counts.groupBy("key", "size").agg(F.sum("n").alias("n")).join(plan.select("key", "rest"), "key")
    takes = lengths.groupBy("key").applyInPandas(fitted, "key string, size long, take long")
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("take") - F.coalesce(F.sum("n").over(before), F.lit(0))
    needs = counts.join(takes, ["key", "size"]).withColumn("need", left).where("need > 0")
    parts = C.staged(needs.select("key", "size", "bucket", "n", "need"), "mix-needs")
    # the one bucket of each source and length that isn't taken whole: up to which hash
    split = parts.where("need < n").select("key", "size", "bucket", "need")
    hashes = slim.join(split, ["key", "size", "bucket"]).groupBy("key", "size", "bucket", "need", "hash").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("key", "size").orderBy("hash"))
    hashes = C.staged(hashes.withColumn("upto", upto), "mix-hashes")
    limits = hashes.where("upto <= need").groupBy("key", "size").agg(F.max("hash").alias("last"))
    edges = hashes.where("upto > need AND upto - m < need").select(F.struct("key", "size", "hash").alias("edge"), (F.col("need") - F.col("upto") + F.col("m")).alias("quota"), "m")
    edges = C.staged(edges, "mix-edges")
    begun = split.select("key", "size", F.col("bucket").alias("part")).join(limits, ["key", "size"], "left")
    done = parts.where("need >= n").groupBy("key", "size").agg(F.max("bucket").alias("until"))
    chosen = done.join(begun, ["key", "size"], "full_outer")
    table = lengths.join(chosen, ["key", "size"], "left").join(plan.drop("rest"), "key")
    table = C.staged(table.select(F.struct("key", "size").alias("of"), "n", "source_size", "target", "whole", "until", "part", "last"), "mix-limits")
    values = ["source_size", "target", "whole", "until", "part", "last"]
    keyed = rows.select("row", "hash", F.struct("key", "size").alias("of"))
    if table.count() <= MOST_SENT:
        out = keyed.join(F.broadcast(table.drop("n")), "of")
    else:
        out = C.lookup(keyed, table, "of", values, "n", F.col("hash"))
    C.drop_staged(slim, counts, parts, hashes)
    bucket = F.pmod("hash", F.lit(BUCKETS))
    once = F.coalesce(bucket <= F.col("until"), F.lit(False)) | F.coalesce((bucket == F.col("part")) & (F.col("hash") <= F.col("last")), F.lit(False))
    if n_edges := edges.count():
        out = _numbered(out.withColumn("edge", F.struct(F.col("of")["key"].alias("key"), F.col("of")["size"].alias("size"), "hash")), edges, n_edges)
        once = once | F.coalesce(F.col("number") < F.col("quota"), F.lit(False))
    times = F.col("whole") + once.cast("int")
    size = F.col("of")["size"]
    return out.select(*[F.col("row")[c].alias(c) for c in rest], size.alias("size"), "source_size", "target", (size * times).alias("taken"), times.alias("times"))


def _numbered(rows: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """rows with quota, and number from 0 within their edge, for those whose edge is among the n edges (null for others).

    Rows of edges are written sorted by edge within the partitions that they lie in; a row's number is its place there plus
    the edge's rows in the partitions before, so that no group of equal rows is shuffled or sorted whole."""
    if n <= MOST_SENT:
        told = rows.join(F.broadcast(edges.select("edge", "quota")), "edge", "left")
    else:
        told = C.lookup(rows, edges, "edge", ["quota"], "m", F.monotonically_increasing_id())
    own = told.where("quota IS NOT NULL").sortWithinPartitions("edge")
    own = C.staged(own.withColumns({"at": F.monotonically_increasing_id(), "lies": F.spark_partition_id()}), "mix-equal")
    counts = own.groupBy("edge", "lies").agg(F.count("*").alias("held"), F.min("at").alias("begin"))
    earlier = F.sum("held").over(Window.partitionBy("edge").orderBy("lies").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("edge", "lies", (F.coalesce(earlier, F.lit(0)) - F.col("begin")).alias("shift"))
    done = own.join(shifts, ["edge", "lies"]).withColumn("number", F.col("at") + F.col("shift"))
    columns = [*rows.columns, "quota", "number"]
    return told.where("quota IS NULL").withColumn("number", F.lit(None).cast("long")).select(*columns).unionAll(done.select(*columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents by the weights 3, 1, 2, 150% of all sizes and at most twice a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mixing": op9_mixing}
SQL: dict[str, str] = {}
