"""Near-duplicates by SimHash: meet-in-the-middle ball hashing over distinct fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common as C

#: Variants that a task holds at once; a bucket with more is split by further bits.
VARIANTS = 1 << 22
#: Sent copies of fingerprints that a bucket should hold about.
BUCKET_ROWS = 100_000
#: A bucket is dealt over more tasks by SPLIT further bits while it has over BUCKET_ROWS rows, or over HOT times the mean and LEAST rows,
#: and over LAST bits are left. Buckets up to which the list of those comes by a broadcast.
SPLIT, HOT, LEAST, LAST, MOST_SENT = 6, 2, 4096, 12, 1_000_000


def shingle_hashes(text: Column, k: int = 4) -> Column:
    """XXH64 (seed 42) of every k-word shingle of the lower-cased text, repeats included; of the whole sequence if it is shorter; none without words."""

    def hashed(ws: Column) -> Column:
        few = F.array(F.xxhash64(F.concat_ws(" ", ws)))
        many = F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(F.concat_ws(" ", *[ws[i + j] for j in range(k)])))
        return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).when(F.size(ws) < k, few).otherwise(many)

    return C.let(C.words(text, lower=True), hashed)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("_hashes")
        lists = batch.column(at)
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        fp = pa.array([_majority(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), fp], names=[*(n for n in batch.schema.names if n != "_hashes"), "_fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id, _fp): a bit of the signed 64-bit fingerprint is 1 if it is set in over half the shingle hashes; 0 without words."""
    C.small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), shingle_hashes(F.col(text_col), k).alias("_hashes"))
    return slim.mapInArrow(_fold, "_id long, _fp long")


def masks(bits: int, radius: int) -> np.ndarray:
    """All words of the given length with at most radius (0 to 2) bits set."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    parts = [np.zeros(1, np.uint64)]
    if radius >= 1:
        parts.append(one)
    if radius >= 2:
        i, j = np.triu_indices(bits, 1)
        parts.append(one[i] | one[j])
    return np.concatenate(parts)


def _meet(fp: np.ndarray, low: np.ndarray, left: np.ndarray, bits: int, reach: int, out: list[np.ndarray]) -> None:
    """Appends to out pairs of positions in fp that share a variant. low: the bits still free; left: how many may still be flipped."""
    sizes = [1, 1 + bits, 1 + bits + bits * (bits - 1) // 2]
    need = sum(int((left == r).sum()) * sizes[r] for r in range(3))
    if need > VARIANTS and bits > 8:
        cut = bits - 4
        top, rest = low >> np.uint64(cut), low & np.uint64((1 << cut) - 1)
        for side in range(16):
            away = np.bitwise_count(top ^ np.uint64(side)).astype(np.int64)
            pick = np.flatnonzero(away <= left)
            if len(pick) > 1:
                found: list[np.ndarray] = []
                _meet(fp[pick], rest[pick], left[pick] - away[pick], cut, reach, found)
                out.extend(pick[x] for x in found)
        return
    owner_bits = max(1, int(len(fp) - 1).bit_length())
    keep = np.uint64(((1 << 64) - 1) ^ ((1 << owner_bits) - 1))
    packed = np.empty(need, np.uint64)
    at = 0
    for r in range(3):
        own = np.flatnonzero(left == r)
        m = masks(bits, r)
        step = max(1, (1 << 18) // len(m))
        for s in range(0, len(own), step):
            part = own[s : s + step]
            mixed = (low[part, None] ^ m) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            packed[at : at + mixed.size] = ((mixed & keep) | part[:, None].astype(np.uint64)).ravel()
            at += mixed.size
    packed.sort()
    run, own = packed & keep, (packed & ~keep).astype(np.int64)
    same = np.flatnonzero(run[1:] == run[:-1])
    if not len(same):
        return
    a, b = own[same], own[same + 1]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= reach
    out.append(np.unique(np.stack([a[near], b[near]], 1), axis=0))
    for r in np.unique(run[same[~near]]):  # two variants with one hash: all pairs of that run are compared
        s, e = np.searchsorted(run, r, "left"), np.searchsorted(run, r, "right")
        ids = np.unique(own[s:e])
        for x in ids:
            others = ids[(ids > x) & (np.bitwise_count(fp[ids] ^ fp[x]) <= reach)]
            out.append(np.stack([np.full(len(others), x), others], 1))


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest position that pairs reach, for each of n."""
    root = np.arange(n)
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, low)
        np.minimum.at(new, rb, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_pairs(distinct: DataFrame, reach: int = 4) -> DataFrame:
    """Links (a, b) between node ids of distinct (node long, _fp long), enough to span every group of fingerprints that differ in reach bits or fewer.

    Every fingerprint emits all variants within half the reach. Variants are shuffled by their leading bits: a fingerprint
    goes once to each prefix that some of its variants have, and the variants with that prefix are made there, as integers
    that are sorted; those that two fingerprints share are links, verified by their distance. Prefixes grow with the number
    of fingerprints, so that a bucket stays small; the buckets of a large group of near copies are dealt over more tasks by
    further bits in the same way, again and again while they are large. No fingerprints give no rows."""
    spark = distinct.sparkSession
    if reach != 4:
        raise ValueError("half the reach is 2 here")
    half = reach // 2
    total = max(1, distinct.count())
    bits = next((b for b in range(6, 20) if total * (1 + b + b * (b - 1) // 2) <= BUCKET_ROWS << b), 20)

    schema = "bucket long, radius byte, node long, _fp long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = masks(bits, half)
        away = np.bitwise_count(flips).astype(np.int8)
        for batch in batches:
            node, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bucket = ((fp.view(np.uint64) >> np.uint64(64 - bits))[:, None] ^ flips).astype(np.int64)
            n = len(flips)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), pa.array(np.tile(half - away, len(fp))), pa.array(np.repeat(node, n)), pa.array(np.repeat(fp, n))], names=["bucket", "radius", "node", "_fp"])

    sent = C.staged(distinct.select("node", "_fp").mapInArrow(send, schema), "simhash-sent")
    used, limit, parts, scratch = bits, None, [], [sent]
    while True:
        sizes = C.staged(sent.groupBy("bucket").agg(F.count("*").alias("n")), "simhash-buckets")
        scratch.append(sizes)
        if limit is None:
            mean = sizes.agg(F.coalesce(F.avg("n"), F.lit(0.0))).first()[0]
            limit = max(LEAST, min(BUCKET_ROWS, HOT * mean))
        hot = sizes.where(F.col("n") > limit).select("bucket")
        n_hot = 0 if 64 - used <= LAST else hot.count()
        if n_hot <= MOST_SENT:
            hot = F.broadcast(hot)
        cold = sent.join(hot, "bucket", "left_anti") if n_hot else sent
        n_buckets = min(1 << min(used, 24), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << min(bits, 8)))
        parts.append(cold.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(_meeting(64 - used, reach), "a long, b long"))
        if not n_hot:
            break
        sent = C.staged(sent.join(hot, "bucket", "left_semi").select("bucket", "radius", "node", "_fp").mapInArrow(_dealing(used), schema), "simhash-sent")
        scratch.append(sent)
        used += SPLIT
    links = C.staged(reduce(DataFrame.unionAll, parts), "simhash-pairs")
    C.drop_staged(*scratch)
    return links


def _meeting(free: int, reach: int):
    """Of one bucket, whose rows have `free` bits left: the first node that each one is linked with, over variants that they share."""

    def meet(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("node")
        node, fp = table["node"].to_numpy(), table["_fp"].to_numpy().view(np.uint64)
        found: list[np.ndarray] = []
        if len(fp) > 1:
            _meet(fp, fp & np.uint64((1 << free) - 1), table["radius"].to_numpy().astype(np.int64), free, reach, found)
        pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        root = _roots(len(fp), pairs)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": node[linked], "b": node[root[linked]]})

    return meet


def _dealing(used: int):
    """Rows of buckets of `used` bits as rows of buckets of SPLIT more: one for each that some of a row's variants fall in, with the flips that are left."""
    shift, flips = np.uint64(64 - used - SPLIT), masks(SPLIT, 2)
    away = np.bitwise_count(flips).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, radius, node, fp = (batch.column(i).to_numpy() for i in range(4))
            top = fp.view(np.uint64) >> shift & np.uint64((1 << SPLIT) - 1)
            i, j = np.nonzero(away[None, :] <= radius[:, None])
            to = bucket[i] << SPLIT | (top[i] ^ flips[j]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array((radius[i] - away[j]).astype(np.int8)), pa.array(node[i]), pa.array(fp[i])], names=["bucket", "radius", "node", "_fp"])

    return deal


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, reach: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest id that links of reach bits or fewer reach.

    Null and empty texts have fingerprint zero and link like any other; rows with one id are one component; a row without an
    id has its component's smallest id, null if no row there has one; an empty table gives no rows; further columns of docs are not read. Equal fingerprints are one node, so copies cost a row
    each and never a pair."""
    each = C.staged(fingerprints(docs, id_col, text_col, k), "simhash-fp")
    table = C.staged(each.groupBy("_fp").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).withColumn("node", F.col("_fp")), "simhash-distinct")
    # an id on rows of several texts ties their fingerprints together
    ties = each.where("_id is not null").groupBy("_id").agg(F.min("_fp").alias("b"), F.max("_fp").alias("_hi")).where("b != _hi").select(F.col("_id").alias("_tie"), "b")
    tied = each.join(ties, F.col("_id") == F.col("_tie")).select(F.col("_fp").alias("a"), "b")
    links = C.components(near_pairs(table).unionAll(tied), "simhash-links")
    parts = table.join(links, "node", "left").select("_fp", "_first", "_n", F.coalesce("component", "node").alias("_part"))
    smallest = parts.groupBy("_part").agg(F.min("_first").alias("component_id"))
    known = parts.join(smallest, "_part").select("_fp", "_n", "component_id")
    out = C.lookup(each, C.staged(known, "simhash-known"), "_fp", ["component_id"], "_n", F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_simhash": op7_simhash}
SQL: dict[str, str] = {}
