"""All pairs of vectors of one group whose cosine reaches a limit, without comparing all pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.ordering import numbered
from lodestone.sources.scratch import drop_staged, staged

#: Rows by whose directions angles are measured and dimensions are ordered, rows of a block, and the share of dimensions that come first.
SAMPLE, BLOCK, LEADING = 4096, 1024, 0.25
#: Pairs whose vectors are side by side at once.
AT_ONCE = 1 << 14
#: By so much may angles, and cosines of two unit vectors, be off by rounding.
SLACK = 1e-9


def _pivot(units: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(a direction that sample rows differ along most, the order of dimensions by their squares); None without rows. The sample has SAMPLE rows at most."""
    rows = units.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("unit").toArrow().column(0).to_pylist()
    if not rows:
        return None
    d = max(map(len, rows))
    x = np.zeros((len(rows), d))
    for i, v in enumerate(rows):
        x[i, : len(v)] = v
    _, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, -1], np.argsort(-(x**2).sum(0), kind="stable")


def _matrix(vectors: pd.Series, order: np.ndarray) -> np.ndarray:
    """Rows filled up with zeros, in the order of dimensions, others behind."""
    d = max(len(order), max((len(v) for v in vectors), default=0))
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.concatenate([out[:, order], out[:, len(order) :]], axis=1)


def compare(table: pd.DataFrame, order: np.ndarray, limit: float) -> pd.DataFrame:
    """(first, second, cosine) of a pair of blocks, or of one with itself: a pair's leading products and the norms of what is left bound its cosine; those that may reach the limit get it in full."""
    lo, hi = table["lo"].iloc[0], table["hi"].iloc[0]
    a, b = table[table["block"] == lo], table[table["block"] == hi]
    none = pd.DataFrame({"first": pd.Series(dtype="int64"), "second": pd.Series(dtype="int64"), "cosine": pd.Series(dtype=float)})
    if not len(a) or not len(b):
        return none
    x, y = _matrix(a["unit"], order), _matrix(b["unit"], order)
    d = max(x.shape[1], y.shape[1])
    x, y = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (x, y))
    k = max(1, round(d * LEADING))
    rest = np.outer(np.linalg.norm(x[:, k:], axis=1), np.linalg.norm(y[:, k:], axis=1))
    may = x[:, :k] @ y[:, :k].T + rest >= limit - SLACK
    may &= a["size"].to_numpy()[:, None] == b["size"].to_numpy()
    if lo == hi:
        may = np.triu(may, 1)
    i, j = np.nonzero(may)
    # where most pairs may reach the limit, both sides of all of them would be a copy of every vector for every other one
    cosine = np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", x[i[k : k + AT_ONCE]], y[j[k : k + AT_ONCE]]) for k in range(0, len(i), AT_ONCE)]])
    hit = cosine >= limit
    p, q = a["rep"].to_numpy()[i[hit]], b["rep"].to_numpy()[j[hit]]
    return pd.DataFrame({"first": np.minimum(p, q), "second": np.maximum(p, q), "cosine": cosine[hit]})


def directions(rows: DataFrame, id_col: str, vector_col: str, by: str) -> DataFrame:
    """(group, vector, rep, n): the different vectors of each group with the smallest id (a long) and the number of their rows; null and zero vectors, and those with null or non-finite components, are left out, as are null ids and groups."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    own = rows.where(fine & F.col(id_col).isNotNull() & F.col(by).isNotNull())
    return own.groupBy(F.col(by).alias("group"), v.alias("vector")).agg(F.min(F.col(id_col).cast("long")).alias("rep"), F.count("*").alias("n"))


def similar_pairs(distinct: DataFrame, limit: float, block: int = BLOCK) -> DataFrame:
    """(group, first, second, cosine) of the directions() whose cosine is limit (above 0) or more, first < second; none is lost.

    Angles obey the triangle inequality: two vectors within an angle t of each other differ by t at most in their angles to any
    third one. Vectors are put in the order of their angle to one direction, cut into blocks, and only blocks that come within t
    of each other meet, each pair of blocks in a task of its own, whatever the group's size; there compare() discards most
    pairs after a share of the dimensions. Equal vectors are one row, so copies give no pairs. Vectors of different lengths
    have none. What is left to compare still grows with the square of a group whose vectors all point about one way."""
    if not 0 < limit <= 1:
        raise ValueError("the limit must be above 0 and 1 at most")
    units = staged(distinct.select("group", "rep", F.size("vector").alias("size"), X.unit(F.col("vector")).alias("unit")), "directions")
    schema = f"group {units.schema['group'].dataType.simpleString()}, first long, second long, cosine double"
    found = _pivot(units)
    if found is None:
        return units.sparkSession.createDataFrame([], schema)
    pivot, order = found
    axis: Column = F.array(*[F.lit(float(x)) for x in pivot])
    n = F.least(F.size("unit"), F.lit(len(pivot)))
    cosine = X.dot(F.slice("unit", F.lit(1), n), F.slice(axis, F.lit(1), n))
    angled = units.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    placed = numbered(angled, ["group"], ["angle", "rep"]).withColumn("block", F.floor(F.col("place") / block))
    spans = staged(placed.groupBy("group", "block").agg(F.min("angle").alias("least"), F.max("angle").alias("most")), "spans")
    far = math.acos(limit) + SLACK
    a, b = spans.select("group", F.col("block").alias("lo"), F.col("most").alias("_end")), spans.select("group", F.col("block").alias("hi"), F.col("least").alias("_begin"))
    meet = a.join(b, "group").where((F.col("lo") <= F.col("hi")) & (F.col("_begin") - F.col("_end") <= far)).select("group", "lo", "hi")
    sides = meet.select("*", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    dealt = placed.select("group", "block", "rep", "size", "unit").join(sides, ["group", "block"])

    def work(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        out = compare(table, order, limit)
        out.insert(0, "group", pd.Series([key[0]] * len(out), dtype=object, index=out.index))
        return out

    pairs = staged(dealt.groupBy("group", "lo", "hi").applyInPandas(work, schema), "similar")
    drop_staged(units, placed, spans)
    return pairs
