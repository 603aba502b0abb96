"""Embedding near-duplicates by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common as C
from lodestone.llm.simhash import _roots

#: Trees, the most distinct vectors that their splits are fitted on, and the rows that a leaf should hold about.
TREES, SAMPLE, LEAF = 6, 16_384, 512
#: Half the overlap of a split, in standard deviations of the projected difference of a pair at the limit; directions tried
#: for a split; the share of a node's rows in the overlap from which it stays a leaf.
SPILL, TRIES, STUCK = 0.6, 4, 0.5
#: Rows of a leaf that are compared in one matrix; a larger leaf is compared block by block.
BLOCK = 2048
#: The most lengths of vectors that get a forest of their own, the most common first; those of another length are one leaf.
MOST_FORESTS = 100
#: Vectors whose largest component is out of these bounds are divided by it, so that no square leaves the range of numbers.
TINY, HUGE = 1e-90, 1e90
SEED = 29


@dataclass
class Forest:
    """Splits of all trees: node k sends rows with projection <= cut + overlap to low[k] and >= cut - overlap to high[k]; a leaf has its number in low[k] and -1 in high[k]."""

    dims: int
    overlap: float
    directions: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, sample: np.ndarray, total: int, trees: int, leaf: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        for _ in range(trees):
            self.roots.append(self._node(sample, total / max(1, len(sample)), leaf, rng))

    def _node(self, rows: np.ndarray, each: float, leaf: int, rng: np.random.Generator) -> int:
        at = len(self.cuts)
        self.directions.append(np.zeros(self.dims))
        self.cuts.append(0.0)
        self.low.append(self.leaves)
        self.high.append(-1)
        if len(rows) * each > leaf and len(rows) >= 32:
            tries = []
            for _ in range(TRIES):
                way = rng.normal(size=self.dims)
                way /= np.linalg.norm(way)
                p = rows @ way
                cut = float(np.median(p))
                tries.append((float((np.abs(p - cut) <= self.overlap).mean()), cut, way, p))
            share, cut, way, p = min(tries, key=lambda t: t[0])
            if share < STUCK:
                self.directions[at], self.cuts[at] = way, cut
                self.low[at] = self._node(rows[p <= cut + self.overlap], each, leaf, rng)
                self.high[at] = self._node(rows[p >= cut - self.overlap], each, leaf, rng)
                return at
        self.leaves += 1
        return at

    def find(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row of unit vectors comes to, sorted by row and leaf."""
        out, todo = [], [(r, np.arange(len(rows))) for r in self.roots]
        while todo:
            k, own = todo.pop()
            if not len(own):
                continue
            if self.high[k] < 0:
                out.append(np.stack([own, np.full(len(own), self.low[k])], 1))
                continue
            p = rows[own] @ self.directions[k] - self.cuts[k]
            todo += [(self.low[k], own[p <= self.overlap]), (self.high[k], own[p >= -self.overlap])]
        both = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        return both[:, 0], both[:, 1]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def compare(table: pd.DataFrame, limit: float) -> pd.DataFrame:
    """Links inside one leaf, or between two blocks of it: (kind 0, node, links counted) and (kind 1, node, linked node), the
    latter enough to span what is linked. A pair is counted in the first of the leaves that both rows came to."""
    table = table.sort_values("node", ignore_index=True)
    leaf, lo, hi = int(table["leaf"].iloc[0]), int(table["lo"].iloc[0]), int(table["hi"].iloc[0])
    node, n = table["node"].to_numpy(), table["n"].to_numpy()
    vectors = np.stack(table["vector"].to_numpy()).astype(np.float64)
    norms = np.linalg.norm(vectors, axis=1)
    before = [np.asarray(x)[np.asarray(x) < leaf] for x in table["leaves"]]
    column = {x: i for i, x in enumerate(np.unique(np.concatenate(before)))} if before else {}
    has = np.zeros((len(table), max(1, len(column))), np.float32)
    for i, x in enumerate(before):
        has[i, [column[y] for y in x]] = 1
    block = table["block"].to_numpy()
    a = np.flatnonzero(block == lo)
    b = a if lo == hi else np.flatnonzero(block == hi)
    links, pairs = np.zeros(len(table), np.int64), []
    if len(a) and len(b):
        hit = vectors[a] @ vectors[b].T / (norms[a, None] * norms[b]) >= limit
        if lo == hi:
            np.fill_diagonal(hit, False)
        once = hit & ~(has[a] @ has[b].T > 0)
        links[a] += once @ n[b]
        if lo != hi:
            links[b] += once.T @ n[a]
        i, j = np.nonzero(hit)
        pairs = np.stack([a[i], b[j]], 1)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    root = _roots(len(table), pairs) if len(pairs) else np.arange(len(table))
    counted, linked = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(table)))
    return pd.DataFrame({"kind": np.repeat([0, 1], [len(counted), len(linked)]), "node": np.concatenate([node[counted], node[linked]]), "value": np.concatenate([links[counted], node[root[linked]]])})


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = 0.95, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept): rows whose vectors have a cosine of limit or more are linked; component_id is the smallest id that links reach.

    Equal vectors are one node with its number of rows, so a group of copies costs a row each and never a pair. Splits are
    fitted on at most sample distinct vectors, by the smallest hashes; every distinct vector then goes down every tree, into
    both sides of a split where it lies in the overlap. Inside a leaf all pairs are compared in double precision; a leaf of
    over BLOCK vectors is compared in pairs of blocks, each its own task. Vectors of each length have a forest of their own;
    those of a length with leaf vectors or fewer, or not among the MOST_FORESTS most common, are one leaf. Null, zero and
    non-finite vectors and those with null components link with nothing, nor do vectors of different lengths. Rows with one
    id are separate rows. An empty table gives no rows."""
    spark = rows.sparkSession
    v = F.col(vector_col).cast("array<double>")
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (top > 0)
    scaled = C.let(top, lambda m: F.when(m.between(TINY, HUGE), v).otherwise(F.transform(v, lambda x: x / m)))
    slim = rows.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), scaled).alias("vector"))
    nodes = C.staged(slim.where("vector is not null").groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("node", F.xxhash64("vector")), "vectors")
    forests, base = {}, 0
    for d, total in nodes.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(MOST_FORESTS).collect():
        if total > leaf:
            picked = nodes.where(F.size("vector") == d).orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toArrow().column("vector").combine_chunks()
            forest = forests[d] = Forest(d, SPILL * math.sqrt(max(0.0, 2 - 2 * limit) / d), leaves=base)
            forest.grow(_unit(picked.values.to_numpy().reshape(-1, d)), total, trees, leaf, seed)
            base = forest.leaves

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                part = batch if (lengths == d).all() else batch.take(pa.array(np.flatnonzero(lengths == d)))
                if d in forests:
                    row, at = forests[d].find(_unit(part.column(0).flatten().to_numpy().reshape(-1, d)))
                else:
                    row, at = np.arange(part.num_rows), np.full(part.num_rows, base + d)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                leaves = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(0), leaves], names=["node", "n", "vector", "leaves"])

    C.small_batches(spark, 4000)
    found = C.staged(nodes.select("vector", "node", "n").mapInArrow(send, "node long, n long, vector array<double>, leaves array<int>"), "vector-leaves")
    each = found.select("*", F.explode("leaves").alias("leaf"))
    blocks = each.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = each.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("leaf", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "vector", "leaves")
    links = C.staged(dealt.groupBy("leaf", "lo", "hi").applyInPandas(lambda t: compare(t, limit), "kind int, node long, value long"), "vector-links")
    counts = links.where("kind = 0").groupBy("node").agg(F.sum("value").alias("links"))
    parts = C.components(links.where("kind = 1").select(F.col("node").alias("a"), F.col("value").alias("b")), "vector-components")
    table = nodes.join(counts, "node", "left").join(parts, "node", "left").select("vector", "first", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("part"))
    table = C.staged(table, "vector-nodes")
    smallest = table.groupBy("part").agg(F.min("first").alias("component_id"))
    known = C.staged(table.join(smallest, "part").select("vector", "n", "n_links", "component_id"), "vector-known")
    out = C.lookup(slim, known, "vector", ["n_links", "component_id"], "n", F.col("id"))
    part = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), (F.col("id") == part).alias("kept"))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op3_vectors": op3_vectors}
SQL: dict[str, str] = {}
