"""Hard negatives by exact integer products, with candidates discarded early after an orthogonal PCA rotation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common as C

#: Rows, by the smallest hashes of their ids, on which a rotation is fitted and first limits are found.
SAMPLE = 4096
#: Bytes of the anchors that a job sends to every task at most; more anchors take more jobs.
SENT = 8 << 20
#: Rows and anchors of one partial product, and leading components by step, as shares of all.
ROWS, ANCHORS, STEPS = 1024, 512, (0.25, 0.5)
#: Squared norms of integer vectors from which products could leave 64 bits.
TOO_LONG = 9.2e18
NONE = np.iinfo(np.int64).min


def whole_vectors(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as 64-bit integers; null for a vector that is null, has a null or non-finite component, or a squared norm of TOO_LONG or more."""
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    short = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x) < TOO_LONG
    return C.let(v, lambda w: F.when(vector.isNotNull() & F.coalesce(fine, F.lit(False)) & short(w), w.cast("array<long>")))


@dataclass
class Rotation:
    """An orthogonal matrix whose first columns carry most of the rows' squares, and the ends of its steps."""

    matrix: np.ndarray
    ends: list[int]

    @classmethod
    def fit(cls, rows: np.ndarray) -> Rotation:
        d = rows.shape[1]
        x = rows.astype(np.float64)
        x /= max(1.0, float(np.abs(x).max(initial=0)))
        _, vectors = np.linalg.eigh(x.T @ x)
        return cls(np.ascontiguousarray(vectors[:, ::-1]), sorted({max(1, round(d * s)) for s in STEPS if d > 1} | {d}))

    def turned(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(rotated rows, norms of what each step leaves, norms)."""
        out = rows.astype(np.float64) @ self.matrix
        left = [np.sqrt((out[:, e:] ** 2).sum(1)) for e in self.ends]
        return out, left, np.sqrt((out**2).sum(1))

    @property
    def slack(self) -> float:
        """By this share of two norms' product may a partial product and its bound be off by rounding."""
        return 64 * len(self.matrix) * np.finfo(np.float64).eps


class Best:
    """The first `most` (score, id) of each group: higher scores first, then smaller ids."""

    def __init__(self, groups: int, most: int) -> None:
        self.score = np.full((groups, most), NONE, np.int64)
        self.id = np.zeros((groups, most), np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(group):
            return
        groups, most = self.score.shape
        own = np.unique(group)
        had = self.score[own] > NONE
        g = np.concatenate([group, np.repeat(own, had.sum(1))])
        s = np.concatenate([score, self.score[own][had]])
        i = np.concatenate([ident, self.id[own][had]])
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        starts = np.searchsorted(g, own)
        rank = np.arange(len(g)) - np.repeat(starts, np.diff([*starts, len(g)]))
        keep = rank < most
        self.score[own], self.id[own] = NONE, 0
        self.score[g[keep], rank[keep]], self.id[g[keep], rank[keep]] = s[keep], i[keep]


class Search:
    """One block of anchors against rows: those of the same label for their best, or of other labels for the best within limits.

    low and high bound what is asked for, by anchor and target (with positives: one target without bounds). A candidate
    whose partial product and remainder can't reach any target of its anchor goes after each step; what is left gets its
    integer product. An anchor's reach rises with what its targets have found."""

    def __init__(self, rotation: Rotation, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, most: int) -> None:
        self.rotation, self.ids, self.vectors, self.same, self.low, self.high, self.most = rotation, ids, vectors, same, low, high, most
        self.index = pd.Index(np.unique(labels))
        self.codes = self.index.get_indexer(labels)
        self.best = Best(low.size, most)

    def prepare(self) -> None:
        self.turned, self.left, self.norms = self.rotation.turned(self.vectors)

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) score that counts for each anchor now."""
        worst = self.best.score[:, -1].reshape(self.low.shape)
        low = np.where(self.high >= self.low, np.maximum(self.low, worst), np.iinfo(np.int64).max)
        return low.min(1), np.where(self.high >= self.low, self.high, NONE).max(1)

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        codes = self.index.get_indexer(labels)
        for a in range(0, len(ids), ROWS):
            part = slice(a, a + ROWS)
            turned, left, norms = self.rotation.turned(vectors[part])
            for b in range(0, len(self.ids), ANCHORS):
                self._block(slice(b, b + ANCHORS), ids[part], codes[part], vectors[part], turned, left, norms)

    def _block(self, own: slice, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, turned: np.ndarray, left: list[np.ndarray], norms: np.ndarray) -> None:
        low, high = (x[own] for x in self.reach())
        low, high = low.astype(np.float64), high.astype(np.float64)
        slack = self.rotation.slack * np.outer(self.norms[own], norms)
        may = codes == self.codes[own, None]
        may = may & (ids != self.ids[own, None]) if self.same else ~may
        partial, start, i, j = np.zeros(may.shape), 0, None, None
        for k, end in enumerate(self.rotation.ends):
            cols = slice(start, end)
            if i is None:
                partial += self.turned[own, cols] @ turned[:, cols].T
                rest = np.outer(self.left[k][own], left[k]) + slack
                may &= (partial + rest >= low[:, None]) & (partial - rest <= high[:, None])
                if may.sum() * 8 < may.size:  # few are left: these alone from here on
                    i, j = np.nonzero(may)
                    partial, slack = partial[i, j], slack[i, j]
            else:
                partial = partial + np.einsum("ij,ij->i", self.turned[own, cols][i], turned[j, cols])
                rest = self.left[k][own][i] * left[k][j] + slack
                keep = (partial + rest >= low[i]) & (partial - rest <= high[i])
                i, j, partial, slack = i[keep], j[keep], partial[keep], slack[keep]
            start = end
        if i is None:
            i, j = np.nonzero(may)
        score = np.einsum("ij,ij->i", self.vectors[own][i], vectors[j])
        at = i + own.start
        targets = self.low.shape[1]
        for t in range(targets):
            hit = (score >= self.low[at, t]) & (score <= self.high[at, t]) & (score >= self.best.score[at * targets + t, -1])
            self.best.add(at[hit] * targets + t, score[hit], ids[j[hit]])

    def found(self, base: int) -> pa.RecordBatch:
        """(anchor: its number, target, id, score) of what was found."""
        group, rank = np.nonzero(self.best.score > NONE)
        targets = self.low.shape[1]
        columns = [base + group // targets, group % targets, self.best.id[group, rank], self.best.score[group, rank]]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=["anchor", "target", "id", "score"])


FOUND = "anchor long, target long, id long, score long"


def _columns(batch: pa.RecordBatch | pa.Table, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = pa.table(batch) if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    vectors = table.column("vector").combine_chunks()
    flat = vectors.flatten() if isinstance(vectors, pa.ListArray) else vectors.combine_chunks().flatten()
    return table.column("id").to_numpy(), table.column("label").to_numpy(), flat.to_numpy().reshape(-1, d)


def _search(rows: DataFrame, search: Search, d: int, sample: tuple, most: int) -> DataFrame:
    """The best of each anchor's targets over all rows: each task gives its own, and those are ranked by anchor and target."""
    search.prepare()
    search.add(*sample)  # rows like any others: what they give is a limit that holds from the start
    floor = search.best.score[:, -1].reshape(search.low.shape)
    search.low = np.maximum(search.low, floor)
    search.best = Best(search.low.size, search.most)
    sent = rows.sparkSession.sparkContext.broadcast(search)  # SENT bytes of vectors, and as much again for each of a few columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        own.best = Best(own.low.size, own.most)
        for batch in batches:
            own.add(*_columns(batch, d))
        yield own.found(0)

    each = rows.where(F.size("vector") == d).select("id", "label", "vector").mapInArrow(work, FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "target").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id: long, label, vector: integers) for the rows that anchors picks.

    A score is an integer product with the anchor. Positives are its first other rows (of another id) of the same label by
    score and then id; negatives are, for each positive, the first rows of other labels with low * positive <= 100 * score <=
    high * positive. Rows with a null id, label or vector take no part; vectors of different lengths have no product; equal
    rows count once, and rows that share an id alone stand for themselves. Empty tables give no rows. Anchors go to the
    tasks in blocks of SENT bytes, each block by two jobs over all rows, so nothing that grows with the rows is sent, grouped
    or brought to the driver; the work is anchors times rows, less what the bounds discard."""
    spark = rows.sparkSession
    kinds = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("vector").cast("array<long>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    kept = C.staged(kinds.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").distinct(), "negatives-rows")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    C.small_batches(spark, 4 * ROWS)
    lengths = kept.where("is_anchor").groupBy(F.size("vector").alias("d")).count().where("d > 0").orderBy("d")
    for d, _ in lengths.toLocalIterator():
        own = kept.where(F.size("vector") == d)
        picked = own.orderBy(F.xxhash64("id"), "id", "label").limit(sample).select("id", "label", "vector")
        first = _columns(picked.toArrow(), d)
        rotation = Rotation.fit(first[2])
        size = max(1, SENT // (8 * d))
        for block in _blocks(own.where("is_anchor").select("id", "label", "vector"), size, d):
            out = out.unionAll(_mined(spark, own, rotation, block, d, first, positives, negatives, low, high))
    C.drop_staged(kept)
    return out


def _blocks(anchors: DataFrame, size: int, d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors, dealt by the hash of their ids into blocks of about size, one block at a time on the driver."""
    blocks = -(-anchors.count() // size)
    for b in range(blocks):
        ids, labels, vectors = _columns(anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow(), d)
        for k in range(0, len(ids), size):
            yield ids[k : k + size], labels[k : k + size], vectors[k : k + size]


def _mined(spark: SparkSession, rows: DataFrame, rotation: Rotation, block: tuple, d: int, first: tuple, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """mine() for one block of anchors, in the shared folder."""
    ids, labels, vectors = block
    n = len(ids)
    span = np.full((n, 1), NONE + 1, np.int64), np.full((n, 1), np.iinfo(np.int64).max, np.int64)
    search = Search(rotation, ids, labels, vectors, True, *span, positives)
    best = _search(rows, search, d, first, positives).select("anchor", "rank", "id", "score").toArrow()  # `positives` rows an anchor of the block
    anchor, rank, ident, score = (best.column(c).to_numpy() for c in ("anchor", "rank", "id", "score"))
    found, scores = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
    floor, roof = np.full((n, positives), 1, np.int64), np.zeros((n, positives), np.int64)  # nothing is asked for without a positive
    found[anchor, rank - 1], scores[anchor, rank - 1] = ident, score
    floor[anchor, rank - 1] = [-(-low * s // 100) for s in score.tolist()]
    roof[anchor, rank - 1] = [high * s // 100 for s in score.tolist()]
    search = Search(rotation, ids, labels, vectors, False, floor, roof, negatives)
    table = pd.DataFrame({"anchor": np.repeat(np.arange(n), positives), "target": np.tile(np.arange(positives), n), "anchor_id": np.repeat(ids, positives), "positive_id": found.ravel(), "positive_score": scores.ravel()})
    pairs = spark.createDataFrame(table[(roof >= floor).ravel()], "anchor long, target long, anchor_id long, positive_id long, positive_score long")
    hits = _search(rows, search, d, first, negatives).join(pairs, ["anchor", "target"])
    return C.staged(hits.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-mined")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mine() of all embeddings: anchors are rows whose vec_id is divisible by 50; where it is by 7, the label is the next of ten."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select(F.col("vec_id").alias("id"), label.alias("label"), whole_vectors(F.col("embedding")).alias("vector"))
    return mine(whole, F.col("id") % 50 == 0)


QUERIES = {"op11_negatives": op11_negatives}
SQL = {
    "op11_negatives": """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON len(a.x) = len(b.x) AND len(a.x) > 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""
}
