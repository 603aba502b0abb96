"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common as C

#: Hash buckets of terms, factors of a term, and the most labelled rows that training takes, by the smallest hashes of their ids.
BUCKETS, FACTORS, MOST_ROWS = 1 << 18, 8, 10_000
EPOCHS, RATE, SHRINK, START, SEED = 8, 0.1, 1e-3, 1.0, 23
#: Words of a window: a document scores by its most toxic window, so that a long text's other words don't hide an insult.
WINDOW = 40
#: Word starts that are terms of their own, by length.
STARTS = (3, 4, 5, 6)
#: Labelled rows that must have a term, so that no row is learnt by heart.
LEAST_ROWS = 10
WORD = re.compile(r"[^\W_]+")
KEPT = 150_000


class Terms:
    """Bucket numbers of a text's terms: its lower-cased words and the starts of longer words."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.known = buckets, {}

    def _learn(self, word: str) -> bytes:
        """A word's bucket numbers as 32-bit integers, which take a third of the memory of a list."""
        if len(self.known) > KEPT:
            self.known.clear()
        terms = [word, *(f"{word[:n]}*" for n in STARTS if len(word) > n)]
        out = self.known[word] = np.array([zlib.crc32(t.encode("utf-8", "replace")) % self.buckets for t in terms], "<i4").tobytes()
        return out

    def windows(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, window) of every term that a window has, each once."""
        known = self.known
        lists = [known.get(w) or self._learn(w) for w in WORD.findall(text.lower())]
        n = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        ids = np.frombuffer(b"".join(lists), "<i4").astype(np.int64)
        both = np.unique(np.repeat(np.arange(len(lists)) // WINDOW, n) * self.buckets + ids)
        return both % self.buckets, both // self.buckets


class Machine:
    """score = sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x_i is 1/sqrt(terms of the window) for the terms it has."""

    def __init__(self, buckets: int = BUCKETS, factors: int = FACTORS, seed: int = SEED) -> None:
        self.bias = 0.0
        self.w = np.zeros(buckets, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (buckets, factors)).astype(np.float32)

    def raw(self, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """The scores before the sigmoid of n rows given as sorted (id, row) pairs; bias alone for a row without terms."""
        if not len(ids):
            return np.full(n, self.bias)
        x = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
        at = rows[starts]
        v = self.v[ids]
        sums = np.add.reduceat(v, starts, axis=0)
        pairs = (sums**2).sum(1) - np.add.reduceat((v * v).sum(1), starts)
        out = np.full(n, self.bias, np.float64)
        out[at] += np.add.reduceat(self.w[ids], starts) * x[at] + 0.5 * pairs * x[at] ** 2
        return out

    def fit(self, examples: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, shrink: float = SHRINK, seed: int = SEED, least_rows: int = LEAST_ROWS) -> None:
        """AdaGrad on the log loss, a document at a time by the window that now scores highest; the rarer label weighs more. Terms of fewer than least_rows documents stay at zero."""
        rng = np.random.default_rng(seed)
        of_docs = np.zeros(len(self.w), np.int32)
        for ids, _ in examples:
            of_docs[np.unique(ids)] += 1
        seen = of_docs >= least_rows
        self.v[~seen] = 0
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
        weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
        gw, gv, gb = np.full(len(self.w), START, np.float32), np.full(self.v.shape, START, np.float32), START
        for _ in range(epochs):
            for k in rng.permutation(len(examples)):
                ids, rows = examples[k]
                keep = seen[ids]
                ids, rows = ids[keep], rows[keep]
                if not len(ids):
                    continue
                scores = self.raw(ids, rows, int(rows[-1]) + 1)
                best = int(scores.argmax())
                own = ids[np.searchsorted(rows, best) : np.searchsorted(rows, best, "right")]
                if not len(own):
                    continue
                y = int(labels[k])
                g = weight[y] * (1 / (1 + math.exp(-min(30.0, max(-30.0, scores[best])))) - y)
                x = 1 / math.sqrt(len(own))
                v = self.v[own]
                dw = g * x + shrink * self.w[own]
                dv = g * x * x * (v.sum(0) - v) + shrink * v
                gw[own] += dw * dw
                gv[own] += dv * dv
                gb += g * g
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                self.v[own] = v - rate * dv / np.sqrt(gv[own])
                self.bias -= rate * g / math.sqrt(gb)


class Examples:
    """(bucket, window) of the terms of documents, made from the terms that each window has when they are asked for."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.rows[k]
        return ids, np.repeat(np.arange(len(sizes)), sizes)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, buckets: int = BUCKETS, epochs: int = EPOCHS) -> Machine:
    """Learns from the labelled documents whose crc32(doc_id as text) mod 5 isn't 0, at most most_rows of them by the smallest
    hashes of their ids; these bounded rows are all that the driver holds of the corpus. Null labels or texts are left out;
    without rows of both labels the machine gives the share of label 1 (0 without rows)."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    terms = Terms(buckets)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [terms.windows(t) for t in batch.column(2).to_pylist()]
            ids = pa.array([x[0].astype(np.int32) for x in got], pa.list_(pa.int32()))
            sizes = pa.array([np.bincount(x[1]).astype(np.int32) for x in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, sizes], names=["doc_id", "toxic", "ids", "sizes"])

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    machine = _taught(rows.mapInArrow(hashed, "doc_id long, toxic int, ids array<int>, sizes array<int>"), buckets, epochs)
    pa.default_memory_pool().release_unused()
    C.let_go(docs.sparkSession)
    return machine


def _taught(rows: DataFrame, buckets: int, epochs: int) -> Machine:
    """A machine that has learnt from rows (doc_id, toxic, ids, sizes)."""
    found = rows.toArrow()
    machine = Machine(buckets)
    y = found.column("toxic").to_numpy()
    if len(y) and 0 < y.mean() < 1:
        order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
        examples = []  # views of the table's memory, not copies
        for ids, sizes in zip(found.column("ids").chunks, found.column("sizes").chunks, strict=True):
            a, b = ids.values.to_numpy(), sizes.values.to_numpy()
            examples += [(a[i:j], b[k:m]) for (i, j), (k, m) in zip(itertools.pairwise(ids.offsets.to_numpy()), itertools.pairwise(sizes.offsets.to_numpy()), strict=True)]
        machine.fit(Examples([examples[i] for i in order]), y[order], epochs)
    else:
        machine.bias = 30.0 if len(y) and y.mean() == 1 else -30.0
        machine.v[:] = 0
    return machine


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1): the highest of the text's windows; an empty or null text has what the bias gives. A column named score is replaced."""
    C.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # (1 + FACTORS) * BUCKETS numbers
    rows = docs.drop("score")
    fields = rows.schema.fields
    at = next(i for i, f in enumerate(fields) if f.name == text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        terms = Terms(len(model.w))
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                ids, windows = terms.windows(t or "")
                raw = model.raw(ids, windows, int(windows[-1]) + 1 if len(windows) else 1).max()
                out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, raw)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(work, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a machine that learns outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(docs, machine).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
