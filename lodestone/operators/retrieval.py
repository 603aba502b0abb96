"""Lexical, dense and fused retrieval."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.operators import term_sums
from lodestone.sources.scratch import drop_staged, staged

#: Rows of a group that a query meets in one task of best_match, about.
BLOCK_ROWS = 4096
#: Queries whose products with a block are held at once, pairs whose scores are summed at once, and by how much products may be off by rounding.
QUERIES_AT_ONCE, PAIRS_AT_ONCE, NEAR = 512, 1 << 18, 1e-9
#: Terms that a task holds before it hands them on, besides those of one document.
TERMS_AT_ONCE = 1 << 16


def _tallies(batches: Iterator[pa.RecordBatch], stop: frozenset[str], sizes: tuple[int, ...]) -> Iterator[tuple[pa.Array, list[int], list[str], list[int]]]:
    """(ids, how many terms each has, terms, how often each occurs) of documents (id, tokens joined by spaces), about TERMS_AT_ONCE terms at a time."""
    for batch in batches:
        ids, begin, lengths, terms, counts = batch.column(0), 0, [], [], []
        for k, text in enumerate(batch.column(1)):
            t = [w for w in text.as_py().split(" ") if w and w not in stop]
            found = Counter(chain.from_iterable(t if n == 1 else map(" ".join, zip(*[t[i:] for i in range(n)], strict=False)) for n in sizes))
            own = sorted(found)
            lengths.append(len(own))
            terms += own
            counts += map(found.__getitem__, own)
            if len(terms) >= TERMS_AT_ONCE:
                yield ids[begin : k + 1], lengths, terms, counts
                begin, lengths, terms, counts = k + 1, [], [], []
        if lengths:
            yield ids[begin:], lengths, terms, counts


def term_arrays(docs: DataFrame, id_col: str, text_col: str, stop: Sequence[str] = (), sizes: Sequence[int] = (1, 2)) -> DataFrame:
    """(id, terms) of documents, one row each: the terms (value) and how often each occurs (n), sorted; null where there are none."""
    without, of = frozenset(stop), tuple(sizes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, terms, counts in _tallies(batches, without, of):
            each = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["value", "n"])
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            none = pa.array([n == 0 for n in lengths], pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, each, mask=none)], ["id", "terms"])

    return term_sums.joined_tokens(docs, id_col, text_col).mapInArrow(work, f"id {docs.schema[id_col].dataType.simpleString()}, terms array<struct<value:string,n:int>>")


def term_counts(docs: DataFrame, id_col: str, text_col: str, stop: Sequence[str] = (), sizes: Sequence[int] = (1, 2)) -> DataFrame:
    """(id, term, tf) of documents, one row each: terms are sorted and counted inside the row, so nothing is shuffled."""
    return token_counts(term_sums.joined_tokens(docs, id_col, text_col), stop, sizes)


def token_counts(rows: DataFrame, stop: Sequence[str] = (), sizes: Sequence[int] = (1, 2)) -> DataFrame:
    """(id, term, tf) of rows (id, tokens joined by spaces)."""
    without, of = frozenset(stop), tuple(sizes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, terms, counts in _tallies(batches, without, of):
            of_term = ids.take(pa.array(np.repeat(np.arange(len(ids)), lengths)))
            yield pa.RecordBatch.from_arrays([of_term, pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["id", "term", "tf"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, term string, tf long")


def squared_counts(docs: DataFrame, id_col: str, text_col: str, stop: Sequence[str] = (), sizes: Sequence[int] = (1, 2), sublinear: bool = True) -> DataFrame:
    """(id, term, tf, w2, own, terms) of documents: w2 is the squared weight of a term by its frequency alone; own, their sum over the document, and terms, their number, stand on the first row of each document, 0 on the others."""
    without, of = frozenset(stop), tuple(sizes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, terms, counts in _tallies(batches, without, of):
            tf, n = np.array(counts, dtype=np.int64), np.array(lengths)
            w2 = (1.0 + np.log(tf) if sublinear else tf.astype(float)) ** 2
            own, some = np.zeros(len(tf)), np.zeros(len(tf), dtype=np.int32)
            first = (np.cumsum(n) - n)[n > 0]
            if len(first):
                own[first], some[first] = np.add.reduceat(w2, first), n[n > 0]
            of_term = ids.take(pa.array(np.repeat(np.arange(len(ids)), n)))
            yield pa.RecordBatch.from_arrays([of_term, pa.array(terms, pa.string()), pa.array(tf), pa.array(w2), pa.array(own), pa.array(some)], ["id", "term", "tf", "w2", "own", "terms"])

    return term_sums.joined_tokens(docs, id_col, text_col).mapInArrow(work, f"id {docs.schema[id_col].dataType.simpleString()}, term string, tf long, w2 double, own double, terms int")


def _idf(df: Column, n_docs: int) -> Column:
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def lengths(docs: DataFrame, id_col: str, text_col: str, n_docs: int, stop: Sequence[str] = (), sizes: Sequence[int] = (1, 2), max_df: float = 1.0, sublinear: bool = True) -> DataFrame:
    """(id, norm) as norms() gives it for the weights of all terms in at most max_df of the n_docs documents; documents without such a term are left out.

    Terms are shuffled once, as hashes, to be counted, and sums by document come back."""
    most = max_df * n_docs
    squares = term_sums.sums(docs, id_col, text_col, lambda df: [np.where(df <= most, (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0) ** 2, 0.0)], 1, stop, sizes, sublinear)
    return squares.where("s0 > 0").select("id", F.sqrt("s0").alias("norm"))


def document_frequencies(counts: DataFrame, n_docs: int, max_df: float = 0.95) -> DataFrame:
    """(term, df, idf) of terms in at most max_df of all documents; smooth idf."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= max_df * n_docs)
    return df.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def weigh(counts: DataFrame, idf: DataFrame, sublinear: bool = True) -> DataFrame:
    """(id, term, w) before normalization."""
    tf: Column = 1.0 + F.log("tf") if sublinear else F.col("tf").cast("double")
    return counts.join(idf, "term").select("id", "term", (tf * F.col("idf")).alias("w"))


def norms(weights: DataFrame) -> DataFrame:
    """(id, norm): the length of each document's row."""
    return weights.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


@dataclass(frozen=True)
class Index:
    """Written tables that any number of searches read: counts (id, term, tf), idf (term, df, idf), and norms (id, norm) of n_docs documents.

    key: what tells documents apart in counts and norms; lookup: gives idf and counts of the terms that it is called with, where that needn't read all."""

    counts: DataFrame
    idf: DataFrame
    norms: DataFrame
    n_docs: int
    stop: tuple[str, ...]
    sizes: tuple[int, ...]
    sublinear: bool
    key: tuple[str, ...] = ("id",)
    lookup: Callable[[Sequence[str]], tuple[DataFrame, DataFrame]] | None = None


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop: Sequence[str] = (), sizes: Sequence[int] = (1, 2), max_df: float = 0.95, sublinear: bool = True) -> Index:
    """Reads the texts once. Counts are written in the order of their terms inside files, so that a search skips most of them.

    No documents give an empty index; where one document is all, max_df below 1 prunes every term."""
    counts = staged(term_counts(docs, id_col, text_col, stop, sizes).sortWithinPartitions("term"), "index-counts")
    n = docs.count()
    idf = staged(document_frequencies(counts, n, max_df), "index-idf")
    return Index(counts, idf, staged(norms(weigh(counts, idf, sublinear)), "index-norms"), n, tuple(stop), tuple(sizes), sublinear)


def search(index: Index, query: str, k: int) -> DataFrame:
    """(id, score): the k documents with the highest cosine to the query, scores above 0 only; ties by id, where scores that differ by less than rounding errors are equal.

    Only the query's terms are read from the index, by its lookup or by filters on terms that reach the files; a request has a
    few, and they come by a broadcast."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark: SparkSession = index.counts.sparkSession
    asked = asked_counts(spark, query, index.stop, index.sizes)
    idf, counts = index.lookup(list(asked)) if index.lookup and asked else (index.idf, index.counts)
    weights = asked_weights(asked, idf, index.sublinear)
    if not weights:
        return index.norms.select("id", F.lit(0.0).alias("score")).limit(0)
    terms = spark.createDataFrame(weights, "term string, idf double, wq double")
    counts = counts.where(F.col("term").isin([t for t, _, _ in weights]))
    tf: Column = 1.0 + F.log("tf") if index.sublinear else F.col("tf").cast("double")
    hits = counts.join(F.broadcast(terms), "term").groupBy(*index.key).agg(F.sum(tf * F.col("idf") * F.col("wq")).alias("dot"))
    scored = hits.join(index.norms, list(index.key)).select("id", (F.col("dot") / F.col("norm")).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 10)), "id").limit(k).where("score > 0")


def asked_counts(spark: SparkSession, query: str, stop: Sequence[str], sizes: Sequence[int]) -> dict[str, int]:
    """How often a request has each of its terms."""
    return {r["term"]: r["tf"] for r in term_counts(spark.createDataFrame([(0, query)], "id int, text string"), "id", "text", stop, sizes).collect()}


def asked_weights(asked: dict[str, int], idf: DataFrame, sublinear: bool) -> list[tuple[str, float, float]]:
    """(term, idf, weight) of a request's terms that idf has, in the length of 1."""
    own = idf.where(F.col("term").isin(list(asked))).select("term", "idf").collect() if asked else []
    raw = {r["term"]: (r["idf"], (1.0 + math.log(asked[r["term"]]) if sublinear else float(asked[r["term"]])) * r["idf"]) for r in own}
    length = math.sqrt(sum(w * w for _, w in raw.values()))
    return [(t, i, w / length) for t, (i, w) in sorted(raw.items())] if length else []


def tfidf_search(docs: DataFrame, query: str, k: int, id_col: str = "doc_id", text_col: str = "text", stop: Sequence[str] = (), max_df: float = 0.95) -> DataFrame:
    """search() of one request over 1- and 2-grams, without an index: terms are written once by document, counted, and joined only for the documents that have a term of the request; what was written is dropped. k rows come to the driver."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark = docs.sparkSession
    held = staged(term_arrays(docs, id_col, text_col, stop), "search-terms")
    n = held.count()
    terms = lambda rows: rows.where(F.size("terms") > 0).select("id", F.explode("terms").alias("t")).select("id", F.col("t.value").alias("term"), F.col("t.n").cast("long").alias("tf"))
    asked = asked_counts(spark, query, stop, (1, 2))
    own = list(asked)
    some = staged(held.where(F.arrays_overlap("terms.value", F.array(*[F.lit(t) for t in own]))) if own else held.limit(0), "search-found")
    weights = asked_weights(asked, document_frequencies(terms(some).where(F.col("term").isin(own)), n, max_df), True)
    found: list = []
    if weights:
        # counted once, in the job that joins it: the request's own weights are known from the documents found
        idf = document_frequencies(terms(held), n, max_df)
        wq = F.coalesce(F.create_map(*[x for t, _, w in weights for x in (F.lit(t), F.lit(w))])[F.col("term")], F.lit(0.0))
        w = (1.0 + F.log("tf")) * F.col("idf")
        dots = terms(some).join(idf.select("term", "idf"), "term").groupBy("id").agg((F.sum(w * wq) / F.sqrt(F.sum(w * w))).alias("score"))
        found = dots.orderBy(F.desc(F.round("score", 10)), "id").limit(k).where("score > 0").collect()
    out = spark.createDataFrame(found, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    drop_staged(held, some)
    return out


def similarity_to(query: str, rows: DataFrame, id_col: str, text_col: str, stop: Sequence[str] = ()) -> DataFrame:
    """(id, lexical) of every row: the cosine of its text and the query, 0 to 1, over plain term frequencies of 1- and 2-grams with an idf fitted on the rows and the query."""
    spark = rows.sparkSession
    own = asked_counts(spark, query, stop, (1, 2))
    n = rows.count() + 1
    asked = F.col("term").isin(list(own)) if own else F.lit(False)
    found = squared_counts(rows, id_col, text_col, stop, sublinear=False).withColumn("df", F.count("*").over(Window.partitionBy("term")))
    # as in lengths(): only terms that others have too, the query among them, change what a document has alone
    alone, idf = _idf(F.lit(1), n) ** 2, _idf(F.col("df") + F.when(asked, 1).otherwise(0), n)
    qtf = F.coalesce(F.create_map(*[x for t, k in own.items() for x in (F.lit(t), F.lit(float(k)))])[F.col("term")], F.lit(0.0)) if own else F.lit(0.0)
    part = F.col("own") * alone + F.when(asked | (F.col("df") > 1), F.col("w2") * (idf**2 - alone)).otherwise(0.0)
    each = found.where((F.col("own") > 0) | (F.col("df") > 1) | asked).select("id", part.alias("part"), (F.col("tf") * idf * idf * qtf).alias("dot"), F.when(asked, F.struct("term", "df")).alias("seen"))
    sums = staged(each.groupBy("id").agg(F.sum("part").alias("square"), F.sum("dot").alias("dot"), F.collect_set("seen").alias("seen")), "context-sums")
    # a document tells of each of the query's terms that it has in how many documents it is
    seen = {r["term"]: r["df"] for r in sums.where(F.size("seen") > 0).select(F.explode("seen").alias("s")).select("s.term", "s.df").distinct().collect()}
    length = math.sqrt(sum((k * (math.log((1.0 + n) / (2.0 + seen.get(t, 0))) + 1.0)) ** 2 for t, k in own.items())) or 1.0
    scores = sums.select("id", (F.col("dot") / F.lit(length) / F.sqrt("square")).alias("s"))
    return rows.select(F.col(id_col).alias("id")).join(scores, "id", "left").select("id", X.clip(F.coalesce("s", F.lit(0.0))).alias("lexical"))


def dense_search(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): exact inner products with unit vectors, the k highest; ties by id."""
    if k <= 0:
        raise ValueError("k must be positive")
    q = X.unit(F.array(*[F.lit(float(x)) for x in query]))
    scored = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), X.dot(X.unit(F.col(vector_col)), q).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 10)), "id").limit(k)


def _best_of(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    """(id, best, score) of queries (id, v) and rows (other, v) with vectors of one size: a product of matrices finds the rows near the best score, whose scores are then summed in the order of dimensions, so that equal vectors score the same."""
    x, y = (np.stack(t["v"].to_numpy()) for t in (q, r))
    ids, others = q["id"].to_numpy(), r["other"].to_numpy()
    found = []
    for begin in range(0, len(x), QUERIES_AT_ONCE):
        part = slice(begin, begin + QUERIES_AT_ONCE)
        rough = x[part] @ y.T
        rough[ids[part, None] == others[None, :]] = -np.inf
        rough[np.isnan(rough)] = np.inf  # counts as the highest, as Spark has it
        i, j = np.nonzero((rough >= rough.max(axis=1, keepdims=True) - NEAR) & (rough > -np.inf))
        for k in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[k : k + PAIRS_AT_ONCE] + begin, j[k : k + PAIRS_AT_ONCE]
            score = np.zeros(len(a))
            for d in range(x.shape[1]):
                score += x[a, d] * y[b, d]
            pairs = pd.DataFrame({"id": ids[a], "best": others[b], "score": score, "_nan": np.isnan(score)})
            found.append(pairs.sort_values(["_nan", "score", "best"], ascending=[False, False, True], kind="stable").drop_duplicates("id")[["id", "best", "score"]])
    return pd.concat(found) if found else pd.DataFrame({"id": ids[:0], "best": others[:0], "score": np.zeros(0)})


def best_match(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, by: str, blocks: int | None = None) -> DataFrame:
    """(id, best, score): for each query row the other row of the same group with the highest cosine, the smaller id on a tie; null vectors, and those of different sizes, don't meet. Ids are longs.

    The rows and the queries of a group are dealt over blocks, and each block of queries meets each of rows in a task of its
    own, so that a large group isn't one task; there are as many as the largest group needs for BLOCK_ROWS rows in each."""
    needed = lambda df: max(1, -(-df.groupBy(by).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] // BLOCK_ROWS))
    r_blocks, q_blocks = blocks or needed(rows), needed(queries)
    of = lambda n, seed: F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fine = lambda df: df.where((F.size(vector_col) > 0) & F.col(by).isNotNull() & F.forall(vector_col, lambda e: e.isNotNull())).select(F.col(id_col).cast("long").alias(id_col), F.col(by).alias("g"), F.size(vector_col).alias("size"), X.unit(F.col(vector_col)).alias("v"))
    q = fine(queries).withColumn("qb", of(q_blocks, 1)).withColumn("rb", every(r_blocks)).withColumnRenamed(id_col, "id")
    r = fine(rows).withColumn("rb", of(r_blocks, 2)).withColumn("qb", every(q_blocks)).withColumnRenamed(id_col, "other")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best_of(left, right) if len(left) and len(right) else pd.DataFrame({"id": [], "best": [], "score": []})

    key = ["g", "size", "qb", "rb"]
    pairs = q.groupBy(*key).cogroup(r.groupBy(*key)).applyInPandas(work, "id long, best long, score double")
    return pairs.groupBy("id").agg(F.max(F.struct("score", (-F.col("best")).alias("o"))).alias("m")).select("id", (-F.col("m.o")).alias("best"), F.col("m.score").alias("score"))


def ranked(hits: DataFrame, name: str) -> DataFrame:
    """Top-k hits with their place from 1; hits is a short list."""
    return hits.withColumn(f"{name}_rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 10)), "id"))).withColumnRenamed("score", f"{name}_score")


def fuse(lexical: DataFrame, dense: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two top-k lists (id, score): (id, score, tfidf_rank, dense_rank, tfidf_score, dense_score)."""
    if rrf_k <= 0 or k <= 0:
        raise ValueError("rrf_k and k must be positive")
    both = ranked(lexical, "tfidf").join(ranked(dense, "dense"), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    out = both.withColumn("score", F.round(part("tfidf_rank") + part("dense_rank"), 6))
    return out.orderBy(F.desc("score"), F.asc_nulls_last("tfidf_rank"), "dense_rank").limit(k)


def over_fetch(k: int) -> int:
    """How many hits each side gives for a fused list of k."""
    return max(2 * k, 20)


def hybrid_search(docs: DataFrame | Index, vectors: DataFrame, query: str, query_vector: Sequence[float], k: int = 10, stop: Sequence[str] = (), tenant: str | None = None, tenant_col: str = "organization_id") -> DataFrame:
    """The k best of both sides fused, of one tenant's rows if one is given; no documents give no rows. docs may be an open index, which is one tenant's then."""
    if tenant is not None:
        vectors = vectors.where(F.col(tenant_col) == tenant)
        docs = docs if isinstance(docs, Index) else docs.where(F.col(tenant_col) == tenant)
    n = over_fetch(k)
    lexical = search(docs, query, n) if isinstance(docs, Index) else tfidf_search(docs, query, n, stop=stop)
    return fuse(lexical, dense_search(vectors, query_vector, n), k)


def answer(hits: DataFrame) -> DataFrame:
    """Fused hits as a caller gets them: ranks and the fused score, without the scores of either side."""
    return hits.select("id", "score", "tfidf_rank", "dense_rank")
