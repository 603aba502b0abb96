"""A lexical index that is saved, opened by its path and kept up to date document by document.

Its tables: pairs, what slices of documents hold of each group of terms (term_sums.pairs), by buckets of groups; forward (id, gen, tokens);
docs (id, gen), the present documents. gen is the generation that wrote a document: only its present one counts, so that a
replaced document's old pairs needn't be found to be outdated; of a document that goes, only how many others have its terms is
written, as less than none.

A document's length needs the inverse frequencies of all its terms, and these change with every document. Lengths (id, gen,
norm) are therefore made when a changed index is opened first, from the pairs alone, and saved with that version."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import term_sums
from lodestone.operators.retrieval import Index, document_frequencies, token_counts
from lodestone.sources import snapshots
from lodestone.sources.snapshots import Snapshot


def _schemas(facts: dict) -> dict[str, str]:
    key = facts["id_type"]
    return {
        "pairs": f"slice long, {term_sums.FIELDS.format(key)}, term_group int, bucket int",
        "forward": f"id {key}, gen int, tokens string",
        "docs": f"id {key}, gen int",
        "lengths": f"id {key}, gen int, norm double",
    }


def _tables(spark: SparkSession, at: Snapshot) -> dict[str, DataFrame]:
    return {name: at.table(spark, name, schema) for name, schema in _schemas(at.facts).items()}


def _write_pairs(root: str, fresh: DataFrame, lost: DataFrame | None, facts: dict) -> str:
    """The folder of what fresh documents (id, gen, tokens) add and lost ones take from the pairs."""
    made = lambda rows, **how: term_sums.pairs(rows.select("id", "tokens"), facts["groups"], facts["stop"], facts["sizes"], facts["gen"], **how)
    rows = made(fresh) if lost is None else made(fresh).unionAll(made(lost, lost=True))
    # the ids of all slices have a bucket of their own; a task writes its rows where they are made, group after group
    rows = rows.withColumn("term_group", F.greatest("term_group", F.lit(-1)).cast("int")).withColumn("bucket", F.floor(F.col("term_group") * facts["buckets"] / facts["groups"]).cast("int"))
    return snapshots.stage(rows.sortWithinPartitions("bucket", "term_group"), root, "pairs", ["bucket"])


def create(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", stop: Sequence[str] = (), sizes: Sequence[int] = (1, 2), max_df: float = 0.95, sublinear: bool = True, buckets: int = 64) -> Snapshot:
    """Indexes docs (one row an id, which isn't null) under root, a path that all executors share, in place of what may be there; terms are in as many buckets, and in as many groups or more."""
    spark = docs.sparkSession
    facts = {"id_type": docs.schema[id_col].dataType.simpleString(), "stop": list(stop), "sizes": list(sizes), "max_df": max_df, "sublinear": sublinear, "buckets": buckets, "groups": max(buckets, term_sums.groups_for(docs, text_col, sizes)), "gen": 0, "n_docs": 0}
    before = snapshots.latest(spark, root)
    return _changed(Snapshot(root, before.number, {}, facts), docs, None, id_col, text_col)


def replace(spark: SparkSession, root: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """Puts docs (one row an id) in the place of the documents with their ids, or adds them, all or nothing; who opens the index from then on finds them."""
    return _changed(_existing(spark, root), docs, docs.select(F.col(id_col).alias("id")), id_col, text_col)


def delete(spark: SparkSession, root: str, ids: DataFrame, id_col: str = "doc_id") -> Snapshot:
    """Takes the documents with the ids out; ids that aren't there change nothing."""
    none = ids.select(F.col(id_col), F.lit("").alias("text")).limit(0)
    return _changed(_existing(spark, root), none, ids.select(F.col(id_col).alias("id")).distinct(), id_col, "text")


def _existing(spark: SparkSession, root: str) -> Snapshot:
    found = snapshots.latest(spark, root)
    if not found.number:
        raise ValueError(f"no index under {root}")
    return found


def _changed(now: Snapshot, docs: DataFrame, gone: DataFrame | None, id_col: str, text_col: str) -> Snapshot:
    """The version of the index in which the documents with the ids `gone` are replaced by docs."""
    spark, root = docs.sparkSession, now.root
    facts = now.facts | {"gen": now.facts["gen"] + 1}
    tables, schemas = _tables(spark, now), _schemas(now.facts)
    tokens = term_sums.joined_tokens(docs, id_col, text_col).select("id", F.lit(facts["gen"]).alias("gen"), "tokens")
    fresh_folder = snapshots.stage(tokens, root, "forward")
    fresh = spark.read.schema(schemas["forward"]).parquet(f"{root}/{fresh_folder}")
    n_fresh, n_ids = fresh.agg(F.count("*"), F.count_distinct("id")).first()
    if n_fresh != n_ids:
        raise ValueError("an id has two documents, or none")
    scratch, lost, live, n_old = [], None, fresh.select("id", "gen"), 0
    if gone is not None:
        scratch.append(snapshots.stage(tables["docs"].join(gone, "id", "left_semi"), root, "gone"))
        old = spark.read.schema(schemas["docs"]).parquet(f"{root}/{scratch[-1]}")
        n_old = old.count()
        lost = tables["forward"].join(old, ["id", "gen"], "left_semi")
        live = tables["docs"].join(old.select("id"), "id", "left_anti").unionAll(live)
    facts["n_docs"] = now.facts["n_docs"] + n_fresh - n_old
    folders = {"pairs": [*now.tables.get("pairs", []), _write_pairs(root, fresh, lost, facts)], "forward": [*now.tables.get("forward", []), fresh_folder], "docs": [snapshots.stage(live, root, "docs")]}
    done = snapshots.commit(spark, now, folders, facts)
    for folder in scratch:
        snapshots.drop(spark, f"{root}/{folder}")
    return done


def compact(spark: SparkSession, root: str) -> Snapshot:
    """Rewrites pairs and forward rows without those of documents that were replaced, each in one folder."""
    now = _existing(spark, root)
    facts, tables = now.facts | {"gen": now.facts["gen"] + 1}, _tables(spark, now)
    live = tables["forward"].join(tables["docs"], ["id", "gen"], "left_semi").withColumn("gen", F.lit(facts["gen"]))
    forward = snapshots.stage(live, root, "forward")
    back = spark.read.schema(_schemas(facts)["forward"]).parquet(f"{root}/{forward}")
    return snapshots.commit(spark, now, {"pairs": [_write_pairs(root, back, None, facts)], "forward": [forward], "docs": [snapshots.stage(back.select("id", "gen"), root, "docs")]}, facts)


def _kept(facts: dict) -> float:
    return facts["max_df"] * facts["n_docs"]


def _measured(spark: SparkSession, now: Snapshot) -> Snapshot:
    """The version with the lengths of its documents; those without a term that counts are left out."""
    tables, n, most = _tables(spark, now), now.facts["n_docs"], _kept(now.facts)
    squares = term_sums.added(tables["pairs"].withColumn("term_group", F.when(F.col("term_group") < 0, -1 - F.col("slice")).otherwise(F.col("term_group"))), lambda df: [np.where(df <= most, (np.log((1.0 + n) / (1.0 + df)) + 1.0) ** 2, 0.0)], 1, now.facts["sublinear"])
    norms = squares.where("s0 > 0").join(tables["docs"], ["id", "gen"], "left_semi").select("id", "gen", F.sqrt("s0").alias("norm"))
    return snapshots.commit(spark, now, now.tables | {"lengths": [snapshots.stage(norms, now.root, "lengths")]}, now.facts)


def open_index(spark: SparkSession, root: str) -> Index:
    """The latest version as retrieval.search() reads it: of pairs only the groups of the terms asked for. The first to open a version saves its lengths."""
    now = _existing(spark, root)
    if "lengths" not in now.tables:
        try:
            now = _measured(spark, now)
        except snapshots.Conflict:
            return open_index(spark, root)
    tables, facts = _tables(spark, now), now.facts
    n, key = facts["n_docs"], ["id", "gen"]
    counts = token_counts(tables["forward"].join(tables["docs"], key, "left_semi").select("id", "tokens"), facts["stop"], facts["sizes"])

    def lookup(terms: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        asked = term_sums.by_group(terms, facts["groups"])
        found = term_sums.found(tables["pairs"].where(F.col("bucket").isin([g * facts["buckets"] // facts["groups"] for g in asked])), asked)
        df = found.groupBy("term").agg(F.sum("n").alias("df")).where((F.col("df") > 0) & (F.col("df") <= _kept(facts)))
        idf = df.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
        at = found.select("slice", "term", F.explode("at").alias("a"))
        ids = tables["pairs"].where("term_group < 0").select("slice", "gen", "ids")
        return idf, at.join(ids, "slice").select(F.element_at("ids", F.col("a.place") + 1).alias("id"), "gen", "term", F.col("a.tf").alias("tf"))

    return Index(counts, document_frequencies(counts, n, facts["max_df"]), tables["lengths"], n, tuple(facts["stop"]), tuple(facts["sizes"]), facts["sublinear"], tuple(key), lookup)
