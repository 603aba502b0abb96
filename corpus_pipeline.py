"""A training-data pipeline over documents: toxicity, line dedup, SimHash near-dedup, mixing, piece encoding.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common, lines, mixing, pieces, simhash, toxicity

#: A document with this score or more is rejected.
TOXIC_FROM = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC_FROM. Texts without terms have nothing toxic in them and stay."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = toxicity.score(docs.withColumnRenamed("score", "_own_score") if "score" in docs.columns else docs, machine)
    kept = scored.where((F.col("score") < TOXIC_FROM) | F.col("text").isNull() | ~F.col("text").rlike(r"[\p{L}\p{N}]")).drop("score")
    return kept.withColumnRenamed("_own_score", "score").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that an earlier line makes superfluous; n_chars follows the text."""
    done = lines.dedup(docs, short_repeats=True).select(*docs.columns)
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of rows with one id the one whose text has the smallest hash; rows without an id stay apart where their texts differ.

    Only rows whose id may go are shuffled with their texts: those that a bitmap shows to stay pass by."""
    ids = simhash.near_duplicates(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("heads"))
    unsure = common.staged(ids.where("n > 1 or heads = 0 or doc_id is null"), "pipeline-unsure")
    keyed = docs.select(F.col("doc_id").alias("id"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    told = common.marked(keyed, unsure.select(F.col("doc_id").alias("id")), ["id"])
    sure, maybe = told.where("not _maybe").select("row"), told.where("_maybe").select("id", "row")
    text = F.col("row")["text"]
    found = common.lookup(maybe, unsure, "id", ["heads"], "n", F.xxhash64(text), "doc_id")
    lone = unsure.where("doc_id is null and heads > 0").select("heads").first() is not None
    kept = found.where(F.when(F.col("id").isNull(), F.lit(lone)).otherwise(F.coalesce("heads", F.lit(1)) > 0))
    first = F.row_number().over(Window.partitionBy("id", F.when(F.col("id").isNull(), F.xxhash64(text))).orderBy(F.xxhash64(text), F.col("row")["source"], F.col("row")["lang"]))
    return sure.unionAll(kept.withColumn("first", first).where("first = 1").select("row")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = docs.select("doc_id", "text", "source", F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return mixing.mix(rows).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: the best segmentation's length and digest, the scores of the best, and whether decoding gives the text."""
    return pieces.digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: SQL has no learned scores and no search over a lattice; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has written is dropped once the next one has."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop_staged(*before)
        before = [docs]
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
