"""Entity evidence and scored propagation of a change through the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import clip
from lodestone.operators import graph

#: Weights and thresholds (fixed values).
LEAST_SCORE = 0.18
TIERS = {1: (0.12, 0.60), 2: (0.20, 0.70), 3: (0.24, 0.82)}
LEAST_EVIDENCE, LEAST_SIMILARITY, LEAST_COMBINED = 0.15, 0.20, 0.50
DIRECT_TYPES = ("API", "SYSTEM", "WORKFLOW", "POLICY", "DOCUMENTATION", "BUSINESS_CONCEPT")


def chunk_evidence(hits: DataFrame) -> DataFrame:
    """Hits (id, dense_score, tfidf_score) that pass a gate, ranked again: evidence = 0.8 relevance + 0.2 / sqrt(rank)."""
    dense, lexical = (clip(F.coalesce(c, F.lit(0.0))) for c in ("dense_score", "tfidf_score"))
    kept = hits.select("*", dense.alias("_d"), lexical.alias("_t")).where("_d >= 0.20 or _t >= 0.08").withColumn("relevance", F.greatest("_d", "_t")).drop("_d", "_t")
    rank = F.row_number().over(Window.orderBy(F.desc("relevance"), "id"))  # a top-k list
    return kept.withColumn("rank", rank).withColumn("evidence", 0.8 * F.col("relevance") + 0.2 / F.sqrt("rank"))


def fold_evidence(rows: DataFrame, key: str) -> DataFrame:
    """(key, evidence, occurrences) of rows (key, rank, evidence): the first counts whole, each further one half, at most 1."""
    first = F.min(F.struct("rank", "evidence"))["evidence"]
    out = rows.groupBy(key).agg(first.alias("first"), F.sum("evidence").alias("all"), F.count("*").alias("occurrences"))
    return out.select(key, F.least(F.lit(1.0), F.col("first") + 0.5 * (F.col("all") - F.col("first"))).alias("evidence"), "occurrences")


def contexts(rows: DataFrame, key: str = "canonical_id") -> DataFrame:
    """(key, name, description, context, occurrences) of mention rows (key, rank, place, name, description): how often each entity is mentioned, and the first mention's name with its description, by the rank of the chunk and the place in it."""
    first = F.min(F.struct("rank", "place", "name", "description")).alias("f")
    out = rows.groupBy(key).agg(first, F.count("*").alias("occurrences"))
    text = F.concat_ws(" ", "f.name", F.nullif(F.col("f.description"), F.lit("")))
    return out.select(key, "f.name", "f.description", text.alias("context"), "occurrences")


def source_documents(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, documents): the distinct documents (name, id) that mention each asked entity (a column id), by name; an entity without any has an empty list.

    mentions: canonical_id, chunk_id; chunks: id, document_id; documents: id, filename. Asked entities are few and go first, so that only their mentions meet the chunks. Documents are made distinct once, in the set of their entity."""
    asked = entities.select("id").distinct()
    found = mentions.select(F.col("canonical_id").alias("id"), "chunk_id").join(asked, "id", "left_semi")
    placed = found.join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id").select("id", "document_id")
    named = placed.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id")
    listed = named.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("filename", "document_id"))).alias("documents"))
    return asked.join(listed, "id", "left").select("id", F.coalesce("documents", F.array().cast(listed.schema["documents"].dataType)).alias("documents"))


def seed_score(evidence: Column, similarity: Column, named: Column, occurrences: Column) -> Column:
    bonus = F.when(named, 0.05).otherwise(0.0) * evidence + F.least(F.lit(0.10), 0.03 * (occurrences - 1)) * evidence
    return clip(0.4 * evidence + 0.6 * similarity + bonus)


def seeds(rows: DataFrame) -> DataFrame:
    """Rows (id, evidence, similarity, named, occurrences) that pass all thresholds, as (id, semantic)."""
    score = seed_score(F.col("evidence"), F.col("similarity"), F.col("named"), F.col("occurrences"))
    out = rows.withColumn("semantic", score).where((F.col("evidence") >= LEAST_EVIDENCE) & (F.col("similarity") >= LEAST_SIMILARITY) & (F.col("semantic") >= LEAST_COMBINED))
    return out.select("id", "semantic")


def level(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.50, "MEDIUM").when(score >= 0.25, "LOW").otherwise("MINIMAL")


def propagate(nodes: DataFrame, edges: DataFrame, seed_rows: DataFrame, max_distance: int = 3) -> DataFrame:
    """(id, score, level, distance, path, label, category): the best impact row of each entity.

    nodes: id, name, entity_type, importance; seed_rows: id, semantic. Seeds are direct rows; nodes within max_distance
    get a propagated row from each seed that reaches them, pruned by the distance's tier and the least score."""
    if max_distance < 0:
        raise ValueError("max_distance must not be negative")
    known = nodes.select("id", "entity_type", "importance")
    direct = seed_rows.join(known, "id").withColumn("raw", 0.85 * F.col("semantic") + 0.15 * F.col("importance"))
    kind = F.when(F.col("entity_type") == "TEAM", "STAKEHOLDER").when(F.col("entity_type").isin(*DIRECT_TYPES), "DIRECT_CHANGE").otherwise("REVIEW_REQUIRED")
    direct = direct.select("id", F.col("id").alias("seed"), "raw", F.lit(0).alias("distance"), F.array("id").alias("path"), F.lit("DIRECT").alias("label"), kind.alias("category"))
    tiers = F.create_map(*[x for d, (a, b) in TIERS.items() for x in (F.lit(d), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])[F.col("distance")]
    # over d hops a seed gives semantic / d at most, whatever the path: it stops before the first tier that it can't pass
    most = F.lit(0)
    for d in sorted(TIERS):
        most = F.when((most == d - 1) & (F.col("semantic") / d >= TIERS[d][0]), d).otherwise(most)
    # a row's score grows with its path's strength and of equal ones the smaller seed counts, so leaves of the same score give way
    found = graph.reach(edges, seed_rows.select("id", most.alias("most"), "semantic"), min(max_distance, max(TIERS)), "semantic")
    near = found.join(seed_rows.withColumnRenamed("id", "seed"), "seed").join(known.withColumnRenamed("id", "node"), "node")
    proximity = F.try_divide(F.lit(1.0), F.col("distance"))
    spread = clip(F.col("semantic") * F.col("strength") * proximity)
    raw = clip(0.60 * spread + 0.25 * F.col("strength") * proximity + 0.15 * proximity * F.col("importance"))
    near = near.withColumns({"ps": spread, "raw": raw, "tier": tiers}).where((F.col("ps") >= F.col("tier.a")) & (F.col("strength") >= F.col("tier.b")) & (F.col("raw") >= LEAST_SCORE))
    label = F.when(F.size("labels") == 0, "CONNECTED").otherwise(F.array_join("labels", " → "))
    category = F.when(F.array_contains("labels", "OWNED_BY"), "STAKEHOLDER").when(F.array_contains("labels", "RELATED_TO"), "INFORMATIONAL").otherwise("REVIEW_REQUIRED")
    near = near.select(F.col("node").alias("id"), "seed", "raw", "distance", "path", label.alias("label"), category.alias("category"))
    every = direct.unionAll(near).withColumns({"score": F.round("raw", 4), "level": level(F.col("raw"))})
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "distance", "seed"))
    return every.withColumn("_n", best).where("_n = 1").select("id", "score", "level", "distance", "path", "label", "category")


def explained(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with a sentence for each."""
    named = rows.join(nodes.select("id", "name"), "id")
    text = F.when(F.col("distance") == 0, F.format_string("%s is directly affected (score %.2f).", "name", "score")).when(F.col("distance") == 1, F.format_string("%s is one step away by %s (score %.2f).", "name", "label", "score"))
    return named.withColumn("explanation", text.otherwise(F.format_string("%s is %d steps away by %s (score %.2f).", "name", "distance", "label", "score")))
