"""Documents and what is derived from them, kept up as documents come, change and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking, entities, graph, relations
from lodestone.sources.keyed import Change, Table, Tables

#: Canonical entities and edges don't cascade: update() holds them to the mentions and relations that are left.
SCHEMA = {
    "documents": Table("id string, organization_id string, filename string, text string", ("id",), "id"),
    "chunks": Table("id string, document_id string, chunk_index int, content string", ("id",), "document_id", {"document_id": "documents"}),
    "mentions": Table("id string, chunk_id string, canonical_id string, name string, normalized_name string, entity_type string, organization_id string", ("id",), "chunk_id", {"chunk_id": "chunks"}),
    "relations": Table("chunk_id string, source string, target string, relationship_type string, confidence double, evidence string", ("chunk_id", "source", "target", "relationship_type"), "chunk_id", {"chunk_id": "chunks", "source": "mentions", "target": "mentions"}),
    "canonical": Table("id string, organization_id string, name string, normalized_name string, entity_type string", ("id",), "id"),
    "edges": Table("source string, target string, relationship_type string, confidence double", ("source", "target", "relationship_type"), "source"),
}
EDGE = ["source", "target", "relationship_type"]
#: Documents that one task derives from at most where their texts are short: by bytes alone a few megabytes of them are one task.
DOCUMENTS_A_FILE = 10_000


def tables(spark: SparkSession, root: str, buckets: int = 64) -> Tables:
    return Tables(spark, root, SCHEMA, buckets)


def _name(*parts: str | Column) -> Column:
    """An id made of the parts' digest, the same whenever it is made."""
    return F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(32))


def derived(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, mentions) of documents, with ids that depend on the documents alone."""
    packed = chunking.chunks(documents, "id", "text").withColumn("id", F.concat_ws("-", "document_id", "chunk_index"))
    chunks = packed.select("id", "document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content")
    found = entities.mentions(entities.without_overlaps(entities.candidates(chunks.select(F.col("id").alias("chunk_id"), "content"))))
    own = documents.select(F.col("id").alias("document_id"), "organization_id")
    placed = found.withColumnRenamed("id", "chunk_id").join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id").join(own, "document_id")
    mentions = placed.select(_name("chunk_id", "normalized_name", "entity_type").alias("id"), "chunk_id", _name("organization_id", "normalized_name", "entity_type").alias("canonical_id"), "name", "normalized_name", "entity_type", "organization_id")
    return chunks, mentions


def told(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """The relations that chunks state between their mentions."""
    return relations.extract(chunks.select(F.col("id").alias("chunk_id"), "content"), mentions.select("chunk_id", "id", "name")).select("chunk_id", *EDGE, "confidence", "evidence")


def canonical_of(mentions: DataFrame) -> DataFrame:
    """The canonical entities that mentions stand for, with the least of their names."""
    return mentions.groupBy(F.col("canonical_id").alias("id")).agg(F.min("organization_id").alias("organization_id"), F.min("name").alias("name"), F.min("normalized_name").alias("normalized_name"), F.min("entity_type").alias("entity_type"))


def update(base: Tables, documents: DataFrame | None = None, gone: DataFrame | None = None) -> None:
    """Puts documents (id, organization_id, filename, text; one row an id) in the place of those with their ids, and takes out those with the ids gone (a column id), with all that is derived from them, as one change.

    Chunks, mentions and relations of these documents go and come by cascades and keys. Of canonical entities and edges just
    those are computed again that a mention or relation that goes or comes belongs to: one that has lost its last goes too.
    Texts are read for the documents given alone; mentions and relations that stay are read for those keys."""
    change = base.change()
    try:
        _apply(change, documents, gone)
        change.commit()
    finally:
        change.discard()


def _apply(change: Change, documents: DataFrame | None, gone: DataFrame | None) -> None:
    fresh = None if documents is None else change._hold(documents.select("id", "organization_id", "filename", "text"), "documents", DOCUMENTS_A_FILE)
    ids = [x.select("id") for x in (fresh, gone) if x is not None]
    if not ids:
        return
    out = change._hold(ids[0] if len(ids) == 1 else ids[0].unionAll(ids[1]), "ids").distinct()
    chunks = change.current["chunks"].join(out.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    lost_mentions = change._hold(change.current["mentions"].join(chunks, "chunk_id", "left_semi").select("id", "canonical_id"), "lost-mentions")
    lost_edges = change._hold(_edge_keys(change.current["relations"].join(chunks, "chunk_id", "left_semi"), change.current["mentions"]), "lost-edges")
    change.delete("documents", out)
    names, keys = lost_mentions.select("canonical_id"), lost_edges
    if fresh is not None:
        change.put("documents", fresh)
        new_chunks, new_mentions = derived(fresh)
        new_chunks = change.put("chunks", new_chunks)
        new_mentions = change.put("mentions", new_mentions)
        new_relations = change.put("relations", told(new_chunks, new_mentions))
        names, keys = names.unionAll(new_mentions.select("canonical_id")), keys.unionAll(_edge_keys(new_relations, new_mentions))
    names, keys = change._hold(names.distinct(), "names"), change._hold(keys.distinct(), "keys")
    left = canonical_of(change.current["mentions"].join(names, "canonical_id", "left_semi"))
    _renew(change, "canonical", names.withColumnRenamed("canonical_id", "id"), left)
    # relations whose ends stand for the ends of such an edge
    edges = graph.resolve(change.current["relations"].select("source", "target", "relationship_type", "confidence"), change.current["mentions"].join(_ends(keys), "canonical_id", "left_semi"))
    _renew(change, "edges", keys, edges.join(keys, EDGE, "left_semi"))


def _ends(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("source").alias("canonical_id")).unionAll(keys.select("target")).distinct()


def _edge_keys(rows: DataFrame, mentions: DataFrame) -> DataFrame:
    return graph.resolve(rows.select("source", "target", "relationship_type", "confidence"), mentions).select(*EDGE).distinct()


def _renew(change: Change, name: str, keys: DataFrame, rows: DataFrame) -> None:
    """The rows of name with keys become rows."""
    own = change._hold(rows, name)
    change.delete(name, keys.join(own, keys.columns, "left_anti"))
    change.put(name, own)
