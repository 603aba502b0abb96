"""From a change request to scored impact rows, over tables that are already extracted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import graph, impact, retrieval
from lodestone.sources.scratch import checkpointed

#: Shares of the dense and the lexical similarity of an entity (fixed values).
DENSE, LEXICAL = 0.75, 0.25


def relevant_chunks(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], top_k: int, stop: Sequence[str] = (), index: retrieval.Index | None = None) -> DataFrame:
    """(chunk_id, rank, evidence): the hits of both searches, fused, that pass the gate. index: an open one of the chunks."""
    n = retrieval.over_fetch(top_k)
    lexical = retrieval.search(index, query, n) if index else retrieval.tfidf_search(chunks, query, n, "id", "content", stop)
    dense = retrieval.dense_search(vectors, query_vector, n, "id", "vector")
    return impact.chunk_evidence(retrieval.fuse(lexical, dense, n)).select(F.col("id").alias("chunk_id"), "rank", "evidence")


def entity_scores(hits: DataFrame, mentions: DataFrame, nodes: DataFrame, query: str, query_vector: Sequence[float], stop: Sequence[str] = ()) -> DataFrame:
    """(id, name, evidence, similarity, named, occurrences) of the entities that the hits mention and the graph has.

    An entity's context is the name and description of its first mention; similarity is 0.75 of the clipped cosine of its
    vector and 0.25 of the TF-IDF cosine of its context and the request. Hits are a short list and come by a broadcast."""
    found = mentions.join(F.broadcast(hits), "chunk_id").join(nodes.select(F.col("id").alias("canonical_id")), "canonical_id", "left_semi")
    found = checkpointed(found.select("canonical_id", "rank", "evidence", "place", "name", "description"))
    about = checkpointed(impact.contexts(found).withColumnRenamed("canonical_id", "id"))
    lexical = retrieval.similarity_to(query, about, "id", "context", stop)
    q = X.unit(F.array(*[F.lit(float(x)) for x in query_vector]))
    dense = X.clip(F.coalesce(X.dot(X.unit(F.col("vector")), q), F.lit(0.0)))
    rated = about.join(lexical, "id").join(nodes.select("id", "vector"), "id").join(impact.fold_evidence(found.withColumnRenamed("canonical_id", "id"), "id").drop("occurrences"), "id")
    named = F.contains(F.lower(F.lit(query)), F.lower("name"))
    return rated.select("id", "name", "evidence", X.clip(DENSE * dense + LEXICAL * F.col("lexical")).alias("similarity"), named.alias("named"), "occurrences")


def analyze(chunks: DataFrame, vectors: DataFrame, mentions: DataFrame, nodes: DataFrame, edges: DataFrame, documents: DataFrame, query: str, query_vector: Sequence[float], top_k: int = 10, max_distance: int = 3, stop: Sequence[str] = (), index: retrieval.Index | None = None) -> DataFrame:
    """Impact rows of a request, each with the documents that mention it; no rows for a blank request or an empty graph.

    chunks: id, document_id, content; vectors: id, vector of the chunks; mentions: chunk_id, canonical_id, name,
    description, place (order in the chunk); nodes: id, name, entity_type, vector; edges: source, target,
    relationship_type, confidence; documents: id, filename; index: an open index of the chunks' contents, which spares one built
    for the request."""
    if top_k <= 0 or max_distance < 0:
        raise ValueError("top_k must be positive and max_distance not negative")
    blank = not query.strip()
    edges = graph.valid_edges(nodes, edges)
    rated = nodes.select("id", "name", "entity_type").join(graph.centrality(nodes, edges), "id")
    if blank:
        seeds = rated.select("id", F.lit(0.0).alias("semantic")).limit(0)
    else:
        hits = checkpointed(relevant_chunks(chunks, vectors, query, query_vector, top_k, stop, index))
        seeds = checkpointed(impact.seeds(entity_scores(hits, mentions, nodes, query, query_vector, stop)))
    rows = checkpointed(impact.propagate(rated, edges, seeds, max_distance))
    named = impact.explained(rows, nodes)
    return named.join(impact.source_documents(rows, mentions, chunks, documents), "id")
