"""Reads and writes of the extracted tables: lookups by key and tenant, listings, counts, checked inserts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(table: DataFrame, **keys: object) -> DataFrame:
    """The rows whose columns equal the given values; null equals nothing. Equalities reach the scan as pushed filters."""
    for name, value in keys.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def tenant_documents(documents: DataFrame, tenant: object, tenant_col: str = "organization_id", newest: str = "created_at") -> DataFrame:
    """A tenant's documents, newest first."""
    return documents.where(F.col(tenant_col) == F.lit(tenant)).orderBy(F.desc(newest))


def organizations(table: DataFrame, newest: str = "created_at") -> DataFrame:
    """All organizations, newest first."""
    return table.orderBy(F.desc(newest))


def recent(rows: DataFrame, n: int = 4, newest: str = "created_at", tie: str = "id") -> DataFrame:
    """The n newest rows."""
    return rows.orderBy(F.desc(newest), tie).limit(n)


def document_chunks(chunks: DataFrame, document: object) -> DataFrame:
    """A document's chunks in their order."""
    return chunks.where(F.col("document_id") == F.lit(document)).orderBy("chunk_index")


def tenant_chunks(chunks: DataFrame, documents: DataFrame, tenant: object, tenant_col: str = "organization_id") -> DataFrame:
    """The chunks of a tenant's documents, by document and place."""
    own = documents.where(F.col(tenant_col) == F.lit(tenant)).select(F.col("id").alias("document_id"))
    return chunks.join(own, "document_id").orderBy("document_id", "chunk_index")


def located_relations(relations: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """relations (evidence_chunk_id, ...) with the document of their evidence and its organization; those without evidence go."""
    placed = relations.join(chunks.select(F.col("id").alias("evidence_chunk_id"), "document_id"), "evidence_chunk_id")
    return placed.join(documents.select(F.col("id").alias("document_id"), "organization_id"), "document_id")


def index_stats(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, relations: DataFrame | None = None, by: str = "id") -> DataFrame:
    """(by, n_documents, n_chunks, n_entities, n_relations) over documents (id, ...), chunks (id, document_id), mentions (chunk_id, canonical_id) and relations (id, evidence_chunk_id).

    Each table is counted on its own key, so that no join multiplies another's rows."""
    own = documents.select(F.col("id").alias("document_id"), F.col(by).alias("by"))
    placed = chunks.select(F.col("id").alias("chunk_id"), "document_id").join(own, "document_id")
    out = own.groupBy("by").agg(F.countDistinct("document_id").alias("n_documents"))
    parts = [placed.groupBy("by").agg(F.count("*").alias("n_chunks")), mentions.join(placed, "chunk_id").groupBy("by").agg(F.countDistinct("canonical_id").alias("n_entities"))]
    if relations is not None:
        told = relations.select("id", F.col("evidence_chunk_id").alias("chunk_id")).join(placed, "chunk_id")
        parts.append(told.groupBy("by").agg(F.countDistinct("id").alias("n_relations")))
    for part in parts:
        out = out.join(part, "by", "left")
    return out.na.fill(0, [c for c in out.columns if c.startswith("n_")]).withColumnRenamed("by", by)


def status_counts(rows: DataFrame, status: Column, groups: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row with the number of rows of each group of statuses."""
    groups = groups or {"completed": ("completed",), "pending": ("pending", "processing"), "failed": ("failed",)}
    return rows.agg(*[F.count_if(status.isin(*own)).alias(name) for name, own in groups.items()])


def count_for(rows: DataFrame, key: str, value: object) -> DataFrame:
    """One row n: how many rows have the value."""
    return rows.where(F.col(key) == F.lit(value)).agg(F.count("*").alias("n"))


def insert(rows: DataFrame, path: str, parents: Mapping[str, tuple[DataFrame, str]] | None = None) -> None:
    """Appends rows whose references exist: parents has for each column the table and its key."""
    for column, (table, key) in (parents or {}).items():
        rows = rows.join(table.select(F.col(key).alias("_parent")), F.col(column) == F.col("_parent"), "left_semi")
    rows.write.mode("append").parquet(path)


def store_path(root: str, organization: Column, document: Column, suffix: Column) -> Column:
    """Where a document's file is kept: root/organization/document and its suffix."""
    return F.concat(F.lit(root.rstrip("/") + "/"), organization.cast("string"), F.lit("/"), document.cast("string"), F.lower(suffix))


def store_files(files: DataFrame, path: str, tenant: str = "organization_id") -> None:
    """Files (organization_id, document_id, suffix, content) under path by tenant; a failed job leaves nothing behind, for the committer removes its parts."""
    files.write.mode("append").partitionBy(tenant).parquet(path)


def collected(rows: DataFrame, key: Column, value: str) -> DataFrame:
    """(key, members): the sorted values of each key. Members of one key are one row: for keys that hold a result list."""
    return rows.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(value)).alias("members"))


def largest(rows: DataFrame, value: str) -> DataFrame:
    """One row: the greatest value, 0 if there is none."""
    return rows.agg(F.coalesce(F.max(value), F.lit(0)).alias(value))
