"""Files in, tables out: text, DOCX and PDF readers, upload checks, and keyed replacement."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import safe_filename, strip

MOST_BYTES = 25 * 1024 * 1024
MIME = {"txt": "text/plain", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, suffix, size, content) of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return found.select("path", name.alias("name"), suffix(name).alias("suffix"), F.col("length").alias("size"), "content")


def docx_text(raw: bytes) -> str:
    """Non-empty paragraphs of a DOCX file, joined by blank lines."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = ("".join(t.text or "" for t in p.iter(f"{w}t")).strip() for p in root.iter(f"{w}p"))
    return "\n\n".join(p for p in found if p)


def pdf_text(raw: bytes) -> str:
    """Non-empty pages of a PDF file, joined by blank lines; needs the optional pypdf."""
    import pypdf

    pages = ((p.extract_text() or "").strip() for p in pypdf.PdfReader(io.BytesIO(raw)).pages)
    return "\n\n".join(p for p in pages if p)


def with_text(files: DataFrame) -> DataFrame:
    """files with extracted_text and reason: why a file was refused, else null. Where files have a column mime, what an upload says of itself, it must be that of the suffix or application/octet-stream."""

    def parse(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            out = []
            for kind, raw in zip(t["suffix"], t["content"], strict=True):
                try:
                    out.append((docx_text(raw) if kind == "docx" else pdf_text(raw), None))
                except (ImportError, KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    out.append((None, f"unreadable: {type(e).__name__}"))
            yield t.drop(columns="content").assign(extracted_text=[x for x, _ in out], reason=[r for _, r in out])

    kinds = accepted_mime(F.col("suffix"), F.col("mime")) if "mime" in files.columns else F.lit(True)
    misnamed = files.where(F.col("suffix").isin(*MIME) & ~F.coalesce(kinds, F.lit(False))).withColumns({"extracted_text": F.lit(None).cast("string"), "reason": F.lit("wrong media type")})
    files = files.where(~F.col("suffix").isin(*MIME) | F.coalesce(kinds, F.lit(False))).drop("mime")
    small = F.col("size") <= MOST_BYTES
    plain = files.where((F.col("suffix") == "txt") & small)
    plain = plain.withColumn("extracted_text", strip(F.expr("string(content)"))).withColumn("reason", F.when(F.col("extracted_text") == "", "no text"))
    rich = files.where(F.col("suffix").isin("docx", "pdf") & small).mapInPandas(parse, "path string, name string, suffix string, size long, extracted_text string, reason string")
    rich = rich.withColumn("reason", F.when(F.col("extracted_text") == "", "no text").otherwise(F.col("reason")))
    refused = files.where(~F.col("suffix").isin(*MIME) | ~small).withColumns({"extracted_text": F.lit(None).cast("string"), "reason": F.when(~small, "too large").otherwise("unsupported type")})
    cols = ["path", "name", "suffix", "size", "extracted_text", "reason"]
    return plain.select(*cols).unionAll(rich.select(*cols)).unionAll(refused.select(*cols)).unionAll(misnamed.select(*cols)).withColumn("safe_name", safe_filename(F.col("name")))


def accepted_mime(kind: Column, mime: Column) -> Column:
    expected = F.create_map(*[x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))])[kind]
    return (mime == expected) | (mime == "application/octet-stream")


def first_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in key]
    least = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("m")
    return rows.groupBy(*key).agg(least).select(*[c if c in key else F.col(f"m.{c}").alias(c) for c in rows.columns])


def replaced(table: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """table with all rows of fresh's keys taken out and fresh put in."""
    return table.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh.select(*table.columns))


def write_by_tenant(rows: DataFrame, path: str, tenant: str = "organization_id") -> None:
    """Replaces the tenants that rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tenant).parquet(path)


def check_request(query: str, top_k: int = 10, max_distance: int = 3) -> None:
    if not 2 <= len(query) <= 2000:
        raise ValueError("a query has 2 to 2000 characters")
    if not 1 <= top_k <= 50:
        raise ValueError("top_k is 1 to 50")
    if not 0 <= max_distance <= 10:
        raise ValueError("max_distance is 0 to 10")


def valid_slug(slug: str) -> bool:
    return re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", slug) is not None
