"""Sentence-packed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X


def pack(text: Column, most: int = 180, overlap: int = 30) -> Column:
    """Chunks of whole sentences as an array of (content, token_count).

    A chunk ends when the next sentence would take it over most tokens; the last whole sentences of at most overlap tokens
    are carried into the next chunk, which takes the new sentence whatever their sum. A longer sentence stays whole."""
    kind = "struct<done:array<struct<content:string,token_count:int>>,own:array<struct<s:string,n:int>>,total:int>"
    sents = F.transform(X.sentences(text), lambda s: F.struct(s.alias("s"), X.piece_count(s).alias("n")))
    start = F.struct(F.array().alias("done"), F.array().alias("own"), F.lit(0).alias("total")).cast(kind)
    joined = lambda own, n: F.struct(F.array_join(F.transform(own, lambda x: x["s"]), " ").alias("content"), n.alias("token_count"))

    def tail(own: Column) -> Column:
        """(kept, total, open): the last sentences that fit into the overlap, up to the first that doesn't."""
        begin = F.struct(F.array().cast("array<struct<s:string,n:int>>").alias("kept"), F.lit(0).alias("total"), F.lit(True).alias("open"))

        def step(a: Column, x: Column) -> Column:
            fits = a["open"] & (a["total"] + x["n"] <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(x), a["kept"])).otherwise(a["kept"]).alias("kept"), F.when(fits, a["total"] + x["n"]).otherwise(a["total"]).alias("total"), fits.alias("open"))

        return F.aggregate(F.reverse(own), begin, step)

    def add(a: Column, x: Column) -> Column:
        full = (a["total"] > 0) & (a["total"] + x["n"] > most)
        carried = tail(a["own"])
        return F.when(
            full,
            F.struct(F.array_append(a["done"], joined(a["own"], a["total"])).alias("done"), F.array_append(carried["kept"], x).alias("own"), (carried["total"] + x["n"]).alias("total")),
        ).otherwise(F.struct(a["done"].alias("done"), F.array_append(a["own"], x).alias("own"), (a["total"] + x["n"]).alias("total"))).cast(kind)

    end = lambda a: F.when(F.size(a["own"]) == 0, a["done"]).otherwise(F.array_append(a["done"], joined(a["own"], a["total"])))
    return F.aggregate(sents, start, add, end)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 180, overlap: int = 30) -> DataFrame:
    """(document_id, chunk_index, content, token_count); documents without text or sentences give none."""
    packed = docs.select(F.col(id_col).alias("document_id"), F.posexplode(pack(F.coalesce(F.col(text_col), F.lit("")), most, overlap)).alias("chunk_index", "c"))
    return packed.select("document_id", "chunk_index", "c.content", "c.token_count")


def rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(document_id, reason) of documents that give no chunks."""
    text = X.strip(F.coalesce(F.col(text_col), F.lit("")))
    reason = F.when(text == "", "no text").when(F.size(X.sentences(text)) == 0, "no chunks")
    return docs.select(F.col(id_col).alias("document_id"), reason.alias("reason")).where("reason is not null")
