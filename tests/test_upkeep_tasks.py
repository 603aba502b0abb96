"""How the work of a knowledge base is parted."""

from pyspark.sql import functions as F

from lodestone.operators import relations
from lodestone.plans import knowledge_base as kb


def test_short_documents_are_derived_from_in_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kb, "DOCUMENTS_A_FILE", 50, raising=False)
    tasks = []
    derived = kb.derived
    monkeypatch.setattr(kb, "derived", lambda documents: (tasks.append(documents.rdd.getNumPartitions()), derived(documents))[1])
    docs = spark.range(0, 200, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("all").alias("organization_id"), F.lit("f").alias("filename"), F.concat(F.lit("The Order Service calls the Payment Database. Item "), "id", F.lit(".")).alias("text"))
    base = kb.tables(spark, str(tmp_path / "k"), buckets=2)
    kb.update(base, docs)
    assert tasks == [4]
    assert base.read("documents").count() == 200 and base.read("chunks").count() == 200
    assert {r["relationship_type"] for r in base.read("edges").collect()} == {"CALLS"}


def test_every_place_of_a_trigger_counts(spark):
    rows = spark.createDataFrame([(1, 0, "Order Service calls and calls Payment Service, which depends on Cart."), (1, 1, "No Order Service and Cart.")], "chunk_id int, piece int, text string")
    names = spark.createDataFrame([(1, "o", "Order Service"), (1, "p", "Payment Service"), (1, "c", "Cart")], "chunk_id int, id string, name string")
    found = relations.triggered(relations.placed_mentions(rows, names))
    got = sorted((r["source"], r["target"], r["relationship_type"]) for r in found.collect())
    assert got == [("o", "p", "CALLS"), ("o", "p", "CALLS"), ("p", "c", "DEPENDS_ON")]
