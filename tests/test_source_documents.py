"""Documents of entities that are mentioned again and again."""

import re

from lodestone.operators import impact


def test_documents_are_listed_once_without_a_shuffle_of_pairs(spark):
    entities = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "id string")
    mentions = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 3), ("b", 3), ("b", 9), ("d", 1), (None, 1), ("a", None)], "canonical_id string, chunk_id int")
    chunks = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (9, None)], "id int, document_id int")
    documents = spark.createDataFrame([(10, "z"), (20, "y"), (30, "x")], "id int, filename string")
    out = impact.source_documents(entities, mentions, chunks, documents)
    assert {r["id"]: [tuple(d) for d in r["documents"]] for r in out.collect()} == {"a": [("y", 20), ("z", 10)], "b": [("y", 20)], "c": []}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\d+L?, (document|chunk)_id", plan)
