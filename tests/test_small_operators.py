"""Checks, formats, orders and gates that no other test holds."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import entities, impact, relations, retrieval, views
from lodestone.sources import files

PAIR = "first_id int, second_id int, relation string, first_entity_type string, first_normalized_name string, second_normalized_name string, dense double, combined double"


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_uploads(spark, tmp_path):
    for name, raw in (("a.txt", b" hi "), ("b.txt", b"  "), ("c.pdf", b"x"), ("d.exe", b"x"), ("e.txt", b"big"), ("f.docx", b"x"), ("g", b"x")):
        (tmp_path / name).write_bytes(raw)
    said = {"a.txt": "text/plain", "b.txt": "application/octet-stream", "c.pdf": "text/plain", "d.exe": "text/plain", "e.txt": "text/plain", "f.docx": None, "g": "text/plain"}
    found = files.read_files(spark, str(tmp_path)).withColumn("size", F.when(F.col("name") == "e.txt", files.MOST_BYTES + 1).otherwise(F.col("size")))
    typed = found.join(spark.createDataFrame(list(said.items()), "name string, mime string"), "name")
    got = {r["name"]: (r["extracted_text"], r["reason"]) for r in files.with_text(typed).collect()}
    assert got == {"a.txt": ("hi", None), "b.txt": ("", "no text"), "c.pdf": (None, "wrong media type"), "d.exe": (None, "unsupported type"), "e.txt": (None, "too large"), "f.docx": (None, "wrong media type"), "g": (None, "unsupported type")}
    kinds = {k: value(spark, files.accepted_mime(F.lit(k), F.lit(m))) for k, m in (("pdf", "application/pdf"), ("txt", "application/octet-stream"), ("docx", "application/msword"))}
    assert kinds == {"pdf": True, "txt": True, "docx": False}


@pytest.mark.parametrize(("asked", "fine"), [(("ab", 1, 0), True), (("a" * 2000, 50, 10), True), (("a", 10, 3), False), (("a" * 2001, 10, 3), False), (("ab", 0, 3), False), (("ab", 51, 3), False), (("ab", 1, -1), False), (("ab", 1, 11), False)])
def test_requests(asked, fine):
    if fine:
        files.check_request(*asked)
    else:
        with pytest.raises(ValueError):
            files.check_request(*asked)
    assert files.valid_slug("a-b2") and not any(map(files.valid_slug, ("", "A", "a--b", "-a", "a_b", "a-")))


def test_searches_of_a_tenant(spark):
    docs = spark.createDataFrame([(1, "red stone", "p"), (2, "red river", "q"), (3, "blue sky", "p"), (4, "grey", "p")], "doc_id int, text string, organization_id string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0], "p"), (2, [1.0, 0.0], "q"), (3, [1.0, 0.1], "p")], "vec_id int, embedding array<double>, organization_id string")
    got = retrieval.hybrid_search(docs, vectors, "red", [1.0, 0.0], 3, tenant="p").collect()
    assert [r["id"] for r in got] == [1, 3] and got[0]["tfidf_rank"] == 1 and got[0]["dense_rank"] == 2 and got[1]["tfidf_rank"] is None
    assert retrieval.answer(retrieval.hybrid_search(docs, vectors, "red", [1.0, 0.0], 1, tenant="p")).columns == ["id", "score", "tfidf_rank", "dense_rank"]
    assert retrieval.hybrid_search(docs, vectors, "red", [1.0, 0.0], 3, tenant="nobody").count() == 0
    for k, rrf in ((0, 60), (5, 0), (-1, 60)):
        with pytest.raises(ValueError):
            retrieval.fuse(docs.limit(0), docs.limit(0), k, rrf)
    for search in (lambda: retrieval.tfidf_search(docs, "red", 0), lambda: retrieval.dense_search(vectors, [1.0], 0)):
        with pytest.raises(ValueError):
            search()
    assert [retrieval.over_fetch(k) for k in (1, 10, 11)] == [20, 20, 22]


def test_exact_matches_need_all_three(spark):
    canonical = spark.createDataFrame([(1, "o", "a b", "API"), (2, "o", "a b", "TEAM"), (3, "x", "a b", "API")], "id int, organization_id string, normalized_name string, entity_type string")
    rows = spark.createDataFrame([(10, "o", "a b", "API"), (11, "o", "a  b", "API"), (12, "x", "a b", "TEAM"), (13, None, "a b", "API")], canonical.schema)
    assert {r["id"]: r["canonical_id"] for r in entities.exact_matches(rows, canonical).collect()} == {10: 1, 11: None, 12: None, 13: None}


def test_reasons_and_order_of_pairs(spark):
    rows = [
        (1, 2, "EXACT_DUPLICATE", "B", "x", "y", 0.99, 0.95), (3, 4, "REPEATED_NAME_ARTIFACT", "A", "x", "z", 0.91, 0.86), (5, 6, "REPEATED_NAME_ARTIFACT", "A", "X", "y", 0.5, 0.86),
        (7, 8, "CONTEXT_EXTENSION", "A", "w", "y", 0.95, 0.86), (9, 10, "DESCRIPTIVE_EXTENSION", "A", "v", "y", 0.9, 0.83), (11, 12, "DESCRIPTIVE_EXTENSION", "A", "v", "y", 0.9, 0.81), (13, 14, "CONTEXT_EXTENSION", "A", "v", "y", 0.93, 0.99),
    ]
    got = entities.in_order(entities.judged(spark.createDataFrame(rows, PAIR))).collect()
    assert [(r["first_id"], r["confidence"]) for r in got] == [(1, "HIGH"), (7, "REVIEW"), (5, "MEDIUM"), (3, "HIGH"), (9, "REVIEW")]
    assert len({r["reason"] for r in got}) == 4 and got[2]["reason"] == got[3]["reason"]


def test_triggers_reach_so_far(spark):
    names = spark.createDataFrame([(i, k, n) for i in (0, 1, 2) for k, n in (("a", "Alpha"), ("b", "Beta"))], "chunk_id int, id string, name string")
    gap = lambda n: "x" * (n - 2)
    chunks = spark.createDataFrame([(0, f"Alpha {gap(240)} calls Beta"), (1, f"Alpha {gap(241)} calls Beta"), (2, "Alpha calls Alpha, not Beta")], "chunk_id int, content string")
    got = {(r["chunk_id"], r["source"], r["target"]) for r in relations.extract(chunks, names).collect()}
    assert got == {(0, "a", "b")}  # the nearest mention on each side: an entity that calls itself gives no edge


def test_looks(spark):
    marks = {n: (value(spark, X.looks_technical(F.lit(n))), value(spark, X.inner_capitals(F.lit(n)))) for n in ("Kafka", "v2", "My SDK", "iPhone", "api", "ÜberÄ", "")}
    assert marks == {"Kafka": (False, False), "v2": (True, False), "My SDK": (True, True), "iPhone": (False, True), "api": (False, False), "ÜberÄ": (False, True), "": (False, False)}


def test_formats(spark):
    day = F.lit(datetime.datetime(2024, 3, 5, 12))
    assert value(spark, views.date_text(day)) == "Mar 05, 2024" and value(spark, views.date_text(F.lit(None).cast("timestamp"))) == "—"
    assert [value(spark, views.percent(F.lit(x))) for x in (0.0, 0.126, 1.0)] == ["0%", "13%", "100%"]


def test_explanations(spark):
    rows = spark.createDataFrame([("a", 0.987, 0, "DIRECT"), ("b", 0.5, 1, "CALLS"), ("c", 0.251, 3, "CALLS → USES")], "id string, score double, distance int, label string")
    nodes = spark.createDataFrame([("a", "Alpha"), ("b", "Beta"), ("c", "Gamma")], "id string, name string")
    got = {r["id"]: r["explanation"] for r in impact.explained(rows, nodes).collect()}
    assert got == {"a": "Alpha is directly affected (score 0.99).", "b": "Beta is one step away by CALLS (score 0.50).", "c": "Gamma is 3 steps away by CALLS → USES (score 0.25)."}


def test_sorted_results(spark):
    rows = spark.createDataFrame([("a", 0.9, "HIGH", 2, 0.1, "API"), ("b", 0.9, "HIGH", 1, 0.9, "API"), ("c", 0.6, "MEDIUM", 1, 0.5, "API"), ("d", 0.8, "HIGH", 1, 0.7, "TEAM")], "id string, score double, level string, distance int, semantic double, entity_type string")
    order = lambda *a: [r["id"] for r in views.sorted_results(rows, *a).collect()]
    assert order("risk") == ["a", "b", "d", "c"] and order("relevance") == ["b", "d", "c", "a"] and order("proximity") == ["b", "d", "c", "a"] and order("risk", "critical", "API") == ["a", "b"]
