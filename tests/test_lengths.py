"""Lengths of documents in one shuffle, and searches by fewer counts."""

import random
import re

from lodestone.operators import retrieval

WORDS = "red green blue stone river cloud wind sand iron gold".split()


def texts(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randrange(0, 12)) + ["all"] * (i % 40 > 0) + [f"own{i}"] * (i % 3))) for i in range(60)]
    return spark.createDataFrame([*rows, (60, None), (61, "all"), (62, "a - b")], "doc_id int, text string")


def test_lengths_equal_those_of_an_index(spark):
    docs = texts(spark)
    for sizes, max_df, sublinear in (((1, 2), 0.95, True), ((1, 2, 3), 1.0, True), ((1,), 0.95, False), ((1, 2), 0.001, True)):
        index = retrieval.build_index(docs, sizes=sizes, max_df=max_df, sublinear=sublinear)
        got = retrieval.lengths(docs, "doc_id", "text", docs.count(), (), sizes, max_df, sublinear)
        assert {x["id"]: round(x["norm"], 9) for x in got.collect()} == {x["id"]: round(x["norm"], 9) for x in index.norms.collect()}


def test_lengths_shuffle_terms_once(spark):
    plan = retrieval.lengths(texts(spark), "doc_id", "text", 63)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(term", plan)) == 1 and "Join" not in plan


def test_search_without_an_index_equals_one_with_it(spark):
    docs = texts(spark)
    index = retrieval.build_index(docs)
    for q in ("red stone", "all gold all", "nothing known", "own7 own7 river", ""):
        assert [(x["id"], round(x["score"], 9)) for x in retrieval.tfidf_search(docs, q, 9).collect()] == [(x["id"], round(x["score"], 9)) for x in retrieval.search(index, q, 9).collect()]


def test_terms_come_in_parts_and_stay_with_their_document(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TERMS_AT_ONCE", 7)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [3, 1, 2, 5], "tokens": ["b a b c d e f g", "", "the x the", ""]})
    parts = list(retrieval._tallies(iter([batch]), frozenset(["the"]), (1, 2)))
    assert [p[0].to_pylist() for p in parts] == [[3], [1, 2, 5]] and [p[1] for p in parts] == [[14], [0, 1, 0]] and parts[1][2:] == (["x"], [1])
    assert dict(zip(parts[0][2], parts[0][3], strict=True))["b"] == 2 and parts[0][2] == sorted(parts[0][2])
