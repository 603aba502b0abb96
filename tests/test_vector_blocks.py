"""Vectors in blocks of bounded memory."""

import tracemalloc

import numpy as np
import pandas as pd

from lodestone.operators import retrieval, similar


def test_dense_blocks_of_similar_vectors_stay_small():
    r = np.random.default_rng(1)
    v = r.normal(size=(1024, 64)) * 0.1 + 1
    v /= np.linalg.norm(v, axis=1)[:, None]
    block = lambda k: pd.DataFrame({"lo": 0, "hi": 1, "block": k, "rep": np.arange(512) + 512 * k, "size": 64, "unit": list(v[512 * k : 512 * k + 512])})
    tracemalloc.start()
    out = similar.compare(pd.concat([block(0), block(1)]), np.arange(64), 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 512 * 512 and peak < 80e6
    assert np.allclose(out["cosine"], (v[:512] @ v[512:].T).ravel())


def test_best_match_equals_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 7)
    r = np.random.default_rng(2)
    some = [[float(x) for x in r.normal(size=4)] for _ in range(20)]
    rows = [(i, i % 3, some[int(r.integers(20))]) for i in range(80)] + [(100, 0, None), (105, 1, [1.0, 2.0]), (110, None, some[0]), (115, 9, some[1])]
    docs = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {x["id"]: (x["best"], round(x["score"], 9)) for x in retrieval.best_match(docs.where("vec_id % 5 = 0"), docs, "vec_id", "embedding", "label").collect()}
    want = {}
    for i, g, v in rows:
        others = [(round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), -j) for j, h, w in rows if v and w and len(v) == len(w) and g is not None and h == g and i != j and i % 5 == 0]
        if others:
            want[i] = (-max(others)[1], max(others)[0])
    assert got == want


def test_best_match_multiplies_blocks(spark):
    docs = spark.createDataFrame([(i, 0, [1.0, float(i)]) for i in range(6)], "vec_id long, label int, embedding array<double>")
    plan = retrieval.best_match(docs, docs, "vec_id", "embedding", "label")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan
