"""Pairs over a limit against all products."""

import numpy as np
import pytest

from lodestone.operators import similar

SCHEMA = "id long, label string, v array<double>"


@pytest.mark.parametrize(("block", "limit"), [(16, 0.9), (1024, 0.9), (7, 0.55)])
def test_pairs_equal_all_products(spark, block, limit):
    g = np.random.default_rng(2)
    centres = g.normal(size=(5, 12))
    rows = [(i, "ab"[i % 3 == 0], [float(x) for x in centres[i % 5] * (1 + i % 4) + g.normal(size=12) * 0.5]) for i in range(180)]
    rows += [(500 + i, "a", rows[1][2]) for i in range(4)] + [(600, "a", [2 * x for x in rows[2][2]])]
    bad = [(700, "a", None), (701, "a", [0.0] * 12), (702, "a", [None] + [1.0] * 11), (703, "a", [float("nan")] * 12), (704, None, [1.0] * 12), (None, "a", [1.0] * 12), (705, "a", [1.0, 2.0]), (706, "a", [1.0, 2.1])]
    found = similar.directions(spark.createDataFrame(rows + bad, SCHEMA), "id", "v", "label")
    assert {r["rep"]: r["n"] for r in found.collect()}[1] == 5
    got = {(r["group"], r["first"], r["second"]): r["cosine"] for r in similar.similar_pairs(found, limit, block).collect()}
    each = [(i, k, np.array(v)) for i, k, v in rows if not 500 <= i < 600] + [(705, "a", np.array([1.0, 2.0])), (706, "a", np.array([1.0, 2.1]))]
    want = {}
    for i, k, v in each:
        for j, m, w in each:
            if i < j and k == m and len(v) == len(w) and (c := v @ w / np.linalg.norm(v) / np.linalg.norm(w)) >= limit:
                want[k, i, j] = c
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_far_apart_do_not_meet(spark):
    rows = [(i, "a", [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(np.linspace(0, 1.5, 400))]
    g = similar.directions(spark.createDataFrame(rows, SCHEMA), "id", "v", "label")
    met = []
    plain = similar.numbered
    try:
        similar.numbered = lambda *a: met.append(plain(*a)) or met[-1]
        pairs = similar.similar_pairs(g, 0.9999, 20)
    finally:
        similar.numbered = plain
    assert pairs.count() == sum(1 for i in range(400) for j in range(i + 1, 400) if np.cos((j - i) * 1.5 / 399) >= 0.9999)


def test_no_vectors_and_bad_limits(spark):
    none = similar.directions(spark.createDataFrame([], SCHEMA), "id", "v", "label")
    assert similar.similar_pairs(none, 0.9).count() == 0
    with pytest.raises(ValueError):
        similar.similar_pairs(none, 0.0)
