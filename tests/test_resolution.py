"""Resolution in blocks against one after another, and places of rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import entities, ordering

SCHEMA = "organization_id string, entity_type string, id int, normalized_name string, vector array<double>, position int"


def unit(v):
    v = np.array([0.0 if x is None or not np.isfinite(x) else x for x in v or [0.0]])
    return v / (np.linalg.norm(v) or 1.0)


def one_by_one(rows, limit=0.82):
    """{id: canonical id}: names in the order of their first rows; the earlier founder with the highest cosine decides."""
    first, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[2])):
        first.setdefault(r[:2] + (r[3],), r)
    founders = {}
    for (org, kind, name), r in sorted(first.items(), key=lambda x: (x[1][5], x[1][2])):
        pool = founders.setdefault((org, kind), [])
        best = None
        for f in pool:
            a, b = unit(r[4]), unit(f[4])
            cos = round(float(a @ b), 12) if len(a) == len(b) else 0.0
            if best is None or cos > best[0]:
                best = (cos, f)
        if best:
            a, b = set(name.split()), set(best[1][3].split())
            if 0.75 * min(1, max(0, best[0])) + 0.25 * len(a & b) / len(a | b) < limit:
                best = None
        if best is None:
            pool.append(r)
        out[org, kind, name] = best[1][2] if best else r[2]
    return {r[2]: out[r[:2] + (r[3],)] for r in rows}


@pytest.mark.parametrize(("block", "founders"), [(7, 3), (1, 2), (500, 8192)])
def test_blocks_equal_one_by_one(spark, monkeypatch, block, founders):
    monkeypatch.setattr(entities, "FOUNDERS", founders)
    r, g = random.Random(5), np.random.default_rng(5)
    centres = g.normal(size=(6, 8))
    rows = []
    for i in range(160):
        c = r.randrange(6)
        v = [float(x) for x in centres[c] + g.normal(size=8) * 0.45]
        rows.append((r.choice("pq"), "API" if i % 5 else "TEAM", i, f"name {c} {r.randrange(12)}", v, r.randrange(100)))
    rows += [("p", "API", 900, "no vector", None, 3), ("p", "API", 901, "zero vector", [0.0] * 8, 4), ("p", "API", 902, "no vector", [1.0] * 8, 50), ("p", "API", 903, "odd", [None, float("nan"), 1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 5)]
    got = {x["id"]: x["canonical_id"] for x in entities.resolve_in_order(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    assert got == one_by_one(rows) and 10 < len(set(got.values())) < 120


def test_no_names(spark):
    rows = spark.createDataFrame([("p", None, 1, "a", [1.0], 0), ("p", "API", 2, None, [1.0], 0)], SCHEMA)
    assert entities.resolve_in_order(rows).count() == 0


def test_places_of_rows(spark):
    rows = [(None if i % 7 == 0 else "ab"[i % 2], (i * 37) % 101, i) for i in range(400)]
    got = ordering.numbered(spark.createDataFrame(rows, "k string, o int, i int").repartition(6), ["k"], ["o", "i"]).collect()
    for k in (None, "a", "b"):
        own = sorted((r["o"], r["i"]) for r in got if r["k"] == k)
        assert [(r["o"], r["i"]) for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["place"])] == own
        assert sorted(r["place"] for r in got if r["k"] == k) == list(range(len(own)))
    assert ordering.numbered(spark.createDataFrame([], "k string, o int"), ["k"], ["o"]).count() == 0


def test_batch_order(spark):
    mentions = spark.createDataFrame([("o", "API", 1, "b a", [0.0, 1.0], "c2", 0), ("o", "API", 2, "a b", [0.0, 1.0], "c1", 1)], "organization_id string, entity_type string, id int, normalized_name string, vector array<double>, chunk_id string, place int")
    chunks = spark.createDataFrame([("c1", "d1", 0), ("c2", "d1", 1)], "id string, document_id string, chunk_index int")
    got = entities.resolve_batch(mentions, chunks).collect()
    assert {r["id"]: r["canonical_id"] for r in got} == {1: 2, 2: 2} and F is not None
