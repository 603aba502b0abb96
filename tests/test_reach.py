"""Reaching through the neighbours of seeds that have one only, against a walk from each seed."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, impact, views

EDGES = "source string, target string, relationship_type string, confidence double"
KINDS = ("USES", "SUPPORTS", "OWNED_BY", "NO_SUCH", "DEPENDS_ON")


def plain_reach(edges, seeds, hops):
    """{(seed, node): (distance, path, strength, labels)} by walking from every seed."""
    best = {}
    for a, b, kind, c in edges:
        base = graph.STRENGTH.get(kind, 0.0)
        for u, v in ((a, b), (b, a)):
            s, t = best.get((u, v), (0.0, (0.0, "")))
            best[u, v] = max(s, base * c), max(t, (base, kind))
    out = {}
    for seed, most in seeds:
        front, done = {seed: ([seed], None, [])}, {seed}
        for hop in range(1, min(hops, most) + 1):
            step = {}
            for node, (path, low, labels) in front.items():
                for (u, v), (s, (base, kind)) in best.items():
                    if u == node and v not in done:
                        way = [*path, v], min([x for x in (low, s if s > 0 else None) if x is not None], default=None), labels + ([kind] if base > 0 else [])
                        step[v] = min(step.get(v, way), way, key=lambda w: w[0])
            for v, (path, low, labels) in step.items():
                out[seed, v] = (hop, path, round(low or 0.0, 9), labels)
            done |= set(step)
            front = step
    return out


def some_graph(seed):
    rng = random.Random(seed)
    core = [f"n{i}" for i in range(6)]
    edges = [(a, b, rng.choice(KINDS), rng.choice((0.0, 0.9, 0.95, 1.0))) for a in core for b in core if rng.random() < 0.25]
    edges += [(f"s{i}", rng.choice(core), rng.choice(KINDS), rng.choice((0.0, 0.8, 0.9, 1.0))) for i in range(40)]
    return edges + [("p", "q", "USES", 1.0), ("s1", "s1", "USES", 1.0)]


@pytest.mark.parametrize("seed", range(3))
def test_leaves_reach_what_walks_reach(spark, seed):
    edges = some_graph(seed)
    asked = [(f"s{i}", 3 - i % 4) for i in range(0, 40, 2)] + [("n0", 3), ("n1", 2), ("p", 3), ("q", 1), ("none", 3)]
    rows = graph.reach(spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, "id string, most int"), 3).collect()
    got = {(r["seed"], r["node"]): (r["distance"], r["path"], round(r["strength"], 9), r["labels"]) for r in rows}
    assert len(got) == len(rows) and got == plain_reach(edges, asked, 3)


@pytest.mark.parametrize("seed", range(3))
def test_seeds_that_give_way_change_no_impact(spark, seed, monkeypatch):
    edges = spark.createDataFrame(some_graph(seed), EDGES)
    nodes = spark.createDataFrame([(f"n{i}", "", "API", i / 6) for i in range(6)] + [(f"s{i}", "", "TEAM", i / 40) for i in range(40)], "id string, name string, entity_type string, importance double")
    seeds = spark.createDataFrame([(f"s{i}", (0.95, 0.95, 0.6)[i % 3]) for i in range(40)] + [("n2", 0.9)], "id string, semantic double")
    got = sorted(impact.propagate(nodes, edges, seeds).collect())
    reach = graph.reach
    monkeypatch.setattr(graph, "reach", lambda edges, seeds, hops, worth=None: reach(edges, seeds, hops))
    assert got == sorted(impact.propagate(nodes, edges, seeds).collect())


def test_impact_rows_grow_with_nodes_not_with_seeds_times_nodes(spark, monkeypatch):
    n = 300
    edges = spark.range(n).select(F.concat(F.lit("s"), "id").alias("source"), F.lit("hub").alias("target"), F.lit("USES").alias("relationship_type"), ((900 + F.col("id") % 10) / 1000).alias("confidence"))
    nodes = edges.select(F.col("source").alias("id"), F.lit("").alias("name"), F.lit("API").alias("entity_type"), F.lit(0.5).alias("importance"))
    sizes, reach = [], graph.reach

    def counted(*args):
        found = reach(*args)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(graph, "reach", counted)
    assert impact.propagate(nodes, edges, nodes.select("id", F.lit(0.95).alias("semantic"))).count() == n
    assert sizes[0] < 25 * n


def test_cascade_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(node):
        seen.add(1)
        return node

    rows = spark.createDataFrame([("a", "A", 0, ["a"], 0.9), ("b", "B", 1, ["a", "b"], 0.8), ("c", "C", 1, ["a", "c"], 0.7)], "id string, name string, distance int, path array<string>, score double")
    got = views.cascade(rows.withColumn("id", F.udf(noted)("id"))).collect()
    assert {(r["id"], r["parent"], r["y"]) for r in got} == {("a", None, 70), ("b", "a", 70), ("c", "a", 275)} and seen.value == 3
