"""Tables with keys and cascades, and a knowledge base kept up against one built anew."""

import random

import pytest

from lodestone.operators import graph
from lodestone.plans import knowledge_base as kb
from lodestone.sources import keyed, snapshots

TABLES = {
    "orgs": keyed.Table("id string, name string", ("id",), "id"),
    "docs": keyed.Table("id string, org string, n int", ("id",), "org", {"org": "orgs"}),
    "notes": keyed.Table("doc string, no int, text string, reply string", ("doc", "no"), "doc", {"doc": "docs"}),
}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keys_references_and_cascades(spark, tmp_path):
    base = keyed.Tables(spark, str(tmp_path / "k"), TABLES, buckets=3)
    frame = spark.createDataFrame
    c = base.change()
    c.put("orgs", frame([("a", "A"), ("b", "B")], "id string, name string"))
    c.put("docs", frame([(f"d{i}", "ab"[i % 2], i) for i in range(6)], "id string, org string, n int"))
    c.put("notes", frame([(f"d{i % 6}", i, "t", None) for i in range(12)], "doc string, no int, text string, reply string"))
    first = c.commit()
    assert base.read("notes").count() == 12
    # the same again: nothing twice
    c = base.change()
    c.put("docs", frame([("d1", "b", 1)], "id string, org string, n int"))
    c.commit()
    assert base.read("docs").count() == 6 and base.read("notes").count() == 12
    # a row that moves to another bucket; what refers to it stays
    c = base.change()
    c.put("docs", frame([("d1", "a", 7)], "id string, org string, n int"))
    c.commit()
    assert ("d1", "a", 7) in rows(base.read("docs")) and base.read("docs").count() == 6
    # an organization goes with its documents and their notes
    c = base.change()
    c.delete("orgs", frame([("b",), ("zz",)], "id string"))
    c.commit()
    assert rows(base.read("docs")) == [("d0", "a", 0), ("d1", "a", 7), ("d2", "a", 2), ("d4", "a", 4)]
    assert {r[0] for r in rows(base.read("notes"))} == {"d0", "d1", "d2", "d4"}
    # by part of a key; and what isn't committed isn't seen
    c = base.change()
    c.delete("notes", frame([("d0",)], "doc string"))
    assert "d0" in {r[0] for r in rows(base.read("notes"))}
    c.commit()
    assert "d0" not in {r[0] for r in rows(base.read("notes"))}
    assert snapshots.latest(spark, base.root).number == first.number + 4
    assert snapshots.vacuum(spark, base.root) > 0 and base.read("docs").count() == 4


def test_what_is_refused(spark, tmp_path):
    base = keyed.Tables(spark, str(tmp_path / "k"), TABLES, buckets=2)
    frame = spark.createDataFrame
    c = base.change()
    with pytest.raises(keyed.Broken):
        c.put("orgs", frame([("a", "A"), ("a", "B")], "id string, name string"))
    with pytest.raises(keyed.Broken):
        c.put("orgs", frame([(None, "A")], "id string, name string"))
    with pytest.raises(keyed.Broken):
        c.put("docs", frame([("d", "nobody", 1)], "id string, org string, n int"))
    c.put("docs", frame([("d", None, 1)], "id string, org string, n int"))  # a null reference is none
    late = base.change()
    late.put("orgs", frame([("x", "X")], "id string, name string"))
    c.commit()
    with pytest.raises(snapshots.Conflict):
        late.commit()
    assert rows(base.read("orgs")) == [] and rows(base.read("docs")) == [("d", None, 1)]
    number = snapshots.latest(spark, base.root).number
    empty = base.change()
    empty.delete("orgs", frame([("nobody",)], "id string"))
    assert empty.commit().number == number
    with pytest.raises(ValueError):
        keyed.Tables(spark, str(tmp_path / "o"), {"notes": TABLES["notes"], "docs": TABLES["docs"]})


NAMES = ["Cart Service", "Stock API", "Parcel Engine", "Route Database", "Depot Team", "Late Policy"]
VERBS = ["calls", "depends on", "is owned by", "routes to", "and"]


def write_up(r):
    return " ".join(f"The {r.choice(NAMES)} {r.choice(VERBS)} the {r.choice(NAMES)}." for _ in range(r.randrange(0, 5))) or None


def test_upkeep_equals_a_rebuild(spark, tmp_path):
    r = random.Random(6)
    frame = lambda held: spark.createDataFrame([(i, o, f"{i}.txt", t) for i, (o, t) in held.items()], "id string, organization_id string, filename string, text string")
    held = {f"d{i}": (r.choice("pq"), write_up(r)) for i in range(9)}
    base = kb.tables(spark, str(tmp_path / "base"), buckets=3)
    kb.update(base, frame(held))
    for step in range(2):
        gone = r.sample(sorted(held), 2)
        new = {f"d{i}": (held.get(f"d{i}", ("p",))[0], write_up(r)) for i in r.sample(range(12), 3) if f"d{i}" not in gone}
        kb.update(base, frame(new), spark.createDataFrame([(g,) for g in gone], "id string"))
        held = {k: v for k, v in held.items() if k not in gone} | new
    anew = kb.tables(spark, str(tmp_path / "anew"), buckets=2)
    kb.update(anew, frame(held))
    for name in kb.SCHEMA:
        assert rows(base.read(name).fillna("-")) == rows(anew.read(name).fillna("-")), name
    whole = graph.resolve(anew.read("relations"), anew.read("mentions"))
    assert rows(whole.select(*kb.EDGE, "confidence")) == rows(anew.read("edges").select(*kb.EDGE, "confidence")) and base.read("edges").count() > 3
    kb.update(base, None, spark.createDataFrame([(k,) for k in held], "id string"))
    assert all(base.read(name).count() == 0 for name in kb.SCHEMA)
