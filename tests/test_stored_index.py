"""A saved index against one built anew, and versions of tables."""

import random

import pytest

from lodestone.operators import retrieval, stored_index
from lodestone.sources import snapshots

WORDS = "red green blue stone river cloud wind sand iron gold".split()


def texts(r, ids):
    # "all" is in most documents, so that the limit of max_df is passed to and fro
    return [(i, " ".join(r.choices(WORDS, k=r.randrange(0, 12)) + ["all"] * (r.random() < 0.93))) for i in ids]


def look(index):
    norms = {x["id"]: round(x["norm"], 9) for x in index.norms.collect()}
    idf = {x["term"]: (x["df"], round(x["idf"], 9)) for x in index.idf.collect()}
    return norms, idf, index.n_docs


def hits(index, query):
    return [(x["id"], round(x["score"], 9)) for x in retrieval.search(index, query, 7).collect()]


def test_upkeep_equals_a_rebuild(spark, tmp_path):
    r, root = random.Random(3), str(tmp_path / "index")
    held = dict(texts(r, range(30)))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, text string")
    stored_index.create(frame(list(held.items())), root, buckets=4)
    for step in range(4):
        if step == 2:
            gone = r.sample(sorted(held), 5)
            stored_index.delete(spark, root, frame([(i, "") for i in [*gone, *gone, 999]]))
            for i in gone:
                del held[i]
        else:
            new = texts(r, [*r.sample(sorted(held), 4), 100 + step, 200 + step]) + [(300 + step, None)]
            stored_index.replace(spark, root, frame(new))
            held |= dict(new)
        if step == 3:
            stored_index.compact(spark, root)
            assert snapshots.vacuum(spark, root) > 0
        now, anew = stored_index.open_index(spark, root), retrieval.build_index(frame(list(held.items())))
        assert look(now) == look(anew)
        for q in ("red stone", "all gold all", "nothing known", "river river cloud"):
            assert hits(now, q) == hits(anew, q)


def test_hybrid_search_takes_an_open_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{w} stone") for i, w in enumerate(WORDS)], "doc_id int, text string")
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(10)], "vec_id int, embedding array<double>")
    stored_index.create(docs, str(tmp_path / "i"), buckets=2)
    index = stored_index.open_index(spark, str(tmp_path / "i"))
    got, want = (retrieval.hybrid_search(x, vectors, "gold stone", [1.0, 0.2], 5).collect() for x in (index, docs))
    assert got == want and got[0]["tfidf_rank"] is not None


def test_what_an_index_refuses(spark, tmp_path):
    with pytest.raises(ValueError):
        stored_index.open_index(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        stored_index.create(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id int, text string"), str(tmp_path / "twice"))
    empty = str(tmp_path / "empty")
    stored_index.create(spark.createDataFrame([], "doc_id int, text string"), empty)
    assert hits(stored_index.open_index(spark, empty), "red") == []
    stored_index.replace(spark, empty, spark.createDataFrame([(1, "red stone"), (2, "blue")], "doc_id int, text string"))
    assert [i for i, _ in hits(stored_index.open_index(spark, empty), "red")] == [1]


def test_a_crash_before_the_switch_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = lambda n: spark.range(n).selectExpr("cast(id as int) id")
    first = snapshots.commit(spark, snapshots.latest(spark, root), {"t": [snapshots.stage(rows(3), root, "t")]}, {"n": 3})
    snapshots.stage(rows(9), root, "t")  # written, then nothing more
    assert snapshots.latest(spark, root) == first and first.table(spark, "t", "id int").count() == 3
    second = snapshots.commit(spark, first, {"t": [snapshots.stage(rows(5), root, "t")]}, {"n": 5})
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, first, {"t": []}, {"n": 0})
    assert snapshots.latest(spark, root) == second and first.table(spark, "t", "id int").count() == 3
    assert snapshots.vacuum(spark, root) == 2 and snapshots.latest(spark, root).table(spark, "t", "id int").count() == 5
