"""What a saved index writes, shuffles and reads."""

import random

import pytest

from lodestone.operators import retrieval, stored_index
from lodestone.sources import snapshots


@pytest.fixture
def shuffled(spark):
    """Bytes shuffled so far."""
    sc = spark.sparkContext
    of = lambda s: (s.stageId(), s.attemptId())

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {of(s): s.shuffleWriteBytes() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)}

    before = total()
    return lambda: sum(b for s, b in total().items() if s not in before)


def test_changes_shuffle_no_terms(spark, tmp_path, shuffled):
    r, root = random.Random(8), str(tmp_path / "index")
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=30)) for _ in range(3000)]
    held = {i: " ".join(r.choices(words, k=300)) for i in range(200)}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    stored_index.create(frame(list(held.items())), root, buckets=4)
    new = {i: " ".join(r.choices(words, k=300)) for i in (3, 5, 500)}
    stored_index.replace(spark, root, frame(list(new.items())))
    stored_index.delete(spark, root, frame([(7, ""), (8, "")]))
    index = stored_index.open_index(spark, root)
    assert shuffled() < 6e6
    held = {k: v for k, v in (held | new).items() if k not in (7, 8)}
    anew = retrieval.build_index(frame(list(held.items())))
    asked = f"{words[0]} {' '.join(new[500].split()[:3])} {held[9][:300]}"
    got, want = ([(x["id"], round(x["score"], 9)) for x in retrieval.search(i, asked, 20).collect()] for i in (index, anew))
    assert got == want and len(got) == 20


def test_lengths_are_saved_by_who_opens_first(spark, tmp_path):
    root = str(tmp_path / "index")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, text string")
    stored_index.create(frame([(1, "red stone"), (2, "red river")]), root, buckets=2)
    number = snapshots.latest(spark, root).number
    for _ in range(2):
        stored_index.open_index(spark, root)
        assert snapshots.latest(spark, root).number == number + 1
    stored_index.replace(spark, root, frame([(2, "blue river")]))
    assert "lengths" not in snapshots.latest(spark, root).tables
    index = stored_index.open_index(spark, root)
    assert [x["id"] for x in retrieval.search(index, "blue", 3).collect()] == [2] and retrieval.search(index, "nothing", 3).count() == 0
    assert sorted(x["df"] for x in index.idf.collect()) == [1] * 6
