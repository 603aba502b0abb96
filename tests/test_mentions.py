"""Names found in the pieces of a text, against a scan for each name."""

import random
import re

from lodestone.operators import relations


def plain_spans(text, names):
    """(start, end, entity) between word boundaries, from the left the longest first, without overlaps."""
    found = []
    for entity, name in names:
        at = text.find(name) if name else -1
        while at >= 0:
            end = at + len(name)
            if not (at and re.match(r"\w", text[at - 1])) and not re.match(r"\w", text[end : end + 1]):
                found.append((at, -len(name), end, entity))
            at = text.find(name, at + 1)
    out = []
    for start, _, end, entity in sorted(set(found)):
        if not out or start >= out[-1][1]:
            out.append((start, end, entity))
    return out


def test_spans_equal_a_scan(spark):
    r = random.Random(9)
    words = ["Cart", "cart", "API", "v2", "Stück", "x", "GET", "a"]
    joints = [" ", "-", "/", "  ", ", ", ".", "", " (", "++"]
    make = lambda n: "".join(r.choice(words) + r.choice(joints) for _ in range(n))
    pieces, mentions = [], []
    for chunk in range(40):
        own = [make(r.randrange(0, 14)) for _ in range(3)]
        pieces += [(chunk, i, t) for i, t in enumerate(own)]
        names = {make(r.randrange(1, 4)).strip() for _ in range(12)} | {"++", "/a", "a", "x x", own[0], own[1][:9], " a", r.choice(words) * 2}
        mentions += [(chunk, f"e{i}", n) for i, n in enumerate(sorted(names))]
    mentions += mentions[:20] + [(0, "none", None), (1, "empty", ""), (99, "far", "a")]
    pieces += [(0, 7, None), (98, 0, "a a")]
    got = relations.placed_mentions(spark.createDataFrame(pieces, "chunk_id int, piece int, text string"), spark.createDataFrame(mentions, "chunk_id int, id string, name string"))
    found = {(x["chunk_id"], x["piece"]): [(s["start"], s["end"], s["entity"]) for s in x["spans"]] for x in got.collect()}
    want = {(c, p): spans for c, p, t in pieces if t and (spans := plain_spans(t, [(e, n) for k, e, n in mentions if k == c and n]))}
    assert found == want and len(want) > 60


def test_long_names_are_verified_whole(spark):
    name = "one two three four five six seven eight nine"
    pieces = spark.createDataFrame([(1, 0, f"see {name}."), (1, 1, "one two three four five six seven eight"), (1, 2, f"{name}s")], "chunk_id int, piece int, text string")
    got = relations.placed_mentions(pieces, spark.createDataFrame([(1, "n", name)], "chunk_id int, id string, name string")).collect()
    assert [(r["piece"], r["spans"][0]["start"]) for r in got] == [(0, 4)]
    none = spark.createDataFrame([], "chunk_id int, piece int, text string")
    assert relations.placed_mentions(none, spark.createDataFrame([(1, "n", name)], "chunk_id int, id string, name string")).count() == 0


def test_many_names_of_a_chunk_do_not_multiply_its_pieces(spark):
    text = " ".join(f"w{i % 50}" for i in range(400))
    names = [(1, f"e{i}", f"w{i} w{i + 1}") for i in range(2000)]
    plan = relations.found_names(spark.createDataFrame([(1, 0, text)], "chunk_id int, piece int, text string"), spark.createDataFrame(names, "chunk_id int, id string, name string"))
    assert plan.count() == 49 * 8 - 0  # each of 49 pairs of neighbours, eight times over
