"""Candidates found in one pass over the chunks, against a pass for each pattern."""

import random

from pyspark.sql import functions as F

from lodestone.operators import chunking, entities
from lodestone.operators.relations import places


def test_chunks_are_made_once_for_all_patterns(spark):
    docs = spark.createDataFrame([(1, "The Order API calls the Payment Service.")], "doc_id long, text string")
    chunks = chunking.chunks(docs).select(F.col("document_id").alias("chunk_id"), "content")
    plan = entities.candidates(chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def test_every_place_of_every_pattern_is_found(spark):
    r = random.Random(4)
    words = "Order order API sdk api_v2 rapid SDKs GET post /a/{b} Payment Service service systems Data Policy Team x Ünder Straße 7 \n . , -".split(" ")
    texts = [(i, "".join(r.choice(words) + r.choice([" ", " ", "-", "  ", ""]) for _ in range(r.randrange(0, 30)))) for i in range(400)]
    chunks = spark.createDataFrame([*texts, (400, ""), (401, None)], "chunk_id long, content string")
    markers = "|".join(w for ws in entities.MARKERS.values() for w in ws.split())
    want = set()
    for source, pattern in (("API", entities.API_NAME), ("STRUCTURAL", entities.PHRASE.replace("MARKERS", markers)), ("NAMED", entities.NAMED)):
        want |= {(x["chunk_id"], x["start"], x["end"]) for x in chunks.select("chunk_id", F.explode(places(F.col("content"), pattern)).alias("p")).select("chunk_id", "p.*").collect()}
        if source == "API":
            assert not chunks.where(F.col("content").rlike(pattern) != F.col("content").rlike(entities.API_END)).count()
    got = entities.candidates(chunks).collect()
    found = {(x["id"], x["start"], x["end"]) for x in got}
    assert found <= want and len(got) == len(found) > 300
    named = {(x["id"], x["start"], x["end"]) for x in got if x["source"] == "NAMED"}
    assert named and all(x["score"] == {"API": 1.0, "STRUCTURAL": 0.98, "NAMED": 0.85}[x["source"]] for x in got)
    # only names without a word, or of too many words, are left out
    left = {(c, s, e): dict(texts)[c][s:e] for c, s, e in want - found}
    assert all(len(t.split()) > 6 or t.lower().strip(" .,-/{}") in ("", "a") for t in left.values()), left
