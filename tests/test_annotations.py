"""Candidates over annotated chunks, by hand-made tokens."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import annotations as A
from lodestone.operators import entities

TOKEN = "struct<text:string,lemma:string,pos:string,dep:string,stop:boolean,number:boolean,sentence:int,start:int,end:int>"
SCHEMA = f"id int, text string, tokens array<{TOKEN}>, entities array<struct<first:int,last:int,label:string>>, phrases array<struct<first:int,last:int,root:int>>"
KINDS = {"N": "NOUN", "P": "PROPN", "A": "ADJ", "V": "VERB", "D": "DET", ".": "PUNCT", "9": "NUM", "C": "CCONJ", "O": "PRON"}


def annotate(words):
    """(text, tokens) of "word/KIND/dep" items; a full stop ends a sentence."""
    text, tokens, sentence = "", [], 0
    for item in words.split():
        w, kind, *dep = item.split("/")
        text += " " * (bool(text) and w not in "-.," and not text.endswith("-"))
        tokens.append((w, w.lower(), KINDS[kind], dep[0] if dep else "dep", kind in "DCO", w.isdigit(), sentence, len(text), len(text) + len(w)))
        text += w
        sentence += w == "."
    return text, tokens


CASES = [
    ("we/O use/V the/D order/N routing/N service/N", ["order routing service"]),  # a determiner ends the growth
    ("a/D one/A two/A three/A four/A five/A six/A seven/A policy/N", ["two three four five six seven policy"]),  # six steps
    ("the/D 15/9 -/. minute/N freshness/N standard/N RateEngine/P/nsubj must/V meet/V", ["15-minute freshness standard"]),  # a number with its hyphen; no subject on the right
    ("x/A k/N b/N c/N 30/9 -/. day/N policy/N", ["k b c 30-day policy"]),
    ("p/N q/N 4/9 -/. e/N f/N g/N h/N i/N guide/N", ["4-e f g h i guide"]),  # five steps, then number and hyphen: seven in all
    ("platform/N team/N/compound lead/N/amod group/N/compound", ["platform team lead", "platform team lead group"]),  # two at most on the right
    ("read/V a/D manual/N ./. Billing/P department/N closes/V", ["manual", "Billing department"]),  # never across sentences
    ("state/N -/. wide/A api/N", ["wide api"]),  # a hyphen without a number ends it
    ("and/C API/N and/C", ["API"]),
    ("nothing/N here/A", []),
]


@pytest.mark.parametrize(("words", "names"), CASES)
def test_structural_phrases(spark, words, names):
    text, tokens = annotate(words)
    got = A.structural_phrases(spark.createDataFrame([(1, text, tokens, [], [])], SCHEMA)).collect()
    assert [r["text"] for r in sorted(got, key=lambda r: r["start"])] == names
    assert all(text[r["start"] : r["end"]] == r["text"] and r["label"] == "STRUCTURAL" for r in got)


def test_no_tokens(spark):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, "", [], [], []), (3, "api", None, None, None), (4, "", [(None,) * 9, ("api", None, None, None, None, None, None, 0, 3)], [], [])], SCHEMA)
    assert [r["text"] for r in A.structural_phrases(rows).collect()] == []
    assert A.candidates(rows).count() == 0 and A.candidates(rows.limit(0)).count() == 0


def passes(spark, words, label):
    text, tokens = annotate(words)
    rows = A.with_starts(spark.createDataFrame([(1, text, tokens, [], [])], SCHEMA)).withColumn("label", F.lit(label).cast("string"))
    return A.filtered(rows).count() == 1


FILTERS = [
    ("a/D b/N c/N d/N e/N f/N g/N", "NOUN_PHRASE", True),
    ("a/D b/N c/N d/N e/N f/N g/N h/N", "STRUCTURAL", False),  # eight words, whatever the label
    ("runs/V fast/V", "NOUN_PHRASE", False),  # no noun
    ("runs/V fast/V", "LAW", True),  # proven by its label
    ("runs/V fast/V", "DATE", False),
    ("the/D it/O", "NOUN_PHRASE", False),  # no content
    ("order/N and/C", "NOUN_PHRASE", False),  # ends in a conjunction
    ("because/C order/N flow/N", "NOUN_PHRASE", False),
    ("because/C order/N flow/N", "API_PATTERN", True),
    ("the/D order/N", "NOUN_PHRASE", False),  # a lone common noun
    ("the/D Kafka/P", "NOUN_PHRASE", True),  # a lone proper noun inside the sentence
    ("Kafka/P", "NOUN_PHRASE", False),  # that opens it
    ("Kafka/P", "ORG", True),
    ("KafKa/P", "DATE", True),  # capitals inside speak for a name
    ("the/D Service/P", "NOUN_PHRASE", False),  # a marker alone
    ("the/D Thing/P", "NOUN_PHRASE", False),  # a word that names nothing
    ("-/. ./.", "STRUCTURAL", False),  # signs only
]


@pytest.mark.parametrize(("words", "label", "kept"), FILTERS)
def test_filters(spark, words, label, kept):
    assert passes(spark, words, label) == kept


def test_candidates_of_a_chunk(spark):
    text, tokens = annotate("the/D Order/P API/N calls/V Acme/P ./. Our/O quick/A checkout/N flow/N waits/V")
    at = {t[0]: i for i, t in enumerate(tokens)}
    rows = spark.createDataFrame([(7, text, tokens, [(at["Acme"], at["Acme"], "ORG")], [(at["the"], at["API"], at["API"]), (at["Our"], at["flow"], at["flow"]), (at["Acme"], at["Acme"], at["Acme"])])], SCHEMA)
    found = A.candidates(rows)
    got = {(r["name"], r["source"], r["score"]) for r in found.collect()}
    # "the Order API" is an API name first and a noun phrase after; "Order API" a structural phrase; Acme a named entity before it is a noun phrase
    assert ("Acme", "NAMED", 0.95) in got and ("Order API", "STRUCTURAL", 0.98) in got and ("Our quick checkout flow", "PHRASE", 0.72) in got
    assert ("Acme", "PHRASE", 0.62) not in got and len({n for n, _, _ in got}) == 3
    kept = {r["name"] for r in entities.without_overlaps(found).collect()}
    assert kept == {"Order API", "Acme", "Our quick checkout flow"}
