"""Entity candidates from a tagger's annotations that callers bring: spans grown around structural markers, and the filters of spans.

Annotated chunks have an id, the text, and tokens: array of struct(text, lemma, pos, dep, stop, number, sentence, start, end)
in order, where number says that the token is one, sentence counts sentences, and start and end are places in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import entities as E
from lodestone.operators.relations import places

#: Parts of speech that a phrase grows over, relations to the head that let it grow to the right, words that it never takes in
#: on the left, words that no phrase begins or ends with, and labels that need no further proof (fixed values).
NOMINAL = ("NOUN", "PROPN", "ADJ", "NUM")
ATTACHED = ("compound", "amod", "nmod", "flat", "fixed", "appos")
NEVER_LEFT = ("and", "or", "but", "because", "which", "that", "this", "these", "those", "the", "a", "an")
CLAUSE_WORDS = ("and", "or", "but", "because", "which", "that")
PROVEN = ("API_PATTERN", "STRUCTURAL", "ORG", "PRODUCT", "FAC", "GPE", "EVENT", "LAW")
#: Steps to the left and right at most, and the scores of a structural phrase and an API name.
LEFT, RIGHT, STRUCTURAL_SCORE, API_SCORE = 6, 2, 0.98, 1.00
MARKER_WORDS = tuple(w for ws in E.MARKERS.values() for w in ws.split())


def is_sign(token: Column) -> Column:
    return token["text"].rlike(r"^\p{P}+$")


def _nominal(token: Column) -> Column:
    return ~is_sign(token) & token["pos"].isin(*NOMINAL)


def _grown_left(tokens: Column, at: Column) -> Column:
    """Where the phrase that ends in token `at` begins: LEFT steps of a fold, each of which takes in the token before, or a number and the hyphen after it (two steps), while it can."""
    here = F.get(tokens, at)["sentence"]
    sure = lambda c: F.coalesce(c, F.lit(False))

    def step(a: Column, _: Column) -> Column:
        before, number = F.get(tokens, a["first"] - 1), F.get(tokens, a["first"] - 2)
        goes_on = a["open"] & (a["steps"] < LEFT) & sure(before["sentence"] == here)
        takes = goes_on & sure(_nominal(before) & ~F.lower(before["text"]).isin(*NEVER_LEFT))
        joins = goes_on & ~takes & sure((before["text"] == "-") & (number["sentence"] == here) & number["number"])
        n = F.when(takes, 1).when(joins, 2).otherwise(0)
        return F.struct((a["first"] - n).alias("first"), (a["steps"] + n).alias("steps"), (takes | joins).alias("open"))

    start = F.struct(at.alias("first"), F.lit(0).alias("steps"), F.lit(True).alias("open"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEFT)), start, step, lambda a: a["first"])


def _grown_right(tokens: Column, at: Column) -> Column:
    """The last token of the phrase around token `at`: RIGHT more at most, while they are nominal and attached to a head."""
    here = F.get(tokens, at)["sentence"]
    fits = lambda t: F.coalesce((t["sentence"] == here) & _nominal(t) & t["dep"].isin(*ATTACHED), F.lit(False))
    reach, chain = at, F.lit(True)
    for k in range(1, RIGHT + 1):
        chain = chain & fits(F.get(tokens, at + k))
        reach = F.when(chain, at + k).otherwise(reach)
    return reach


def structural_spans(tokens: Column) -> Column:
    """(marker, first, last) of the phrase around every marker word: places of tokens, from 0. Null or empty tokens give none."""

    def spans(t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.coalesce(F.lower(F.get(t, i)["text"]).isin(*MARKER_WORDS), F.lit(False)))
        return F.transform(at, lambda i: F.struct(i.alias("marker"), _grown_left(t, i).alias("first"), _grown_right(t, i).alias("last")))

    none = F.array().cast("array<struct<marker:int,first:int,last:int>>")
    return F.when(F.size(tokens) > 0, X.let(tokens, spans)).otherwise(none)


def span_tokens(tokens: Column, first: Column, last: Column) -> Column:
    return F.slice(tokens, first + 1, last - first + 1)


def covered_text(text: Column, tokens: Column, first: Column, last: Column) -> Column:
    """The text from the first token's start to the last one's end."""
    start, end = F.get(tokens, first)["start"], F.get(tokens, last)["end"]
    return F.substring(text, start + 1, end - start)


def structural_phrases(chunks: DataFrame) -> DataFrame:
    """(id, text, start, end, label, score, tokens) of the structural phrases of annotated chunks, one row for each marker; names that cleaning leaves empty go."""
    found = chunks.select("id", F.col("text").alias("_whole"), F.col("tokens").alias("_all"), F.explode(structural_spans(F.col("tokens"))).alias("s"))
    return _spans(found, F.lit("STRUCTURAL"), F.lit(STRUCTURAL_SCORE))


def _spans(found: DataFrame, label: Column, score: Column) -> DataFrame:
    """Rows (id, _whole, _all, s: first and last) as spans with their own text and tokens."""
    first, last, whole = F.col("s.first"), F.col("s.last"), F.col("_all")
    out = found.select(
        "id", covered_text(F.col("_whole"), whole, first, last).alias("text"), F.get(whole, first)["start"].alias("start"), F.get(whole, last)["end"].alias("end"), label.alias("label"), score.alias("score"), span_tokens(whole, first, last).alias("tokens")
    )
    return out.where(X.clean_name(F.col("text"), E.EDGES) != "")


def keeps(tokens: Column, label: Column) -> Column:
    """Whether a span passes as a candidate: MOST_WORDS words at most, and either a PROVEN label, or words with content, a noun among
    them, a lone one as E.valid_token says, and no CLAUSE_WORDS at its ends. Null or empty tokens never pass."""
    words = F.filter(tokens, lambda t: ~is_sign(t) & (F.trim(t["text"]) != ""))

    def fits(w: Column) -> Column:
        content = F.filter(w, lambda t: ~F.coalesce(t["stop"], F.lit(False)) & ~F.coalesce(t["pos"].isin("DET", "PRON", "PUNCT"), F.lit(False)))
        noun = F.exists(content, lambda t: F.coalesce(t["pos"].isin("NOUN", "PROPN"), F.lit(False)))
        alone = (F.size(content) > 1) | F.exists(content, lambda t: E.valid_token(_with_start(t, tokens), label))
        ends = F.lower(F.get(w, F.lit(0))["text"]).isin(*CLAUSE_WORDS) | F.lower(F.element_at(w, -1)["text"]).isin(*CLAUSE_WORDS)
        return noun & alone & ~ends

    proven = F.coalesce(label.isin(*PROVEN), F.lit(False))
    return F.coalesce(X.let(words, lambda w: F.when(F.size(w).between(1, E.MOST_WORDS), proven | fits(w)).otherwise(False)), F.lit(False))


def _with_start(token: Column, tokens: Column) -> Column:
    """The token as E.valid_token reads it; a column `starts` of the tokens says whether one opens its sentence."""
    return F.struct(token["text"].alias("text"), token["lemma"].alias("lemma"), token["pos"].alias("pos"), token["starts"].alias("starts"))


def filtered(spans: DataFrame) -> DataFrame:
    """spans (id, text, label, tokens, ...) that keeps() lets pass and whose name isn't empty; tokens need `starts` besides."""
    return spans.where(keeps(F.col("tokens"), F.col("label")) & (X.normalize_name(X.clean_name(F.col("text"), E.EDGES)) != ""))


def with_starts(chunks: DataFrame) -> DataFrame:
    """Annotated chunks whose tokens say in `starts` whether they open a sentence: the first, and each whose sentence isn't that of the token before."""
    t = F.col("tokens")
    opens = lambda x, i: ~F.coalesce(F.get(t, i - 1)["sentence"] == x["sentence"], F.lit(False))
    return chunks.withColumn("tokens", F.transform(t, lambda x, i: x.withField("starts", opens(x, i))))


def candidates(chunks: DataFrame) -> DataFrame:
    """(id, name, normalized_name, start, end, score, source) of annotated chunks that also have entities (array of first, last,
    label) and phrases (noun phrases: array of first, last, root), as E.without_overlaps takes them.

    API names of the text, named entities, structural phrases and noun phrases, in this order; of spans that cover the same place
    with one name the first stays; then filtered(). Chunks with null columns give what the others of them give."""
    own = with_starts(chunks).withColumn("text", F.coalesce("text", F.lit("")))
    t = F.col("tokens")
    at = own.where(F.col("text").rlike(E.API_NAME)).select("id", "text", t.alias("tokens"), F.explode(places(F.col("text"), E.API_NAME)).alias("p"))
    start, end = F.col("p.start"), F.col("p.end")
    inside = F.filter("tokens", lambda x: (x["start"] < end) & (x["end"] > start))
    # a match is widened to whole tokens
    wide = at.withColumn("tokens", inside).where(F.size("tokens") > 0)
    first, last = F.get("tokens", F.lit(0))["start"], F.element_at("tokens", -1)["end"]
    apis = wide.select("id", F.substring("text", first + 1, last - first).alias("text"), first.alias("start"), last.alias("end"), F.lit("API_PATTERN").alias("label"), F.lit(API_SCORE).alias("score"), "tokens")
    rows = own.select("id", F.col("text").alias("_whole"), t.alias("_all"), F.explode("entities").alias("s"))
    named = _spans(rows, F.col("s.label"), F.when(F.col("s.label").isin(*E.STRONG), 0.95).otherwise(0.85))
    named = named.where((F.size("tokens") != 1) | E.valid_token(F.get("tokens", F.lit(0)), F.col("label")))
    rows = own.select("id", F.col("text").alias("_whole"), t.alias("_all"), F.explode("phrases").alias("s"))
    rooted = rows.withColumn("_all", F.transform("_all", lambda x, i: x.withField("root", i == F.col("s.root"))))
    content = F.size(E.content_tokens(F.col("tokens")))
    nouns = _spans(rooted, F.lit("NOUN_PHRASE"), F.lit(0.0)).where(E.valid_phrase(F.col("tokens"))).withColumn("score", F.when(content >= 3, 0.72).otherwise(0.62)).withColumn("tokens", F.transform("tokens", lambda x: x.dropFields("root")))
    found = None
    for k, part in enumerate((apis, named, structural_phrases(own), nouns)):
        part = part.withColumn("_order", F.lit(k))
        found = part if found is None else found.unionByName(part)
    name = X.clean_name(F.col("text"), E.EDGES)
    source = F.when(F.col("label") == "API_PATTERN", "API").when(F.col("label") == "STRUCTURAL", "STRUCTURAL").when(F.col("label") == "NOUN_PHRASE", "PHRASE").otherwise("NAMED")
    out = found.withColumns({"name": name, "normalized_name": X.normalize_name(name), "source": source}).where("normalized_name != ''")
    first_of = F.min_by(F.struct("name", "text", "label", "score", "source", "tokens"), F.struct("_order", "label")).alias("f")
    kept = out.groupBy("id", "start", "end", "normalized_name").agg(first_of).select("id", "start", "end", "normalized_name", "f.*")
    return filtered(kept).select("id", "name", "normalized_name", "start", "end", "score", "source")
