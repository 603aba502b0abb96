"""Entity candidates, types, canonical resolution and reconciliation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.operators.ordering import numbered
from lodestone.operators.relations import places
from lodestone.sources.scratch import checkpointed, staged

#: Words that mark a structural type, types by priority, and words at a name's ends that aren't part of it (fixed values).
MARKERS = {
    "API": "api sdk", "WORKFLOW": "workflow pipeline procedure", "POLICY": "policy regulation standard guideline", "TEAM": "team department committee squad",
    "DOCUMENTATION": "documentation manual guide", "SYSTEM": "system platform application database service engine", "PROJECT": "project initiative program",
}
PRIORITY = {"API": 100, "WORKFLOW": 90, "POLICY": 80, "TEAM": 70, "DOCUMENTATION": 60, "SYSTEM": 50, "PROJECT": 40, "ORGANIZATION": 30, "TECHNOLOGY": 20, "BUSINESS_CONCEPT": 10}
EDGES = ("the", "a", "an", "this", "that", "these", "those", "and", "or", "of", "for", "to", "in", "on", "with", "by", "from")
#: Words that name nothing, labels that vouch for a word at a sentence's start, and labels that score highest (fixed values).
GENERIC = "thing something anything everything nothing example way time part kind type number person people item case area aspect fact result detail details content".split()
VOUCHING, STRONG = ("ORG", "PRODUCT", "FAC", "GPE"), ("ORG", "PRODUCT", "FAC")
MOST_WORDS = 7
API_NAME = r"(?:[\p{L}\p{N}_]+[ -]){0,3}[\p{L}\p{N}_]*(?i:API|SDK)\b|(?i:GET|POST|PUT|PATCH|DELETE)\s+/[A-Za-z0-9_/{}.-]+"
#: What a text has if API_NAME matches in it, and only then.
API_END = r"(?i:API|SDK)\b|(?i:GET|POST|PUT|PATCH|DELETE)\s+/[A-Za-z0-9_/{}.-]"
PHRASE = r"(?:\p{Lu}[\p{L}\p{N}_-]*[ ]){1,5}(?i:MARKERS)\b"
NAMED = r"\p{Lu}[\p{L}\p{N}_-]+(?:[ ]\p{Lu}[\p{L}\p{N}_-]+){1,4}"
#: Words that set a name apart rather than describe it (fixed values).
CONTEXT = (
    "api apis architecture article articles checkout database databases documentation document documents gateway guide guides issue issues module modules policy policies "
    "request requests responsibility responsibilities rule rules service services status support team teams transaction transactions workflow workflows"
).split()
#: Names of a group that are resolved in turn at once, founders that one task compares them with, and digits of a cosine that count.
BLOCK, FOUNDERS, DIGITS = 2048, 8192, 12
STRUCTURAL = {"EXACT_DUPLICATE": 1.0, "REPEATED_NAME_ARTIFACT": 1.0, "CONTEXT_EXTENSION": 0.20, "DESCRIPTIVE_EXTENSION": 0.90}


def entity_type(name: Column) -> Column:
    """The type that a marker word gives, by priority; technology or business concept without one."""
    words = F.split(F.lower(name), r"[^\p{L}\p{N}]+")
    out = F
    for kind in sorted(MARKERS, key=lambda k: -PRIORITY[k]):
        out = out.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in MARKERS[kind].split()])), kind)
    return out.when(X.looks_technical(name), "TECHNOLOGY").otherwise("BUSINESS_CONCEPT")


def candidates(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(id, name, normalized_name, start, end, score, source) of API names, phrases that end in a marker, and capitalized names.

    A rule-based stand-in for a tagger: patterns over the whole text, a row for every place where one matches."""
    markers = "|".join(w for ws in MARKERS.values() for w in ws.split())
    # with each pattern one that every text with a match has and that is found without going back over words
    kinds = [("API", API_NAME, API_END, 1.00), ("STRUCTURAL", PHRASE.replace("MARKERS", markers), f"[ ](?i:{markers})\\b", 0.98), ("NAMED", NAMED, NAMED, 0.85)]
    text = F.col(text_col)
    none = F.array().cast("array<struct<start:int,end:int,score:double,source:string>>")

    def found(source: str, pattern: str, sign: str, score: float) -> Column:
        return F.when(text.rlike(sign), F.transform(places(text, pattern), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(score).alias("score"), F.lit(source).alias("source")))).otherwise(none)

    each = chunks.select(F.col(id_col).alias("id"), text.alias("t"), F.explode(F.concat(*[found(*k) for k in kinds])).alias("p"))
    name = X.clean_name(F.substring("t", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")), EDGES)
    out = each.select("id", name.alias("name"), X.normalize_name(name).alias("normalized_name"), "p.start", "p.end", "p.score", "p.source")
    out = out.where(f"normalized_name != '' and size(split(normalized_name, ' ')) <= {MOST_WORDS}")
    first = F.row_number().over(Window.partitionBy("id", "start", "end", "normalized_name").orderBy(F.desc("score")))
    return out.withColumn("_n", first).where("_n = 1").drop("_n")


def valid_token(token: Column, label: Column) -> Column:
    """Whether a word (text, lemma, pos, starts: whether it starts a sentence) may stand alone as a name."""
    word = F.lower(token["text"])
    markers = [w for ws in MARKERS.values() for w in ws.split()]
    inside = ~F.coalesce(token["starts"], F.lit(False)) | label.isin(*VOUCHING) | X.looks_technical(token["text"]) | X.inner_capitals(token["text"])
    return F.coalesce(~word.isin(*markers) & ~word.isin(*GENERIC) & ~F.lower(token["lemma"]).isin(*GENERIC) & (token["pos"] == "PROPN") & F.coalesce(inside, F.lit(False)), F.lit(False))


def content_tokens(tokens: Column) -> Column:
    """The words of a phrase that aren't stop words, determiners, pronouns or signs."""
    return F.filter(tokens, lambda t: ~F.coalesce(t["stop"], F.lit(False)) & ~t["pos"].isin("DET", "PRON", "PUNCT", "SPACE"))


def valid_phrase(tokens: Column) -> Column:
    """Whether a phrase (array of text, lemma, pos, stop, starts, root) names something: at most MOST_WORDS words, a noun among those with content, a noun as its root; a lone one as valid_token says."""
    content = content_tokens(tokens)
    noun = lambda t: t["pos"].isin("NOUN", "PROPN")
    words = F.size(F.filter(tokens, lambda t: ~t["pos"].isin("PUNCT", "SPACE")))
    several = F.exists(tokens, lambda t: F.coalesce(t["root"], F.lit(False)) & noun(t))
    alone = F.exists(content, lambda t: valid_token(t, F.lit(None).cast("string")))
    return F.coalesce((words <= MOST_WORDS) & F.exists(content, noun) & F.when(F.size(content) == 1, alone).otherwise(several), F.lit(False))


def annotated(spans: DataFrame) -> DataFrame:
    """candidates() from a tagger's spans that callers bring: (id, text, start, end, label, tokens); a label makes a span a named entity, without one it is a noun phrase.

    A named entity of one word must pass valid_token and scores 0.95 with a STRONG label, else 0.85; a noun phrase must
    pass valid_phrase and scores 0.72 with three words of content, else 0.62. Spans of nulls give none."""
    name = X.clean_name(F.col("text"), EDGES)
    single = F.size("tokens") == 1
    named = F.col("label").isNotNull()
    fine = F.when(named, ~single | valid_token(F.col("tokens")[0], F.col("label"))).otherwise(valid_phrase(F.col("tokens")))
    score = F.when(named, F.when(F.col("label").isin(*STRONG), 0.95).otherwise(0.85)).otherwise(F.when(F.size(content_tokens(F.col("tokens"))) >= 3, 0.72).otherwise(0.62))
    out = spans.where(fine).select("id", name.alias("name"), X.normalize_name(name).alias("normalized_name"), "start", "end", score.alias("score"), F.when(named, "NAMED").otherwise("PHRASE").alias("source"))
    return out.where(f"normalized_name != '' and size(split(normalized_name, ' ')) <= {MOST_WORDS}")


def priority(score: Column, source: Column, kind: Column) -> Column:
    rank = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v / 100))])[kind]
    return score + F.when(source == "API", 2.0).when(source == "STRUCTURAL", 1.5).otherwise(0.0) + rank


def without_overlaps(found: DataFrame) -> DataFrame:
    """One row for each chunk's spans kept, taken by priority, start and end. The spans of one chunk are one array.

    A span meets the first span already kept that it overlaps and that decides: it goes if that has its name, is
    structural where it is neither that nor an API, or contains it; it takes that one's place if it is structural and that
    one isn't, or if it contains it. Spans that overlap in part otherwise both stay, and a span takes one place at most."""
    span = F.struct((-priority(F.col("score"), F.col("source"), entity_type(F.col("name")))).alias("p"), "start", "end", "name", "normalized_name", "score", "source")
    spans = found.groupBy("id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    kind = spans.schema["spans"].dataType
    strong = lambda x: x["source"].isin("STRUCTURAL", "API")
    beats = lambda x, y: (x["source"] == "STRUCTURAL") & ~strong(y)
    inside = lambda x, y: (y["start"] <= x["start"]) & (y["end"] >= x["end"])
    same = lambda x, y: x["normalized_name"] == y["normalized_name"]
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    decides = lambda x, y: meets(x, y) & (same(x, y) | beats(x, y) | beats(y, x) | inside(x, y) | inside(y, x))
    goes = lambda x, y: same(x, y) | (~beats(x, y) & (beats(y, x) | inside(x, y)))

    def take(a: Column, x: Column) -> Column:
        met = F.try_element_at(F.filter(a, lambda y: decides(x, y)), F.lit(1))
        return F.when(met.isNull(), F.array_append(a, x)).when(goes(x, met), a).otherwise(F.array_append(F.array_remove(a, met), x))

    return spans.select("id", F.explode(F.aggregate("spans", F.array().cast(kind), take)).alias("s")).select("id", "s.name", "s.normalized_name", "s.start", "s.end", "s.score", "s.source")


def mentions(found: DataFrame) -> DataFrame:
    """(id, normalized_name, name, entity_type): a chunk's candidates by name, with the type of the highest (priority, score) and the name of the highest score."""
    typed = found.withColumn("entity_type", entity_type(F.col("name")))
    rank = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])[F.col("entity_type")]
    best = F.max(F.struct(rank.alias("r"), "score", "entity_type"))["entity_type"]
    return typed.groupBy("id", "normalized_name").agg(F.min(F.struct((-F.col("score")).alias("s"), "start", "name"))["name"].alias("name"), best.alias("entity_type"))


def backfill(rows: DataFrame) -> DataFrame:
    """Canonical entities (organization_id, normalized_name, entity_type) with the least name and description."""
    return rows.groupBy("organization_id", "normalized_name", "entity_type").agg(F.min("name").alias("name"), F.min("description").alias("description"))


def exact_matches(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """rows with canonical_id where organization, normalized name and type agree."""
    key = ["organization_id", "normalized_name", "entity_type"]
    return rows.join(canonical.select(*key, F.col("id").alias("canonical_id")), key, "left")


def linked(rows: DataFrame, chunks: DataFrame, documents: DataFrame, canonical: DataFrame) -> DataFrame:
    """rows (id, chunk_id, normalized_name, entity_type) with canonical_id: the canonical entity of their name and type in the
    organization of their chunk's document; null without one.

    rows: mentions; chunks: id, document_id; documents: id, organization_id. One plan: the organization comes over two keyed
    joins of ids alone, then exact_matches()."""
    owned = chunks.select(F.col("id").alias("chunk_id"), "document_id").join(documents.select(F.col("id").alias("document_id"), "organization_id"), "document_id").select("chunk_id", "organization_id")
    return exact_matches(rows.drop("organization_id", "canonical_id").join(owned, "chunk_id", "left"), canonical)


def per_chunk(rows: DataFrame, order: str = "place") -> DataFrame:
    """One row for each chunk, name (trimmed, lower case) and type (trimmed, upper case), the first by order; blank names and types go."""
    key = ["chunk_id", "normalized_name", "entity_type"]
    fine = rows.withColumns({"normalized_name": F.lower(F.trim("normalized_name")), "entity_type": F.upper(F.trim("entity_type"))}).where("normalized_name != '' and entity_type != ''")
    rest = [c for c in fine.columns if c not in key]
    first = F.min(F.struct(order, *[c for c in rest if c != order])).alias("f")
    return fine.groupBy(*key).agg(first).select(*[c if c in key else F.col(f"f.{c}").alias(c) for c in fine.columns])


def described(canonical: DataFrame, rows: DataFrame) -> DataFrame:
    """canonical with an empty description filled by the first that rows (canonical_id, position, description) have."""
    told = rows.where("description is not null and description != ''").groupBy(F.col("canonical_id").alias("_of")).agg(F.min(F.struct("position", "description"))["description"].alias("_told"))
    return canonical.join(told, F.col("id") == F.col("_of"), "left").withColumn("description", F.coalesce(F.nullif("description", F.lit("")), "_told", "description")).drop("_of", "_told")


def resolve_batch(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """resolve_in_order() of all mentions (chunk_id, place, id, ...) of an organization, in the order of their documents and chunks (id, document_id, chunk_index)."""
    placed = rows.join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index"), "chunk_id")
    return resolve_in_order(placed.withColumn("position", F.struct("document_id", "chunk_index", "place")))


def _units(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows of length 1, shorter ones filled up with zeros; null vectors and null or non-finite components are zeros."""
    own = [np.nan_to_num(np.asarray([] if v is None else v, dtype=float), posinf=0.0, neginf=0.0) for v in vectors]
    out = np.zeros((len(own), max((len(v) for v in own), default=0) or 1))
    for i, v in enumerate(own):
        out[i, : len(v)] = v
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded, so that equal ones are equal however they were summed."""
    n = min(a.shape[1], b.shape[1])
    return np.round(a[:, :n] @ b[:, :n].T, DIGITS)


def _joins(cosine: float, own: str, other: str, limit: float) -> bool:
    a, b = set(own.split()), set(other.split())
    return 0.75 * min(1.0, max(0.0, cosine)) + 0.25 * (len(a & b) / len(a | b) if a | b else 0.0) >= limit


def _nearest_founders(asked: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
    """Of one part of a pool, the founder with the highest cosine to each row asked for, the earlier one on a tie."""
    if not len(asked) or not len(pool):
        return asked[["organization_id", "entity_type", "name"]].iloc[:0].assign(cosine=pd.Series(dtype=float), founded_at=pd.Series(dtype=int), founder=pd.Series(dtype=object))
    pool = pool.sort_values("place", ignore_index=True)
    theirs, best, at = _units(pool["vector"]), np.full(len(asked), -np.inf), np.zeros(len(asked), int)
    for k in range(0, len(asked), 1024):
        cosines = _cosines(_units(asked["vector"].iloc[k : k + 1024]), theirs)
        at[k : k + 1024], best[k : k + 1024] = cosines.argmax(1), cosines.max(1)
    return asked[["organization_id", "entity_type", "name"]].assign(cosine=best, founded_at=pool["place"].to_numpy()[at], founder=pool["name"].to_numpy()[at])


def _in_turn(block: pd.DataFrame, limit: float) -> pd.DataFrame:
    """One block of a group's names in their order: each joins the earlier founder, of the pool or of the block, with the highest cosine if it is close enough, else founds one."""
    block = block.sort_values("place", ignore_index=True)
    units, names, out = _units(block["vector"]), block["name"].tolist(), []
    founders: list[int] = []
    within = _cosines(units, units)
    for i, (cosine, founder) in enumerate(zip(block["cosine"], block["founder"], strict=True)):
        best = founder if founder is not None and not pd.isna(cosine) else None
        if founders:
            own = within[i, founders]
            k = int(own.argmax())
            if best is None or own[k] > cosine:
                best, cosine = names[founders[k]], own[k]
        if best is None or not _joins(float(cosine), names[i], best, limit):
            founders.append(i)
            best = names[i]
        out.append(best)
    return block[["organization_id", "entity_type", "name", "place"]].assign(founder=out)


def resolve_in_order(rows: DataFrame, limit: float = 0.82, block: int = BLOCK) -> DataFrame:
    """(id, canonical_id) of rows (organization_id, entity_type, id, normalized_name, vector, position): each row joins the
    earlier canonical entity of its name, else that with the highest cosine if 0.75 cosine + 0.25 Jaccard is limit or more, else founds one.

    As one after another, in blocks of so many names of each group (organization, type): a block's names are compared with the
    founders of the blocks before, which are written and dealt in parts, and only what is within the block is taken in turn. So
    a task holds a block and a part of the founders, however large a group is; a round of two jobs serves a block of every
    group. The first row of a name, by position and id, stands for all. Cosines count to 12 digits; a null or zero vector has a
    cosine of 0 with all; rows with a null organization, type or name give no row."""
    group, key = ["organization_id", "entity_type"], ["organization_id", "entity_type", "normalized_name"]
    spark = rows.sparkSession
    fine = rows.where(" and ".join(f"{k} is not null" for k in key))
    first = F.min(F.struct("position", "id", "vector")).alias("f")
    names = fine.groupBy(*key).agg(first).select(*group, F.col("normalized_name").alias("name"), "f.position", "f.id", "f.vector")
    ordered = numbered(names, group, ["position", "id"]).select(*group, "name", "id", F.col("vector").cast("array<double>").alias("vector"), "place")
    most = ordered.agg(F.coalesce(F.max("place"), F.lit(-1))).first()[0]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in group)
    found: list[DataFrame] = []
    pool: list[DataFrame] = []
    for start in range(0, most + 1, block):
        own = ordered.where(F.col("place").between(start, start + block - 1))
        if pool:
            held = reduce(DataFrame.unionAll, pool)
            parts = held.groupBy(*group).agg(F.ceil(F.count("*") / FOUNDERS).cast("int").alias("parts"))
            dealt = held.join(parts, group).withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")).drop("parts")
            asked = own.join(parts, group).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*group, "part", "name", "vector")
            schema = f"{kinds}, name string, cosine double, founded_at long, founder string"
            # each part answers for itself; the best of a name's answers is a keyed maximum
            near = asked.groupBy(*group, "part").cogroup(dealt.groupBy(*group, "part")).applyInPandas(_nearest_founders, schema)
            best = near.groupBy(*group, "name").agg(F.max(F.struct("cosine", (-F.col("founded_at")).alias("_early"), "founder")).alias("b")).select(*group, "name", "b.cosine", "b.founder")
            own = own.join(best, [*group, "name"], "left")
        else:
            own = own.withColumns({"cosine": F.lit(None).cast("double"), "founder": F.lit(None).cast("string")})
        turn = own.groupBy(*group).applyInPandas(lambda t: _in_turn(t, limit), f"{kinds}, name string, place long, founder string")
        found.append(staged(turn, "resolved"))
        pool.append(staged(found[-1].where("name = founder").select(*group, "name").join(ordered, [*group, "name"]).select(*group, "name", "vector", "place"), "founders"))
    if not found:
        return spark.createDataFrame([], rows.select("id", F.col("id").alias("canonical_id")).schema)
    done = reduce(DataFrame.unionAll, found)
    told = done.join(ordered.select(*group, F.col("name").alias("founder"), F.col("id").alias("canonical_id")), [*group, "founder"])
    return fine.select("id", *key).join(told.select(*group, F.col("name").alias("normalized_name"), "canonical_id"), key).select("id", "canonical_id")


def relation(a: Column, b: Column) -> Column:
    """How two names (token arrays) relate."""
    left, right = F.array_except(a, b), F.array_except(b, a)
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    windows = F.filter(F.sequence(F.lit(1), F.size(long) - F.size(short) + 1), lambda i: F.slice(long, i, F.size(short)) == short)
    repeated = (F.size(a) != F.size(b)) & (F.size(windows) >= 2)
    extra = F.concat(left, right)
    extension = F.when(F.arrays_overlap(extra, F.array(*[F.lit(w) for w in CONTEXT])), "CONTEXT_EXTENSION").otherwise("DESCRIPTIVE_EXTENSION")
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), "STRUCTURAL_MISMATCH")
        .when((F.size(left) == 0) & (F.size(right) == 0), "EXACT_DUPLICATE")
        .when(repeated, "REPEATED_NAME_ARTIFACT")
        .when((F.size(left) == 0) | (F.size(right) == 0), extension)
        .otherwise("STRUCTURAL_MISMATCH")
    )


def duplicates(entities: DataFrame) -> DataFrame:
    """Pairs of entities (id, normalized_name, entity_type, vector) of one type that may be the same, scored.

    Only names of which one's words are all in the other can be kept, so a name meets just those that have its rarest
    word: the join's key is the type and a word that is rare by choice, never the whole type. Names meet once, however
    many entities have them; their entities are paired only where the names can be kept. Cosine is null-safe 0."""
    fine = entities.where("id is not null and trim(normalized_name) != '' and trim(entity_type) != ''")
    fine = fine.select("id", F.upper(F.trim("entity_type")).alias("entity_type"), "normalized_name", F.split(F.trim("normalized_name"), r"\s+").alias("words"), "vector")
    names = fine.select("entity_type", "normalized_name", "words").distinct()
    every = names.select("entity_type", F.col("normalized_name").alias("name"), F.explode(F.array_distinct("words")).alias("word"))
    count = every.groupBy("entity_type", "word").agg(F.count("*").alias("n"))
    rarest = every.join(count, ["entity_type", "word"]).groupBy("entity_type", "name").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    met = rarest.withColumnRenamed("name", "x").join(every.withColumnRenamed("name", "y"), ["entity_type", "word"]).where("x != y")
    met = met.select("entity_type", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    words = lambda c: F.split(F.trim(c), r"\s+")
    met = met.withColumn("relation", relation(words("x"), words("y"))).where("relation != 'STRUCTURAL_MISMATCH'")
    side = lambda name: fine.select(F.col("entity_type"), F.col("normalized_name").alias(name), F.struct(*fine.columns).alias(f"_{name}"))
    both = met.join(side("x"), ["entity_type", "x"]).join(side("y"), ["entity_type", "y"])
    turned = F.col("_y.id") < F.col("_x.id")
    both = both.select("relation", F.when(turned, F.col("_y")).otherwise(F.col("_x")).alias("_first"), F.when(turned, F.col("_x")).otherwise(F.col("_y")).alias("_second"))
    return scored(both.select("relation", *[F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in ("first", "second") for c in fine.columns]))


def in_order(pairs: DataFrame) -> DataFrame:
    """Pairs as they are shown: the highest combined similarity first, then by type and names."""
    return pairs.orderBy(F.desc("combined"), "first_entity_type", F.lower("first_normalized_name"), F.lower("second_normalized_name"))


def validated(candidates: DataFrame, canonical: DataFrame) -> DataFrame:
    """candidates (keep_id, drop_id) that may still be merged: two different entities (id, organization_id, entity_type) that both exist, of one organization and one type whatever its case."""
    side = lambda s: canonical.select(F.col("id").alias(f"{s}_id"), F.col("organization_id").alias(f"_{s}_org"), F.upper("entity_type").alias(f"_{s}_type"))
    both = candidates.where("keep_id != drop_id").join(side("keep"), "keep_id").join(side("drop"), "drop_id")
    return both.where("_keep_org = _drop_org and _keep_type = _drop_type").drop("_keep_org", "_drop_org", "_keep_type", "_drop_type")


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (first_*, second_*, relation) with dense, lexical, structural and combined similarity, confidence and reason; those under their limit go."""
    structural = F.create_map(*[x for k, v in STRUCTURAL.items() for x in (F.lit(k), F.lit(v))])[F.col("relation")]
    dense = X.clip(F.coalesce(X.dot(X.unit(F.col("first_vector")), X.unit(F.col("second_vector"))), F.lit(0.0)))
    out = pairs.withColumns({"dense": dense, "lexical": X.jaccard(F.array_distinct("first_words"), F.array_distinct("second_words")), "structural": structural})
    out = out.withColumn("combined", 0.60 * F.col("dense") + 0.25 * F.col("lexical") + 0.15 * F.col("structural"))
    return judged(out)


def judged(pairs: DataFrame) -> DataFrame:
    d, c, r = F.col("dense"), F.col("combined"), F.col("relation")
    passed = F.when(r == "CONTEXT_EXTENSION", (d >= 0.94) & (c >= 0.86)).otherwise(c >= 0.82)
    confidence = (
        F.when(r == "REPEATED_NAME_ARTIFACT", F.when((d >= 0.90) & (c >= 0.85), "HIGH").otherwise("MEDIUM"))
        .when(r == "CONTEXT_EXTENSION", "REVIEW")
        .when((d >= 0.94) & (c >= 0.88), "HIGH")
        .when(c >= 0.85, "MEDIUM")
        .otherwise("REVIEW")
    )
    reason = F.when(r == "EXACT_DUPLICATE", "same words").when(r == "REPEATED_NAME_ARTIFACT", "one name repeats the other").when(r == "CONTEXT_EXTENSION", "one name adds context").otherwise("one name adds a description")
    return pairs.where(passed).withColumns({"confidence": confidence, "reason": reason})


def survivors(pairs: DataFrame) -> DataFrame:
    """pairs with keep_id and drop_id: the name with fewer words for a repeated name, else the shorter name, else the smaller id."""
    words = lambda s: F.when(F.col("relation") == "REPEATED_NAME_ARTIFACT", F.size(f"{s}_words")).otherwise(0)
    key = lambda s: F.struct(words(s).alias("w"), F.length(f"{s}_normalized_name").alias("l"), F.col(f"{s}_id").alias("id"))
    keep = F.least(key("first"), key("second"))["id"]
    return pairs.withColumn("keep_id", keep).withColumn("drop_id", F.when(keep == F.col("first_id"), F.col("second_id")).otherwise(F.col("first_id")))


def merge(mention_rows: DataFrame, canonical: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions moved from drop_id to keep_id, and the canonical entities left. merges: one row for each drop_id, already without chains."""
    to = merges.select(F.col("drop_id").alias("_from"), F.col("keep_id").alias("_to"))
    moved = mention_rows.join(to, F.col("canonical_id") == F.col("_from"), "left").withColumn("canonical_id", F.coalesce("_to", "canonical_id")).drop("_from", "_to")
    return moved, canonical.join(to, F.col("id") == F.col("_from"), "left_anti")


def left_behind(moved: DataFrame, merges: DataFrame) -> DataFrame:
    """Mentions that still name a merged entity; none after merge()."""
    return moved.join(merges.select(F.col("drop_id").alias("canonical_id")), "canonical_id", "left_semi")


def merge_rounds(entities: DataFrame, least: str = "HIGH") -> DataFrame:
    """(drop_id, keep_id) after merging the best pairs until none of the confidence is left; a round takes the pairs that are the best of the one dropped and that none which drops the one kept comes before."""
    levels = ["HIGH", "MEDIUM", "REVIEW"][: ["HIGH", "MEDIUM", "REVIEW"].index(least) + 1]
    spark, left, done = entities.sparkSession, entities, []
    while True:  # each round takes an entity out at least
        pairs = survivors(duplicates(left).where(F.col("confidence").isin(*levels))).select("keep_id", "drop_id", "combined")
        ends = pairs.select(F.col("keep_id").alias("e"), "*").unionAll(pairs.select(F.col("drop_id").alias("e"), "*"))
        best = ends.groupBy("e").agg(F.max(F.struct("combined", "keep_id", "drop_id")).alias("b"))
        lost = pairs.groupBy(F.col("drop_id").alias("_h")).agg(F.max(F.struct("combined", "keep_id", "drop_id")).alias("_l"))
        both = best.where("e = b.drop_id").join(lost, F.col("b.keep_id") == F.col("_h"), "left").where("_l is null or _l < b")
        both = checkpointed(both.select("b.drop_id", "b.keep_id"))
        if both.isEmpty():
            break
        done.append(both)
        left = checkpointed(left.join(both.select(F.col("drop_id").alias("id")), "id", "left_anti"))
    out = spark.createDataFrame([], done[0].schema) if done else spark.createDataFrame([], entities.select(F.col("id").alias("drop_id"), F.col("id").alias("keep_id")).schema)
    for x in done:
        moved = out.join(x.withColumnsRenamed({"drop_id": "_d", "keep_id": "_k"}), F.col("keep_id") == F.col("_d"), "left").select("drop_id", F.coalesce("_k", "keep_id").alias("keep_id"))
        out = checkpointed(moved.unionAll(x))  # rounds may be many: plans don't grow with them
    return out
