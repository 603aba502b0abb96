"""Relationships between the entities mentioned in a chunk: the nearest mentions around a trigger, and labelled lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

#: Triggers: pattern, type, confidence (fixed values).
TRIGGERS = (
    (r"\bcalls?\b", "CALLS", 0.96), (r"\binvokes?\b", "CALLS", 0.96), (r"\brequests?\b", "CALLS", 0.94), (r"\bqueries?\b", "QUERIES", 0.94),
    (r"\breads?\s+from\b", "READS_FROM", 0.96), (r"\breads?\b", "READS_FROM", 0.94), (r"\bfetch(?:es)?\s+from\b", "READS_FROM", 0.94),
    (r"\bwrites?\s+to\b", "WRITES_TO", 0.96), (r"\bsends?\s+to\b", "SENDS_TO", 0.94), (r"\bposts?\s+to\b", "SENDS_TO", 0.94),
    (r"\bdepends?\s+on\b", "DEPENDS_ON", 0.96), (r"\brel(?:y|ies)\s+on\b", "DEPENDS_ON", 0.96),
    (r"\buses?\b", "USES", 0.93), (r"\butilizes?\b", "USES", 0.93), (r"\bleverages?\b", "USES", 0.93),
    (r"\broutes?\s+to\b", "ROUTES_TO", 0.96), (r"\bsends?\s+to\b", "ROUTES_TO", 0.92), (r"\btriggers?\b", "TRIGGERS", 0.96), (r"\binitiates?\b", "TRIGGERS", 0.94),
    (r"\bfeeds?\b", "FEEDS", 0.92), (r"\bnotifies?\b", "NOTIFIES", 0.96), (r"\balerts?\b", "NOTIFIES", 0.94), (r"\bloops?\s+in\b", "INVOLVES", 0.92),
    (r"\bowned\s+by\b", "OWNED_BY", 0.98), (r"\bmaintained\s+by\b", "MAINTAINED_BY", 0.98), (r"\boperated\s+by\b", "OPERATED_BY", 0.98), (r"\bmanaged\s+by\b", "MANAGED_BY", 0.96),
    (r"\bassigned\s+to\b", "ASSIGNED_TO", 0.96), (r"\bescalated\s+to\b", "ESCALATES_TO", 0.96), (r"\bcoordinates?\s+with\b", "COORDINATES_WITH", 0.94),
    (r"\bgoverned\s+by\b", "GOVERNED_BY", 0.98), (r"\bregulated\s+by\b", "GOVERNED_BY", 0.96), (r"\benforced\s+by\b", "ENFORCED_BY", 0.98),
    (r"\bimplemented\s+by\b", "IMPLEMENTED_BY", 0.96), (r"\bimplements?\b", "IMPLEMENTS", 0.94), (r"\bsupports?\b", "SUPPORTS", 0.90),
    (r"\breferences?\b", "REFERENCES", 0.98), (r"\bdescribed\s+in\b", "DOCUMENTED_IN", 0.96), (r"\bdocumented\s+in\b", "DOCUMENTED_IN", 0.96),
    (r"\bdefined\s+in\b", "DEFINED_IN", 0.96), (r"\bspecified\s+in\b", "DEFINED_IN", 0.96), (r"\brelated\s+to\b", "RELATED_TO", 0.86),
)
#: Labels of lists: pattern, type (fixed values); their confidence, the farthest mention from a trigger, the longest labelled line.
LABELS = (("systems?", "RELATED_SYSTEM"), ("apis?", "RELATED_API"), ("workflows?", "RELATED_WORKFLOW"), ("polic(?:y|ies)", "RELATED_POLICY"), ("sops?", "RELATED_SOP"), ("documents?", "REFERENCES"))
LABEL_CONFIDENCE, FARTHEST, LONGEST_LINE = 0.90, 240, 600
#: A word of a name, and words of a name that are looked up; a longer name is verified whole.
NAME_WORD, MOST_RUN = r"[\p{L}\p{N}_]+", 7


def places(text: Column, pattern: Column | str, length: Column | None = None) -> Column:
    """(start, end) of every match of a pattern, in order. length: that of every match, where it is known."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.split(text, pattern, -1)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length) if length is None else F.transform(F.slice(gaps, 2, F.size(gaps)), lambda _: length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["g"])
        return F.struct((begin + x["n"]).alias("at"), F.array_append(a["out"], F.struct(begin.alias("start"), (begin + x["n"]).alias("end"))).alias("out"))

    return F.aggregate(F.filter(F.arrays_zip(gaps.alias("g"), sizes.alias("n")), lambda x: x["n"].isNotNull()), start, step, lambda a: a["out"])


def _run_hash(words: Column) -> Column:
    return F.xxhash64(words)


def name_runs(names: DataFrame) -> DataFrame:
    """names (chunk_id, entity, name) with lead (characters before the first word), words (the number of them looked up) and hash (of these); names without a word have 0 words."""
    w = F.slice(F.regexp_extract_all("name", F.lit(NAME_WORD), F.lit(0)), 1, MOST_RUN)
    return names.withColumns({"words": F.size(w), "hash": _run_hash(w), "lead": F.regexp_instr("name", F.lit(NAME_WORD)) - 1})


def text_runs(text: Column, sizes: Column) -> Column:
    """(hash, start) of every run of words whose length is among sizes: the words and their places are found once."""
    words, starts = F.regexp_extract_all(text, F.lit(NAME_WORD), F.lit(0)), F.transform(places(text, NAME_WORD), lambda p: p["start"])

    def runs(x: Column) -> Column:
        each = lambda k: F.when(F.size(x["w"]) >= k, F.transform(F.sequence(F.lit(0), F.size(x["w"]) - k), lambda i: F.struct(_run_hash(F.slice(x["w"], i + 1, k)).alias("hash"), F.get(x["s"], i).alias("start"))))
        return F.flatten(F.filter(F.transform(sizes, each), lambda r: r.isNotNull()))

    return X.let(F.struct(words.alias("w"), starts.alias("s")), runs)


def found_names(pieces: DataFrame, mentions: DataFrame) -> DataFrame:
    """(chunk_id, piece, entity, name, start) of names that may stand in a piece: those whose first MOST_RUN words do.

    A dictionary join: every run of words of a length that the chunk's names have is hashed once and meets the names of its
    chunk by that hash, so that a piece is read once whatever the number of names; start is where the whole name would begin.
    Names without a word meet each piece of their chunk that holds them."""
    names = name_runs(mentions.select("chunk_id", F.col("id").alias("entity"), "name").where("name != ''").distinct())
    lengths = names.where("words > 0").groupBy("chunk_id").agg(F.collect_set("words").alias("sizes"))  # MOST_RUN numbers at most
    runs = pieces.join(lengths, "chunk_id").select("chunk_id", "piece", F.explode(text_runs(F.col("text"), F.col("sizes"))).alias("r")).select("chunk_id", "piece", "r.hash", "r.start")
    met = runs.join(names.where("words > 0").select("chunk_id", "hash", "entity", "name", "lead"), ["chunk_id", "hash"])
    met = met.select("chunk_id", "piece", "entity", "name", (F.col("start") - F.col("lead")).alias("start"))
    signs = pieces.join(names.where("words = 0").select("chunk_id", "entity", "name"), "chunk_id").where(F.contains("text", F.col("name")))
    quoted = F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E"))
    return met.unionAll(signs.select("chunk_id", "piece", "entity", "name", F.explode(places(F.col("text"), quoted, F.length("name"))).alias("p")).select("chunk_id", "piece", "entity", "name", "p.start"))


def placed_mentions(pieces: DataFrame, mentions: DataFrame) -> DataFrame:
    """pieces (chunk_id, piece, text) with spans: the mentions (id, name) of the chunk found in the text, case-sensitive, between
    word boundaries; from the left the longest first, overlapping ones dropped.

    found_names() says what may stand where; each place is verified in the text. Pieces without a mention give no row, nor do
    null texts and names; names that occur twice among a chunk's mentions count once."""
    maybe = found_names(pieces, mentions).where("start >= 0").groupBy("chunk_id", "piece").agg(F.collect_set(F.struct("start", "name", "entity")).alias("maybe"))
    both = pieces.join(maybe, ["chunk_id", "piece"])
    edge = lambda c: ~c.rlike(r"[\p{L}\p{N}_]")
    text = F.col("text")

    def stands(x: Column) -> Column:
        end = x["start"] + F.length(x["name"])
        whole = F.substring(text, x["start"] + 1, F.length(x["name"])) == x["name"]
        return whole & ((x["start"] == 0) | edge(F.substring(text, x["start"], F.lit(1)))) & edge(F.substring(text, end + 1, F.lit(1)))

    span = lambda x: F.struct(x["start"].alias("start"), (-F.length(x["name"])).alias("minus"), (x["start"] + F.length(x["name"])).alias("end"), x["entity"].alias("entity"))
    spans = both.select("chunk_id", "piece", "text", F.array_sort(F.transform(F.filter("maybe", stands), span)).alias("all")).where(F.size("all") > 0)
    kind = spans.schema["all"].dataType
    # sorted by start, so that a span overlaps those kept if it begins before the last of them ends
    keep = F.aggregate("all", F.array().cast(kind), lambda a, x: F.when((F.size(a) > 0) & (x["start"] < F.get(a, F.size(a) - 1)["end"]), a).otherwise(F.array_append(a, x)))
    return spans.select("chunk_id", "piece", "text", keep.alias("spans"))


def triggered(placed: DataFrame) -> DataFrame:
    """The nearest mention before and after each trigger, as edges; both within FARTHEST characters."""
    each = []
    none = F.array().cast("array<struct<start:int,end:int,kind:string,confidence:double>>")
    for pattern, kind, confidence in TRIGGERS:
        found = F.transform(places(F.col("text"), f"(?i){pattern}"), _trigger(kind, confidence))
        each.append(F.when(F.col("text").rlike(f"(?i){pattern}"), found).otherwise(none))
    some = "|".join(p for p, _, _ in TRIGGERS)  # a text without any is read once
    rows = placed.where((F.size("spans") >= 2) & F.col("text").rlike(f"(?i){some}")).select("chunk_id", "text", "spans", F.explode(F.concat(*each)).alias("t"))
    before = F.array_max(F.transform(F.filter("spans", lambda m: m["end"] <= F.col("t.start")), lambda m: F.struct(m["end"].alias("end"), m["entity"].alias("entity"))))
    after = F.array_min(F.transform(F.filter("spans", lambda m: m["start"] >= F.col("t.end")), lambda m: F.struct(m["start"].alias("start"), m["entity"].alias("entity"))))
    rows = rows.withColumns({"b": before, "a": after}).where("b is not null and a is not null and b.entity != a.entity")
    rows = rows.where((F.col("t.start") - F.col("b.end") <= FARTHEST) & (F.col("a.start") - F.col("t.end") <= FARTHEST))
    return rows.select("chunk_id", F.col("b.entity").alias("source"), F.col("a.entity").alias("target"), F.col("t.kind").alias("relationship_type"), F.col("t.confidence").alias("confidence"), F.col("text").alias("evidence"))


def _trigger(kind: str, confidence: float):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))


def labelled(placed: DataFrame) -> DataFrame:
    """Edges of labelled lists: from the nearest mention before the label to each after it, else from each listed one to the next other one."""
    out = None
    for words, kind in LABELS:
        pattern = rf"(?i)\brelated\s+{words}\s*:"
        rows = placed.where(F.col("text").rlike(pattern) & (F.length("text") <= LONGEST_LINE)).select("chunk_id", "text", "spans", places(F.col("text"), pattern)[0].alias("l"))
        before = F.array_max(F.transform(F.filter("spans", lambda m: m["end"] <= F.col("l.start")), lambda m: F.struct(m["end"].alias("end"), m["entity"].alias("entity"))))["entity"]
        after = F.transform(F.filter("spans", lambda m: m["start"] >= F.col("l.end")), lambda m: m["entity"])
        rows = rows.withColumns({"source": before, "listed": after})
        star = rows.where("source is not null").select("chunk_id", "text", "source", F.explode("listed").alias("target"))
        chain = rows.where("source is null").select("chunk_id", "text", F.explode(F.transform("listed", lambda x, i: F.struct(x.alias("source"), F.try_element_at(F.filter(F.slice(F.col("listed"), i + 2, F.size("listed")), lambda y: y != x), F.lit(1)).alias("target")))).alias("e")).select("chunk_id", "text", "e.source", "e.target")
        own = star.unionAll(chain).where("target is not null and source != target").select("chunk_id", "source", "target", F.lit(kind).alias("relationship_type"), F.lit(LABEL_CONFIDENCE).alias("confidence"), F.col("text").alias("evidence"))
        out = own if out is None else out.unionAll(own)
    return out


def extract(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(chunk_id, source, target, relationship_type, confidence, evidence) of chunks (chunk_id, content), the most confident for each edge of a chunk."""
    sents = chunks.select("chunk_id", F.posexplode(F.transform(X.sentences(F.col("content")), X.collapse)).alias("piece", "text"))
    lines = F.filter(F.transform(F.split("content", "\n"), X.collapse), lambda x: x != "")
    rows = triggered(placed_mentions(sents, mentions)).unionAll(labelled(placed_mentions(chunks.select("chunk_id", F.posexplode(lines).alias("piece", "text")), mentions)))
    return most_confident(rows, ["chunk_id", "source", "target", "relationship_type"])


def most_confident(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row with the highest confidence for each key, the least evidence on a tie."""
    rest = [c for c in rows.columns if c not in key and c != "confidence"]
    best = F.min(F.struct((-F.col("confidence")).alias("_c"), *rest)).alias("m")
    return rows.groupBy(*key).agg(best).select(*key, (-F.col("m._c")).alias("confidence"), *[f"m.{c}" for c in rest])


def across_chunks(rows: DataFrame) -> DataFrame:
    """One edge for each (source, target, upper-cased type) over all chunks, with the chunk that gave it."""
    return most_confident(rows.withColumn("relationship_type", F.upper("relationship_type")), ["source", "target", "relationship_type"])
