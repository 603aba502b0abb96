"""Line dedup by word edits in DataFrame functions only: a deletion-neighbourhood join for one edit, shared fingerprints and verification for the more edits of longer lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common as C

#: The words that a line must have to be compared at all.
LEAST_WORDS = 5
#: A line of n words is compared within n // WORDS_AN_EDIT edits, one at least; from LONG words on these are two or more.
WORDS_AN_EDIT = 20
LONG = 2 * WORDS_AN_EDIT
#: The fewest words of a line that one of LONG words or more may be close to.
PARTNER = LONG - LONG // WORDS_AN_EDIT
#: Words in a gram and grams in a window, whose least hash is a fingerprint. k = n // 20 edits part a line's n - k or more
#: unedited words into k + 1 runs, so that one has 13 words or more: the GRAM + WINDOW - 1 words of a whole window.
GRAM, WINDOW = 5, 9
#: Shares of the lines, and of their fingerprints, that are shuffled one after another.
TURNS = 2
#: Words whose running hashes are chained in one go.
CHAIN = 512
#: Signs that stand for words where lines are verified: SIGNS characters beyond the first plane, by two hashes.
SIGNS, FIRST_SIGN = 1 << 20, 1 << 16


def normal(text: Column) -> Column:
    """text with one space between words and none at the ends of lines; most texts are so already and are only looked through."""
    odd = [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r", " \n", "\n ")]
    odd = reduce(lambda a, b: a | b, [*odd, F.startswith(text, F.lit(" ")), F.endswith(text, F.lit(" "))])
    return F.when(odd, F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), " ?\n ?", "\n"))).otherwise(text)


def running_hashes(ws: Column) -> Column:
    """Hashes of the first 0, 1, ... all words: chained inside blocks of CHAIN words, each block begun from a chain over the blocks before."""
    last = lambda a: F.element_at(a, -1)
    seed = F.array(F.lit(42).cast("long"))

    def joined(blocks: Column) -> Column:
        begins = F.aggregate(blocks, seed, lambda a, b: F.array_append(a, F.xxhash64(last(a), b)))

        def chained(begin: Column) -> Column:
            inside = lambda b, k: F.aggregate(b, F.array(begin[k]), lambda a, w: F.array_append(a, F.xxhash64(last(a), w)))
            # a full block's last hash is the next block's first
            whole = F.flatten(F.transform(blocks, lambda b, k: F.when(F.size(b) == CHAIN, F.slice(inside(b, k), 1, CHAIN)).otherwise(inside(b, k))))
            return F.when(F.size(last(blocks)) == CHAIN, F.array_append(whole, last(begin))).otherwise(whole)

        return C.let(begins, chained)

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / CHAIN).cast("int")), lambda b: F.slice(ws, b * CHAIN + 1, CHAIN))
    return F.when(F.size(ws) == 0, seed).otherwise(C.let(cut, joined))


def half_keys(line: Column, n: Column) -> Column:
    """Hashes of the front and back half of a line of n words, as of one that is compared with lines of its length or one more (0, 1) and of one less (2, 3).

    An edit of one word leaves the front or the back half alone, so lines that are one edit apart share a key of the same side."""

    def side(front: bool, of: Column) -> Column:
        m = (F.floor(of / 2) if front else F.ceil(of / 2)).cast("int")
        return F.xxhash64(F.lit(front), m, F.call_function("substring_index", line, F.lit(" "), m if front else -m))

    return F.array(side(True, n), side(False, n), side(True, n - 1), side(False, n - 1))


def fingerprints(words: Column) -> Column:
    """The distinct least hashes of all windows of WINDOW grams; words are GRAM + WINDOW - 1 or more."""
    spans = lambda a, of, work: F.transform(F.sequence(F.lit(0), F.size(a) - of), lambda i: work(*[a[i + j] for j in range(of)]))
    grams = lambda h: spans(h, GRAM, F.xxhash64)
    return F.array_distinct(C.let(C.let(F.transform(words, lambda w: F.xxhash64(w)), grams), lambda g: spans(g, WINDOW, F.least)))


def _occurrences(docs: DataFrame, least: int) -> DataFrame:
    """A row for each line with least words or more: its place (doc, text hash, line), two hashes of its words, its half keys if it has LEAST_WORDS words to less than LONG, and its fingerprints if it has PARTNER words or more."""
    lines = docs.select("doc", "rev", F.posexplode(F.split(normal(F.col("text")), "\n")).alias("line", "raw")).where("raw != ''")
    raw, n = F.col("raw"), F.col("n")
    counted = lines.withColumn("n", (F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit(" "))) + 1).cast("int")).where(n >= least)
    keys = F.when(n.between(LEAST_WORDS, LONG - 1), half_keys(raw, n)).alias("keys")
    return counted.select("doc", "rev", "line", F.xxhash64(raw).alias("h1"), F.xxhash64(F.lit(7), raw).alias("h2"), keys, F.when(n >= PARTNER, fingerprints(F.split(raw, " "))).alias("prints"))


def _cut(j: Column | int, n: Column) -> Column:
    return F.floor(j * n / 4).cast("int")


def _quarters(hashed: DataFrame) -> DataFrame:
    """(h1, mask): in which quarter an edit may lie that makes a line of another one, and of which kind it is.

    Lines that agree but for one quarter, as cut in a line of their length, or of one word less for the longer of two, share
    a key of it. Bits 0 to 3: another line of that length shares it; 4 to 7: one that is longer by a word; 8 to 11: one that is shorter."""
    n = F.col("n")
    key = lambda j, p: F.xxhash64(F.lit(j), p, F.col("front")[_cut(j, p)], F.col("back")[p - _cut(j + 1, p)])
    each = hashed.select("h1", F.posexplode(F.array(*[key(j, n) for j in range(4)], *[key(j, n - 1) for j in range(4)])).alias("code", "key"))
    kinds = each.groupBy("key").agg(F.count_if(F.col("code") < 4).alias("own"), F.count_if(F.col("code") >= 4).alias("longer")).where("own > 1 or own > 0 and longer > 0")
    bits = F.expr("case when code >= 4 then shiftleft(1, code + 4) else if(own > 1, shiftleft(1, code), 0) | if(longer > 0, shiftleft(1, code + 4), 0) end")
    return each.join(kinds, "key").groupBy("h1").agg(F.bit_or(bits).alias("mask"))


def _variants(hashed: DataFrame) -> DataFrame:
    """(key, role, at, place): all that a line is with one word less or changed, as hashed keys, where it may have a neighbour (mask).

    Lines of one length that agree but for word at share a key of role s. A line as it stands (role w), parted at a place,
    shares a key with one that has one word more at that place (role d)."""
    codes = F.filter(F.array(*[F.lit(i) for i in range(12)]), lambda i: F.getbit("mask", i) == 1)
    each = hashed.select("place", "n", "front", "back", F.explode(codes).alias("code"))
    j, same, whole, p = F.pmod("code", F.lit(4)), F.col("code") < 4, F.col("code").between(4, 7), F.when(F.col("code") >= 8, F.col("n") - 1).otherwise(F.col("n"))
    ranged = each.withColumns({"lo": _cut(j, p), "hi": _cut(j + 1, p) - same.cast("int"), "rest": F.col("n") - F.when(whole, 0).otherwise(1)}).where("hi >= lo")
    role = F.when(same, "s").when(whole, "w").otherwise("d")
    variant = lambda i: F.struct(i.alias("at"), F.xxhash64(F.when(same, "s").otherwise("d"), i, F.col("front")[i], F.col("back")[F.col("rest") - i]).alias("key"))
    return ranged.select("place", role.alias("role"), F.explode(F.transform(F.sequence("lo", "hi"), variant)).alias("v")).select("v.key", "role", "v.at", "place")


def _without(words: Column, at: Column) -> Column:
    return F.concat(F.slice(words, 1, at), F.slice(words, at + 2, F.size(words)))


def _with_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc, rev, line, ...) with the words of each line. Texts are parted where they are read, and only lines that a bitmap lets by are shuffled, not texts."""
    rest = [c for c in wanted.columns if c not in ("doc", "rev", "line")]
    lines = docs.select("doc", "rev", F.posexplode(F.split(normal(F.col("text")), "\n")).alias("line", "raw")).where("raw != ''")
    asked = wanted.select(F.col("doc").alias("_doc"), F.col("rev").alias("_rev"), F.col("line").alias("_line"), *rest)
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("rev") == F.col("_rev")) & (F.col("line") == F.col("_line"))
    found = C.marked(lines, wanted, ["doc", "rev", "line"]).where("_maybe").join(asked, same)
    return found.select("doc", "rev", "line", *rest, F.split("raw", " ").alias("words"))


def signs(words: Column, seed: int) -> Column:
    """A string with one sign for each word, so that edits of signs are edits of words. Different words share a sign once in a million; two seeds make that one in 10 ** 12."""
    code = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(F.lit(seed), w), F.lit(SIGNS)) + FIRST_SIGN), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-32")


def parities(words: Column) -> Column:
    """64 bits, each the parity of the words that a hash gives it; an edit turns two at most."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(bit(w)))


def _verified(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h1, h2) of the pairs (place, partner, most) whose lines are within most edits. lines: place, h1, h2, raw."""
    pairs = C.staged(pairs.distinct(), "line-pairs")
    asked = pairs.select("place").unionAll(pairs.select(F.col("partner").alias("place")))
    words = F.split("raw", " ")
    signed = C.staged(C.marked(lines, asked, ["place"]).where("_maybe").select("place", "h1", "h2", signs(words, 1).alias("a"), signs(words, 2).alias("b")), "line-signs")
    mine = pairs.join(signed, "place")
    both = mine.join(signed.select(F.col("place").alias("partner"), F.col("a").alias("_a"), F.col("b").alias("_b")), "partner")
    near = lambda x, y: F.call_function("levenshtein", F.col(x), F.col(y), F.col("most")) >= 0
    out = C.staged(both.where(near("a", "_a") & near("b", "_b")).select("h1", "h2").distinct(), "line-close")
    C.drop_staged(pairs, signed)
    return out


def _in_turns(work: Callable[[Column], DataFrame], by: str, name: str) -> DataFrame:
    """work() for each of TURNS shares of the rows, as a condition on the hash by, all written down: of shuffle files only one share's are there at a time."""
    parts = []
    for turn in range(TURNS):
        parts.append(C.staged(work(F.pmod(by, F.lit(TURNS)) == turn), name))
        C.let_go(parts[-1].sparkSession)
    return reduce(DataFrame.unionAll, parts)


def _shared_prints(distinct: DataFrame) -> DataFrame:
    """(h1, print) of the fingerprints that two lines or more have, written down."""
    each = distinct.where("prints is not null").select("h1", F.explode("prints").alias("print"))
    along = Window.partitionBy("print").orderBy("h1")

    def shared(own: Column) -> DataFrame:
        beside = each.where(own).withColumns({"_before": F.lag("h1").over(along), "_after": F.lead("h1").over(along)})
        return beside.where("_before is not null or _after is not null").select("h1", "print")

    return _in_turns(shared, "print", "line-prints")


def _long_edited(docs: DataFrame, distinct: DataFrame, shared: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that are within n // WORDS_AN_EDIT edits of an earlier one, n (LONG or more) the words of the longer of both.

    Close lines share a fingerprint. Each line is verified against the earliest of each of its fingerprints, and only lines
    that none of these settles against all earlier ones that share a fingerprint and whose length and parities allow it."""
    asked = distinct.where("printed").join(shared.select("h1").distinct(), "h1", "left_semi").select("h1", "h2", "place.*")
    words = F.col("words")
    lines = _with_words(docs, asked).select("h1", "h2", F.struct("doc", "rev", "line").alias("place"), F.size(words).alias("n"), parities(words).alias("odd"), F.array_join(words, " ").alias("raw"))
    lines = C.staged(lines, "line-long")
    C.let_go(docs.sparkSession)
    rows = C.staged(shared.join(lines.select("h1", "h2", "place", "n", "odd"), "h1"), "line-printed")
    longer = F.greatest("n", "b.n")
    most = F.floor(longer / WORDS_AN_EDIT).cast("int")
    apart = F.abs(F.col("n") - F.col("b.n"))
    turned = F.bit_count(F.col("odd").bitwiseXOR(F.col("b.odd")))
    close = (F.col("b.place") < F.col("place")) & (longer >= LONG) & (apart <= most) & (turned <= 2 * most - apart)

    def pairs(of: DataFrame, others: DataFrame) -> DataFrame:
        return of.join(others, "print").where(close).select("place", F.col("b.place").alias("partner"), most.alias("most"))

    other = F.struct("place", "n", "odd")
    first = _verified(lines, pairs(rows, rows.groupBy("print").agg(F.min(other).alias("b"))))
    C.let_go(docs.sparkSession)
    rest = _verified(lines, pairs(rows.join(first, ["h1", "h2"], "left_anti"), rows.select("print", other.alias("b"))))
    C.drop_staged(shared, lines, rows)
    C.let_go(docs.sparkSession)
    return first.unionAll(rest)


def dropped_lines(docs: DataFrame, short_repeats: bool = False) -> DataFrame:
    """(doc, rev, line) of every line that goes, written down. docs: doc, rev (hash of the text), text without nulls."""
    full = C.staged(_occurrences(docs, 1 if short_repeats else LEAST_WORDS), "line-full")
    place = F.struct("doc", "rev", "line")
    once = [F.min(place).alias("place"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("prints").alias("prints")]
    whole = _in_turns(lambda own: full.where(own).groupBy("h1", "h2").agg(*once), "h1", "line-distinct")
    seen = C.staged(full.drop("keys", "prints"), "line-seen")  # most of the bytes aren't asked for again
    C.drop_staged(full)
    C.let_go(docs.sparkSession)
    # lines that share no half with another one have no neighbour
    halves = whole.select("h1", F.explode("keys").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("half")
    sides = halves.join(shared, "half", "left_semi").select("h1").distinct()
    near = C.staged(whole.select("h1", "h2", "place.*").join(sides, "h1", "left_semi"), "line-near")
    C.let_go(docs.sparkSession)
    prints = _shared_prints(whole)
    distinct = C.staged(whole.select("h1", "h2", "place", "n", F.col("prints").isNotNull().alias("printed")), "line-places")
    C.drop_staged(whole)
    found = C.staged(_with_words(docs, near).select("h1", "h2", place.alias("place"), "words"), "line-words")
    C.let_go(docs.sparkSession)
    hashed = found.select("h1", "place", F.size("words").alias("n"), running_hashes(F.col("words")).alias("front"), running_hashes(F.reverse("words")).alias("back"))  # back[k]: of the last k words
    hashed = C.staged(hashed.join(_quarters(hashed), "h1"), "line-hashed")
    C.let_go(docs.sparkSession)
    slim = _variants(hashed)
    least = lambda role: F.min(F.when(F.col("role") != role, F.col("place")))
    firsts = slim.groupBy("key").agg(least("d").alias("whole"), least("w").alias("longer"), F.count("*").alias("c")).where("c > 1 and whole is not null and longer is not null").drop("c")
    partner = F.when(F.col("role") == "w", F.col("longer")).otherwise(F.col("whole"))
    pairs = slim.join(firsts, "key").withColumn("partner", partner).where(F.col("partner") < F.col("place")).select("place", "role", "at", "partner").distinct()
    other_words = found.select(F.col("place").alias("_place"), F.col("words").alias("_words"))
    both = pairs.join(found.select("place", "h1", "h2", "words"), "place").join(other_words, F.col("partner") == F.col("_place"))
    mine, other, at = F.col("words"), F.col("_words"), F.col("at")
    same = F.when(F.col("role") == "s", (F.size(mine) == F.size(other)) & (_without(mine, at) == _without(other, at))).when(F.col("role") == "w", mine == _without(other, at)).otherwise(_without(mine, at) == other)
    short = C.staged(both.where(same).select("h1", "h2").distinct(), "line-edited")
    C.drop_staged(near, found, hashed)
    C.let_go(docs.sparkSession)
    long = _long_edited(docs, distinct, prints)
    edited = short.unionAll(long).distinct().withColumn("edited", F.lit(True))
    table = distinct.select("h1", "h2", "place", "n").join(edited, ["h1", "h2"], "left").select(F.struct("h1", "h2").alias("hash"), "n", F.col("place").alias("first"), F.coalesce("edited", F.lit(False)).alias("edited"))
    # a line that stands nowhere else and is close to none stays without being looked up
    table = C.staged(table.where("n > 1 or edited"), "line-table")
    rows = seen.select("doc", "rev", "line", F.struct("h1", "h2").alias("hash"))
    told = C.lookup(rows, table, "hash", ["first", "edited"], "n", F.struct("doc", "rev", "line"))
    gone = C.staged(told.where(F.col("edited") | (F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")))).select("doc", "rev", "line"), "line-dropped")
    C.drop_staged(seen, distinct, short, long, table)
    C.let_go(docs.sparkSession)
    return gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_repeats: bool = False) -> DataFrame:
    """docs with text_col less the dropped lines, and n_lines and n_dropped.

    Lines end at \\n and count as their words [^\\x20\\x09-\\x0D]+. A line of LEAST_WORDS words or more goes if a line that
    comes before it, by document id (null first), hash of the text and place in the text, has the same words or is one
    word edit away (one word changed, more or less), or n // WORDS_AN_EDIT edits where the longer of both has n words and
    these are more. Shorter lines stay, but with short_repeats those of one word or more go if one that comes before has the
    same words. A line goes for an earlier one that went
    itself. Null and empty texts stay as they are; rows of equal id and text are one document and come out alike; an empty
    table gives no rows; columns named n_lines or n_dropped are replaced.

    Of lines with less than LONG words, those that share no half with another can't have a neighbour and are left out
    first; all others emit the variants within one edit as hashed keys. Groups of equal keys are only ever reduced to their
    earliest line, so a large group costs a row a line; each line is verified against that one. Longer lines meet on shared
    fingerprints: see _long_edited."""
    rows = docs.drop("n_lines", "n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = rows.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("rev"), F.struct(*[F.col(c) for c in rows.columns]).alias("row"))
    slim = keyed.where(F.col("row")[text_col].isNotNull()).select("doc", "rev", F.col("row")[text_col].alias("text"))
    dropped = dropped_lines(slim, short_repeats)
    gone = dropped.groupBy(F.col("doc").alias("_doc"), F.col("rev").alias("_rev")).agg(F.array_sort(F.collect_set("line")).alias("gone"))
    gone = C.staged(gone, "line-gone")
    C.drop_staged(dropped)
    C.let_go(docs.sparkSession)
    told = C.marked(keyed, gone.select(F.col("_doc").alias("doc"), F.col("_rev").alias("rev")), ["doc", "rev"])
    some = told.where("_maybe").join(gone, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("rev") == F.col("_rev")), "left").select("row", "gone")
    out = some.unionAll(told.where("not _maybe").select("row", F.lit(None).cast("array<int>").alias("gone")))  # nothing of these goes: they aren't shuffled
    own = F.col("row")[text_col]
    lines = F.split(own, "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n")
    kept = F.when(F.col("gone").isNull(), own).otherwise(left)
    n_lines = F.when(own.isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return out.select(*[(kept if c == text_col else F.col("row")[c]).alias(c) for c in rows.columns], n_lines.alias("n_lines"), n_gone.alias("n_dropped"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup() of all documents, repeats of short lines included, with a digest of what is left."""
    done = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), short_repeats=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


QUERIES = {"op4_lines": op4_lines}
SQL: dict[str, str] = {}
