"""Quality rules by distribution divergence, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common as C

#: Symbols that count as such (fixed values).
SYMBOLS = "[#*$%&|<>]"
#: What a word is, and what parts the words of the lower-cased text that histograms count: white space and common punctuation.
WORD, PARTED = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D.,;:!?'\"()]+"
#: Character classes that are counted, blanks with the white space; bytes beyond a character's first are one more, and the other
#: characters the last. PLAIN has the characters that none of them has, and blanks: most of a text, taken out before counting.
PLAIN = "[a-z ]+"
CLASSES = ("[A-Z]", "[0-9]", r"[\x09-\x0D]", "[.,;:!?'\"()-]", r"[#*$%&|<>/@_=+~^\\{}\[\]`]")
SPACES_AT, N_CLASSES = 2, len(CLASSES) + 2
#: Most common words of each language that a histogram tells apart.
COMMON = 64
#: Largest Jensen-Shannon distance (base 2) from the nearest language: of character classes, of common words. A short text's
#: word histogram strays by chance, so NOISE over the root of its words is added to the limit.
CLASS_LIMIT, WORD_LIMIT, NOISE = 0.28, 0.45, 0.6
#: A histogram counts from so many characters or words; shorter texts pass by the other rules.
LEAST_CHARS, LEAST_WORDS = 100, 40


#: Documents, and share of all that have a language, that a language must have for a reference of its own: at most 1000 have one.
LEAST_DOCS, LEAST_SHARE = 5, 1e-3


def text_words(text: Column) -> Column:
    """The matches of WORD; texts with single blanks and line ends between words are parted at these."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    odd = reduce(lambda a, b: a | b, [F.contains(flat, F.lit(x)) for x in ("  ", *C.SPACES)]) | F.startswith(flat, F.lit(" ")) | F.endswith(flat, F.lit(" ")) | (text == "")
    return F.when(odd, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).otherwise(F.split(flat, " "))


def repeat_words(ws: Column, k: int = 5) -> Column:
    """Words in k-word windows that occur twice or more. Windows are hashed; where a hash set finds any twice, they are sorted
    with their places, and the places of equal neighbours are covered."""

    def covered(places: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda i: F.least(F.lit(k), places[i] - places[i - 1]))
        return k + F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def places(sorted_: Column) -> Column:
        n = F.size(sorted_)
        same = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: ((i > 0) & (sorted_[F.greatest(i - 1, F.lit(0))]["h"] == sorted_[i]["h"])) | ((i < n - 1) & (sorted_[F.least(i + 1, n - 1)]["h"] == sorted_[i]["h"])),
        )
        return F.array_sort(F.transform(same, lambda i: sorted_[i]["p"]))

    def repeated(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(C.let(C.let(placed, places), covered))

    def hashed(w: Column) -> Column:
        windows = F.transform(F.slice(w, F.lit(1), F.size(w) - k + 1), lambda x, i: F.xxhash64(x, *[w[i + j] for j in range(1, k)]))
        return F.when(F.size(w) <= k, 0).otherwise(C.let(windows, repeated))

    return C.let(F.transform(ws, lambda w: F.xxhash64(w)), hashed).cast("long")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return C.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _free(name: str, columns: list[str]) -> str:
    """name, made longer until none of columns has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def characters(text: Column) -> Column:
    """(classes, symbols): characters of each of CLASSES, bytes beyond the first of a character, and all other characters; and SYMBOLS."""
    blanks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" ")))
    beyond = F.octet_length(text) - F.length(text)

    def counted(rest: Column) -> Column:
        by = [F.regexp_count(rest, F.lit(c)) for c in CLASSES]
        by[SPACES_AT] = by[SPACES_AT] + blanks
        return F.struct(F.array(*by, beyond).alias("c"), F.regexp_count(rest, F.lit(SYMBOLS)).cast("long").alias("symbols"))

    whole = lambda x: F.concat(x["c"], F.array(F.length(text) - reduce(lambda a, b: a + b, [x["c"][i] for i in range(len(CLASSES))]))).cast("array<double>")
    return C.let(C.let(F.regexp_replace(text, PLAIN, ""), counted), lambda x: F.struct(whole(x).alias("classes"), x["symbols"].alias("symbols")))


def _measured(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """docs with the columns of base_stats, and with the text's class counts in a column of the name returned."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, chars = _free("_words", docs.columns), _free("_chars", docs.columns)
    of_words = C.let(text_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeat")))
    out = docs.withColumns({words: of_words, chars: characters(text)}).select(
        *docs.columns,
        F.col(words)["n"].alias("n_words"),
        (F.length(text) - F.col(chars)["classes"][SPACES_AT]).cast("long").alias("word_chars"),
        F.col(chars)["symbols"].alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
        F.col(words)["repeat"].alias("n_repeat_words"),
        F.col(chars)["classes"].alias(chars),
    )
    return out, chars


def base_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (a null text counts as empty)."""
    out, chars = _measured(docs, text_col)
    return out.drop(chars)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[dict[str, list[float]], dict[str, dict[str, float]]]:
    """Of each language over all documents: the shares of its character classes, and of its COMMON most common words among all its words.

    Rows without a language are left out, and languages that fewer than LEAST_DOCS documents or LEAST_SHARE of all have: an
    odd document isn't its own reference. The driver holds N_CLASSES and COMMON numbers a language, of at most 1000."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.select("lang", characters(F.col("text"))["classes"].alias("c"))
    summed = counts.groupBy("lang").agg(F.count("*").alias("docs"), *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(N_CLASSES)])
    summed = C.staged(summed, "quality-classes")  # a row a language
    least = max(LEAST_DOCS, LEAST_SHARE * (summed.agg(F.sum("docs")).first()[0] or 0))
    classes = summed.where(F.col("docs") >= least).drop("docs").collect()
    C.drop_staged(summed)
    each = known.where(F.col("lang").isin([r["lang"] for r in classes])).select("lang", F.explode(F.split(F.lower("text"), PARTED)).alias("w")).where("w != ''")
    tally = each.groupBy("lang", "w").agg(F.count("*").alias("n"))
    top = tally.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= COMMON)
    sums = tally.groupBy("lang").agg(F.sum("n").alias("all"))
    by_class = {r["lang"]: [r[f"c{i}"] / total for i in range(N_CLASSES)] for r in classes if (total := sum(r[1:]))}
    by_word: dict[str, dict[str, float]] = {}
    for r in top.join(sums, "lang").collect():
        by_word.setdefault(r["lang"], {})[r["w"]] = r["n"] / r["all"]
    return by_class, by_word


def _half_divergence(p: Column, q: Column) -> Column:
    """The share of one bucket in the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def class_distance(counts: Column, refs: dict[str, list[float]]) -> Column:
    """The Jensen-Shannon distance of class counts from the nearest language's; null without references or below LEAST_CHARS."""
    if not refs:
        return F.lit(None).cast("double")

    def nearest(c: Column) -> Column:
        n = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        one = [F.sqrt(F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, [_half_divergence(c[i] / n, F.lit(float(q))) for i, q in enumerate(ref)]))) for _, ref in sorted(refs.items())]
        return F.when(n >= LEAST_CHARS, F.array_min(F.array(*one)))

    return C.let(counts, nearest)


def _slots(vocabulary: list[str]) -> tuple[int, list[int]]:
    """A modulus under which the words' XXH64 hashes (as Spark makes them) differ, and by remainder the word's place plus 1, or 0."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in vocabulary]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    m = max(16, 16 * len(vocabulary)) | 1
    while len({h % m for h in signed}) < len(signed):
        m += 2
    slots = [0] * m
    for i, h in enumerate(signed):
        slots[h % m] = i + 1
    return m, slots


def _runs(ids: Column) -> Column:
    """(i, c): the values of a sorted array and how often each occurs."""
    last = F.size(ids) - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (ids[i] != ids[F.least(i + 1, last)]))

    def counted(e: Column) -> Column:
        before = lambda j: F.when(j > 0, e[F.greatest(j - 1, F.lit(0))]).otherwise(-1)
        return F.transform(F.sequence(F.lit(0), F.size(e) - 1), lambda j: F.struct(ids[e[j]].alias("i"), (e[j] - before(j)).cast("double").alias("c")))

    return F.when(F.size(ids) == 0, F.array().cast("array<struct<i:int,c:double>>")).otherwise(C.let(ends, counted))


def _numbers(values: list, kind: str) -> Column:
    """A literal array, as one string that the optimizer folds."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _distance(counted: Column, n: Column, q: Column, mass: float) -> Column:
    """The Jensen-Shannon distance of counts (i, c) among n words from shares q that sum to mass; all other words are one bucket."""
    total = lambda of: F.aggregate(own, F.lit(0.0), lambda a, x: a + of(x))
    own = F.filter(counted, lambda x: q[x["i"]] > 0)
    seen = total(lambda x: _half_divergence(x["c"] / n, q[x["i"]]))
    unseen = (F.lit(mass) - total(lambda x: q[x["i"]])) / 2  # a bucket that the text lacks: half of q log2(q / (q / 2))
    rest = _half_divergence(F.greatest(F.lit(0.0), 1 - total(lambda x: x["c"] / n)), F.lit(max(0.0, 1 - mass)))
    return F.sqrt(F.greatest(F.lit(0.0), seen + unseen + rest))


def word_distance(ws: Column, refs: dict[str, dict[str, float]]) -> Column:
    """The Jensen-Shannon distance of the text's common-word histogram from the nearest language's; null below LEAST_WORDS.

    A histogram has one bucket for each common word of the language and one for all other words. Other words are sifted out by a
    set of the common ones; a common word's bucket is looked up by its hash in a literal array, and the buckets found are
    sorted and counted by runs."""
    if not refs:
        return F.lit(None).cast("double")
    vocabulary = sorted({w for ref in refs.values() for w in ref})
    m, slots = _slots(vocabulary)
    slot = _numbers(slots, "int")

    def bucket(w: Column) -> Column:
        """The place of a common word: no two of them have one slot."""
        return slot[F.pmod(F.xxhash64(w), F.lit(m)).cast("int")] - 1

    def nearest(n: Column) -> Callable[[Column], Column]:
        each = [(_numbers([float(ref.get(w, 0.0)) for w in vocabulary], "double"), sum(ref.values())) for _, ref in sorted(refs.items())]
        return lambda counted: F.array_min(F.array(*[_distance(counted, n, q, mass) for q, mass in each]))

    def of_words(w: Column) -> Column:
        ids = F.sort_array(F.transform(F.filter(w, lambda x: x.isin(*vocabulary)), bucket))
        return F.when(F.size(w) >= LEAST_WORDS, C.let(C.let(ids, _runs), nearest(F.size(w).cast("double"))))

    return C.let(ws, of_words)


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with base_stats, base_failed, class_distance, word_distance and kept.

    kept is false where base_failed (fewer than 10 words, or over 20 in 100 words in repeated five-word windows), or where
    a histogram that is long enough to count lies further from every language's than its limit. Null texts are empty and
    fail. Whatever a document's language, known, rare or null, the nearest reference counts; without any no distance does.
    An empty table gives no rows; columns of docs with the added names are replaced."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    by_class, by_word = references(docs, text_col, lang_col)
    stats, chars = _measured(docs.drop(*added), text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = stats.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "class_distance": class_distance(F.col(chars), by_class),
            "word_distance": word_distance(F.split(F.lower(text), PARTED), by_word),
        }
    ).drop(chars)
    far = (F.coalesce("class_distance", F.lit(0.0)) > CLASS_LIMIT) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_LIMIT + NOISE / F.sqrt(F.greatest("n_words", F.lit(1))))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all documents."""
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
