"""What a client does with results: filters, formats, trees; and set metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordering import numbered
from lodestone.sources.scratch import checkpointed


def category(kind: Column) -> Column:
    out = F.upper(F.trim(F.regexp_replace(F.coalesce(kind, F.lit("")), "[_-]+", " ")))
    return F.when(out == "", "OTHER").otherwise(out)


def categories(docs: DataFrame, kind_col: str = "document_type") -> DataFrame:
    return docs.select(category(F.col(kind_col)).alias("category")).distinct().orderBy("category")


def search(docs: DataFrame, needle: str, name_col: str, kind_col: str, only: str | None = None) -> DataFrame:
    """Rows whose name or type holds needle, whatever the case, of one category if given."""
    low = F.lit(needle.strip().lower())
    out = docs.where(F.contains(F.lower(name_col), low) | F.contains(F.lower(kind_col), low))
    return out.where(category(F.col(kind_col)) == only) if only else out


def size_text(n: Column) -> Column:
    unit = lambda power, name: F.concat(F.round(n / 1024.0**power, 1).cast("string"), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def extension(name: Column) -> Column:
    last = F.substring_index(name, ".", -1)
    return F.when(F.contains(name, F.lit(".")) & (last != ""), F.upper(F.substring(last, 1, 4))).otherwise("?")


def date_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM dd, yyyy"), F.lit("—"))


def severity(level: Column) -> Column:
    low = F.lower(level)
    return F.when(low.isin("critical", "high"), "critical").when(low.isin("medium", "moderate"), "medium").otherwise("low")


def initials(name: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.slice(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def percent(x: Column) -> Column:
    return F.concat(F.round(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def size_bytes(metadata: Column) -> Column:
    """A document's size from its JSON metadata: a whole number, 0 on failure, never negative."""
    return F.greatest(F.lit(0), F.coalesce(F.get_json_object(metadata, "$.size_bytes").try_cast("bigint"), F.lit(0)))


def sorted_results(rows: DataFrame, by: str = "risk", bucket: str | None = None, kind: str | None = None) -> DataFrame:
    """Impact rows of a severity bucket and an entity type, by risk, relevance or proximity."""
    if bucket:
        rows = rows.where(severity(F.col("level")) == bucket)
    if kind:
        rows = rows.where(F.col("entity_type") == kind)
    order = {"risk": [F.desc("score"), "id"], "relevance": [F.desc("semantic"), "id"], "proximity": ["distance", F.desc("score"), "id"]}[by]
    return rows.orderBy(*order)


#: The client's grid: where the first node stands and how far levels and nodes are apart (fixed values).
GRID_X, GRID_Y, STEP_X, STEP_Y = 420, 70, 390, 205


def cascade(rows: DataFrame) -> DataFrame:
    """(id, parent, x, y) of results (id, name, distance, path, score).

    parent is the last node of a row's path before its end that is another result, by id or else by name whatever its
    case; else the only result one step nearer; else null, the root. Nodes stand by level, in the order of their scores.
    Results are a request's list: levels are a few, and names that several results share count for the greatest id."""
    rows = checkpointed(rows.select("id", "name", "distance", "path", "score"))
    ids = rows.select(F.col("id").alias("_id")).distinct()
    names = rows.groupBy(F.lower(F.trim("name")).alias("_name")).agg(F.max("id").alias("_named"))
    before = F.filter(F.transform("path", lambda p: F.trim(p)), lambda p: p != "")
    steps = rows.select("id", F.posexplode(F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0)))).alias("at", "node"))
    found = steps.join(ids, F.col("node") == F.col("_id"), "left").join(names, F.lower("node") == F.col("_name"), "left").withColumn("hit", F.coalesce("_id", "_named"))
    on_path = found.where("hit is not null and hit != id").groupBy("id").agg(F.max(F.struct("at", "hit"))["hit"].alias("by_path"))
    lone = rows.groupBy("distance").agg(F.count("*").alias("n"), F.min("id").alias("only")).where("n = 1").select((F.col("distance") + 1).alias("distance"), "only")
    # a level may have most of the rows, so places come from ranges
    levels = numbered(rows.select("id", "distance", F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("_down")), ["distance"], ["_down", "id"])
    placed = levels.select("id", "distance", (GRID_X + STEP_X * F.col("distance")).alias("x"), (GRID_Y + STEP_Y * F.col("place")).cast("int").alias("y"))
    return placed.join(on_path, "id", "left").join(lone, "distance", "left").select("id", F.coalesce("by_path", F.when(F.col("only") != F.col("id"), F.col("only"))).alias("parent"), "x", "y").distinct()


def set_metrics(predicted: DataFrame, gold: DataFrame, name_col: str = "name") -> DataFrame:
    """One row tp, fp, fn, precision, recall, f1 of two sets of names, compared in lower case with white space collapsed."""
    norm = F.lower(F.trim(F.regexp_replace(F.col(name_col), r"\s+", " ")))
    side = lambda df, flag: df.select(norm.alias("k")).where("k != ''").distinct().withColumn(flag, F.lit(1))
    both = side(predicted, "p").join(side(gold, "g"), "k", "full_outer")
    n = both.agg(F.count_if(F.expr("p = 1 and g = 1")).alias("tp"), F.count_if(F.expr("p = 1 and g is null")).alias("fp"), F.count_if(F.expr("g = 1 and p is null")).alias("fn"))
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})
