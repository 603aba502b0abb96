"""Places of rows in an order, where one key may have most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.scratch import drop_staged, staged


def numbered(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows, written, with place: from 0 among the rows of one key, by order; rows equal in it come in no told order.

    Rows are parted by ranges of key and order and sorted inside, so a large key lies in many parts; a row's place is that in
    its part plus the key's rows in the parts before, which are counted: a number for each key and part. Nulls come first."""
    by = [*key, *order]
    parts = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    held = staged(parts, "ordered")
    counts = held.groupBy(*[F.col(c).alias(f"_{c}") for c in key], F.col("_part").alias("_own")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*[f"_{c}" for c in key]).orderBy("_own").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.withColumn("_shift", F.coalesce(before, F.lit(0)) - F.col("_first")).drop("_n", "_first")
    same = F.col("_part") == F.col("_own")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = staged(held.join(shifts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place")), "numbered")
    drop_staged(held)
    return out
