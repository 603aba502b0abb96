"""Tables that change as a whole: data is written first, and one small file that names it switches readers over."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Snapshot:
    """One version: of each table the folders that hold it, below root, and facts about them."""

    root: str
    number: int
    tables: dict[str, list[str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)

    def table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """The rows of all folders of a table, each partitioned for itself; none without a folder."""
        parts = [spark.read.schema(schema).parquet(f"{self.root}/{f}") for f in self.tables.get(name, [])]
        return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder and all in it, if it is there."""
    fs, at = _file_system(spark, path)
    fs.delete(at(path), True)


def stage(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = ()) -> str:
    """Writes df below root, where no reader looks until a commit names it, and gives its folder."""
    folder = f"data/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(f"{root}/{folder}")
    return folder


def latest(spark: SparkSession, root: str) -> Snapshot:
    """The version with the highest number; an empty one, numbered 0, where nothing was committed."""
    fs, at = _file_system(spark, root)
    versions = at(f"{root}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(versions)] if fs.exists(versions) else []
    numbers = sorted(int(n) for n in names if n.isdigit())
    if not numbers:
        return Snapshot(root, 0)
    text = "".join(r["value"] for r in spark.read.text(f"{root}/versions/{numbers[-1]:012d}", wholetext=True).collect())  # one small file
    found = json.loads(text)
    return Snapshot(root, numbers[-1], found["tables"], found["facts"])


def commit(spark: SparkSession, before: Snapshot, tables: dict[str, list[str]], facts: dict) -> Snapshot:
    """Makes the version after `before`, of the given folders; a Conflict if there is one already. A crash before the last step leaves `before` as it is."""
    fs, at = _file_system(spark, before.root)
    number = before.number + 1
    made, final = at(f"{before.root}/versions/.{uuid.uuid4().hex}"), at(f"{before.root}/versions/{number:012d}")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps({"tables": tables, "facts": facts}), "utf-8"))
    out.close()
    if fs.exists(final) or not fs.rename(made, final):
        fs.delete(made, False)
        raise Conflict(f"version {number} of {before.root} is there already")
    return Snapshot(before.root, number, tables, facts)


def vacuum(spark: SparkSession, root: str) -> int:
    """Removes the folders below root that the latest version doesn't name, and older versions; gives the number of folders. Not while others write or read older versions."""
    now = latest(spark, root)
    fs, at = _file_system(spark, root)
    kept = {f for folders in now.tables.values() for f in folders}
    gone = 0
    if fs.exists(at(f"{root}/data")):
        for f in fs.listStatus(at(f"{root}/data")):
            if f"data/{f.getPath().getName()}" not in kept:
                fs.delete(f.getPath(), True)
                gone += 1
    if fs.exists(at(f"{root}/versions")):
        for f in fs.listStatus(at(f"{root}/versions")):
            if f.getPath().getName().isdigit() and int(f.getPath().getName()) < now.number:
                fs.delete(f.getPath(), False)
    return gone
