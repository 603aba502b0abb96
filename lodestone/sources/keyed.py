"""Tables with keys, references and cascades over versions of Parquet files.

Each table's rows lie in buckets by the hash of one of its columns. A change deletes and puts rows of any of the tables and is
made with one switch: only the buckets that it touches are written anew, and readers see all of it or nothing. Putting the
same rows again changes nothing, so a job that is run again after a crash does no harm."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import snapshots
from lodestone.sources.scratch import drop_staged, staged


class Broken(ValueError):
    """Rows whose keys aren't unique, or that refer to rows that aren't there."""


@dataclass(frozen=True)
class Table:
    """schema: columns and types; key: the columns that tell rows apart; by: the column whose hash gives the bucket; parents: for
    a column that refers to another table's only key column, that table."""

    schema: str
    key: tuple[str, ...]
    by: str
    parents: Mapping[str, str] = field(default_factory=dict)


class Tables:
    """Tables under root, a path that all executors share. tables: parents before those that refer to them."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Table], buckets: int = 64) -> None:
        self.spark, self.root, self.tables = spark, root, dict(tables)
        known: list[str] = []
        for name, t in self.tables.items():
            if not set(t.parents.values()) <= {*known, name}:
                raise ValueError(f"{name} comes before a table that it refers to")
            known.append(name)
        now = snapshots.latest(spark, root)
        self.buckets = now.facts.get("buckets", buckets)

    def read(self, name: str) -> DataFrame:
        """The rows of the latest version."""
        return self.change().current[name]

    def change(self) -> Change:
        """A change of what is there now."""
        return Change(self, snapshots.latest(self.spark, self.root))


class Change:
    """Deletions and rows to put, gathered until commit()."""

    def __init__(self, tables: Tables, now: snapshots.Snapshot) -> None:
        self.of, self.now, self.spark = tables, now, tables.spark
        self.current = {name: self._read(name) for name in tables.tables}
        self.touched: dict[str, set[int]] = {name: set() for name in tables.tables}
        self.scratch: list[DataFrame] = []

    def _read(self, name: str) -> DataFrame:
        t = self.of.tables[name]
        parts = []
        for folder, buckets in self.now.facts.get("parts", {}).get(name, []):
            part = self.spark.read.schema(f"{t.schema}, _bucket int").parquet(f"{self.now.root}/{folder}")
            parts.append(part.where(F.col("_bucket").isin(buckets)).drop("_bucket"))
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], t.schema)

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(self.of.tables[name].by)), F.lit(self.of.buckets)).cast("int")

    def _touch(self, name: str, rows: DataFrame) -> None:
        self.touched[name] |= {r["b"] for r in rows.select(self._bucket(name).alias("b")).distinct().collect()}  # a number for each bucket at most

    def _hold(self, rows: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
        self.scratch.append(staged(rows, f"keyed-{name}", rows_a_file))
        return self.scratch[-1]

    def delete(self, name: str, values: DataFrame) -> DataFrame:
        """Takes out the rows of name that agree with one of values in all its columns, and all that refer to them in other tables; gives the rows of name that go."""
        columns = values.columns
        own = self._hold(values.select(*columns).distinct(), "asked")
        gone = self._hold(self.current[name].join(own, columns, "left_semi"), "gone")
        if gone.isEmpty():
            return gone
        self._touch(name, gone)
        self.current[name] = self.current[name].join(own, columns, "left_anti")
        key = self.of.tables[name].key
        for child, t in self.of.tables.items():
            for column, parent in t.parents.items():
                if parent == name:
                    self.delete(child, gone.select(F.col(key[0]).alias(column)))
        return gone

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """Puts rows in, each in the place of the row with its key if there is one (what refers to that stays); gives them. Broken if a key is null or comes twice, or if a row refers to one that isn't there; null references are allowed."""
        t = self.of.tables[name]
        fresh = self._hold(rows.select(*[F.col(c) for c in self.current[name].columns]), "fresh")
        n, keys = fresh.agg(F.count("*"), F.count_distinct(*t.key)).first()
        if n != keys:
            raise Broken(f"{name}: {n} rows have {keys} keys")
        for column, parent in t.parents.items():
            ids = self.current[parent].select(F.col(self.of.tables[parent].key[0]).alias(column))
            if parent == name:
                ids = ids.unionAll(fresh.select(F.col(t.key[0]).alias(column)))
            if not fresh.where(F.col(column).isNotNull()).join(ids, column, "left_anti").isEmpty():
                raise Broken(f"{name}.{column} refers to rows of {parent} that aren't there")
        old = self._hold(self.current[name].join(fresh.select(*t.key), list(t.key), "left_semi"), "old")
        self._touch(name, old)  # a row may move from one bucket to another
        self._touch(name, fresh)
        self.current[name] = self.current[name].join(fresh.select(*t.key), list(t.key), "left_anti").unionByName(fresh)
        return fresh

    def commit(self) -> snapshots.Snapshot:
        """Writes the touched buckets and switches readers over; Conflict if another change came first. A change of nothing makes no version."""
        parts = {k: [list(p) for p in v] for k, v in self.now.facts.get("parts", {}).items()}
        for name, touched in self.touched.items():
            if not touched:
                continue
            rows = self.current[name].withColumn("_bucket", self._bucket(name)).where(F.col("_bucket").isin(sorted(touched)))
            folder = snapshots.stage(rows.repartition("_bucket", F.pmod(F.xxhash64(*self.of.tables[name].key), F.lit(8))), self.now.root, name, ["_bucket"])
            kept = [[f, sorted(set(b) - touched)] for f, b in parts.get(name, [])]
            parts[name] = [p for p in kept if p[1]] + [[folder, sorted(touched)]]
        done = self.now
        if any(self.touched.values()):
            done = snapshots.commit(self.spark, self.now, {k: [f for f, _ in v] for k, v in parts.items()}, self.now.facts | {"parts": parts, "buckets": self.of.buckets})
        self.discard()
        return done

    def discard(self) -> None:
        """Drops what the change has written for itself; readers see nothing of it."""
        drop_staged(*self.scratch)
        self.scratch = []
