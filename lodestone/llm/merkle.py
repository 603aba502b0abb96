"""A Merkle manifest of a dataset: parents keep their children's hashes, leaves fold to the root along their ancestors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common as C

#: Children of a node, and hex digits of a digest.
FAN, DIGITS = 8, 64
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UP = "array<struct<preimage:string,slot:int>>"


def digest(*parts: Column) -> Column:
    """The lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value, so that no two rows give one string."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def ranked(rows: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """rows with pos (from 0 among the rows of one key, by order) and n (rows of the key), in the shared folder.

    Rows are range-partitioned and sorted, so a key with most rows lies in many partitions; a row's place is that in its
    partition plus the key's counts in the partitions before."""
    by = [key, *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    placed = C.staged(placed, name)
    counts = placed.groupBy("_part", key).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(key)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", key, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    out = placed.join(offsets, ["_part", key]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
    done = C.staged(out, name)
    C.drop_staged(placed)
    return done


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """[nodes, their parents, ...] up to one node a key: (key, pos, n, hash, preimage). n stays the number of the key's first nodes, so a key has nodes of level k where n > FAN ** (k - 1)."""
    out = [nodes.select("key", "pos", "n", "hash")]
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while FAN ** (len(out) - 1) < most:
        own = out[-1].where(F.col("n") > FAN ** (len(out) - 1))
        children = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        runs = own.groupBy("key", F.floor(F.col("pos") / FAN).alias("pos")).agg(F.first("n").alias("n"), F.array_join(F.transform(children, lambda x: x["hash"]), "").alias("preimage"))
        out.append(C.staged(runs.withColumn("hash", digest(F.col("preimage"))), f"{name}-{len(out)}"))
    return out


def paths(of: list[DataFrame], above: DataFrame) -> DataFrame:
    """(key, pos, up, subroot) of the first level's nodes: up has the preimage of each ancestor and the node's slot in it, from
    the bottom to the root. above: (key, up, subroot) of each key's last node. From the top down, nodes join their parent's row."""
    found = None
    for k in reversed(range(len(of))):
        ends = of[k].where(F.col("n") <= FAN**k).select("key", "pos").join(above, "key")
        if found is not None:
            held = of[k + 1].select("key", F.col("pos").alias("_pos"), "preimage").join(found.withColumnRenamed("pos", "_pos"), ["key", "_pos"])
            inner = of[k].where(F.col("n") > FAN**k).select("key", "pos").withColumn("_pos", F.floor(F.col("pos") / FAN)).join(held, ["key", "_pos"])
            own = F.array(F.struct("preimage", (F.col("pos") % FAN).cast("int").alias("slot")))
            ends = ends.unionAll(inner.select("key", "pos", F.concat(own, "up").alias("up"), "subroot"))
        found = ends
    return found


def _cut(x: Column) -> tuple[Column, Column]:
    """What stands before and after a node's own digest in its parent's preimage."""
    at = x["slot"] * DIGITS
    return F.substring(x["preimage"], F.lit(1), at), F.substring(x["preimage"], at + DIGITS + 1, F.lit(FAN * DIGITS))


def siblings(up: Column) -> Column:
    """The other digests of every run from a leaf to the root, left to right."""
    return F.array_join(F.transform(up, lambda x: F.concat(*_cut(x))), "")


def folded(leaf: Column, up: Column) -> Column:
    """The root that a leaf's digest gives: spliced into its parent's preimage, whose digest goes into the next one."""
    splice = lambda acc, x: F.concat(_cut(x)[0], acc, _cut(x)[1])
    return F.aggregate(up, leaf, lambda acc, x: F.sha2(splice(acc, x), 256))


@dataclass
class Manifest:
    """leaves: the carried columns with key, pos, n and hash; inner, outer: the levels over leaves and over subroots; root: null for no rows."""

    leaves: DataFrame
    inner: list[DataFrame]
    outer: list[DataFrame]
    root: str | None

    def paths(self) -> DataFrame:
        """leaves with up and subroot."""
        top = self.outer[0].select(F.col("hash").alias("subroot"), F.col("name").alias("key"), F.col("key").alias("_top"), "pos")
        one = self.outer[-1].where(F.col("pos") == 0).select("key", F.array().cast(UP).alias("up"), F.lit(None).cast("string").alias("subroot"))
        over = paths([self.outer[0].drop("name"), *self.outer[1:]], one).select(F.col("key").alias("_top"), "pos", "up")
        above = top.join(over, ["_top", "pos"]).select("key", "up", "subroot")
        return self.leaves.join(paths(self.inner, above), ["key", "pos"])

    def save(self, path: str) -> None:
        """Writes leaves, and parents with their preimages, as Parquet under path."""
        self.leaves.write.parquet(f"{path}/leaves")
        empty = self.inner[0].select("key", "pos", "n", F.lit("").alias("preimage"), "hash").limit(0)
        for name, of in (("inner", self.inner), ("outer", self.outer)):
            own = [empty.withColumn("level", F.lit(0)), *(x.select("key", "pos", "n", "preimage", "hash").withColumn("level", F.lit(k)) for k, x in enumerate(of) if k)]
            for x in own:
                x.write.mode("append").partitionBy("level").parquet(f"{path}/{name}")
        self.outer[0].write.parquet(f"{path}/subroots")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Manifest:
        """What save() wrote."""
        leaves, subroots = spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/subroots")

        def over(first: DataFrame, name: str) -> list[DataFrame]:
            found = spark.read.schema("key string, pos long, n long, preimage string, hash string, level int").parquet(f"{path}/{name}")
            most = found.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
            return [first, *(found.where(F.col("level") == k).drop("level") for k in range(1, most + 1))]

        outer = over(subroots, "outer")
        return cls(leaves, over(leaves.select("key", "pos", "n", "hash"), "inner"), outer, _root(outer))


def _root(outer: list[DataFrame]) -> str | None:
    top = outer[-1].select("hash").first()
    return top and top["hash"]


def build(rows: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id", carry: Sequence[str] = ()) -> Manifest:
    """The tree over rows: one leaf a row with the given digest; leaves of one value of group ascend by order (null first, ties by
    digest: rows equal in both are alike), every FAN consecutive nodes become one until one is left; the values' last nodes,
    ordered by value (null first, by bytes), likewise give the root. A lone node stands for itself. carry: columns kept with
    the leaves. No rows have no root. Only the largest count and the root come to the driver."""
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    slim = C.staged(rows.select(key.alias("key"), F.col(order).alias("_order"), leaf.alias("hash"), *[F.col(c).alias(f"own_{c}") for c in carry]), "merkle-leaves")
    leaves = ranked(slim, "key", ["_order", "hash"], "merkle-ranked").withColumnRenamed("_order", "order")
    C.drop_staged(slim)
    inner = levels(leaves, "merkle-inner")
    last = [x.where(F.col("n") <= FAN**k).select("key", "hash") for k, x in enumerate(inner)]
    subroots = last[0]
    for x in last[1:]:
        subroots = subroots.unionAll(x)
    tops = ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "hash"), "key", ["name"], "merkle-subroots")
    outer = levels(tops, "merkle-outer")
    outer[0] = tops
    return Manifest(leaves, inner, outer, _root(outer))


def document_leaf(text: Column | None = None) -> Column:
    """The digest of a documents row, with another text if one is given."""
    return digest(*[field(text if c == "text" and text is not None else F.col(c)) for c in FIELDS])


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, each leaf's proof, and what folding gives where every third text (by crc32 of its id) is lower-cased (A-Z).

    Equal rows are leaves of their own; a null doc_id comes first and isn't tampered with; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)) & F.col("text").isNotNull()
    lower = F.when(F.octet_length("text") == F.length("text"), F.lower("text")).otherwise(F.translate("text", C.UPPER, C.LOWER))
    tree = build(docs.withColumn("other", F.when(hit, document_leaf(lower))), document_leaf(), carry=["other"])
    found = tree.paths().withColumn("root", F.lit(tree.root).cast("string"))
    back = folded(F.coalesce("own_other", "hash"), F.col("up"))
    out = found.select(F.col("order").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("up")), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of the SQL twin over leaves and over subroots: FAN ** LEVELS[0] documents of a language at most, which is beyond the table that it is run on.
LEVELS = (7, 3)


def _sql() -> str:
    encoded = lambda c, v: f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" if c in ("source", "lang", "text") else f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(encoded(c, text if c == "text" else c) for c in FIELDS) + ")"
    steps = "flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: list_concat([256 + ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"xor(list_reduce(list_concat([4294967295], {steps}), lambda c, s: CASE WHEN s >= 256 THEN xor(c, s - 256) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    low = f"translate(text, '{C.UPPER}', '{C.LOWER}')"
    parts = [
        f"h AS (SELECT doc_id, coalesce('+' || lang, '') AS key, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 AND text IS NOT NULL THEN {leaf(low)} ELSE {leaf('text')} END AS other FROM documents)",
        "a0 AS (SELECT *, leaf AS hash, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM h)",
    ]

    def tree(t: str, top: int) -> None:
        for k in range(1, top + 1):
            inner = f"SELECT key, pos // {FAN} AS pos, any_value(n) AS n, string_agg(hash, '' ORDER BY pos) AS pre FROM {t}{k - 1} WHERE n > {FAN ** (k - 1)} GROUP BY key, pos // {FAN}"
            parts.append(f"{t}{k} AS (SELECT *, sha256(pre) AS hash FROM ({inner}))")

    tree("a", LEVELS[0])
    ends = " UNION ALL ".join(f"SELECT key AS name, hash FROM a{k} WHERE n <= {FAN**k}" for k in range(LEVELS[0] + 1))
    parts.append(f"s AS ({ends})")
    parts.append("b0 AS (SELECT '' AS key, name, hash, row_number() OVER (ORDER BY name) - 1 AS pos, count(*) OVER () AS n FROM s)")
    tree("b", LEVELS[1])
    tops = " UNION ALL ".join(f"SELECT hash FROM b{k} WHERE n <= {FAN**k}" for k in range(LEVELS[1] + 1))
    parts.append(f"r AS ({tops})")
    last = "SELECT doc_id, leaf, key AS name, other AS acc, '' AS proof, pos, n FROM a0"
    for t, top in (("a", LEVELS[0]), ("b", LEVELS[1])):
        if t == "b":
            last = f"SELECT x.doc_id, x.leaf, x.name, x.acc, x.proof, b0.pos, b0.n, b0.hash AS subroot FROM ({last}) x JOIN b0 ON b0.name = x.name"
        for k in range(1, top + 1):
            on = "y.key = x.name AND y.pos" if t == "a" else "y.pos"
            pre = f"left(y.pre, {DIGITS} * (x.pos % {FAN}))", f"substr(y.pre, {DIGITS} * (x.pos % {FAN}) + {DIGITS + 1})"
            keep = ", x.subroot" if t == "b" else ""
            last = (
                f"SELECT x.doc_id, x.leaf, x.name, CASE WHEN y.pre IS NULL THEN x.acc ELSE sha256({pre[0]} || x.acc || {pre[1]}) END AS acc, x.proof || coalesce({pre[0]} || {pre[1]}, '') AS proof, x.pos // {FAN} AS pos, x.n{keep} "
                f"FROM ({last}) x LEFT JOIN {t}{k} y ON {on} = x.pos // {FAN}"
            )
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, r.hash AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.hash AS verified FROM ({last}), r"


QUERIES = {"op12_merkle": op12_merkle}
SQL = {"op12_merkle": _sql()}
