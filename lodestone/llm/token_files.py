"""Token ids in binary files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common as C

#: Longest code in bits; 2 ** MAX_BITS entries make the decoding table.
MAX_BITS = 20
#: Ids of a block (each block's bit offset is kept) and of a segment, about: a segment holds whole documents.
BLOCK, SEGMENT = 256, 1 << 18
#: Distinct words in each of the two tables of ids that a worker keeps, and punctuation that may end a word.
KEPT, STOPS = 400_000, ".,;:!?"
END_ID = 2


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Known:
    """Ids of words by their text, as bytes: those met since the table was last full, and the table before it."""

    def __init__(self) -> None:
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.now) > KEPT:
            self.now, self.before = {}, self.now

    def missing(self, words: set[str]) -> set[str]:
        """The words that are in neither table; the others are in the present one from here on."""
        new = words - self.now.keys()
        back = new & self.before.keys()
        self.now.update((w, self.before[w]) for w in back)
        return new - back


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian 32-bit integers.

    The vocabulary's pre-tokenizer never joins what stands before a space to what follows it, where neither neighbour is
    white space, nor a letter to punctuation after it. So a text's ids are those of its first word and of each further
    word with its space, and a word's are those of its stem and of the punctuation that ends it; words and stems come back
    again and again and are encoded once, and a line end between letters parts words too. A text where a space has white space beside it is encoded in one piece."""

    def __init__(self, path: str) -> None:
        self.path, self.first, self.inner, self.ends = path, Known(), Known(), {}
        self.line_end = np.frombuffer(self._whole(["\n"])[0], "<u4")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in _tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[str]) -> list[bytes]:
        """_whole() of words without line ends, by way of one text: a line end after a word is a token of its own."""
        if not words:
            return []
        raw = self._whole(["".join(f"{w}\n" for w in words)])[0]
        ends = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == self.line_end)).tolist()
        if len(ends) != len(words):
            return self._whole(words)
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends, strict=False)]

    def _learn(self, known: Known, words: set[str], lead: str) -> set[str]:
        """Learns all words but those that begin or end with white space, or are empty; gives these."""
        new = known.missing(words)
        if not new:
            return new
        plain = {w for w in new if w.isalnum()}
        rest = new - plain
        odd = {w for w in rest if not w or w[0].isspace() or w[-1].isspace()}
        rest -= odd
        lines = {w: w.split("\n") for w in rest if "\n" in w}
        parts = {w: (stem, w[len(stem) :]) if (stem := w.rstrip(STOPS)) and stem[-1].isalpha() else (w, "") for w in rest - lines.keys()}
        stems = list(plain | known.missing({stem for stem, _ in parts.values()}))
        known.now.update(zip(stems, self._apart([lead + s for s in stems]), strict=True))
        for end in {e for _, e in parts.values()} - self.ends.keys():
            self.ends[end] = self._whole([end])[0]
        known.now.update((w, known.now[stem] + self.ends[end]) for w, (stem, end) in parts.items() if end)
        if lines:
            whole = [w for w, x in lines.items() if any(not y or y[0].isspace() or y[-1].isspace() for y in x)]
            known.now.update(zip(whole, self._whole([lead + w for w in whole]), strict=True))
            parted = {w: x for w, x in lines.items() if w not in known.now}
            self._learn(known, {x[0] for x in parted.values()}, lead)
            self._learn(self.first, {y for x in parted.values() for y in x[1:]}, "")
            end = self.line_end.tobytes()
            known.now.update((w, end.join([known.now[x[0]], *(self.first.now[y] for y in x[1:])])) for w, x in parted.items())
        return odd

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self.first.turn()
        self.inner.turn()
        parts: list[list[str] | None] = [t.split(" ") for t in texts]
        odd = self._learn(self.inner, set().union(*parts), " ")
        if odd:
            parts = [p if len(p) == 1 or odd.isdisjoint(p) else None for p in parts]
        lone = self._learn(self.first, {p[0] for p in parts if p}, "")
        if lone:  # a first word that begins with white space, or an empty text
            self.first.now.update(zip(sorted(lone), self._whole(sorted(lone)), strict=True))
        whole = iter(self._whole([t for t, p in zip(texts, parts, strict=True) if p is None]))
        first, inner = self.first.now, self.inner.now.__getitem__
        return [np.frombuffer(next(whole) if p is None else first[p[0]] + b"".join(map(inner, p[1:])), "<u4") for p in parts]


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, at = [np.ones(len(leaves), bool)], leaves
    for _ in range(limit - 1):
        pairs = at[: len(at) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        at = both[rank]
        levels.append(rank < len(leaves))
    take, own = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        own[:n] += 1
        take = 2 * (take - n)
    lengths[order] = own
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for n in np.unique(lengths[order]):
        own = order[lengths[order] == n]
        code <<= int(n - before)
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code, before = code + len(own), n
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes as one bit string, and the bit offset of every BLOCK-th id."""
    if not len(ids):
        return b"", np.empty(0, np.int64)
    n = lengths[ids]
    ends = np.cumsum(n)
    at = ends - n
    spread = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    word = at >> 5
    starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    out = np.zeros((int(ends[-1]) >> 5) + 3, np.uint64)
    out[word[starts]] += np.add.reduceat(spread >> np.uint64(32), starts)
    out[word[starts] + 1] += np.add.reduceat(spread & np.uint64(0xFFFFFFFF), starts)
    return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::BLOCK]


class Decoder:
    def __init__(self, lengths: np.ndarray) -> None:
        codes = canonical_codes(lengths)
        order = np.lexsort((codes, lengths))
        order = order[lengths[order] > 0]
        spans = 1 << (MAX_BITS - lengths[order])
        self.symbol = np.zeros(1 << MAX_BITS, np.uint32)
        self.length = np.ones(1 << MAX_BITS, np.int64)
        end = int(spans.sum())
        self.symbol[:end] = np.repeat(order, spans)
        self.length[:end] = np.repeat(lengths[order], spans)

    def __call__(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All n ids: the blocks are independent and are decoded side by side, one id of each at a step."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at, last = checkpoints.astype(np.int64), len(windows) - 1
        out = np.empty((BLOCK, len(at)), np.uint32)
        for step in range(min(BLOCK, n)):
            byte = np.minimum(at >> 3, last)  # only lanes whose block has ended run past
            code = (windows[byte] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32)) & np.uint32((1 << MAX_BITS) - 1)
            out[step] = self.symbol[code]
            at = at + self.length[code]
        return out.T.ravel()[:n]


FILE_SCHEMA = "part int, segment int, first long, n_ids long, payload binary, checkpoints binary, doc_ids array<long>, doc_lengths array<long>"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> DataFrame:
    """(id, rev, ids, tally), written under path: each document's ids as compressed 32-bit integers, and a last row of each task with how often each id occurred in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = _encoder(tokenizer), max(_tokenizer(tokenizer).get_vocab_size(), end_id + 1)
        total, packer, end = np.zeros(size, np.int64), zstandard.ZstdCompressor(level=3), np.array([end_id], "<u4")
        row = lambda i, r, x, t: pa.RecordBatch.from_arrays([i, r, pa.array(x, pa.binary()), pa.array(t, pa.binary())], names=["id", "rev", "ids", "tally"])
        for batch in batches:
            if not batch.num_rows:
                continue
            every = [np.concatenate([ids, end]) for ids in encoder.encode(batch.column(1).to_pylist())]
            total += np.bincount(np.concatenate(every), minlength=size)
            # the low and the high halves apart, for the latter are mostly zero
            yield row(batch.column(0), batch.column(2), [packer.compress(ids.view("<u2").reshape(-1, 2).T.tobytes()) for ids in every], [None] * len(every))
        yield row(pa.array([None], pa.int64()), pa.array([None], pa.int64()), [None], [packer.compress(total.tobytes())])

    rows = docs.select("id", "text", F.xxhash64("text").alias("rev")).mapInArrow(work, "id long, rev long, ids binary, tally binary")
    rows.write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.parquet(path)


def id_counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; the driver holds one number an id of the vocabulary."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["id", "n"])

    found = rows.where("tally is not null").select("tally").mapInArrow(unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes the ids in ascending id_col order under path.

    Texts are encoded once; ids are counted over all documents, then documents are range-partitioned by id, sorted and
    written. path/codes has (id, length), all that canonical codes need; path/segments has a row for each segment of whole
    documents: its Huffman bits, the bit offset of every BLOCK-th id, and its documents' ids and lengths; part and segment
    give the order. An empty table writes empty files; null ids come first; rows of one id keep the order of their text's hash."""
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    C.small_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = tokenized(slim, tokenizer, end_id, temporary := C.new_path(spark, "tokenized"))
    lengths = code_lengths(id_counts(rows))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{path}/codes")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        names = [f.split()[0] for f in FILE_SCHEMA.split(", ")]
        part, seq, first, held, ids, sizes = 0, 0, 0, 0, [], []
        chunks: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, first, held
            payload, marks = pack_bits(np.concatenate(chunks), lengths, codes)
            values = [part, seq, first, held, payload, marks.astype("<u4").tobytes(), list(ids), list(sizes)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            row = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)
            seq, first, held = seq + 1, first + held, 0
            for x in (ids, sizes, chunks):
                x.clear()
            return row

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = np.frombuffer(unpacker.decompress(raw), "<u2").reshape(2, -1).astype(np.int64)
                chunks.append(low | high << 16)
                ids.append(i)
                sizes.append(len(low))
                held += len(low)
                if held >= SEGMENT:
                    yield flush()
        if ids:
            yield flush()

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.where("tally is null").select("id", "ids", "rev").repartitionByRange(n_parts, "id").sortWithinPartitions("id", "rev").drop("rev")
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(segments, FILE_SCHEMA).write.option("compression", "none").parquet(f"{path}/segments")
    C.drop_path(spark, temporary)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit integers) of every document, from the files alone."""
    return _decoded(spark, path, digest=False)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """read_ids with ids_crc32 in place of the ids."""
    return _decoded(spark, path, digest=True)


def _decoded(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    rows = spark.read.parquet(f"{path}/codes").collect()  # bounded by the vocabulary
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        lengths[r["id"]] = r["length"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for part, first, n, payload, marks, ids, sizes in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                tokens = decoder(payload, np.frombuffer(marks, "<u4"), n)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                raw = [tokens[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                last = pa.array([zlib.crc32(x) for x in raw], pa.int64()) if digest else pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(first + starts), pa.array(sizes, pa.int64()), last], names=["doc_id", "part", "at", "n_tokens", "last"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    files = spark.read.parquet(f"{path}/segments")
    out = files.select("part", "first", "n_ids", "payload", "checkpoints", "doc_ids", "doc_lengths").mapInArrow(decode, f"doc_id long, part int, at long, n_tokens long, last {'long' if digest else 'binary'}")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file part
    base = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return out.join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids and reads their digests back from the files."""
    path = C.new_path(spark, "token-files")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_digests(spark, path)


QUERIES = {"op1_token_files": op1_token_files}
SQL: dict[str, str] = {}
