"""SentencePiece encoding and decoding with N-best segmentation: forward Viterbi scores are exact heuristics for a backward A* search."""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common as C

#: The sign for a space in pieces, and how much an unknown character scores below the lowest piece (fixed values).
SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Segmentations of each text in the query.
N_BEST = 4
#: Distinct units in each of the two tables of segmentations that a worker keeps while a task runs.
KEPT = 100_000


class Lattice:
    """The piece lattice over a model's vocabulary. Characters that no piece covers stand as their UTF-8 bytes' pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        normal = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i).replace(SPACE, " "): (i, float(model.get_score(i))) for i in normal}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        self.automaton = ahocorasick.Automaton()
        for text, (i, score) in self.pieces.items():
            self.automaton.add_word(text, (i, score, len(text)))
        self.automaton.make_automaton()
        self.singles = frozenset(p for p in self.pieces if len(p) == 1)
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.surface = [b""] * len(every)
        for text, (i, _) in self.pieces.items():
            self.surface[i] = text.encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        if any(" " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("a piece spans a word's end, so that words can't be told apart")

    def edges(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """The edges (start, id, score) into every place, by start; -1 is the edge of a character that is no piece."""
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(unit) + 1)]
        for last, (i, score, n) in self.automaton.iter(unit):
            into[last + 1].append((last + 1 - n, i, score))
        for at, c in enumerate(unit):
            if c not in self.singles:
                into[at + 1].append((at, -1, self.unknown))
        return into

    def forward(self, into: list[list[tuple[int, int, float]]]) -> list[float]:
        """The best score of every prefix."""
        best = [0.0]
        for edges in into[1:]:
            best.append(max(best[start] + score for start, _, score in edges))
        return best

    def best(self, unit: str) -> tuple[list[int], float, float]:
        """The ids of the path that segmentations() finds first, its score, and that of the second best: forward Viterbi with the two best of every place."""
        size, low = len(unit), float("-inf")
        best, second, back = [low] * (size + 1), [low] * (size + 1), [(0, 0)] * (size + 1)
        best[0] = 0.0
        if self.singles.issuperset(unit):
            for last, (i, score, n) in self.automaton.iter(unit):  # by place, and there the edge first that starts first
                end = last + 1
                start = end - n
                x = best[start] + score
                if x > best[end]:
                    y = second[start] + score
                    second[end] = y if y > best[end] else best[end]
                    best[end], back[end] = x, (start, i)
                elif x > second[end]:
                    second[end] = x
        else:
            for end, edges in enumerate(self.edges(unit)):
                for start, i, score in edges:
                    x = best[start] + score
                    if x > best[end]:
                        second[end] = max(best[end], second[start] + score)
                        best[end], back[end] = x, (start, i)
                    elif x > second[end]:
                        second[end] = x
        at, found = size, []
        while at:
            start, i = back[at]
            found.append((i,) if i >= 0 else [self.bytes[b] for b in unit[start:at].encode()])
            at = start
        return [i for ids in reversed(found) for i in ids], best[size], second[size]

    def segmentations(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a string, best first; of equal scores the one found first by the search, the same each time.

        The search goes backward from the end. The forward score of a place is exactly what is still to be gained, so the
        first n paths that come to the start are the n best."""
        into = self.edges(unit)
        forward = self.forward(into)
        order, size = itertools.count(), len(unit)
        heap: list = [(-forward[size], size, next(order), 0.0, None)]
        out = []
        while heap and len(out) < n:
            _, at, _, after, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    start, end, i, path = path
                    ids += [self.bytes[b] for b in unit[start:end].encode()] if i < 0 else [i]
                out.append((after, ids))
                continue
            for start, i, score in into[at]:
                heapq.heappush(heap, (-(forward[start] + score + after), start, next(order), after + score, (start, at, i, path)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids: pieces and bytes joined, without the space that encoding puts before."""
        surface = self.surface.__getitem__
        return b"".join(map(surface, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")[1:]


class Encoder:
    """N-best segmentations of texts. No piece goes on after a word's end, so that a text's segmentations are made of its units': a word with the spaces before it."""

    def __init__(self, path: str, n: int) -> None:
        self.lattice, self.n = Lattice(path), n
        self.forget()

    def forget(self) -> None:
        """Empties the tables, so that an idle worker doesn't hold them through other operators' stages."""
        self.known, self.before, self.wider = {}, {}, {}

    def _unit(self, key: str) -> tuple[bytes, float, float]:
        """Of a unit without its first space: best ids, their score, and what the second best loses."""
        if len(self.known) > KEPT:
            self.known, self.before = {}, self.known
        if (out := self.before.get(key)) is None:
            unit = " " + key
            ids, score, second = self.lattice.best(unit)
            out = struct.pack(f"<{len(ids)}I", *ids), score, score - second
        self.known[key] = out
        return out

    def _ways(self, key: str) -> list[tuple[float, bytes]]:
        """(loss, ids) of the n best of a unit."""
        if len(self.wider) > KEPT // 4:
            self.wider.clear()
        if (out := self.wider.get(key)) is None:
            found = self.lattice.segmentations(" " + key, self.n)
            out = self.wider[key] = [(found[0][0] - score, np.array(ids, "<u4").tobytes()) for score, ids in found]
        return out

    def __call__(self, text: str) -> list[tuple[float, bytes]]:
        """(score, ids as little-endian 32-bit integers), best first; an empty text has one segmentation, of no ids.

        Only the n - 1 units whose second best loses least can differ from their best in the n best of the text: any other
        change loses no less than each of those n - 1 alone."""
        if not text:
            return [(0.0, b"")]
        keys = text.split(" ")
        if "" in keys:
            keys = [u[1:] for u in re.findall(" +[^ ]*", " " + text)]
        known = self.known.get
        units = [known(k) or self._unit(k) for k in keys]
        best = [u[0] for u in units]
        score = sum(u[1] for u in units)
        loss = [u[2] for u in units]
        first = sorted(heapq.nsmallest(self.n - 1, range(len(loss)), key=loss.__getitem__))
        ways = [self._ways(keys[i]) for i in first]
        out = []
        for lost, picks in _least_sums([[w[0] for w in own] for own in ways], self.n):
            for i, w, x in zip(first, ways, picks, strict=True):
                best[i] = w[x][1]
            out.append((score - lost, b"".join(best)))
        return out


def _least_sums(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums of one number from each sorted list, with the places taken; of equal sums the smaller places first.

    A heap holds what can follow the sums taken so far: one place more in one list, no list before the last that was moved."""
    start = (0,) * len(lists)
    heap, out = [(sum(x[0] for x in lists), start, 0)], []
    while heap and len(out) < n:
        total, picks, moved = heapq.heappop(heap)
        out.append((total, picks))
        for k in range(moved, len(lists)):
            if picks[k] + 1 < len(lists[k]):
                after = (*picks[:k], picks[k] + 1, *picks[k + 1 :])
                heapq.heappush(heap, (sum(x[i] for x, i in zip(lists, after, strict=True)), after, k))
    return out


@functools.cache
def _encoder(path: str, n: int) -> Encoder:
    return Encoder(path, n)


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, path: str | None = None) -> DataFrame:
    """(id, ids, scores, others): the best segmentation's ids, the scores of the n best, and the ids of the others, best first.

    Whole texts; null and empty texts have no ids and one score of 0; a text with fewer than n segmentations has all it
    has. A literal U+2581 in a text goes as its bytes, so that decode() returns every text exactly. Rows are independent:
    an empty table gives no rows, repeated rows come out alike, further columns are not read."""
    path = path or model_path()
    C.small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, n)
        ints = lambda raw: np.frombuffer(raw, "<i4")
        for batch in batches:
            got = [encoder(t) for t in batch.column(1).to_pylist()]
            kinds = pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ints(g[0][1]) for g in got], kinds[0]), pa.array([[s for s, _ in g] for g in got], kinds[1]), pa.array([[ints(x) for _, x in g[1:]] for g in got], kinds[2])], names=["id", "ids", "scores", "others"])
        encoder.forget()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(work, "id long, ids array<int>, scores array<double>, others array<array<int>>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of ids as encode() gives them; null ids decode to an empty text."""
    path = path or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _encoder(path, N_BEST).lattice
        for batch in batches:
            lists = batch.column(1)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lattice.decode(values[a:b].tobytes()) for a, b in itertools.pairwise(ends)], pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")).mapInArrow(work, "id long, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_crc32, scores, others_crc32, round_trip): encode() and decode() in one pass, with the ids as CRC-32 of
    little-endian 32-bit integers; round_trip says that the best ids decode to the whole text."""
    path = path or model_path()
    C.small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, n)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [encoder(t) for t in texts]
            columns = [
                batch.column(0),
                pa.array([len(g[0][1]) // 4 for g in got], pa.int64()),
                pa.array([zlib.crc32(g[0][1]) for g in got], pa.int64()),
                pa.array([[s for s, _ in g] for g in got], pa.list_(pa.float64())),
                pa.array([[zlib.crc32(x) for _, x in g[1:]] for g in got], pa.list_(pa.int64())),
                pa.array([encoder.lattice.decode(g[0][1]) == t for g, t in zip(got, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_crc32", "scores", "others_crc32", "round_trip"])
        encoder.forget()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = "id long, n_tokens long, ids_crc32 long, scores array<double>, others_crc32 array<long>, round_trip boolean"
    return slim.mapInArrow(work, kinds).withColumnRenamed("id", id_col)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digests() of all documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_pieces": op8_pieces}
SQL: dict[str, str] = {}
