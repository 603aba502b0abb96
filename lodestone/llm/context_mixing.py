"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and an end. Each common word is a path of bits in a Huffman tree (so a bit's node says all
about the word's bits before it), every other word is an escape and then either its place among the rarer known words or,
if new, its bytes' bits. A bit is predicted from counts under three contexts: its node alone, with the word before, and
with the two words before, the latter two by hashes into tables of counters. The predictions are mixed in the logistic domain by
weights that a gate chooses (how far down the path, and how often each context was seen), and refined by what was off at
like predictions; weights and refinement go on learning inside a text, block by block, from what is already coded."""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common as C

#: Most words that have a path of their own, most words whose counts are sent to every task, and the bytes of such a word at most.
CODED, SENT, LONGEST = 1 << 16, 1 << 18, 64
#: Counters of a table at most, as a power of two (it grows with the training tokens up to that), and of the tables for new words' bytes.
MOST_BITS, BYTE_BITS = 21, 18
#: Counters in a row of a partial table, distinct words and bytes of texts that a task counts before it hands sums on, and bytes of words that are spelt at once.
CHUNK, HELD, HELD_BYTES, RUN = 1 << 14, 500_000, 1 << 28, 1 << 16
#: Tokens and texts that are scored side by side, tokens of a text's first block, and of any block at most.
GROUP, LANES, FIRST, BLOCK = 1 << 16, 1000, 64, 1 << 13
#: Tokens whose bits are worked on at once: their arrays stay in a core's cache.
SLICE = 1024
#: Bytes of words that are counted and learnt from together.
TAUGHT = 1 << 11
#: How fast weights follow: steps are sums of slopes over the number of bits (times a constant) and this many.
STEADY, STEADY_TEXT, CURVE = 2000.0, 400.0, 0.5
#: Stages of a path, bins of the refinement, counters' start.
STAGES, BINS, START = 8, 24, 0.4
GATES = STAGES * 16
ALL = np.ones(1, bool)
#: Of the sums of tables the part that has weights, which are added as whole multiples of 1 / FINE, so that their order doesn't matter.
STATE, FINE = -1, 1 << 20
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at]; all places are inside, so that nothing is looked through for some that aren't."""
    return values.take(at, mode="clip")


class Mixer:
    """Weights by lane and gate, and a correction by lane, stage and bin of the mixed prediction; slopes are what the next step learns from."""

    def __init__(self, weights: np.ndarray, refined: np.ndarray, lanes: int = 1, steady: float = STEADY) -> None:
        self.gates, self.inputs = weights.shape
        self.w = [np.tile(w, lanes) for w in weights.T.astype(np.float32)]  # by input
        self.r = np.tile(refined.astype(np.float32).ravel(), lanes)
        self.per_lane, self.steady = refined.size, steady
        self.slopes = [np.zeros_like(v) for v in (*self.w, self.r)]
        self.bits = np.zeros_like(self.w[0]), np.zeros_like(self.r)  # by weight and by correction

    def code(self, inputs: list[np.ndarray], gate: np.ndarray, stage: np.ndarray, lane: np.ndarray, sign: np.ndarray, learn: np.ndarray | None) -> np.ndarray:
        """The cost of each bit (sign: 1 or -1); keeps the slopes of those whose lanes learn says."""
        at = lane * self.gates + gate
        x = taken(self.w[0], at) * inputs[0]
        for w, own in zip(self.w[1:], inputs[1:], strict=True):
            x += taken(w, at) * own
        cell = np.clip(x * 2 + BINS / 2, 0, BINS - 1).astype(np.int64) + stage * BINS + lane * self.per_lane
        x += taken(self.r, cell)
        x *= sign
        e = np.exp(-np.clip(x, -30, 30))
        if learn is not None:
            off = e / (1 + e) * sign
            if not learn.all():
                on = np.flatnonzero(taken(learn, lane))
                at, cell, off, inputs = taken(at, on), taken(cell, on), taken(off, on), [taken(v, on) for v in inputs]
            for slope, own in zip(self.slopes, inputs, strict=False):
                np.add.at(slope, at, off * own)
            np.add.at(self.slopes[-1], cell, off)
            np.add.at(self.bits[0], at, np.float32(1))
            np.add.at(self.bits[1], cell, np.float32(1))
        return np.log(1 + e) * np.float32(1 / math.log(2))

    def step(self) -> None:
        """Learns from the slopes kept since the last step."""
        for v, slope, n in zip((*self.w, self.r), self.slopes, [self.bits[0]] * self.inputs + [self.bits[1]], strict=True):
            v += (slope / (CURVE * n + self.steady)).astype(np.float32)
            slope[:] = 0
        for n in self.bits:
            n[:] = 0


@dataclass
class Counters:
    """Counts of zeros and ones by slot, for each of some orders, as float32; and for use, in 16 bits, a slot's logit times 64 and how often it was seen (0 to 3)."""

    size: int
    counts: np.ndarray  # orders, 2, size
    packed: np.ndarray | None = field(default=None)

    @staticmethod
    def logit(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.log((one + np.float32(START)) / (zero + np.float32(START)))

    @staticmethod
    def seen(n: np.ndarray) -> np.ndarray:
        return (n > 0).astype(np.int16) + (n > 2) + (n > 15)

    def pack(self) -> Counters:
        """For use only: without the counts."""
        zero, one = self.counts[:, 0], self.counts[:, 1]
        out = np.round(self.logit(zero, one) * 64).astype(np.int16) * 4 + self.seen(zero + one).astype(np.int16)
        return Counters(self.size, np.empty((0, 2, 0), np.float32), out)

    def read(self, slots: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(logits, seen) by order."""
        got = [taken(self.packed[k], s) for k, s in enumerate(slots)]
        return [(v >> 2) * np.float32(1 / 64) for v in got], [(v & 3).astype(np.int64) for v in got]


def signs(bit: np.ndarray) -> np.ndarray:
    """1 for a bit that is set, else -1."""
    return bit * np.float32(2) - np.float32(1)


@dataclass
class Code:
    """Paths of symbols in a Huffman tree: of symbol s, entries start[s] to start[s] + length[s] of node, sign (of the bit), stage and logit."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    sign: np.ndarray
    stage: np.ndarray
    logit: np.ndarray

    @classmethod
    def of(cls, counts: list[int]) -> Code:
        n = len(counts)
        weight, parent, side = [*counts], [0] * (2 * n), [0] * (2 * n)
        heap = [(c, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for x, bit in ((a[1], 0), (b[1], 1)):
                parent[x], side[x] = len(weight), bit
            heapq.heappush(heap, (a[0] + b[0], len(weight)))
            weight.append(a[0] + b[0])
        root, nodes, bits, lengths = len(weight) - 1, [], [], []
        ones = {parent[x]: weight[x] for x in range(root) if side[x]}
        for s in range(n):
            x, up = s, []
            while x != root:
                up.append((parent[x] - n, side[x]))
                x = parent[x]
            nodes += [k for k, _ in reversed(up)]
            bits += [b for _, b in reversed(up)]
            lengths.append(len(up))
        length = np.array(lengths, np.int64)
        node, start = np.array(nodes, np.int64), np.cumsum(length) - length
        one = np.array([ones.get(k + n, 0) for k in range(len(weight) - n)], np.float64)
        zero = np.array(weight[n:], np.float64) - one
        depth = np.arange(len(node)) - np.repeat(start, length)
        stage = np.minimum(STAGES - 1, depth // 2)
        logit = np.log((one + START) / (zero + START)).astype(np.float32)
        return cls(start, length, (node.astype(np.uint64) + np.uint64(1)) * ODD[1], signs(np.array(bits, bool)), stage, logit[node] if len(node) else np.empty(0, np.float32))

    def bits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in symbols, place in the paths) of every bit."""
        n = self.length[symbols]
        of = np.repeat(np.arange(len(symbols)), n)
        return of, np.arange(len(of)) + np.repeat(self.start[symbols] - (np.cumsum(n) - n), n)


def hashes(symbols: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each symbol, hashes of the symbol before and of the two before; first: the places where texts begin, before which there is nothing."""
    one = np.empty(len(symbols), np.uint64)
    one[1:] = symbols[:-1].astype(np.uint64) + np.uint64(1)
    one[first] = 0
    two = np.empty_like(one)
    two[1:] = one[:-1]
    two[first] = 0
    return [(one + np.uint64(1)) * ODD[0], ((one + np.uint64(1)) * ODD[1] ^ (two + np.uint64(3)) * ODD[2]) * ODD[0]]


def slots(of: list[np.ndarray], node: np.ndarray, size: int) -> list[np.ndarray]:
    """The slot of each context's hash with a bit's node in a table of size (a power of two)."""
    shift = np.uint64(65 - size.bit_length())
    return [((h + node) * ODD[0] >> shift).view(np.int64) for h in of]


# ---- new words, byte by byte

def byte_bits(words: list[bytes], lead: int = 0) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(word, hashes of none and of the one, two, three bytes before, node, bit) of every bit of the words' bytes, but for the first lead bytes."""
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    before = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), raw[:-k]])[: len(raw)] + np.uint64(1), np.uint64(0)) for k in (1, 2, 3)]
    of = [np.zeros(len(raw), np.uint64), before[0] * ODD[0]]
    of += [of[1] ^ before[1] * ODD[1]]
    of += [of[2] ^ before[2] * ODD[2]]
    raw, word, of = raw[lead:], word[lead:], [h[lead:] for h in of]
    j = np.tile(np.arange(8, dtype=np.uint64), len(raw))
    byte = np.repeat(raw, 8)
    node = (np.uint64(1) << j | byte >> (np.uint64(8) - j)) * ODD[1]
    bit = (byte >> (np.uint64(7) - j) & np.uint64(1)).astype(bool)
    return np.repeat(word, 8), [np.repeat(h * ODD[0], 8) for h in of], node, bit


def byte_runs(words: list[bytes]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """byte_bits() of all words, each ended by a line end, for RUN bytes at a time; a longer word comes in parts that know the three bytes before."""
    at = 0
    for part in _by_size(words, RUN):
        ended = [w + b"\n" for w in part]
        if len(part) == 1:
            for i in range(0, len(ended[0]), RUN):
                lead = min(i, 3)
                word, of, node, bit = byte_bits([ended[0][i - lead : i + RUN]], lead)
                yield word + at, of, node, bit
        else:
            word, of, node, bit = byte_bits(ended)
            yield word + at, of, node, bit
        at += len(part)


def byte_gate(n: int, seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(gate, stage): which bit of its byte, and how often the longest two contexts were seen."""
    stage = np.tile(np.arange(8), n // 8)
    return stage * 16 + seen[3] * 4 + seen[2], stage


# ---- the model

@dataclass
class Model:
    """What scoring knows: bounded tables only. The counts of words beyond `index` are joined."""

    index: dict[bytes, int]  # of the SENT most frequent words, those with a path first
    counts: np.ndarray  # of these
    coded: int
    code: Code
    words: Counters
    spelt: Counters
    tokens: int
    kinds: int
    texts: int
    rare: int
    new: float
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, 3), 0.35))
    refined: np.ndarray = field(default_factory=lambda: np.zeros((STAGES, BINS)))
    byte_weights: np.ndarray = field(default_factory=lambda: np.full((GATES, 4), 0.3))
    byte_refined: np.ndarray = field(default_factory=lambda: np.zeros((STAGES, BINS)))

    @property
    def escape(self) -> int:
        return self.coded

    @property
    def end(self) -> int:
        return self.coded + 1

    def known_bits(self, counts: np.ndarray) -> np.ndarray:
        """The cost, beyond the escape, of words without a path that training has so often."""
        return -np.log2((1 - self.new) * np.asarray(counts, np.float64) / max(1, self.rare))

    def spell(self, words: list[bytes]) -> np.ndarray:
        """The cost, beyond the escape, of new words."""
        out = np.zeros(len(words))
        for word, of, node, bit in byte_runs(words):
            logits, seen = self.spelt.read(slots(of, node, self.spelt.size))
            gate, stage = byte_gate(len(bit), seen)
            cost = Mixer(self.byte_weights, self.byte_refined).code(logits, gate, stage, np.zeros(len(bit), np.int64), signs(bit), None)
            out += np.bincount(word, cost, len(words))
        return out - math.log2(self.new)

    def ranks(self, texts: list[list[bytes]], index: dict[bytes, int] | None = None) -> np.ndarray:
        """Places in an index of all words of the texts, its size for others."""
        index = self.index if index is None else index
        find, other = index.get, len(index)
        return np.fromiter(map(find, chain.from_iterable(texts), repeat(other)), np.int64, sum(map(len, texts)))

    @functools.cached_property
    def paths(self) -> dict[bytes, int]:
        """index of the words with a path alone: fewer, and so found faster."""
        return {w: i for w, i in self.index.items() if i < self.coded}

    def symbols(self, ranks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of the texts, each ended, and the number of each text's symbols)."""
        words = np.minimum(ranks, self.escape)
        return np.insert(words, np.cumsum(lengths), self.end), lengths + 1

    def gate(self, stage: np.ndarray, seen: list[np.ndarray]) -> np.ndarray:
        return stage * 16 + seen[1] * 4 + seen[0]

    def code_texts(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The cost in bits of each text's symbols; all texts are coded side by side, a block of each at a time."""
        ends = np.cumsum(lengths)
        lane = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(symbols)) - np.repeat(ends - lengths, lengths)
        grown = int(math.log2(BLOCK // FIRST))
        turn = np.where(place < BLOCK, np.ceil(np.log2(np.maximum(1, (place + 1) / FIRST))), grown + place // BLOCK).astype(np.int32)
        order, last = np.argsort(turn, kind="stable"), np.zeros(len(lengths), np.int32)
        last[lane] = turn  # a lane's last block is its highest
        of = [h[order] for h in hashes(symbols, ends - lengths)]
        symbols, lane, turn = symbols[order], lane[order], turn[order]
        mixer, bits = Mixer(self.weights, self.refined, len(lengths), STEADY_TEXT), np.zeros(len(lengths))
        cuts = np.flatnonzero(np.diff(turn, prepend=-1, append=turn[-1] + 1)) if len(turn) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            more = last > turn[a]
            for c in range(a, b, SLICE):
                own = slice(c, min(b, c + SLICE))
                t, path = self.code.bits(symbols[own])
                logits, seen = self.words.read(slots([taken(h[own], t) for h in of], taken(self.code.node, path), self.words.size))
                stage, of_bit = taken(self.code.stage, path), taken(lane[own], t)
                cost = mixer.code([taken(self.code.logit, path), *logits], self.gate(stage, seen), stage, of_bit, taken(self.code.sign, path), more if more.any() else None)
                bits += np.bincount(of_bit, cost, len(bits))
            if more.any():
                mixer.step()
        return bits


def _by_size(words: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Runs of words of about most bytes; a longer word is alone."""
    held, size = [], 0
    for w in words:
        if held and size + len(w) > most:
            yield held
            held, size = [], 0
        held.append(w)
        size += len(w)
    if held:
        yield held


def grouped(texts: Iterator[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of texts, for about GROUP tokens and at most LANES texts at a time."""
    held, size = [], 0
    for t in texts:
        held.append((t or b"").lower().split())
        size += len(held[-1]) + 1
        if size >= GROUP or len(held) == LANES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
    for batch in batches:
        yield from batch.column(0).to_pylist()


def count_words(texts: DataFrame) -> DataFrame:
    """(word: bytes, n) of the one binary column's texts, lower-cased A-Z; a null word has the number of texts. Tasks hand on sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        read = 0

        def done() -> pa.RecordBatch:
            words, counts = pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, counts], names=["word", "n"])

        for t in _texts(batches):
            held.update((t or b"").lower().split())
            held[None] += 1
            read += len(t or b"")
            if len(held) > HELD or read > HELD_BYTES:
                read = 0
                yield done()
        yield done()

    return texts.mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(parts: DataFrame) -> DataFrame:
    """(part, counts) with the counts of equal parts (STATE: of weights) added, one after another in a sorted partition, so that a part's rows are never held together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.astype("<i8" if now == STATE else "<f4").tobytes()])], names=["part", "counts"])

        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(counts.as_py(), "<i8" if part == STATE else "<u4")
                if part != now:
                    if now is not None:
                        yield done()
                    now, total = part, values.astype(np.int64)
                else:
                    total += values
        if now is not None:
            yield done()

    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(work, "part int, counts binary")


def gather(rows: DataFrame, orders: int, size: int, weights: np.ndarray, refined: np.ndarray, events: Callable) -> tuple[Counters, np.ndarray, np.ndarray]:
    """Counters over all rows, and weights and refinement that all rows have taught.

    events gives runs of a task's rows: slices of (slots by order, bits, further inputs, gate by what was seen, stage), of whole texts
    or words. Each task adds up a table of its own. A run's bits are predicted from what the task has counted before it, so from
    nothing of their own texts, and teach the weights; then they are counted. Tables are summed chunk by chunk, weights averaged by
    the bits of the tasks; they are as given without rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(orders * 2 * size, np.uint32)  # a slot's zeros and ones side by side
        each = [table[2 * k * size : 2 * (k + 1) * size] for k in range(orders)]
        both = [x.view(np.uint64) for x in each]
        mixer, n = Mixer(weights, refined), 0
        for run in events(batches):
            held = []
            for places, bit, inputs, gate, stage in run:
                logits, seen = [], []
                for x, s in zip(both, places, strict=True):
                    zero, one = taken(x, s).view(np.uint32).reshape(-1, 2).T.astype(np.float32)
                    logits.append(Counters.logit(zero, one))
                    seen.append(Counters.seen(zero + one).astype(np.int64))
                mixer.code([*inputs, *logits], gate(seen), stage, np.zeros(len(bit), np.int64), signs(bit), ALL)
                mixer.step()
                n += len(bit)
                held.append([(2 * s + bit).astype(np.uint32) for s in places])
            for places in held:
                for x, s in zip(each, places, strict=True):
                    np.add.at(x, s.astype(np.int64), np.uint32(1))
        row = lambda part, raw: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw])], names=["part", "counts"])
        for part, a in enumerate(range(0, len(table), CHUNK)):
            own = table[a : a + CHUNK]
            if own.any():
                yield row(part, own.astype("<u4").tobytes())
        if n:
            state = np.concatenate([np.stack(mixer.w, 1).ravel(), mixer.r]).astype(np.float64)
            yield row(STATE, np.append(np.rint(state * FINE).astype(np.int64) * n, n).astype("<i8").tobytes())

    table = np.zeros(orders * 2 * size, np.float32)
    summed = C.staged(_summed(rows.mapInArrow(work, "part int, counts binary")), "lm-counts")  # all parts at once; below, one after another
    for r in summed.toLocalIterator():
        if r["part"] == STATE:
            state = np.frombuffer(r["counts"], "<i8")
            state = state[:-1] / (FINE * state[-1])
            weights, refined = state[: weights.size].reshape(weights.shape), state[weights.size :].reshape(refined.shape)
        else:
            own = np.frombuffer(r["counts"], "<f4")
            table[r["part"] * CHUNK : r["part"] * CHUNK + len(own)] = own
    C.drop_staged(summed)
    return Counters(size, np.ascontiguousarray(table.reshape(orders, size, 2).transpose(0, 2, 1))), weights, refined


def train(texts: DataFrame, words: DataFrame) -> Model:
    """Learns from texts (a binary column `text`); words: count_words() of them, staged.

    Counters and word counts are gathered from all texts, and every text and word teaches the first weights, before it is counted. The
    driver holds SENT words and tables of 2 ** MOST_BITS counters at most, whatever the corpus."""
    spark = texts.sparkSession
    known = words.where("word IS NOT NULL")
    got = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("word"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)), F.count_if((F.col("n") == 1) & F.col("word").isNotNull())).first()
    tokens, kinds, n_texts, once = got[0], got[1], got[2], got[3]
    # the most frequent words, by counts of words in sixteenths of powers of two
    short = known.where(F.octet_length("word") <= LONGEST).withColumn("b", F.floor(16 * F.log2("n")).cast("int"))
    limit, total = 1 << 20, 0
    for b, n in sorted(((r["b"], r["count"]) for r in short.groupBy("b").count().collect()), reverse=True):
        if (total := total + n) > SENT:
            break
        limit = b
    table = short.where(F.col("b") >= limit).select("word", "n").toArrow()
    top = sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    coded = min(CODED, sum(n > 1 for _, n in top))
    rare = tokens - n_texts - sum(n for _, n in top[:coded])
    code = Code.of([n for _, n in top[:coded]] + [rare + 1, n_texts + 1])
    new = min(0.5, (once + 1) / (rare + 2)) if rare else 1.0
    size = 1 << min(MOST_BITS, max(10, math.ceil(math.log2(max(2, tokens))) - 1))
    blank = Counters(size, np.empty((0, 2, 0), np.float32))
    model = Model({w: i for i, (w, _) in enumerate(top)}, np.array([n for _, n in top], np.int64), coded, code, blank, blank, tokens, kinds + (n_texts > 0), n_texts, rare, new)
    sent = spark.sparkContext.broadcast(model)

    def word_events(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
        own = sent.value

        def cut(symbols: np.ndarray, of: list[np.ndarray]) -> Iterator[tuple]:
            for a in range(0, len(symbols), SLICE):
                t, path = own.code.bits(symbols[a : a + SLICE])
                stage = taken(own.code.stage, path)
                places = slots([taken(h[a : a + SLICE], t) for h in of], taken(own.code.node, path), size)
                yield places, taken(own.code.sign, path) > 0, [taken(own.code.logit, path)], functools.partial(own.gate, stage), stage

        for group in grouped(_texts(batches)):
            symbols, lengths = own.symbols(own.ranks(group, own.paths), np.array([len(g) for g in group], np.int64))
            ends = np.cumsum(lengths)
            of = hashes(symbols, ends - lengths)
            # whole texts, of SLICE symbols together at most, or one
            at, first = 0, 0
            while first < len(ends):
                first = max(first + 1, int(np.searchsorted(ends, at + SLICE, side="right")))
                yield cut(symbols[at : ends[first - 1]], [h[at : ends[first - 1]] for h in of])
                at = int(ends[first - 1])

    def byte_events(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
        def one(of: list[np.ndarray], node: np.ndarray, bit: np.ndarray) -> tuple:
            return slots(of, node, 1 << BYTE_BITS), bit, [], lambda seen: byte_gate(len(bit), seen)[0], np.tile(np.arange(8), len(bit) // 8)

        for batch in batches:
            for part in _by_size(batch.column(0).to_pylist(), TAUGHT):
                yield (one(of, node, bit) for _, of, node, bit in byte_runs(part))

    counted, model.weights, model.refined = gather(texts.select("text"), 2, size, model.weights, model.refined, word_events)
    spelt, model.byte_weights, model.byte_refined = gather(known.select("word"), 4, 1 << BYTE_BITS, model.byte_weights, model.byte_refined, byte_events)
    model.words, model.spelt = counted.pack(), spelt.pack()
    sent.destroy()
    return model


def score(docs: DataFrame, model: Model, words: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score, bits, bits_per_byte (of the text; null for no bytes) and score, the model's log10 probability of the text.

    Words that no task knows the counts of are joined with words (count_words() of training, staged) by their bytes: their
    counts are small, so no key of that table is hot, and a text gives a word once. A null text is an empty one: its end alone. Equal texts
    have equal scores up to rounding (6 decimals); columns of docs with the names added here are replaced; extra columns stay."""
    spark = docs.sparkSession
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "bits", "bits_per_byte", "score"]
    rest = [c for c in docs.columns if c not in added]
    sent = spark.sparkContext.broadcast(model)  # SENT words, and tables of 2 ** MOST_BITS counters
    own = docs.select(F.col(text_col).cast("binary").alias("_text"), F.monotonically_increasing_id().alias("_key"), F.struct(*[F.col(c) for c in rest if c != text_col] or [F.lit(1).alias("_none")]).alias("_row"))
    row_type = own.schema["_row"].dataType
    schema = T.StructType([T.StructField("_row", row_type), *(T.StructField(n, t) for n, t in (("_key", T.LongType()), ("_tokens", T.LongType()), ("_known", T.LongType()), ("_base", T.DoubleType()), ("_bits", T.DoubleType()), ("_bytes", T.LongType()), ("_rare", T.ArrayType(T.BinaryType())), ("_times", T.ArrayType(T.IntegerType()))))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        log_c, other = np.append(np.log10(m.counts + 0.5), 0.0), len(m.index)
        extra = np.concatenate([np.zeros(m.coded), m.known_bits(m.counts[m.coded :]), [0.0]])
        end_base = math.log10(m.texts + 0.5)
        for batch in batches:
            texts, at = batch.column(0).to_pylist(), 0
            for group in grouped(iter(texts)):
                lengths = np.array([len(g) for g in group], np.int64)
                ranks = m.ranks(group)
                bits = m.code_texts(*m.symbols(ranks, lengths))
                text = np.repeat(np.arange(len(group)), lengths)
                base = np.bincount(text, log_c[ranks], len(group)) + end_base
                bits += np.bincount(text, extra[ranks], len(group))
                known = np.bincount(text, ranks < other, len(group)).astype(np.int64) + (m.texts > 0)
                out = ranks == other
                starts = np.cumsum(lengths) - lengths
                rare: list[Counter] = [Counter() for _ in group]
                for i, j in zip(text[out].tolist(), (np.flatnonzero(out) - starts[text[out]]).tolist(), strict=True):
                    rare[i][group[i][j]] += 1
                part = batch.slice(at, len(group))
                columns = [part.column(2), part.column(1), pa.array(lengths + 1), pa.array(known), pa.array(base), pa.array(bits), pa.array([len(t or b"") for t in texts[at : at + len(group)]], pa.int64())]
                columns += [pa.array([list(c.keys()) for c in rare], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int32()))]
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    C.small_batches(spark)
    found = C.staged(own.mapInArrow(work, schema), "lm-texts")
    each = found.select("_key", F.explode(F.arrays_zip(F.col("_rare").alias("word"), F.col("_times").alias("times"))).alias("x")).select("_key", F.col("x.word").alias("word"), F.col("x.times").alias("times"))
    joined = each.join(words.where("word IS NOT NULL"), "word", "left").select("_key", "word", "times", "n")

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
            times = batch.column(2).to_numpy()
            new = np.flatnonzero(n == 0)
            bits = m.known_bits(np.maximum(n, 1))
            if len(new):
                bits[new] = m.spell(batch.column(1).take(pa.array(new)).to_pylist())
            columns = [batch.column(0), pa.array(np.where(n > 0, times, 0).astype(np.int64)), pa.array(times * np.log10(n + 0.5)), pa.array(times * bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_known2", "_base2", "_bits2"])

    rare = joined.mapInArrow(cost, "_key long, _known2 long, _base2 double, _bits2 double").groupBy("_key").agg(*[F.sum(c).alias(c) for c in ("_known2", "_base2", "_bits2")])
    out = found.drop("_rare", "_times").join(rare, "_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    bits = F.col("_bits") + zero("_bits2")
    base = F.col("_base") + zero("_base2") - F.col("_tokens") * F.lit(math.log10(model.tokens + 0.5 * (model.kinds + 1)))
    return out.select(
        *[F.col("_row")[c].alias(c) for c in rest if c != text_col],
        F.col("_tokens").alias("n_tokens"),
        (F.col("_known") + zero("_known2")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.round(base, 6).alias("base_score"),
        F.round(bits, 6).alias("bits"),
        F.round(F.when(F.col("_bytes") > 0, bits / F.col("_bytes")), 6).alias("bits_per_byte"),
        F.round(-bits * F.lit(math.log10(2)), 6).alias("score"),
    )


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by a model of those whose crc32(doc_id as text) mod 5 isn't 1; a null doc_id is among these."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held.alias("held_out"), "text")
    texts = docs.where("NOT held_out").select(F.col("text").cast("binary").alias("text"))
    C.small_batches(spark)
    words = C.staged(count_words(texts), "lm-words")
    return score(docs, train(texts, words), words)


QUERIES = {"op13_context_mixing": op13_context_mixing}
SQL: dict[str, str] = {}
