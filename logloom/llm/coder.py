"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block predicts each id three times: the id last seen after the two ids before (order 2), after the one
before (order 1), and the block's majority id (order 0). Which of them is right, or none, is one of four
outcomes, coded with a mix of two adaptive distributions: one by order-2 confidence, one by order-1
confidence and agreement. The mix leans to the one that did better. An id that no prediction gives is coded
by the block's adaptive order-0 frequencies of its first two hex digits, then its last two digits as they are.
A block starts from nothing and needs nothing but itself; all blocks of a record are coded in step as
vectors. All arithmetic is on integers, and four frequencies of 16 bits share a 64-bit word.

A file row (record) holds whole documents in ascending doc_id order: doc ids, their lengths, coded blocks with
their CRC-32, and how many ids its part holds before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, text_of
from .tokens import encoder

BLOCK = 1024
RECORD = 1 << 23
SLOTS = 256
END_ID = 1


def _fields(values: list[int]) -> int:
    """Four 16-bit numbers in a word, the first lowest."""
    return sum(v << 16 * i for i, v in enumerate(values))


_TOP, _LOW = np.uint64(1 << 48), np.uint64(1 << 42)
_U = [np.uint64(x) for x in range(65)]
_SHIFT = np.array([0, 16], np.uint64)
_MASK = np.uint64(0xFFFF)

# Cumulative frequencies of the outcomes none, order 1, order 2, order 0: of 4032 as adapted, of 4096 as coded.
_SHARE, _SLOW = 4032, np.uint64(5)
_EVEN = np.uint64(_fields([_SHARE * (i + 1) // 4 for i in range(4)]))
_GAIN = np.array([_fields([(_SHARE >> 5) * (i >= o) for i in range(4)]) for o in range(4)], np.uint64)
_KEPT, _MIXED, _FLOOR = (np.uint64(_fields([x] * 4)) for x in (0xFFFF >> 5, 0xFFF, 0))
_FLOOR = np.uint64(_fields([16 * (i + 1) for i in range(4)]))
_TOTAL_BITS = np.uint64(12)
_OUTCOME = np.array([2 if i & 4 else 1 if i & 2 else 3 if i & 1 else 0 for i in range(8)], np.uint8)
_AT = np.arange(4, dtype=np.uint64) * _U[16]

# Cumulative frequencies of a hex digit: of 1008 as adapted, of 1024 as coded.
_RAMP = np.arange(1, 17, dtype=np.int16)
_AIM = np.where(np.arange(16) >= np.arange(16)[:, None], 1008, 0).astype(np.int16)
_DIGIT_BITS, _TAIL_BITS = np.uint64(10), np.uint64(8)
_LITERAL_BITS = np.uint64(28)
_LITERAL = np.uint64(1 << 28)
_ALL_BITS = _TOTAL_BITS + _LITERAL_BITS


class _Digits:
    """Adaptive distributions over hex digits, one a row."""

    def __init__(self, rows: int, n: int):
        self.table = np.tile((np.arange(1, 17) * 63).astype(np.int16), (rows, 1))
        self.base = np.arange(0, 16 * n, 16)

    def open(self, at: np.ndarray | None = None) -> None:
        """Takes up the distributions in the rows `at`, or in all."""
        self.at = at
        self.rows = self.table if at is None else self.table.take(at, axis=0)
        self.cum = self.rows + _RAMP

    def find(self, slot: np.ndarray) -> np.ndarray:
        """The digit whose part holds `slot`."""
        below = (self.cum.ravel() <= np.repeat(slot.astype(np.int16), 16)).view(np.uint64)
        ones = np.bitwise_count(below)
        return np.minimum(ones[::2] + ones[1::2], 15).astype(np.int64)

    def part(self, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(below, width) of each digit."""
        flat, at = self.cum.ravel(), self.base + digit
        below = flat.take(at - 1, mode="wrap") * (digit > 0)
        return below.astype(np.uint64), (flat.take(at) - below).astype(np.uint64)

    def learn(self, digit: np.ndarray) -> None:
        self.rows += (_AIM.take(digit, axis=0) - self.rows) >> 4
        if self.at is not None:
            self.table[self.at] = self.rows


class _Model:
    """The predictions and adaptive distributions of n blocks in step."""

    def __init__(self, n: int):
        self.one, self.two = np.zeros(n * SLOTS, np.int32), np.zeros(n * SLOTS, np.int32)  # id * 4 + confidence
        self.a, self.b = np.full(n * 4, _EVEN), np.full(n * 8, _EVEN)
        self.lean = np.full(n, 8, np.uint64)
        self.major, self.votes = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.last, self.before = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.base, self.quad, self.octet = np.arange(n) * SLOTS, np.arange(n) * 4, np.arange(n) * 8
        self.first, self.second, self.rows17 = _Digits(n, n), _Digits(17 * n, n), np.arange(0, 17 * n, 17)
        self.step = 0

    def predict(self) -> np.ndarray:
        """Cumulative frequencies of the four outcomes in one word a block."""
        self.i1 = self.base + ((self.last * 40503 >> 4) & (SLOTS - 1))
        self.i2 = self.base + ((self.last * 31337 + self.before * 7919 >> 3) & (SLOTS - 1))
        self.e1, self.e2 = self.one.take(self.i1), self.two.take(self.i2)
        self.p1, self.k1, self.p2, self.k2 = self.e1 >> 2, self.e1 & 3, self.e2 >> 2, self.e2 & 3
        self.ia = self.quad + self.k2
        self.ib = self.octet + (self.k1 * 2 + (self.p1 == self.p2))
        self.fa, self.fb = self.a.take(self.ia), self.b.take(self.ib)
        return ((self.fa * self.lean + self.fb * (_U[16] - self.lean) >> _U[4]) & _MIXED) + _FLOOR

    def outcome(self, ids: np.ndarray) -> np.ndarray:
        hits = ((ids == self.p2).view(np.uint8) << 2) | ((ids == self.p1).view(np.uint8) << 1) | (ids == self.major).view(np.uint8)
        return _OUTCOME.take(hits)

    def decoded(self, outcome: np.ndarray) -> np.ndarray:
        """The predicted ids; zero where none is right."""
        return np.where(outcome == 2, self.p2, np.where(outcome == 1, self.p1, np.where(outcome == 3, self.major, 0)))

    def update(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        if not self.step & 3:
            at = _AT.take(outcome)
            qa, qb = (((f >> at) - (f << _U[16] >> at)) & _MASK for f in (self.fa, self.fb))
            self.lean = np.minimum(np.maximum(self.lean + (qa > qb) - (qa < qb), _U[1]), _U[15])
        self.step += 1
        gain = _GAIN.take(outcome)
        self.a[self.ia] = self.fa - ((self.fa >> _SLOW) & _KEPT) + gain
        self.b[self.ib] = self.fb - ((self.fb >> _SLOW) & _KEPT) + gain
        fresh = ids << 2
        for table, i, e, p, k in ((self.one, self.i1, self.e1, self.p1, self.k1), (self.two, self.i2, self.e2, self.p2, self.k2)):
            table[i] = np.where(ids == p, e + (k < 3), np.where(k > 0, e - 1, fresh))
        same, free = ids == self.major, self.votes == 0
        self.major = np.where(free, ids, self.major)
        self.votes += np.where(same | free, 1, -1).astype(np.int32)
        self.before, self.last = self.last, ids


class _Writer:
    """Range coders of n blocks in step, putting out 16-bit words."""

    def __init__(self, n: int, room: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.out, self.base, self.room = np.zeros(n * room, "<u2"), np.arange(0, n * room, room), room
        self.at = self.base.copy()  # where each coder's next word goes

    def put(self, below: np.ndarray, width: np.ndarray) -> None:
        """Narrows every coder to its part of 2^40."""
        part = self.range >> _ALL_BITS
        self.low += part * below
        self.range = part * width
        while self._settle():
            pass

    def _settle(self) -> bool:
        """Moves out a word of every coder that has one settled; whether any had."""
        apart = self.low ^ (self.low + self.range)
        settled = apart < _TOP
        short = (self.range < _LOW) > settled
        if short.any():
            i = np.flatnonzero(short)
            self.range[i] = (~self.low[i] + _U[1]) & (_LOW - _U[1])
            settled |= short
        if not settled.any():
            return False
        self._move(settled)
        shift = _SHIFT.take(settled.view(np.uint8))
        self.low <<= shift
        self.range <<= shift
        self.at += settled
        return True

    def _move(self, settled: np.ndarray) -> None:
        self.out[self.at] = self.low >> _U[48]

    def close(self) -> list[bytes]:
        for shift in (48, 32, 16, 0):
            self.out[self.at] = (self.low >> _U[shift]) & _MASK
            self.at += 1
        return [row[:n].tobytes() for row, n in zip(self.out.reshape(-1, self.room), (self.at - self.base).tolist(), strict=True)]


class _Reader(_Writer):
    """The same coders, reading."""

    def __init__(self, blocks: list[bytes]):
        n, room = len(blocks), max(map(len, blocks)) // 2 + 8
        super().__init__(n, room)
        for at, b in zip(self.base.tolist(), blocks, strict=True):
            self.out[at : at + len(b) // 2] = np.frombuffer(b, "<u2")
        self.code = np.zeros(n, np.uint64)
        for _ in range(4):
            self._move(np.ones(n, bool))
            self.at += 1

    def _move(self, settled: np.ndarray) -> None:
        self.code = np.where(settled, (self.code << _U[16]) | self.out.take(self.at, mode="clip"), self.code)

    def outcome(self, freq: np.ndarray) -> np.ndarray:
        """Which outcome the coders hold."""
        self.part, self.over = self.range >> _ALL_BITS, self.code - self.low
        unit = self.part << _LITERAL_BITS
        return sum((((freq >> _U[s]) & _MASK) * unit <= self.over).view(np.uint8) for s in (0, 16, 32))

    def literal(self, below: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Where in 2^28 the coders stand within their outcome's part."""
        return np.minimum((self.over - self.part * (below << _LITERAL_BITS)) // (self.part * width), _LITERAL - _U[1])


def _spans(freq: np.ndarray, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(below, width) of each outcome."""
    at = _AT.take(outcome)
    below = (freq << _U[16] >> at) & _MASK
    return below, ((freq >> at) & _MASK) - below


def _put(coder: _Writer, model: _Model, spans: tuple, miss: np.ndarray, ids: np.ndarray, digits: tuple) -> None:
    """Codes outcomes, and ids where none was right; the model adapts."""
    (below, width), (high, middle, tail) = spans, digits
    low1, wide1 = model.first.part(high)
    low2, wide2 = model.second.part(middle)
    wide = wide1 * wide2
    inner = np.where(miss, (low1 << _U[18]) + wide1 * (low2 << _TAIL_BITS) + wide * tail, _U[0])
    coder.put((below << _LITERAL_BITS) + width * inner, width * np.where(miss, wide, _LITERAL))
    model.second.learn(middle)
    model.first.learn(ids >> 12)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], list[int]]:
    """(coded blocks, CRC-32 of each block's ids) of unsigned 16-bit ids."""
    if not len(ids):
        return [], []
    steps = min(block, len(ids))
    n = -(-len(ids) // steps)
    grid = np.zeros(n * steps, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(n, steps).T)
    model, writer = _Model(n), _Writer(n, 3 * steps + 16)
    for row in grid:
        freq = model.predict()
        outcome = model.outcome(row)
        miss = outcome == 0
        model.first.open()
        digits = row >> 12, row >> 8 & 15, (row & 255).astype(np.uint64)
        model.second.open(model.rows17 + np.where(miss, digits[0], 16))
        _put(writer, model, _spans(freq, outcome), miss, row, digits)
        model.update(row, outcome)
    raw = np.asarray(ids, "<u2").tobytes()
    return writer.close(), [zlib.crc32(raw[2 * steps * i : 2 * steps * (i + 1)]) for i in range(n)]


def decode(blocks: list[bytes], crcs: list[int], count: int, block: int = BLOCK) -> np.ndarray:
    """The `count` ids of coded blocks; an error if a checksum fails."""
    if not count:
        return np.zeros(0, "<u2")
    steps, n = min(block, count), len(blocks)
    model, reader = _Model(n), _Reader(blocks)
    out = np.zeros((steps, n), "<u2")
    for t in range(steps):
        freq = model.predict()
        outcome = reader.outcome(freq)
        miss = outcome == 0
        spans = _spans(freq, outcome)
        slot = reader.literal(*spans)
        model.first.open()
        high = model.first.find(slot >> _U[18])
        low, wide = model.first.part(high)
        slot -= low << _U[18]
        model.second.open(model.rows17 + np.where(miss, high, 16))
        middle = model.second.find((slot / wide).astype(np.int64) >> 8)
        low, more = model.second.part(middle)
        tail = np.minimum(((slot - wide * (low << _TAIL_BITS)) / (wide * more)).astype(np.uint64), np.uint64(255))
        row = np.where(miss, (high << 12 | middle << 8 | tail.astype(np.int64)).astype(np.int32), model.decoded(outcome))
        _put(reader, model, spans, miss, row, (high, middle, tail))
        model.update(row, outcome)
        out[t] = row
    ids = out.T.reshape(-1)[:count]
    raw = np.ascontiguousarray(ids).tobytes()
    for i, crc in enumerate(crcs):
        if zlib.crc32(raw[2 * steps * i : 2 * steps * (i + 1)]) != crc:
            raise ValueError(f"block {i} is damaged")
    return ids


RECORD_TYPE = "part int, seq int, before long, n_ids long, doc_ids array<long>, lengths array<long>, blocks array<binary>, crcs array<long>"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block: int = BLOCK, record: int = RECORD) -> None:
    """Writes the ids of every text and its end id to Parquet record files under `path`, in doc_id order.

    Rows are dealt to ranges of doc_id and sorted; a record ends with the document that fills it, so a very long
    text makes a long record. Null text counts as empty; repeated rows are each written, those of one id in the
    order of their texts; null ids come first; an empty table gives files without records. Other columns are not
    read. All rows of one id go to one range.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary, spaced=False)
        tail = np.array([end_id], "<u2").tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        names, held, size = [], [], 0

        def close() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(held), "<u2")
            row = (part, seq, before, len(ids), names, [len(h) // 2 for h in held], *encode(ids, block))
            return pd.DataFrame([row], columns=["part", "seq", "before", "n_ids", "doc_ids", "lengths", "blocks", "crcs"])

        for batch in batches:
            for doc, raw in zip(batch["doc_id"].astype(object), own.encode(batch["text"].tolist()), strict=True):
                names.append(None if pd.isna(doc) else int(doc))
                held.append(raw + tail)
                size += len(raw) // 2 + 1
                if size >= record:
                    yield close()
                    seq, before, names, held, size = seq + 1, before + size, [], [], 0
        if held:
            yield close()

    ordered = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(run, RECORD_TYPE).write.parquet(path)


def read(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from their decoded ids.

    start counts the ids of all documents before it in the files; ids_crc32 is over the ids as little-endian
    unsigned 32-bit integers.
    """
    files = spark.read.schema(RECORD_TYPE).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row a partition of the writer
    offsets, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        offsets[r["part"]] = total
        total += r["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                raw = decode(list(r.blocks), list(r.crcs), r.n_ids, block).astype("<u4").tobytes()
                at, rows = 0, []
                for doc, n in zip(r.doc_ids, r.lengths, strict=True):
                    rows.append((None if pd.isna(doc) else int(doc), offsets[r.part] + r.before + at, int(n), zlib.crc32(raw[4 * at : 4 * (at + int(n))])))
                    at += int(n)
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the token-id files of `docs` to the shared folder and reads them back; see `write` and `read`.

    An empty table gives no rows.
    """
    path = f"{scratch_dir(docs.sparkSession)}/ids"
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path)
