"""Best-fit packing of token sequences by linear grouping.

Only how often each length from 1 to the capacity occurs decides the packing, so it is planned on that
bounded histogram and never on documents:

1. large lengths, longest first, are cut into groups of equal cardinality and rounded up to the longest of
   their group, so few sizes are left;
2. configurations of those sizes are optimised: the fullest that still holds the largest size is found by
   a knapsack over the sizes left and used as often as they last;
3. real lengths take the places of the rounded ones, which frees room;
4. small lengths go into the fullest sequence that has room for them, and into new sequences at last.

A plan is a list of segments: ranks (all pieces ordered by length, longest first) to sequences. Each piece
finds its rank by counts of (length, chunk) and its place in the plan by binary search.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written
from .tokens import encoder

CAPACITY = 1024
END_ID = 2
GROUPS = 160
SMALL = 48
CHUNKS = 512


@dataclass
class Plan:
    """Segments over ranks: from start[i] on, per[i] pieces go to each sequence from sequence[i] on."""

    start: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    sequences: int


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Configurations ((size number, times), ...) with how many sequences use each, until all counts are used."""
    left = list(counts)
    for top in range(len(sizes)):
        while left[top]:
            room = capacity - sizes[top]
            filled, steps = 1, []  # bit t: length t can be filled; what it was before each piece
            for i in range(top, len(sizes)):
                for _ in range(min(left[i] - (i == top), room // sizes[i])):
                    more = filled | (filled << sizes[i]) & ((2 << room) - 1)
                    if more == filled:
                        break
                    steps.append((i, filled))
                    filled = more
                if filled >> room:
                    break
            rest = filled.bit_length() - 1
            chosen = {top: 1}
            for i, before in reversed(steps):
                if not before >> rest & 1:
                    chosen[i] = chosen.get(i, 0) + 1
                    rest -= sizes[i]
            times = min(left[i] // n for i, n in chosen.items())
            for i, n in chosen.items():
                left[i] -= n * times
            yield sorted(chosen.items()), times


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> Plan:
    """The packing of `histogram` (length to number of pieces, lengths from 1 to the capacity)."""
    lengths = sorted((x for x, n in histogram.items() if n), reverse=True)
    base, total = {}, 0
    for x in lengths:
        base[x] = total
        total += histogram[x]
    segments: list[tuple[int, int, int]] = []
    sequences = 0
    first = 0
    if lengths and lengths[0] == capacity:
        segments.append((0, 1, 0))
        sequences = first = histogram[capacity]
    large_end = max([base[x] + histogram[x] for x in lengths if x > small], default=0)
    runs: list[tuple[int, int, int]] = []  # (free room, first sequence, sequences)
    if large_end > first:
        ends = np.cumsum([histogram[x] for x in lengths]).tolist()

        def length_at(rank: int) -> int:
            return lengths[bisect_left(ends, rank + 1)]

        bounds = sorted({first + (large_end - first) * g // groups for g in range(groups + 1)})
        sizes: list[int] = []
        at: list[int] = []
        counts: list[int] = []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if sizes and sizes[-1] == length_at(lo):
                counts[-1] += hi - lo
            else:
                sizes.append(length_at(lo))
                at.append(lo)
                counts.append(hi - lo)
        for chosen, times in _configurations(sizes, counts, capacity):
            cuts = {0, times}
            for i, n in chosen:
                segments.append((at[i], n, sequences))
                for e in ends:  # where a real length ends inside this segment
                    if at[i] < e < at[i] + n * times:
                        cuts |= {(e - at[i]) // n, -((at[i] - e) // n)}
            edges = sorted(c for c in cuts if 0 <= c <= times)
            for lo, hi in zip(edges, edges[1:], strict=False):
                full = sum(length_at(at[i] + lo * n + k) for i, n in chosen for k in range(n))
                runs.append((capacity - full, sequences + lo, hi - lo))
            for i, n in chosen:
                at[i] += n * times
            sequences += times
    free: dict[int, list[tuple[int, int]]] = {}
    for room, s, n in runs:
        free.setdefault(room, []).append((s, n))
    for x in lengths:
        if x > small:
            continue
        rank, count = base[x], histogram[x]
        while count:
            room = min((r for r in free if r >= x and free[r]), default=None)
            if room is None:
                room, per = capacity, capacity // x
                free[room] = [(sequences, -(-count // per))]
                sequences += -(-count // per)
            per = room // x
            s, n = free[room].pop()
            if count >= per * n:
                segments.append((rank, per, s))
                free.setdefault(room - per * x, []).append((s, n))
                rank, count = rank + per * n, count - per * n
                continue
            use, rest = divmod(count, per)
            if use:
                segments.append((rank, per, s))
                free.setdefault(room - per * x, []).append((s, use))
            if rest:
                segments.append((rank + use * per, rest, s + use))
                free.setdefault(room - rest * x, []).append((s + use, 1))
            if (left := n - use - bool(rest)) > 0:
                free[room].append((s + use + bool(rest), left))
            count = 0
    segments.sort()
    start, per, sequence = (np.array([x[i] for x in segments], np.int64) for i in range(3))
    return Plan(start, per, sequence, sequences)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, n_tokens, ids) of each document's ids and its end id.

    Ids are `byte_bpe`-like: white space belongs to the word after it. A document over the capacity is cut into
    full pieces, of which the first may be shorter.
    """
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, spaced=True)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, raw in zip(batch["doc_id"].astype(object), own.encode(batch["text"].tolist()), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4").tobytes() + tail
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    end = at + ((n - at) % capacity or capacity)
                    part = ids[4 * at : 4 * end]
                    rows.append((None if pd.isna(doc) else int(doc), piece, at, end - at, zlib.crc32(part), part))
                    at, piece = end, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, out)


def packed(found: DataFrame, capacity: int = CAPACITY, chunks: int = CHUNKS) -> DataFrame:
    """`found` (a stable table with doc_id, piece, start, length) with sequence_id and offset.

    Ranks of equal lengths are counted in `chunks` parts by a hash of the document, so one common length is
    no single task.
    """
    order = [F.col("doc_id"), F.col("piece"), F.col("start")]
    marked = found.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    counts = marked.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk")) - F.col("_n"))
    before = written(before, "counts")
    histogram = {int(r["length"]): int(r["n"]) for r in before.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if not histogram:
        return found.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    made = plan(histogram, capacity)
    bases, total = {}, 0
    for x in sorted(histogram, reverse=True):
        bases[x] = total
        total += histogram[x]
    base = np.zeros(capacity + 2, np.int64)
    for x, n in bases.items():
        base[x] = n

    @F.pandas_udf("struct<sequence_id:long,rank:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = base[length.to_numpy(np.int64)] + rank.to_numpy(np.int64)
        i = np.searchsorted(made.start, r, "right") - 1
        return pd.DataFrame({"sequence_id": made.sequence[i] + (r - made.start[i]) // made.per[i], "rank": r})

    local = F.row_number().over(Window.partitionBy("length", "_chunk").orderBy(*order)) - 1
    ranked = marked.withColumn("_local", local).join(before.drop("_n"), ["length", "_chunk"])
    placed = ranked.withColumn("_place", place("length", F.col("_local") + F.col("_before")))
    offset = F.sum("length").over(Window.partitionBy("_place.sequence_id").orderBy("_place.rank")) - F.col("length")
    return placed.select(*found.columns, F.col("_place.sequence_id").alias("sequence_id"), offset.cast("long").alias("offset"))


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Null and empty texts are their end id alone; repeated rows are packed each; a null doc_id stays null; an
    empty table gives no rows.
    """
    found = written(pieces(docs, path).drop("ids"), "pieces")
    return packed(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
