"""Exact ranked search of queries over all documents by the Best Position Algorithm.

Documents are read once: those terms of theirs that a query holds are written with their counts, so that the corpus figures
(N, L, document frequencies) cover all documents before a score is made. The written rows are then searched in shards of
`SHARD` documents. A shard has an impact list a term, highest first. A query reads its lists side by side; each document it
meets is looked up in all its lists, which also marks the places it has there as seen. A list's best position is the end of
its first run of seen places, and the sum of the impacts there bounds every document not met yet; the search of a shard ends
as soon as that bound lies strictly below the kth score. A task carries its kth scores from shard to shard, so later shards
end sooner. Only the best k rows a task and query are shuffled, and merged in two steps.

Queries are taken in blocks whose texts have a bounded size, so what a task holds of them is bounded; each block is searched
against all documents. Rows of one item_id and text are one item; texts that share an item_id are items of their own. Null
texts, and texts without terms, find and are found by nothing; null doc_ids come last among equal scores, documents that
share a doc_id are each ranked; ties go to the smaller doc_id; very long texts are counted in slices; empty tables give no
rows; other columns take no part.
"""

from __future__ import annotations

import itertools
import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

SHARD = 8192
#: Bytes of the texts of one block of queries, and what the driver may hold of its distinct terms.
BLOCK_BYTES = 4 << 20
#: Raw spellings whose term a worker keeps, and terms of a text that are counted in one go.
MEMO, SLICE = 500_000, 200_000
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BIG = np.iinfo(np.int64).max


def terms_of(text: str | None) -> set[str]:
    return set(TERM.findall(text.translate(LOWER))) if text else set()


def posted(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """doc_id, n, terms, tfs: documents with terms, how many they have, and the numbers and counts of those in `number`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}

        def known(word: str) -> int:
            at = memo.get(word)
            if at is None:
                at = memo[word] = number.get(word.translate(LOWER), -1)
            return at

        for batch in batches:
            ids, sizes, terms, tfs, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(memo) > MEMO:
                    memo.clear()
                words = (m.group() for m in TERM.finditer(text.as_py())) if len(text.as_py()) > 1 << 20 else iter(TERM.findall(text.as_py()))
                seen: Counter = Counter()
                while part := list(itertools.islice(words, SLICE)):
                    found = list(map(memo.get, part))
                    seen.update(map(known, part) if None in found else found)
                n = seen.total()
                if not n:
                    continue
                seen.pop(-1, None)
                at = sorted(seen)
                ids.append(doc_id)
                sizes.append(n)
                terms += at
                tfs += [seen[t] for t in at]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's occurrences add to a document's score."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def norms(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 less half the pull of a document's length against the mean; beyond 64 bits in Python's integers."""
    if len(n) and int(n.max()) * 50 * documents >= BIG:
        return np.array([50 + (50 * int(x) * documents) // total for x in n], np.int64)
    return 50 + (50 * n * documents) // total


class Shard:
    """Impact lists of a shard's documents: by term and falling impact, and by document for direct access."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int, terms: int):
        self.size, self.terms = size, terms
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1))
        key = self.doc.astype(np.int64) * terms + term[order]
        self.place = np.argsort(key, kind="stable")
        self.key = key[self.place]

    def search(self, terms: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, shard_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of (scores, ids) and this shard's documents for a query's terms."""
        lists = [(self.start[t], self.start[t + 1]) for t in terms if self.start[t] < self.start[t + 1]]
        terms = np.array([t for t in terms if self.start[t] < self.start[t + 1]], np.int64)
        if not lists:
            return scores, ids
        met = np.zeros(self.size, bool)
        seen = [np.zeros(hi - lo, bool) for lo, hi in lists]
        best = [0] * len(lists)
        depth, step = 0, 8
        while True:
            new = np.unique(np.concatenate([self.doc[lo + depth : min(hi, lo + depth + step)] for lo, hi in lists]))
            new = new[~met[new]]
            depth, step = depth + step, min(step * 2, 256)
            if len(new):
                met[new] = True
                key = new.astype(np.int64)[:, None] * self.terms + terms
                at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                has = self.key[at] == key
                place = self.place[at]
                total = np.where(has, self.impact[place], 0).sum(axis=1)
                for i, (lo, _) in enumerate(lists):
                    seen[i][place[has[:, i], i] - lo] = True
                good = total > 0
                scores, ids = top(np.concatenate([scores, total[good]]), np.concatenate([ids, shard_ids[new[good]]]), k)
            bound = 0
            for i, (lo, hi) in enumerate(lists):
                rest = seen[i][best[i] :]
                gap = int(rest.argmin()) if len(rest) else 0
                best[i] = hi - lo if not len(rest) or rest[gap] else best[i] + gap
                if best[i] < hi - lo:
                    bound += int(self.impact[lo + best[i] - 1])
            if not bound or (len(scores) == k and bound < scores[-1]):
                return scores, ids


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores with their ids, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        stay = scores >= least
        scores, ids = scores[stay], ids[stay]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _searched(rows: DataFrame, queries: list[tuple[int, np.ndarray]], weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """q, doc_id, score: each task's k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        found = {q: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for q, _ in queries}

        def search(part: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(part).combine_chunks()
            size = t.num_rows
            # No id is BIG, and stands behind all ids.
            ids = t["doc_id"].fill_null(BIG).to_numpy()
            m = norms(t["n"].to_numpy(), documents, total)
            lists = t["terms"].combine_chunks()
            term, tf = lists.flatten().to_numpy().astype(np.int64), t["tfs"].combine_chunks().flatten().to_numpy()
            doc = np.repeat(np.arange(size), np.diff(lists.offsets.to_numpy()))
            shard = Shard(doc, term, impacts(weight[term], tf, m[doc]), size, len(weight))
            for q, terms in queries:
                found[q] = shard.search(terms, *found[q], k, ids)

        for part in sharded(batches):
            search(part)
        for q, (scores, ids) in found.items():
            if len(scores):
                yield pd.DataFrame({"q": q, "doc_id": ids, "none": ids == BIG, "score": scores})

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    out = rows.mapInArrow(arrow, "q long, doc_id long, none boolean, score long")
    return out.select("q", F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "score")


def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together to at least SHARD rows, but for the last."""
    part, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            part.append(batch)
            rows += batch.num_rows
        if rows >= SHARD:
            yield part
            part, rows = [], 0
    if part:
        yield part


def ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 of each item (item_id, text)."""
    items = items.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    out = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = _block(docs, part, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        spark = docs.sparkSession
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def _block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """`search` for items whose texts have a bounded size."""
    asked = [(i, r["item_id"], terms_of(r["text"])) for i, r in enumerate(items.collect())]
    words = sorted(set().union(*(t for *_, t in asked)))
    number = {w: i for i, w in enumerate(words)}
    spark = docs.sparkSession
    rows = written(posted(docs, number), "postings")
    documents, total = (x or 0 for x in rows.agg(F.count("*"), F.sum("n")).first())
    weight = np.zeros(max(len(words), 1), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
        weight[r["t"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1)))
    queries = [(i, np.array(sorted(number[w] for w in t), np.int64)) for i, _, t in asked if t]
    found = _searched(rows, queries, weight, documents, total, k)
    near = ranked(found.withColumn("salt", F.spark_partition_id() % 256), ["q", "salt"], k)
    best = ranked(near.select("q", "doc_id", "score"), ["q"], k)
    names = spark.createDataFrame([(i, item) for i, item, _ in asked], f"q long, item_id {items.schema['item_id'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of each item's 50 best documents."""
    return search(docs, items)
