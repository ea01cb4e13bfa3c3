"""Near-duplicates by SimHash, and further ones by the Jaccard similarity of five-word shingles.

Texts whose fingerprints differ in at most DISTANCE bits are linked by `simhash.links`: two segments, variants with
one wildcard, equality join, verified. Copies further apart are added to these: a similarity of 0.8 is some 10 of
64 SimHash bits on average and often 16, where segments with one wildcard would have seven bits and select nothing.
Bands of MinHash values find pairs of that similarity with a chance of 1 - (1 - 0.8^ROWS)^BANDS, 0.9996, and closer
ones more surely. Each such link is then verified on both texts.

A bucket is first compared with its smallest member, which takes a row a member. Only buckets that this
leaves in several components are compared in whole, in tiles of two blocks of about BLOCK texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker_memo, written
from .graph import components
from .simhash import SEED, fingerprint_of_words, links, survivors, with_text_hash, words_of

DISTANCE = 3
WIDTH = 5
LEAST = 0.8
BANDS = 20
ROWS = 5
BLOCK = 256

_random = np.random.default_rng(SEED)
_FACTOR, _SHIFT = (_random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_FACTOR |= np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles_of(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; all words are one shingle where they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    each = np.array([digest(w, SEED) for w in words], np.uint64)
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = _mixed(out + each[i : i + len(out)])
    return np.unique(out)


def _bands(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[None, at : at + 2048] * _FACTOR + _SHIFT).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys + column)
    return keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the Jaccard similarity of two shingle sets is at least `least`."""
    small, large = sorted((len(a), len(b)))
    if not small or small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both) - 1e-9


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    worker_memo(("nearwords",))  # lets go of the memo of another operator
    for batch in batches:
        nodes, fps, bands = [], [], []
        for text in batch["text"]:
            words = words_of(text)
            fps.append(fingerprint_of_words(words))
            nodes.append(xxhash.xxh128_hexdigest(b" ".join(words), SEED))
            bands.append(_bands(shingles_of(words)) if words else [])
        yield batch[["doc_id", "_h1", "_h2"]].assign(node=nodes, fp=np.array(fps, np.uint64).view(np.int64), bands=bands)


def _are_similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows (a, b, text, other): the links whose texts are similar."""
    for batch in batches:
        pairs = zip(batch["text"], batch["other"], strict=True)
        yield batch.loc[[similar(shingles_of(words_of(x)), shingles_of(words_of(y))) for x, y in pairs], ["a", "b"]]


def _tile_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows (key, i, j, block, node, root, text) sorted by key, i, j: links between components in a tile."""
    tile, rows = None, []

    def close() -> pd.DataFrame:
        up: dict[str, str] = {}

        def top(x: str) -> str:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        out = []
        for at, (block, node, root, shingles) in enumerate(rows):
            for other, node2, root2, shingles2 in rows[:at]:
                if (tile[1] == tile[2] or block != other) and (x := top(root)) != (y := top(root2)) and similar(shingles, shingles2):
                    up[max(x, y)] = min(x, y)
                    out.append((node, node2))
        return pd.DataFrame(out, columns=["a", "b"])

    for batch in batches:
        for key, i, j, block, node, root, text in batch.itertuples(index=False):
            if (key, i, j) != tile:
                if len(rows) > 1 and len(out := close()):
                    yield out
                tile, rows = (key, i, j), []
            rows.append((block, node, root, shingles_of(words_of(text))))
    if len(rows) > 1 and len(out := close()):
        yield out


def _near_fingerprints(marked: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints differ in at most `distance` bits, each fingerprint by its smallest node."""
    of_fp = marked.groupBy("fp").agg(F.min("node").alias("least"))
    same = marked.join(of_fp, "fp").filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    ends = of_fp.select(F.col("fp").alias("b"), F.col("least").alias("other"))
    apart = links(marked, distance).join(of_fp.withColumnRenamed("fp", "a"), "a").join(ends, "b")
    return same.union(apart.select(F.col("least").alias("a"), F.col("other").alias("b")))


def rooted(docs: DataFrame, block: int = BLOCK, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, _h1, _h2, root) for every row of `docs`: links of fingerprints and verified links of shingles join all rows of a root.

    Texts of the same words are one node, so texts without words are copies of each other.
    """
    hashed = with_text_hash(docs.select("doc_id", text_of().alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = written(hashed.mapInPandas(_marked, f"doc_id {kind}, _h1 long, _h2 long, node string, fp long, bands array<long>"), "marked")
    per = marked.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    # Buckets of the same members are one.
    buckets = per.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader"), F.bit_xor(F.xxhash64("node")).alias("x")).filter("n > 1")
    buckets = written(buckets.groupBy("n", "leader", "x").agg(F.min("key").alias("key")), "buckets")
    members = written(per.join(buckets.select("key", "n", "leader"), "key"), "members")
    of_node = marked.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("_h1", "_h2")).alias("r"))
    texts = hashed.join(of_node.select("node", "r.*"), ["_h1", "_h2"]).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "texts")

    pairs = members.filter("node != leader").select("node", "leader").distinct()
    both = pairs.join(texts, "node").join(texts.select(F.col("node").alias("leader"), F.col("text").alias("other")), "leader")
    both = both.select(F.col("node").alias("a"), F.col("leader").alias("b"), "text", "other")
    star = written(both.mapInPandas(_are_similar, "a string, b string"), "star")
    first = written(components(_near_fingerprints(marked, distance).union(star)), "first")

    placed = members.filter("n > 2").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed.select("key", "n", "node", "root"), "placed")
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    blocks = F.ceil(F.col("n") / block).cast("int")
    rest = placed.join(several.select("key"), "key", "left_semi").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    tiles = (
        rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .join(texts, "node")
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "text")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    more = tiles.mapInPandas(_tile_links, "a string, b string")
    roots = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    return marked.join(roots, "node", "left").select("doc_id", "_h1", "_h2", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """`docs` with one row of each group of near-duplicates (see `simhash.survivors`)."""
    return survivors(docs, rooted(docs, block))
