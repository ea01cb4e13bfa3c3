"""SimHash near-duplicate groups found with deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that differ in at most
three bits one segment differs in at most one, so both share a variant of that segment with one bit
left out. Each distinct fingerprint is indexed under its 64 one-wildcard variants; fingerprints that
meet under a variant are verified and linked; links become components.

A variant that very many fingerprints share is compared in tiles: a task holds two blocks of BLOCK
fingerprints at most, and only links of a spanning forest leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .graph import components

BLOCK = 2048
SEED = 42


def words_of(text: str) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint_of(text: str, width: int = 3) -> int:
    """Unsigned SimHash over word shingles: a bit is set if it is set in over half of the hashes."""
    return fingerprint_of_words(words_of(text), width)


def fingerprint_of_words(words: list[bytes], width: int = 3) -> int:
    """The SimHash of a text's words."""
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = np.array([digest(s, SEED) for s in shingles[at : at + (1 << 16)]], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """`docs` with a signed 64-bit fingerprint column; null text counts as empty."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint_of(t, width) for t in texts], np.uint64)
        return pd.Series(values.view(np.int64), dtype="int64")

    return docs.withColumn(out, fingerprints(text_of(text)))


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the links (a[i], b[i]) that a spanning forest needs."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := top(x)) != (y := top(y)):
            up[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


def _own(key: np.ndarray | int, x: np.ndarray, distance: int) -> np.ndarray:
    """Which differences x (a ^ b) are within `distance` and belong to this variant.

    A link belongs to the low segment if that differs in at most one bit, else to the high one; there
    to the bit that differs, or to bit 0. So each link is made under one variant.
    """
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    segment = np.where(np.bitwise_count(low) <= 1, np.uint64(0), np.uint64(1))
    part = np.where(segment == 0, low, high)
    single = np.bitwise_count(part) <= 1
    bit = np.where(part == 0, np.uint64(0), np.bitwise_count(part - np.uint64(1)).astype(np.uint64))
    tag = (np.asarray(key, np.int64) >> 32).astype(np.uint64)
    return (np.bitwise_count(x) <= distance) & single & (segment * np.uint64(32) + bit == tag)


def _links(key: int, left: np.ndarray, right: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links within `left`, or between `left` and `right`, under one variant."""
    xs, ys = [], []
    step = max(1, (1 << 20) // max(1, len(left if right is None else right)))
    other = left if right is None else right
    for at in range(0, len(left), step):
        i, j = np.nonzero(_own(key, left[at : at + step, None] ^ other[None, :], distance))
        keep = j > i + at if right is None else np.ones(len(i), bool)
        xs.append(left[at + i[keep]])
        ys.append(other[j[keep]])
    a, b = np.concatenate(xs), np.concatenate(ys)
    kept = _forest(a, b)
    return a[kept], b[kept]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows (key, block, a, b): links have block -1, put-off members have b null-like 0."""
    key, block, a, b = (np.concatenate([np.atleast_1d(r[i]) for r in rows]) for i in range(4))
    return pd.DataFrame({"key": key.astype(np.int64), "block": block.astype(np.int32), "a": a.view(np.int64), "b": b.view(np.int64)})


def _within_runs(distance: int, block: int):
    """Over rows (key, fp) sorted by key: links within each run's blocks; members of longer runs are put off."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key: int | None = None
        held: np.ndarray = np.zeros(0, np.uint64)
        number = 0

        def close(key: int, fps: np.ndarray, more: bool) -> list[tuple]:
            out = []
            if len(fps) > 1:
                a, b = _links(key, fps, None, distance)
                out.append((np.full(len(a), key), np.full(len(a), -1), a, b))
            if more or number:
                out.append((np.full(len(fps), key), np.full(len(fps), number), fps, np.zeros(len(fps), np.uint64)))
            return out

        for batch in batches:
            keys, fps = batch["key"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64).view(np.uint64)
            if not len(keys):
                continue
            rows: list[tuple] = []
            ends = np.append(np.nonzero(np.diff(keys))[0] + 1, len(keys))
            starts = np.append(0, ends[:-1])
            # Runs inside the batch of one or two members: no loop.
            inner = np.ones(len(starts), bool)
            inner[[0, -1]] = False
            two = starts[inner & (ends - starts == 2)]
            if len(two):
                ok = _own(keys[two], fps[two] ^ fps[two + 1], distance)
                rows.append((keys[two[ok]], np.full(ok.sum(), -1), fps[two[ok]], fps[two[ok] + 1]))
            for s, e in zip(*(v[~inner | (ends - starts > 2)].tolist() for v in (starts, ends)), strict=True):
                key = int(keys[s])
                if key != held_key:
                    if held_key is not None:
                        rows += close(held_key, held, False)
                    held_key, held, number = key, np.zeros(0, np.uint64), 0
                held = np.concatenate([held, fps[s:e]])
                while len(held) > block:
                    rows += close(key, held[:block], True)
                    held, number = held[block:], number + 1
            if rows and sum(len(r[0]) for r in rows):
                yield _frame(rows)
        if held_key is not None and (rows := close(held_key, held, False)):
            yield _frame(rows)

    return run


def _between_tiles(distance: int):
    """Over rows (key, i, j, block, a) sorted by key, i, j: links between block i and block j."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, parts = None, {}

        def close() -> pd.DataFrame | None:
            if tile is None or len(parts) < 2:
                return None
            left, right = (np.concatenate(parts[k]) for k in sorted(parts))
            a, b = _links(tile[0], left, right, distance)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            for name, group in batch.groupby(["key", "i", "j"], sort=False):
                if name != tile:
                    if (out := close()) is not None and len(out):
                        yield out
                    tile, parts = name, {}
                for number, g in group.groupby("block"):
                    parts.setdefault(int(number), []).append(g["a"].to_numpy(np.int64).view(np.uint64))
        if (out := close()) is not None and len(out):
            yield out

    return run


def links(fingerprints: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints `fp` differing in at most `distance` (0 to 3) bits.

    Not every pair is returned, but every pair within the distance is connected by links.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    fps = fingerprints.select("fp").distinct()
    variants = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda tag: tag.cast("long") * F.lit(1 << 32)
        + F.when(tag < 32, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseAND(
            F.bitwise_not(F.expr("1L") * F.pow(F.lit(2), tag % 32).cast("long"))
        ),
    )
    index = fps.select(F.explode(variants).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    found = written(index.mapInPandas(_within_runs(distance, block), "key long, block int, a long, b long"), "links")
    direct = found.filter("block = -1").select("a", "b")
    late = found.filter("block >= 0")
    blocks = late.groupBy("key").agg(F.max("block").alias("last"))
    tiles = (
        late.join(blocks, "key")
        .select("key", "block", "a", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
        .filter("other != block")
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    return direct.union(tiles.mapInPandas(_between_tiles(distance), "a long, b long"))


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links reach, itself included. Null and empty texts have
    fingerprint zero and are linked as any other; repeated rows stay and share their component; a null
    doc_id stays and is passed over when the smallest is sought; an empty table gives an empty one.
    Columns besides doc_id and text are not read.
    """
    marked = written(with_fingerprints(docs.select("doc_id", "text"), width=width).select("doc_id", "fp"), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(marked, distance, block)).withColumnRenamed("node", "fp")
    grouped = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(grouped.join(names, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def with_text_hash(docs: DataFrame) -> DataFrame:
    """`docs` with a 128-bit hash of the text in two columns, _h1 and _h2; null text counts as empty."""
    return docs.withColumn("_h1", F.xxhash64(text_of())).withColumn("_h2", F.xxhash64(text_of(), F.lit(7)))


def survivors(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of `docs` for each root of `rooted` (doc_id, _h1, _h2, root; a row for each of `docs`).

    The row with the smallest doc_id stays, nulls last, then the one with the smallest hash of its text.
    Rows are told apart by doc_id and text, so null and repeated ids take no other text along.
    """
    same = rooted.groupBy("root", "doc_id", "_h1", "_h2").agg(F.count("*").alias("_rows"))
    least = same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h1", "_h2", "_rows")).alias("r"))
    keep = written(least.select(F.col("r.doc_id").alias("_keep"), F.col("r._h1").alias("_k1"), F.col("r._h2").alias("_k2"), "r._rows"), "keep")
    hashed = with_text_hash(docs)
    of_row = F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2"))
    once = hashed.join(keep.filter("_rows = 1"), of_row, "left_semi")
    more = hashed.join(keep.filter("_rows > 1"), of_row, "left_semi").dropDuplicates(["doc_id", "_h1", "_h2"])
    return once.unionByName(more).select(*docs.columns)


def one_of_each(docs: DataFrame, distance: int = 3) -> DataFrame:
    """`docs` without the near-duplicates: of each component of fingerprints one row stays (see `survivors`)."""
    marked = written(with_fingerprints(with_text_hash(docs.select("doc_id", "text"))).select("doc_id", "_h1", "_h2", "fp"), "fingerprints")
    roots = components(links(marked, distance)).withColumnRenamed("node", "fp")
    return survivors(docs, marked.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every document."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
