"""Removal of passages that occur more than once, by sorted sample suffixes and induced windows.

A string of `length` bytes is repeated if it starts at two places. Sorting every suffix of the corpus is
not needed to find all of them. The smallest of the hashed GRAM-byte strings inside a window of `length`
bytes is its anchor; equal windows have equal anchors at equal places, and about one position in a
hundred and forty is an anchor. So

1. anchors are counted over all documents, and only those that occur twice stay; where all bytes in the
   windows of an anchor agree between places, these are repeated, and one of them stays;
2. the suffixes at the remaining anchors are sorted by Spark's external shuffle sort, which spills to
   disk, and each carries its common-prefix value with the suffix before it;
3. the windows that start left of an anchor are induced from that order, step by step: at o bytes to the
   left two windows are equal if their suffixes share length - o bytes (prefix values at the right) and
   their o bytes before the anchor are the same (prefix values of the reversed left contexts).

Passages of some number of words are found in the same way, on the sequence of the words' 64-bit hashes.

Two windows count as equal where a 64-bit hash of the anchor and one of all bytes in its windows agree; windows
of one anchor that differ are compared on bytes. An anchor that more than HOT places share is not sorted in one
task: its windows are counted as (anchor, 64-bit window hash) rows by partial aggregation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

LENGTH = 400
GRAM = 128
HOT = 4096  # contexts of one anchor, of some 600 bytes each, that a task sorts at once
CHUNK = 1 << 20
PASSAGE = 51  # words
BATCH = 4096
WORD_GRAM = 8
SPAN, WORDS, COPY = range(3)  # what begin and end of a span are: bytes, words, or all bytes of a copied text

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, np.int64).view(np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2^64, at least n of each."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for b in (_BASE, inverse):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            both.append(p)
        _powers[size] = (both[0], both[1])
    return _powers[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash mod 2^64 of bytes or 64-bit words."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLE[data] if data.dtype == np.uint8 else data) * _power_tables(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Mixed hash of each `width` items in a row."""
    n = len(sums) - width
    return _mixed((sums[width:] - sums[:n]) * _power_tables(len(sums))[1][:n])


def _span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each span of items, its length taken in."""
    return _mixed((sums[end] - sums[begin]) * _power_tables(len(sums))[1][begin] + (end - begin).astype(np.uint64))


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` keys in a row."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, _MASK, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of all bytes in its windows, its place, and its first and last window start."""
    out: list[tuple[np.ndarray, ...]] = []
    place = np.uint64((1 << 24) - 1)
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        sums = _sums(part)
        h = _hashes(sums, gram)
        keys = (h & ~place) | np.arange(len(h), dtype=np.uint64)
        least = (_window_minima(keys, length - gram + 1) & place).astype(np.int64)
        low = np.append(0, np.flatnonzero(np.diff(least)) + 1)
        high = np.append(low[1:], len(least)) - 1
        p = least[low]
        context = _span_hashes(sums, low, high + length)
        out.append((h[p].view(np.int64), context.view(np.int64), p + at, low + at, high + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(_utf8(text), np.uint8)


def _words_of(text: str) -> np.ndarray:
    """A hash of each word between white space, lower-cased."""
    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    return np.fromiter((digest(_utf8(w)) for w in words), np.uint64, len(words))


def _word_places(text: str, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of spans of words."""
    places = np.array([m.span() for m in re.finditer(r"\S+", text)], np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))
    return at[places[begin, 0]], at[places[end - 1, 1]]


def _anchor_rows(length: int, gram: int, data_of: Callable[[str], np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k1, k2, found = [], [], []
            for a, b, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                data = data_of(text)
                if len(data) >= length:
                    found.append(rows := anchors_of(data, length, gram))
                    k1.append(np.full(len(rows[0]), a))
                    k2.append(np.full(len(rows[0]), b))
            if found:
                cols = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pd.DataFrame({"anchor": cols[0], "context": cols[1], "k1": np.concatenate(k1), "k2": np.concatenate(k2), "p": cols[2], "lo": cols[3], "hi": cols[4]})

    return run


def _contexts(length: int, hot: int, data_of: Callable[[str], np.ndarray]):
    """Over texts with their repeated anchors: the items that the anchors' windows cover, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k1, k2, text, found in zip(batch["k1"], batch["k2"], batch["text"], batch["found"], strict=True):
                data = data_of(text)
                for x in found:
                    lo, hi, p = x["lo"], x["hi"], x["p"]
                    out.append((x["anchor"], x["n"] > hot, data[p : hi + length].tobytes(), data[lo:p][::-1].tobytes(), k1, k2, p, lo, hi))
                if len(out) > BATCH:
                    yield pd.DataFrame(out, columns=_CONTEXT)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=_CONTEXT)

    return run


_CONTEXT = ["anchor", "hot", "right", "left", "k1", "k2", "p", "lo", "hi"]
_CONTEXT_TYPE = "anchor long, hot boolean, right binary, left binary, k1 long, k2 long, p int, lo int, hi int"


def _common(sorted_parts: list[bytes], width: int) -> np.ndarray:
    """Common-prefix length of each string with the one before it."""
    lengths = np.fromiter(map(len, sorted_parts), np.int64, len(sorted_parts))
    out = np.zeros(len(sorted_parts), np.int64)
    for at in range(0, len(sorted_parts), 1024):
        part = sorted_parts[max(0, at - 1) : at + 1024]
        grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), np.uint8).reshape(len(part), width)
        differ = grid[1:] != grid[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        begin = max(0, at - 1) + 1
        out[begin : begin + len(first)] = np.minimum(first, np.minimum(lengths[begin : begin + len(first)], lengths[begin - 1 : begin - 1 + len(first)]))
    return out


def _runs(starts: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, begin and end of the joined spans [start, start + length); sorted by owner and start."""
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(starts) > length))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return owner[first], starts[first], starts[last] + length


def _induced(length: int, unit: int):
    """Over contexts sorted by anchor and right context: spans covered by repeated windows; an item has `unit` bytes."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        anchor = rows["anchor"].to_numpy(np.int64)
        right, left = rows["right"].tolist(), rows["left"].tolist()
        p, lo, hi = (rows[c].to_numpy(np.int64) for c in ("p", "lo", "hi"))
        n = len(rows)
        new = np.append(True, np.diff(anchor) != 0)
        group = np.cumsum(new)
        prefix = _common(right, length * unit) // unit
        prefix[new] = -1
        order = sorted(range(n), key=lambda i: (group[i], left[i]))
        behind = _common([left[i] for i in order], length * unit) // unit
        behind[np.append(True, np.diff(group[order]) != 0)] = -1
        order_at = np.array(order)
        starts, owner = [], []
        first, last = p - hi, p - lo
        left_class = np.zeros(n, np.int64)
        for o in range(int(first.min()), int(last.max()) + 1):
            active = np.flatnonzero((first <= o) & (o <= last))
            if len(active) < 2:
                continue
            left_class[order_at] = np.cumsum(behind < o)
            key = (left_class * (n + 1) + np.cumsum(prefix < length - o))[active]
            by = np.argsort(key, kind="stable")
            same = np.diff(key[by]) == 0
            hit = active[by[np.append(same, False) | np.append(False, same)]]
            if len(hit):
                starts.append(p[hit] - o)
                owner.append(hit)
        if not starts:
            return rows.iloc[:0][["k1", "k2"]].assign(begin=0, end=0)
        s, i = np.concatenate(starts), np.concatenate(owner)
        by = np.lexsort((s, i))
        i, begin, end = _runs(s[by], i[by], length)
        return pd.DataFrame({"k1": rows["k1"].to_numpy()[i], "k2": rows["k2"].to_numpy()[i], "begin": begin, "end": end})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= BATCH:
                rows = pd.concat(held, ignore_index=True)
                anchor = rows["anchor"].to_numpy()
                cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
                if cut:
                    yield solve(rows.iloc[:cut])
                    rows = rows.iloc[cut:]
                held, size = [rows], len(rows)
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _hot_windows(length: int, kind: type):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                found = []
                for left, right in zip(part["left"], part["right"], strict=True):
                    before = np.frombuffer(left, kind)[::-1]
                    found.append(_hashes(_sums(np.concatenate([before, np.frombuffer(right, kind)])), length).view(np.int64))
                times = [len(x) for x in found]
                cols = {c: np.repeat(part[c].to_numpy(), times) for c in ("anchor", "k1", "k2")}
                start = np.repeat(part["lo"].to_numpy(), times) + np.concatenate([np.arange(t) for t in times])
                yield pd.DataFrame(cols | {"window": np.concatenate(found), "start": start})

    return run


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, words: bool = False) -> DataFrame:
    """(k1, k2, begin, end): byte spans of the texts `keyed` (k1, k2, text) that repeated strings cover.

    With `words`, length, gram and spans are in words.

    Spans may overlap, and none comes twice. Copies of a text share their key, and each counts as an occurrence;
    the bytes of one of them are compared.
    """
    data_of, kind = (_words_of, np.uint64) if words else (_bytes_of, np.uint8)
    rows = keyed.filter(F.octet_length("text") >= (2 * length - 1 if words else length))
    anchors = rows.mapInPandas(_anchor_rows(length, gram, data_of), "anchor long, context long, k1 long, k2 long, p int, lo int, hi int")
    anchors = written(anchors, "anchors")
    counts = anchors.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("context") == F.max("context")).alias("same")).filter("n > 1")
    counts = written(counts, "counts")
    twice = written(anchors.join(counts.select("anchor", "same"), "anchor").distinct(), "twice")

    # All bytes of an anchor's windows agree: wholly repeated, and bytes need not be compared.
    span = [F.col("lo").alias("begin"), (F.col("hi") + length).alias("end")]
    alike = twice.filter("same").select("k1", "k2", *span)
    mixed = twice.filter("not same")
    contexts = mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "p", "lo", "hi")).alias("r"))
    contexts = written(contexts, "contexts")
    twins = mixed.join(contexts.filter("n > 1").select("anchor", "context"), ["anchor", "context"]).select("k1", "k2", *span)

    # One text of each context is compared with the other contexts of its anchor.
    kinds = written(contexts.groupBy("anchor").agg(F.count("*").alias("n")), "kinds")
    wanted = (
        contexts.select("anchor", "r.*")
        .join(kinds, "anchor")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("anchor", "n", "p", "lo", "hi")).alias("found"))
    )
    wanted = written(wanted, "wanted")
    one = keyed.join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    bytes_of = one.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "found").mapInPandas(_contexts(length, hot, data_of), _CONTEXT_TYPE)
    bytes_of = written(bytes_of, "bytes")
    usual = bytes_of.filter("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor", "right")
    spans = usual.mapInPandas(_induced(length, kind().itemsize), "k1 long, k2 long, begin int, end int")
    windows = bytes_of.filter("hot").mapInPandas(_hot_windows(length, kind), "anchor long, k1 long, k2 long, window long, start int")
    again = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "window")
    again = written(again, "again")
    hot_spans = windows.join(again, ["anchor", "window"]).select("k1", "k2", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))
    return written(alike.union(twins).union(spans).union(hot_spans), "spans")


_KEPT = "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,n_gone:long,text:string>"


def _without(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    """`data` without its spans, and how many runs they make."""
    if not len(begin):
        return data, 0
    by = np.argsort(begin, kind="stable")
    begin, reach = begin[by], np.maximum.accumulate(end[by])
    first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    stops = reach[np.append(first[1:], len(begin)) - 1].tolist()
    parts = [data[x:y] for x, y in zip([0, *stops], [*begin[first].tolist(), len(data)], strict=True)]
    return b"".join(parts), len(first)


def _kept(with_text: bool, length: int, words: int | None):
    nothing = np.zeros(0, np.int64)

    @F.pandas_udf(_KEPT)
    def kept(texts: pd.Series, begins: pd.Series, ends: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        out = []
        for text, b, e, k in zip(texts, begins, ends, kinds, strict=True):
            data = _utf8(text)
            begin, end, kind = (nothing,) * 3 if b is None else (np.asarray(x) for x in (b, e, k))
            own = (kind == SPAN) | (kind == COPY) & (len(data) >= length)
            left, runs = _without(data, begin[own], end[own])
            digest = hashlib.sha256(left).hexdigest()
            n_left = len(left)
            if words is not None and not own.all():
                copied = (kind == COPY).any() and len(text.split()) >= words
                coded = kind == WORDS
                spans = [np.concatenate(x) for x in zip(_word_places(text, begin[coded], end[coded]), (begin[own], end[own]), strict=True)]
                left = b"" if copied else _without(data, *spans)[0]
            out.append((len(data), len(data) - n_left, runs, digest, len(data) - len(left), left.decode("utf-8", "ignore") if with_text else None))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_gone", "text"])

    return kept


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True, hot: int = HOT, words: int | None = None) -> DataFrame:
    """(row, cut) for every row of `docs`: the row itself, and n_bytes, n_removed, n_spans, kept_sha256, n_gone, text.

    Each byte that a string of `length` bytes covers which starts anywhere else too is removed, judged on
    the input; strings do not cross rows. Null text counts as empty; repeated rows are copies of each
    other; texts shorter than `length` stay whole; `text` leaves out bytes of characters cut in two. Rows may have
    any columns beside text; an empty table gives none.

    With `words`, passages of that many words that start anywhere else too go from `text` as well, however short
    they are; case and the white space between words make no difference there. n_gone counts what `text` lacks.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), text_of().alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64("text", F.lit(7))})
    keys = keyed.select("k1", "k2", "text")
    copies = (
        keys.filter(F.octet_length("text") >= (length if words is None else min(length, 2 * words - 1)))
        .groupBy("k1", "k2")
        .agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("end"))
        .filter("n > 1")
        .select("k1", "k2", F.lit(0).alias("begin"), "end", F.lit(COPY).alias("kind"))
    )
    spans = repeated_spans(keys, length, gram, hot).withColumn("kind", F.lit(SPAN)).union(copies)
    if words is not None:
        spans = spans.union(repeated_spans(keys, words, min(WORD_GRAM, words), hot, True).withColumn("kind", F.lit(WORDS)))
    marked = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end", "kind")).alias("spans"))
    joined = keyed.drop("text").join(marked, ["k1", "k2"], "left")
    return joined.select("row", _kept(with_text, length, words)(text_of("row.text"), F.col("spans.begin"), F.col("spans.end"), F.col("spans.kind")).alias("cut"))


def report(docs: DataFrame, words: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text for every document.

    The counts and the hash are of strings of LENGTH bytes; `text` is what is left where passages of `words` words
    go too (see `cleaned`).
    """
    found = cleaned(docs.select("doc_id", "text"), words=words)
    return found.select("row.doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256", "cut.text")


def without_repeats(docs: DataFrame, words: int | None = None) -> DataFrame:
    """`docs` with the repeated passages taken out of their text; documents left empty by it go.

    Passages are of LENGTH bytes or, where it is given, of `words` words, which may be fewer bytes.
    n_chars, where there is such a column, follows the text; other columns stay as they are, whatever their names.
    """
    changed = F.col("cut.n_gone") > 0
    found = cleaned(docs, words=words).filter("cut.n_gone < cut.n_bytes or cut.n_bytes = 0").filter(~changed | (F.col("cut.text") != ""))
    new = {"text": F.when(changed, F.col("cut.text")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.char_length("cut.text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
