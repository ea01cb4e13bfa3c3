"""I-Match document fingerprints on several randomised lexicons, in built-in functions only.

The lexicon holds the terms whose document frequency, counted over all documents for each term, lies in a band.
As every lexicon term is in at least the band's lower share of the documents, it has at most the mean number of
terms of a text over that share, whatever the input. It becomes a set of at most 2^21 bits in which a term has
three places: a lexicon term always passes, another one with a chance of some per cent at most, and a term passes
in all texts or in none. A document's distinct lexicon terms are sorted by hash, and each randomised sub-lexicon (a hashed
share of the lexicon, from a quarter to a thousandth, in several families) gives the hash of the terms it
keeps. Thin sub-lexicons keep a few terms of a long document, thick ones those of a short one, so some
hashes outlive an edit. A text without lexicon terms keeps all its terms, one without terms is hashed whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

MOST_BITS = 21
PLACES = 3
BAND = (0.002, 0.05)
FAMILIES = 8
LEVELS = 5
RANGES = 256
RANGE_ROWS = 16_000
EMPTY = "-"


def terms(text: Column) -> Column:
    """Distinct hashed terms: letters and digits in a row, lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, total: int, band: tuple[float, float] = BAND) -> DataFrame:
    """(h): the hashed terms whose share of the `total` documents lies in the band."""
    counts = docs.select(F.explode(terms(text_of())).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") >= band[0] * total) & (F.col("n") <= band[1] * total)).select("h")


def bit_set(terms_in: DataFrame) -> list[int]:
    """A power of two of bits in 64-bit words: PLACES bits are set for each term of the table."""
    terms_in = written(terms_in, "lexicon")
    bits = min(MOST_BITS, max(12, (16 * terms_in.count()).bit_length()))
    places = terms_in.select(F.explode(F.array(*[F.shiftrightunsigned("h", 21 * j).bitwiseAND(F.lit((1 << bits) - 1)) for j in range(PLACES)])).alias("b"))
    words = places.groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    out = [0] * ((1 << bits) // 64)
    for r in words.collect():  # at most 2^MOST_BITS / 64 rows
        out[r["word"]] = r["bits"]
    return out


def fingerprint(text: Column, band: list[int]) -> Column:
    """FAMILIES x LEVELS hashes of eight hex digits, EMPTY where a sub-lexicon keeps no term of the text."""
    known = F.split(F.lit(",".join(map(str, band))), ",").cast("array<long>")
    mask = 64 * len(band) - 1

    def at(h: Column, j: int) -> Column:
        b = F.shiftrightunsigned(h, 21 * j).bitwiseAND(F.lit(mask))
        return F.getbit(F.element_at(known, (F.shiftright(b, 6) + 1).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1

    def inside(h: Column) -> Column:
        return reduce(lambda x, y: x & y, [at(h, j) for j in range(PLACES)])

    def code(kept: Column) -> Column:
        digits = F.substring(F.lpad(F.lower(F.hex(F.xxhash64(kept))), 16, "0"), 1, 8)
        return F.when(F.size(kept) == 0, F.lit(EMPTY)).otherwise(digits)

    def levels(family: int, level: int, outer: Column) -> Column:
        mask = (1 << 2 * level) - 1
        kept = F.filter(outer, lambda h: F.shiftrightunsigned(h, 6 * family).bitwiseAND(F.lit(mask)) == 0)

        def each(own: Column) -> Column:
            codes = F.array(code(own))
            return codes if level == LEVELS else F.concat(codes, levels(family, level + 1, own))

        return F.flatten(F.transform(F.array(kept), each))

    def of_terms(all_terms: Column) -> Column:
        return F.flatten(F.transform(F.array(F.filter(all_terms, inside)), lambda own: F.array(F.when(F.size(own) > 0, own).otherwise(all_terms))))

    def of_text(found: Column) -> Column:
        return F.when(F.size(found) > 0, F.sort_array(found)).otherwise(F.array(F.xxhash64(text)))

    def bind(value: Column, body) -> Column:
        """body(value) with the value computed once."""
        return F.element_at(F.transform(F.array(value), body), 1)

    chosen = bind(terms(text), lambda t: F.element_at(of_terms(t), 1))
    codes = bind(bind(chosen, of_text), lambda own: F.concat(*[levels(j, 1, own) for j in range(FAMILIES)]))
    mixed = bind(codes, lambda c: F.when(F.forall(c, lambda x: x == EMPTY), F.array(F.substring(F.sha2(text, 256), 1, 8))).otherwise(c))
    return F.array_join(mixed, " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the sub-lexicons that keep a term of either text; 1 for equal fingerprints."""
    pairs = F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: F.when((x == EMPTY) & (y == EMPTY), F.lit(None)).otherwise((F.coalesce(x, F.lit("")) == F.coalesce(y, F.lit(""))).cast("int")))
    used = F.filter(pairs, lambda x: x.isNotNull())
    same = F.aggregate(used, F.lit(0), lambda s, x: s + x)
    return F.when(a == b, F.lit(1.0)).when(F.size(used) == 0, F.lit(0.0)).otherwise(same / F.size(used))


def with_next(docs: DataFrame, columns: list[str], ranges: int = RANGES, parts: int = 1) -> DataFrame:
    """`docs` (doc_id, `columns`) with next_<column>: the columns of the document after it by descending doc_id.

    The document after the last is the first. Rows are dealt to ranges of doc_id by quantiles, each cut into
    `parts` of equal width; the first row of each range also ends the range before it, so no task sees more than
    a range. Equal ids are ordered by `columns`, and null ids come last.
    """
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    edges = keyed.agg(F.percentile_approx("_id", [i / ranges for i in range(1, ranges)], 10000).alias("q")).first()["q"]
    edges = sorted(set(edges or []))
    bounds = F.array(*[F.lit(x) for x in edges]) if edges else F.array().cast("array<long>")
    keyed = keyed.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col("_id"))))
    if parts > 1 and len(edges) > 1:
        low, high = (F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col("_range") + 1) for xs in ([edges[0], *edges], [*edges, edges[-1]]))
        share = F.when(high > low, (F.col("_id").cast("double") - low) / (high - low)).otherwise(0.0)
        keyed = keyed.withColumn("_range", F.col("_range") * parts + F.greatest(F.least(F.floor(share * parts), F.lit(parts - 1)), F.lit(0)).cast("int"))
    tops = {r["_range"]: r["top"] for r in keyed.groupBy("_range").agg(F.max("_id").alias("top")).collect()}  # one row a range
    order = sorted(tops, reverse=True)
    after = {a: tops[b] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    if not after:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    homes = docs.sparkSession.createDataFrame(list(after.items()), "_range int, _id long")  # one row a range
    firsts = keyed.drop("_range").join(F.broadcast(homes.select("_id")), "_id", "left_semi")  # goes below what makes the columns
    head = firsts.groupBy("_id").agg(F.min(F.struct(*columns)).alias("_h")).join(F.broadcast(homes), "_id")
    ends = head.select(F.lit(None).cast("long").alias("doc_id"), *[F.col(f"_h.{c}").alias(c) for c in columns], "_id", "_range", F.lit(1).alias("_end"))
    every = keyed.select("doc_id", *columns, "_id", "_range", F.lit(0).alias("_end")).unionByName(ends)
    w = Window.partitionBy("_range").orderBy("_end", F.desc("_id"), *columns)
    led = every.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return led.filter("_end = 0").drop("_id", "_range", "_end")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Null text counts as empty; repeated rows follow each other, those of one doc_id in the order of their texts and in
    one task; a null doc_id comes last; a sole document is its own next; very long texts are taken whole; an empty
    table gives no rows. Other columns are not read.
    """
    slim = docs.select("doc_id", text_of().alias("text"))
    total = docs.count()
    band = bit_set(lexicon(slim, total))
    marked = slim.withColumn("fingerprint", fingerprint(F.col("text"), band))
    paired = with_next(marked, ["text", "fingerprint"], parts=max(1, total // (RANGES * RANGE_ROWS))).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.expr("cast(n_chars div 3 as int)")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substr("next_text", F.lit(1), cut))
    paired = paired.withColumn("edited", edited)
    out = paired.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), band).alias("edited_fingerprint"), "next_fingerprint")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
