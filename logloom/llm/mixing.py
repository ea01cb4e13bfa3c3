"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed for each (source, language, topic) cell; categories without a target form one other
category, so the cells are bounded by the targets, whatever the input. Raking multiplies the cells' weights
until source, language and topic shares of the weighted tokens meet their targets, with no weight above the
one that would ask for a document more than once. Each document is then kept with its cell's probability,
by a hash of its id and text.

Targets are a parameter. Where none are given they follow from the corpus: the root of each category's share
of the tokens, so large sources and languages give way to small ones.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

OTHER = "*"
DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Targets:
    """Wanted shares of tokens; what they leave of 1 goes to all other categories together."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]
    fraction: float = 0.6
    seed: int = 17


#: Categories of a dimension that get a target of their own when targets follow from the corpus.
NAMED = 64


def topic_of(text: Column) -> Column:
    """A coarse topic by form: licence notes, symbol-heavy text, many short lines, or prose."""
    n = F.greatest(F.char_length(text), F.lit(1))
    symbols = F.char_length(F.translate(text, "#$%&*+=<>@[]^_`{|}~\\/!", ""))
    lines = n - F.char_length(F.translate(text, "\n", "")) + 1
    return (
        F.when(F.lower(text).contains("licens"), F.lit("licensed"))
        .when((n - symbols) / n > 0.08, F.lit("symbols"))
        .when(n / lines < 300, F.lit("lines"))
        .otherwise(F.lit("prose"))
    )


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def rake(mass: np.ndarray, targets: list[np.ndarray], fraction: float, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(weights, probabilities) of the cells of `mass` (tokens; one axis for each of `targets`).

    Weighted shares meet the targets where cells with tokens allow it; a category without tokens leaves its
    share to the others. Probabilities are weights times one factor, 1 at most, and keep about `fraction` of
    all tokens.
    """
    total = mass.sum()
    if not total:
        return np.ones_like(mass), np.full_like(mass, fraction)
    wanted = []
    for axis, share in enumerate(targets):
        has = mass.sum(axis=tuple(a for a in range(mass.ndim) if a != axis)) > 0
        share = np.where(has, share, 0.0)
        wanted.append(share / share.sum() if share.sum() else has / has.sum())
    keep = fraction * total
    p = np.where(mass > 0, fraction, 0.0)
    for _ in range(rounds):
        before = p.copy()
        for axis, share in enumerate(wanted):
            others = tuple(a for a in range(mass.ndim) if a != axis)
            now = (p * mass).sum(axis=others)
            ratio = np.divide(share * keep, now, out=np.ones_like(share), where=now > 0)
            p = np.minimum(p * ratio.reshape([-1 if a == axis else 1 for a in range(mass.ndim)]), 1.0)
        if np.abs(p - before).max() < 1e-10:
            break
    else:
        logging.getLogger(__name__).warning("raking moved by %.2g in its last of %d rounds", np.abs(p - before).max(), rounds)
    return p / fraction, p


def shapes(docs: DataFrame, topic: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, _source, _lang, _topic, n_tokens and _draw (0 to 1, by id and text) of every row of `docs`, and columns to keep."""
    text = text_of()
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), text, F.lit(Targets.seed)), 11) / F.lit(float(1 << 53))
    return docs.select(
        "doc_id", *keep, *[(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(f"_{c}") for c in ("source", "lang")],
        (topic_of(text) if topic is None else topic).alias("_topic"), tokens_of(text).alias("n_tokens"), draw.alias("_draw"),
    )


def flattened(shaped: DataFrame, most: int = NAMED) -> Targets:
    """Targets that follow from `shaped`: roots of the token shares, of the `most` largest categories each."""
    found = {}
    for d in DIMENSIONS:
        per = shaped.groupBy(F.col(f"_{d}").alias("name")).agg(F.sum("n_tokens").alias("n"))
        total = per.agg(F.sum("n")).first()[0] or 1
        top = per.filter("name is not null and n > 0").orderBy(F.desc("n"), "name").limit(most).collect()
        roots = {r["name"]: float(np.sqrt(r["n"] / total)) for r in top}
        rest = float(np.sqrt(max(0.0, 1 - sum(r["n"] for r in top) / total)))
        found[d] = {k: v / (sum(roots.values()) + rest) for k, v in roots.items()}
    return Targets(**found)


def _category(column: str, names: dict[str, float]) -> Column:
    return F.when(F.col(column).isin(list(names)), F.col(column)).otherwise(F.lit(OTHER))


def factors(shaped: DataFrame, targets: Targets) -> DataFrame:
    """_source, _lang, _topic, weight, probability of every cell that `shaped` has; a row a cell, bounded by the targets."""
    named = {d: getattr(targets, d) for d in DIMENSIONS}
    names = [[*named[d], OTHER] for d in DIMENSIONS]
    mass = np.zeros([len(n) for n in names])
    seen = np.zeros(mass.shape, bool)
    keys = [_category(f"_{d}", named[d]).alias(d) for d in DIMENSIONS]
    for r in shaped.groupBy(*keys).agg(F.sum("n_tokens").alias("n")).collect():  # bounded by the targets
        at = tuple(n.index(r[d]) for n, d in zip(names, DIMENSIONS, strict=True))
        mass[at], seen[at] = r["n"], True
    shares = [np.array([*named[d].values(), max(0.0, 1 - sum(named[d].values()))]) for d in DIMENSIONS]
    weight, p = rake(mass, shares, targets.fraction)
    empty = seen & (mass == 0)
    weight[empty], p[empty] = 1.0, targets.fraction
    rows = [(*(names[a][i] for a, i in enumerate(at)), float(weight[tuple(at)]), float(p[tuple(at)])) for at in np.argwhere(seen)]
    rows = rows or [(OTHER, OTHER, OTHER, 1.0, targets.fraction)]
    return shaped.sparkSession.createDataFrame(rows, "_source string, _lang string, _topic string, weight double, probability double")


def _drawn(shaped: DataFrame, cells: DataFrame, targets: Targets) -> DataFrame:
    """`shaped` with its categories, and weight, probability and sampled of its cell."""
    marked = shaped.withColumns({f"_{d}": _category(f"_{d}", getattr(targets, d)) for d in DIMENSIONS})
    return marked.join(F.broadcast(cells), ["_source", "_lang", "_topic"]).withColumn("sampled", F.col("_draw") < F.col("probability"))


def report(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """doc_id, source, lang, topic (categories), n_tokens, weight, probability, sampled for every row of `docs`.

    Each text is read once; cells and draws are made on a narrow table of it. Null sources and languages, missing
    columns and names without a target count as the other category. Documents without tokens are kept with their
    cell's probability. Rows of one id and text are drawn together; ties in the order of categories go to the smaller
    name; an empty table gives none. Other columns are not read.
    """
    shaped = written(shapes(docs), "shapes")
    targets = flattened(shaped) if targets is None else targets
    found = _drawn(shaped, factors(shaped, targets), targets)
    return found.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), "n_tokens", "weight", "probability", "sampled")


def mixed(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The sampled rows of `docs`, with its columns alone (see `report`)."""
    shaped = written(shapes(docs).select("_source", "_lang", "_topic", "n_tokens").groupBy("_source", "_lang", "_topic").agg(F.sum("n_tokens").alias("n_tokens")), "cells")
    targets = flattened(shaped) if targets is None else targets
    plain = docs.select(F.struct(*docs.columns).alias("_row"))
    inner = plain.select("_row", *[F.col(f"_row.`{c}`").alias(c) for c in ("doc_id", "text", "source", "lang") if c in docs.columns])
    found = _drawn(shapes(inner, keep=("_row",)), factors(shaped, targets), targets).filter("sampled")
    return found.select("_row.*")

