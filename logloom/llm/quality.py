"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, a linear scorer.

Each labeller votes good (1), bad (-1) or nothing (0) on a text. Votes are counted by pattern over all documents, so at most 3^7 rows reach the driver, where EM estimates how often each labeller
votes each way on good and on bad texts, and the posterior of every pattern. A logistic scorer over hashed
words and character shapes is fitted to posteriors of a bounded sample and scores whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SAMPLE = 4000
FEATURES = 1 << 15
ROUNDS = 100
EPOCHS = 12

_SYMBOLS = b"#$%&*+=<>@[]^_`{|}~\\/"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUNS = re.compile(rb"[!-\-/:-@\[-`{-~]{2,}")


def labellers(text: str) -> list[int]:
    """Votes of the heuristics on a text: most find one kind of junk and say nothing of other texts.

    In order: symbols, runs of marks, capitals, words said twice in a row, repeated lines, few different words,
    and sentences (the one that also votes good).
    """
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, count = max(len(text), 1), max(len(words), 1)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    marks = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    lines = [x for x in text.split("\n") if x]
    length = n / count
    against = [
        symbols / n > 0.03,
        len(_RUNS.findall(raw)) / count > 0.1,
        capitals / n > 0.25,
        sum(map(eq, words, words[1:])) / count > 0.15,
        len(lines) > 2 and 1 - len(set(lines)) / len(lines) > 0.25,
        count > 40 and len(set(words)) / count < 0.2,
    ]
    sentences = 1 if 0.02 < marks / count < 0.3 and 3 < length < 10 else -1 if not marks or length > 14 else 0
    return [-int(x) for x in against] + [sentences]


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, rates[class, labeller, vote + 1], prior of good).

    votes: patterns x labellers of -1, 0, 1. Labellers are independent given the class; the start calls a
    text bad by its share of votes against among all votes on it, so good is what they call good.
    """
    total = counts.sum()
    against = (votes < 0).sum(axis=1) / np.maximum((votes != 0).sum(axis=1), 1)
    post = np.clip(0.95 - against, 0.05, 0.95)
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    rates, prior = np.zeros((2, votes.shape[1], 3)), 0.5
    for _ in range(rounds):
        for c, w in enumerate((counts * (1 - post), counts * post)):
            rates[c] = ((w[:, None, None] * hot).sum(axis=0) + 1) / (w.sum() + 3)
        prior = float(np.clip((counts * post).sum() / max(total, 1), 0.02, 0.98))
        logs = np.einsum("plv,clv->cp", hot, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -40, 40)))
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return post, rates, prior


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, values): roots of counts of hashed words, word forms and echoes, of length one."""
    found: Counter = Counter()
    for w, times in Counter(text.split()).items():
        found[crc32(w.encode("utf-8", "surrogatepass")) % FEATURES] += times
        last = w[-1]
        form = (w.isupper(), w.islower(), w.isalpha(), last.isalnum(), last in ".,", min(len(w), 16) // 4)
        found[crc32(repr(form).encode()) % FEATURES] += times
    words = text.split()
    echoes = sum(map(eq, words, words[1:]))
    if echoes:
        found[crc32(b"echo") % FEATURES] += echoes
    if not found:
        return np.zeros(1, np.int64), np.ones(1)
    at = np.fromiter(found.keys(), np.int64, len(found))
    values = np.sqrt(np.fromiter(found.values(), np.float64, len(found)))
    return at, values / np.sqrt((values * values).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic scorer by adaptive gradient steps on soft labels, classes balanced."""
    w, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    share = float(np.clip(target.mean(), 0.02, 0.98))
    bias = 0.0
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ v + bias, -30, 30)))
            g = (p - target[i]) * (target[i] * 0.5 / share + (1 - target[i]) * 0.5 / (1 - share))
            step = g * v
            squares[at] += step * step
            w[at] -= 0.3 * step / np.sqrt(squares[at])
            bias -= 0.02 * g
    return w, bias


def scored(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`docs` with weak_label (the votes' posterior of good) and score (the linear scorer's), 0 to 1.

    Null text counts as empty; an empty text is voted on as any other, a very long one whole; repeated rows are each
    scored and count once in the sample, whose ties go by hash; an empty table gives no rows. Columns weak_label and
    score of the input are replaced. The scorer is fitted on the `sample` texts with the smallest hashes.
    """
    text = text_of()

    @F.pandas_udf("array<int>")
    def votes_of(texts: pd.Series) -> pd.Series:
        return pd.Series([labellers(t) for t in texts])

    counted = docs.select(votes_of(text).alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect()  # one row a pattern of votes
    if not counted:
        return docs.withColumn("weak_label", F.lit(0.5)).withColumn("score", F.lit(0.5))
    patterns = np.array([r["v"] for r in counted])
    post, _, _ = expectation_maximisation(patterns, np.array([r["n"] for r in counted], float))
    label = {tuple(map(int, p)): float(x) for p, x in zip(patterns, post, strict=True)}
    # At most `sample` texts, by hash, are fitted on; hashes are picked first, so no more texts are moved, and what
    # reaches the driver of a text are its features, at most FEATURES of them.
    hashed = docs.select(F.xxhash64(text).alias("h"), text.alias("text"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    picked = hashed.filter(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text"))

    @F.pandas_udf("struct<at:array<int>,value:array<float>,v:array<int>>")
    def learned(texts: pd.Series) -> pd.DataFrame:
        found = [features(t) for t in texts]
        return pd.DataFrame({"at": [x.astype(np.int32) for x, _ in found], "value": [v.astype(np.float32) for _, v in found], "v": [labellers(t) for t in texts]})

    rows = picked.select("h", learned("text").alias("f")).select("h", "f.*").toPandas().sort_values("h", kind="stable")
    target = np.array([label[tuple(map(int, v))] for v in rows["v"]])
    weights, bias = fit([(np.asarray(x, np.int64), np.asarray(v, np.float64)) for x, v in zip(rows["at"], rows["value"], strict=True)], target)
    weights = weights.astype(np.float32)

    @F.pandas_udf("struct<weak_label:double,score:double>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        out = np.empty((len(texts), 2))
        for i, t in enumerate(texts):
            at, v = features(t)
            out[i] = label[tuple(labellers(t))], weights[at] @ v + bias
        out[:, 1] = 1 / (1 + np.exp(-np.clip(out[:, 1], -30, 30)))
        return pd.DataFrame(out, columns=["weak_label", "score"])

    own = [F.col(c) for c in docs.columns if c not in ("weak_label", "score")]
    judged = docs.select(*own, judge(text).alias("_judged"))
    return judged.select(*own, F.col("_judged.weak_label").alias("weak_label"), F.col("_judged.score").alias("score"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, weak_label, score, keep (1 if score >= 0.5, else 0) for every document."""
    found = scored(docs.select("doc_id", "text"))
    return found.select("doc_id", "weak_label", "score", (F.col("score") >= 0.5).cast("int").alias("keep"))
