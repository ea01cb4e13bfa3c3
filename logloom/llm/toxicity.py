"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

A word is the bag of its three-character subsequences within a span of six characters, each occurrence
weighted by DECAY for every character it skips, so inserted or dropped characters only lower a match.
A sentence is as toxic as its worst words. Labels belong to documents, so the word stems that bear toxic
labels out (witnesses) are picked first, and a squared-hinge SVM is fitted on Nyström features of
witnesses against words of clean text. As the kernel has explicit features, the fitted expansion over
landmarks folds into one weight for each subsequence, and a word costs a few look-ups to score.

Spark counts words by label and scores all texts; the driver only fits on at most WORDS words of at
most TOXIC_ROWS + CLEAN_ROWS labelled rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker_memo, written

TOXIC_ROWS, CLEAN_ROWS = 2000, 5000
WORDS = 6000
LANDMARKS = 240
DECAY = 0.6
SPAN = 6
LENGTH = 24
CODES = 64
MEMO = 150_000
SLICE = 32  # texts whose substrings are held at once
WORST = 4
CLEAN_WEIGHT = 3.0

_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_DROP = re.compile(r"[\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased words between white space; letters set apart by spaces also as one word."""
    text = text.lower()
    return text.split() + ["".join(m.split()) for m in _SPACED.findall(text)]


def tokens_of(text: str) -> set[str]:
    return set(words_of(text))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes (rows of LENGTH, 0 is padding) and the word each row is of; long words take several rows."""
    rows, owner = [], []
    for i, w in enumerate(words):
        w = _DROP.sub("", w)
        coded = [1] + [ord(c) - 95 if "a" <= c <= "z" else 28 + ord(c) % 35 for c in w] + [63] if w else []
        for at in range(0, max(1, len(coded) - 8), LENGTH - 8):
            part = coded[at : at + LENGTH]
            rows.append(part + [0] * (LENGTH - len(part)))
            owner.append(i)
    return np.array(rows, np.int64).reshape(-1, LENGTH), np.array(owner, np.int64)


def _features(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: subsequence numbers, whether they are of real characters, and their weight."""
    for a, b in _OFFSETS:
        x, y, z = codes[:, : LENGTH - b], codes[:, a : LENGTH - b + a], codes[:, b:]
        yield (x * CODES + y) * CODES + z, z > 0, DECAY ** (b - 2)


def _norms(codes: np.ndarray) -> np.ndarray:
    return np.sqrt(sum(w * w * ok.sum(axis=1) for _, ok, w in _features(codes)) + 1e-9)


def _apply(weights: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return sum(w * (weights[f] * ok).sum(axis=1) for f, ok, w in _features(codes)) / norms


def _explicit(codes: np.ndarray, norms: np.ndarray, row: int) -> np.ndarray:
    out = np.zeros(CODES**3, np.float64)
    for f, ok, w in _features(codes[row : row + 1]):
        np.add.at(out, f[ok], w)
    return out / norms[row]


@dataclass
class Model:
    """Weights of subsequences, bias, and the logistic curve over a document's worst words."""

    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        out = np.full(len(words), -np.inf)
        for at in range(0, len(words), 4096):
            codes, owner = _codes(words[at : at + 4096])
            np.maximum.at(out, owner + at, _apply(self.weights, codes, _norms(codes)) + self.bias)
        return out

    def documents(self, texts: pd.Series, memo: dict[str, float]) -> np.ndarray:
        """The WORST highest word scores of each text, -2 where words run out, and the log of its words."""
        bags = [words_of(t) for t in texts]
        new = list(set().union(*bags) - memo.keys())
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(set().union(*bags))
        memo.update(zip(new, self.words(new).tolist(), strict=True))
        out = np.full((len(bags), WORST + 1), -2.0)
        for i, bag in enumerate(bags):
            scores = np.fromiter(map(memo.__getitem__, bag), np.float64, len(bag))
            if len(scores) > WORST:
                scores = np.partition(scores, len(scores) - WORST)[-WORST:]
            out[i, : len(scores)] = np.sort(scores)[::-1]
            out[i, WORST] = np.log1p(len(bag))
        return np.clip(out, -2.0, 20.0)

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + worst @ self.curve[1:], -30, 30)))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Newton steps on the active set; y is -1 or 1."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag(np.append(np.full(z.shape[1], ridge), 1e-6)) * weight.sum()
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(penalty + (xa.T * wa) @ xa, xa.T @ (wa * y[active]))
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (p * (1 - p) + 1e-6)) @ x + np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
        step = np.linalg.solve(h, x.T @ (y - p) - np.append(0, np.full(x.shape[1] - 1, ridge)) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def grams_of(word: str) -> set[str]:
    """Substrings of four and five characters of a word, its first place marked; a short word whole."""
    w = "^" + _DROP.sub("", word)
    return {w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1)} or {w}


def witnesses(pairs: pd.DataFrame, lift: dict[str, float], cover: int = 3, share: float = 0.003) -> list[str]:
    """Grams (doc, gram) that cover each toxic document `cover` times, the most covering and telling first.

    A gram that only occurs in documents that others have covered, as in copies of one text, is left out.
    """
    docs = {w: set(g) for w, g in pairs.groupby("gram")["doc"]}
    need = dict.fromkeys(pairs["doc"].unique(), cover)
    least, out = max(3, share * len(need)), []
    heap = [(-len(d) * lift[w], w) for w, d in docs.items()]
    heapq.heapify(heap)
    while heap:
        gain, word = heapq.heappop(heap)
        now = sum(need[d] > 0 for d in docs[word])
        if now < least:
            continue
        if now * lift[word] < -gain - 1e-9:
            heapq.heappush(heap, (-now * lift[word], word))
            continue
        out.append(word)
        for d in docs[word]:
            need[d] -= 1
    return out


def fit_words(words: list[str], bad: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, float]:
    """Subsequence weights and bias of the SVM.

    words are ordered from telling to plain; bad and good are the shares of toxic and clean documents with
    the word, which weigh its toxic and its clean example. The landmarks are the most telling words, then
    an even pick of the rest.
    """
    codes, owner = _codes(words)
    codes = codes[np.unique(owner, return_index=True)[1]]
    norms = _norms(codes)
    telling = LANDMARKS * 3 // 4
    rest = range(telling, len(words), max(1, (len(words) - telling) // (LANDMARKS - telling)))
    marks = [*range(min(telling, len(words))), *rest][:LANDMARKS]
    k = np.array([_apply(_explicit(codes, norms, i), codes, norms) for i in marks]).T
    values, vectors = np.linalg.eigh((k[marks] + k[marks].T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = k @ root
    y = np.repeat([1.0, -1.0], len(words))
    share = bad / np.maximum(bad + good, 1e-9)
    support = np.log1p(1000 * (bad + good))
    weight = np.concatenate([support * share, CLEAN_WEIGHT * support * (1 - share)])
    w, bias = _svm(np.vstack([z, z]), y, weight)
    weights = np.zeros(CODES**3)
    for alpha, i in zip(root @ w, marks, strict=True):
        weights += alpha * _explicit(codes, norms, i)
    return weights.astype(np.float32), bias


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, text, toxic) of the bounded sample: labelled rows whose crc32(doc_id) mod 5 is not 0."""
    usable = labels.filter((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("toxic").isin(0, 1))
    known = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    take = [known.filter(F.col("toxic") == v).orderBy(order, "doc_id").limit(n) for v, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    picked = take[0].union(take[1])  # at most TOXIC_ROWS + CLEAN_ROWS rows of two numbers
    return docs.join(F.broadcast(picked), "doc_id").select(F.col("doc_id").alias("doc"), text_of().alias("text"), "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None if the labelled rows don't hold both classes."""
    sample = written(training_rows(docs, labels), "sample")  # the texts are scanned once for it

    bad, good = sample.filter("toxic = 1").select("doc", "text"), sample.filter("toxic = 0").select("doc", "text")

    def spread(df: DataFrame, pick, column: str) -> DataFrame:
        """(doc, column): what `pick` makes of each text, once a document."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), SLICE):
                    part = batch.iloc[at : at + SLICE]
                    bags = [sorted(pick(t)) for t in part["text"]]
                    yield pd.DataFrame({"doc": np.repeat(part["doc"].to_numpy(), [len(b) for b in bags]), column: pd.Series([w for b in bags for w in b], dtype=object)})

        return df.mapInPandas(run, f"doc long, {column} string")

    grams = spread(bad, lambda t: set().union(*map(grams_of, tokens_of(t))), "gram")
    rows = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not rows.get(0) or not rows.get(1):
        return None
    often = grams.groupBy("gram").agg(F.count("*").alias("bad")).filter(f"bad >= {max(3, round(0.003 * rows[1]))}")
    innocent = spread(good, lambda t: set().union(*map(grams_of, tokens_of(t))), "gram").groupBy("gram").agg(F.count("*").alias("good"))
    lift = F.log2((F.col("bad") / rows[1]) / ((F.coalesce("good", F.lit(0)) + 1) / rows[0]))
    suspects = often.join(innocent, "gram", "left").select("gram", lift.alias("lift")).filter("lift >= 2")
    pairs = grams.join(suspects, "gram").toPandas()
    chosen = set(witnesses(pairs, dict(zip(pairs["gram"], pairs["lift"], strict=True))))
    def counted(pick) -> DataFrame:
        """Words that `pick` takes from the sample, with the numbers of toxic and clean documents that have them."""
        both = spread(bad, pick, "word").withColumn("bad", F.lit(1)).unionByName(spread(good, pick, "word").withColumn("bad", F.lit(0)))
        return both.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))

    telling = counted(lambda t: {w for w in tokens_of(t) if not chosen.isdisjoint(grams_of(w))})
    plain = counted(lambda t: {w for w in tokens_of(t) if chosen.isdisjoint(grams_of(w))})
    score = F.col("bad") * F.log2(1 + (F.col("bad") / rows[1]) / ((F.col("good") + 1) / rows[0]))
    parts = [
        telling.orderBy(F.desc(score), "word").limit(WORDS // 2),
        plain.orderBy(F.desc("good"), "word").limit(WORDS // 4),
        plain.orderBy(F.xxhash64("word"), "word").limit(WORDS // 4),
    ]
    words = pd.concat([p.toPandas() for p in parts]).drop_duplicates("word")
    if not chosen or not len(words):
        return None
    weights, bias = fit_words(words["word"].tolist(), words["bad"].to_numpy() / rows[1], (words["good"].to_numpy() + 0.3) / rows[0])
    model = Model(weights, bias, np.zeros(WORST + 2))
    worst = sample.mapInPandas(_worst(model, "toxic int"), "worst array<double>, toxic int").toPandas()
    if worst["toxic"].nunique() < 2:
        return None
    model.curve = _logistic(np.array(worst["worst"].tolist()).reshape(-1, WORST + 1), worst["toxic"].to_numpy(float))
    return model


def _worst(model: Model, extra: str):
    name = extra.split()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, float] = {}
        for batch in batches:
            yield pd.DataFrame({"worst": list(model.documents(batch["text"], memo)), name: batch[name]})

    return run


def score_of(text: Column, model: Model | None) -> Column:
    """How likely a text is toxic, 0 to 1; without a model 0."""
    if model is None:
        return F.lit(0.0)
    stamp = hash((float(model.bias), float(model.weights.sum()), float(model.curve.sum())))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        memo = worker_memo(("toxicity", stamp))
        out = [model.probability(model.documents(texts.iloc[at : at + 8 * SLICE], memo)) for at in range(0, len(texts), 8 * SLICE)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Repeated rows are each scored, very long texts and words whole. A null doc_id is scored, never held out and never labelled; several
    labels of one document count as the highest; null labels are passed over; empty tables give no rows.
    """
    slim = docs.select("doc_id", "text")
    out = slim.withColumn("score", score_of(text_of(), fit(slim, labels)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows whose text is scored 0.5 or more.

    All columns stay as they are, whatever their names; null text counts as empty, null ids and repeated rows are
    judged by their text, and an empty table gives none.
    """
    return docs.filter(score_of(text_of(), fit(docs.select("doc_id", "text"), labels)) < 0.5)
