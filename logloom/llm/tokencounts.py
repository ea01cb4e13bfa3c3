"""Token counts by a byte-level BPE vocabulary, merged rank by rank in numpy.

A text is cut at its added tokens and then into pre-tokens. Pre-tokens that a worker has not met yet are held together as one
ragged array of symbols; in each round every sequence applies its lowest-ranked pair at all its places at once, until no pair
is left. What survives is counted. Applying one rank at all places is the same as one place after the other where each pair
ranks above the pairs that made its parts, which `Merges` checks when it reads the vocabulary.

Null texts count as empty and have no tokens; very long texts are read in slices of pre-tokens, so only one pre-token is ever
held whole; repeated rows and ties give the same count each; empty tables give no rows; further columns pass through, those
named like a result are left out.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker_memo

#: Pre-tokens that a worker keeps with their counts, and pre-tokens of a text that are looked up in one go.
MEMO, SLICE = 700_000, 200_000
#: Characters of a text above which it is never cut into chunks at once.
LONG = 1 << 20
#: Stands for the count of a pre-token that the library has to cut; no sum of counts makes up for it.
UNKNOWN = -(1 << 50)
NONE = np.iinfo(np.int64).max


#: White space in a row. Elsewhere the rule never joins what a space parts, so a text falls into chunks at its spaces.
IN_A_ROW = re.compile(r"\s\s")

# Fixed value: the rule of this family of vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else one from 256 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = itertools.count(256)
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Merges:
    """The merge table of a vocabulary file and counts of what it leaves of byte strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"] or not plain:
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options are not known here")
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b: rank for rank, (a, b) in enumerate(pairs)}
        if len(made) != len(pairs) or any(made.get(x, -1) >= rank for rank, p in enumerate(pairs) for x in p):
            raise ValueError("a pair ranks below one that makes its parts")
        self.width = max(ids.values()) + 1
        self.first = np.array([ids[c] for c in byte_letters()], np.int64)
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.added = sorted((t["content"] for t in spec["added_tokens"] if t["content"]), key=len, reverse=True)

    def split(self, text: str) -> list[str]:
        """What lies between the strings of added tokens, which are one fewer."""
        return re.split("|".join(map(re.escape, self.added)), text) if any(a in text for a in self.added) else [text]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols are left of each byte string, none of which is empty."""
        out = np.array(list(map(len, words)), np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        own = np.repeat(np.arange(len(words)), out)
        rank = np.full(len(symbols), NONE)
        inner = np.flatnonzero(own[:-1] == own[1:])
        rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sizes = np.diff(np.r_[starts, len(own)])
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():
                out[own[starts[done]]] = sizes[done]
                live = np.repeat(~done, sizes)
                symbols, own, rank = symbols[live], own[live], rank[live]
                low, sizes = low[~done], sizes[~done]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            # In a run of places that overlap, every second one is merged, from the left.
            new = np.r_[True, np.diff(hit) != 1]
            run = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))
            symbols, own, rank = symbols[stay], own[stay], rank[stay]
            touched = np.unique(np.r_[at, at[at > 0] - 1])
            joined = touched[touched + 1 < len(own)]
            joined = joined[own[joined] == own[joined + 1]]
            rank[touched] = NONE
            rank[joined] = self._rank(symbols[joined], symbols[joined + 1])
        return out


class Counter:
    """Counts the tokens of texts, each distinct chunk and pre-token once.

    Libraries know different versions of Unicode, so a text with a code point that has no class here is cut by the
    tokenizer library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges, self.owner = Merges(path), ("tokencounts", path)
        self.library = Tokenizer.from_file(path)

    def _count(self, words: list[str], memo: dict[str, int]) -> None:
        """Adds pre-tokens to the memo, those that hold unknown code points as UNKNOWN."""
        odd = [not w.isascii() and "Cn" in map(unicodedata.category, w) for w in words]
        memo.update((w, UNKNOWN) for w, o in zip(words, odd, strict=True) if o)
        good = [w for w, o in zip(words, odd, strict=True) if not o]
        if good:
            memo.update(zip(good, self.merges.counts([w.encode() for w in good]).tolist(), strict=True))

    def _learn(self, chunks: list[str], memo: dict[str, int], chunk_memo: dict[str, int]) -> None:
        """Adds chunks, each with the space before it, by way of their pre-tokens."""
        parts = [PATTERN.findall(" " + c) for c in chunks]
        if new := set().union(*parts).difference(memo):
            self._count(list(new), memo)
        chunk_memo.update((c, sum(map(memo.__getitem__, p))) for c, p in zip(chunks, parts, strict=True))

    def _exact(self, text: str, memo: dict[str, int]) -> int:
        """A text by its pre-tokens, a slice of them at a time."""
        found, total = (m.group() for m in PATTERN.finditer(text)), 0
        while words := list(itertools.islice(found, SLICE)):
            if new := set(words).difference(memo):
                self._count(list(new), memo)
            total += sum(map(memo.__getitem__, words))
            if len(memo) > MEMO:
                memo.clear()
        return total

    def _split(self, text: str) -> int:
        """A text cut by the library."""
        at = (text[b:e].encode() for _, (b, e) in self.library.pre_tokenizer.pre_tokenize_str(text))
        return int(self.merges.counts(list(at)).sum())

    def counts(self, texts: list[str]) -> list[int]:
        memos = worker_memo(self.owner)
        memo, chunk_memo = memos.setdefault("words", {}), memos.setdefault("chunks", {})
        out = []
        for at in range(0, len(texts), 128):
            for m in (memo, chunk_memo):
                if len(m) > MEMO:
                    m.clear()
            pieces = [self.merges.split(t) for t in texts[at : at + 128]]
            chunks = [None if len(x) > LONG or IN_A_ROW.search(x) else x.split(" ") for p in pieces for x in p]
            heads = [c.pop(0) if c else "" for c in chunks]
            known = [None if c is None else list(map(chunk_memo.get, c)) for c in chunks]
            lack = [bool(k) and None in k for k in known]
            if new := {w for c, x in zip(chunks, lack, strict=True) if x for w in c if w not in chunk_memo}:
                self._learn(list(new), memo, chunk_memo)
            known = [map(chunk_memo.__getitem__, c) if x else k for c, k, x in zip(chunks, known, lack, strict=True)]
            sums = iter([None if k is None else (self._exact(h, memo) if h else 0) + sum(k) for h, k in zip(heads, known, strict=True)])
            for p in pieces:
                total = len(p) - 1
                for x in p:
                    n = next(sums)
                    n = self._exact(x, memo) if n is None else n
                    total += n if n >= 0 else self._split(x)
                out.append(total)
        return out


_counters: dict[str, Counter] = {}


def token_count(text: Column, path: str) -> Column:
    """The number of a text's tokens, added tokens' strings counted as those tokens."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if path not in _counters:
            if not os.path.exists(path):
                raise FileNotFoundError(path)
            _counters[path] = Counter(path)
        return pd.Series(_counters[path].counts(texts.tolist()), dtype="int64")

    return count(text)


def with_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit (more than `limit` tokens) of a text column."""
    rest = docs.drop("n_bytes", "n_tokens", "over_limit")
    out = rest.withColumn("n_bytes", F.octet_length(text_of(text)).cast("long")).withColumn("n_tokens", token_count(text_of(text), path))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document."""
    return with_counts(docs.select("doc_id", "text"), path).drop("text")
