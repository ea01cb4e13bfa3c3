"""Licence scans: phrases, and an exact set-similarity join of text blocks with a table of licence templates.

A block is any run of words, STRETCH times as many as the template has; a template is the set of its words. A block
and a template meet if the block holds at least the threshold's share of the template's words. Words of templates are
ordered by how many documents hold them, counted over all documents, the rarest first. By the prefix filter a meeting
block holds one of a template's rarest words, so documents are joined with templates on equality of these words. By
the length filter a document holds enough words of the template at all, and by the positional filter a candidate is
left as soon as the words that remain in the order cannot reach the need. The rest slide a block over the places of
the template's words, one word after the other, so no block is missed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of, written

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of public licences and their labels.
TEMPLATES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Released under the MIT License": "mit",
    "Licensed under the Apache License, Version 2.0": "apache",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl",
    "All rights reserved. No part of this publication may be reproduced": "reserved",
}

THRESHOLD = 0.8
STRETCH = 1.5
MOST_WORDS = 2_000_000  # of all templates together, which are broadcast

_TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters as UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand in a row."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases.items():
        needle = b" " + phrase + b" "
        at = joined.find(needle)
        while at >= 0:
            out.append((joined.count(b" ", 0, at), label))
            at = joined.find(needle, at + 1)
    return out


def frequencies(texts: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each template word; counted over all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update(tokens.intersection(words_of(text)))
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    counts = texts.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}  # one row a template word at most


def default_templates(spark: SparkSession) -> DataFrame:
    """(text, label) of TEMPLATES."""
    return spark.createDataFrame(list(TEMPLATES.items()), "text string, label string")


class Index:
    """Templates in arrays: words are numbered from the rarest on, and a template is its words' numbers in order."""

    def __init__(self, texts: list[str], labels: list[str], frequency: dict[bytes, int], threshold: float, stretch: float):
        runs = [words_of(t) for t in texts]
        if sum(map(len, runs)) > MOST_WORDS:
            raise ValueError(f"templates of over {MOST_WORDS} words together are not broadcast")
        order = sorted({w for run in runs for w in run}, key=lambda w: (frequency.get(w, 0), w))
        self.number = {w: i for i, w in enumerate(order)}
        self.labels = labels
        self.tokens = [sorted({self.number[w] for w in run}) for run in runs]
        self.need = [math.ceil(threshold * len(t) - 1e-9) for t in self.tokens]
        self.block = [math.ceil(stretch * len(run)) for run in runs]
        self.prefix = sorted({(w, k) for k, t in enumerate(self.tokens) if t for w in t[: len(t) - self.need[k] + 1]})

    def best(self, k: int, numbers: np.ndarray, places: np.ndarray) -> float:
        """The largest containment of template k in a block, from the places of words; 0 where none meets the threshold."""
        tokens, need, block = self.tokens[k], self.need[k], self.block[k]
        own = np.isin(numbers, tokens)
        numbers, places = numbers[own].tolist(), places[own].tolist()
        held = set(numbers)
        if len(held) < need:
            return 0.0
        found = 0
        for at, w in enumerate(tokens):
            found += w in held
            if found + len(tokens) - at - 1 < need:
                return 0.0
        inside, most, first = Counter(), 0, 0
        for w, at in zip(numbers, places, strict=True):
            inside[w] += 1
            while places[first] <= at - block:
                inside[numbers[first]] -= 1
                if not inside[numbers[first]]:
                    del inside[numbers[first]]
                first += 1
            most = max(most, len(inside))
        return most / len(tokens) if most >= need else 0.0


_FOUND = "doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, numbers array<int>, places array<int>"


def _found(index: Index, phrases: dict[bytes, str]):
    """Counts and phrase places of each text; where it holds a prefix word, the places of all words of templates."""
    number = index.number
    rare = {w for w, i in number.items() if i in {x for x, _ in index.prefix}}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].astype(object), batch["text"], strict=True):
                words = words_of(text)
                places = phrase_places(words, phrases)
                first, last = (min(places)[0], max(places)[0]) if places else (None, None)
                hits = [] if rare.isdisjoint(words) else [(number[w], i) for i, w in enumerate(words) if w in number]
                out.append((None if pd.isna(doc) else doc, len(words), len(places), first, last, ",".join(sorted({x for _, x in places})), [x for x, _ in hits], [x for _, x in hits]))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "numbers", "places"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return run


def scanned(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, stretch: float = STRETCH) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of `docs`.

    n_base counts the places of PHRASES, first_word and last_word are their smallest and largest start (null if
    there is none). labels adds those of `templates` (text, label) that a block meets; score is 1 for a phrase, else the
    best containment met, else 0. Null text counts as empty, a very long one is scanned whole; repeated rows, which are
    scanned each, and null ids stay; templates without words meet nothing; an empty table gives none. Other columns are
    not read.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    rows = templates.select(text_of().alias("text"), text_of("label").alias("label")).distinct().orderBy("text", "label").collect()  # a parameter; its size is checked
    texts = docs.select("doc_id", text_of().alias("text"))
    frequency = frequencies(texts, {w for r in rows for w in words_of(r["text"])})
    index = Index([r["text"] for r in rows], [r["label"] for r in rows], frequency, threshold, stretch)
    phrases = {p.encode(): label for p, label in PHRASES.items()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(texts.mapInPandas(_found(index, phrases), _FOUND.format(kind)).withColumn("row", F.monotonically_increasing_id()), "found")

    hits = found.filter(F.size("numbers") > 0)
    prefix = docs.sparkSession.createDataFrame(index.prefix or [(-1, -1)], "number int, template int")
    pairs = hits.select("row", F.explode(F.array_distinct("numbers")).alias("number")).join(F.broadcast(prefix), "number")
    wanted = pairs.groupBy("row").agg(F.collect_set("template").alias("templates"))

    @F.pandas_udf("struct<labels:array<string>,score:double>")
    def verified(wanted: pd.Series, numbers: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for ks, n, p in zip(wanted, numbers, places, strict=True):
            met = {int(k): s for k in ks if (s := index.best(int(k), np.asarray(n), np.asarray(p)))}
            out.append((sorted({index.labels[k] for k in met}), max(met.values(), default=0.0)))
        return pd.DataFrame(out, columns=["labels", "score"])

    met = hits.join(wanted, "row").select("row", verified("templates", "numbers", "places").alias("m"))
    joined = found.drop("numbers", "places").join(met, "row", "left")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(base, F.coalesce("m.labels", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("m.score", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
