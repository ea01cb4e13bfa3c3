"""Ranked lexical search against scores of all documents."""

import math
import random
import re

import pytest

from logloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k):
    counted = [(d, terms(t)) for d, t in docs]
    counted = [(d, t) for d, t in counted if t]
    size, total = len(counted), sum(len(t) for _, t in counted)
    out = []
    for item, text in sorted(set(items), key=repr):
        asked, scores = set(terms(text)), []
        df = {w: sum(w in t for _, t in counted) for w in asked}
        for d, t in counted:
            m = 50 + (50 * len(t) * size) // total
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[w] + 1))) * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 20 * m)) for w in asked if w in t)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(params=[8, 8192])
def shard(request, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", request.param)


@pytest.mark.parametrize("k", [3, 50])
def test_search_finds_what_scoring_everything_finds(spark, shard, k):
    r = random.Random(k)
    word = lambda: "abcdefghijklmnopqrst"[min(19, int(r.expovariate(0.2)))] + r.choice(["", "É", "x"])
    docs = [(i, " ".join(word() for _ in range(r.randrange(30)))) for i in range(300)]
    docs += [(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (400, ""), (401, " .,! "), (402, "A b, C " * 1000), (403, "a b c"), (404, "a b c")]
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 8)))) for i in range(12)]
    items += [(1, "A, b c"), (1, "A, b c"), (20, None), (21, "zz"), (None, "a"), (22, "a a a t")]
    d = spark.createDataFrame([(i, t, 0, "q") for i, t in docs], "doc_id long, text string, n long, score string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = [(x.item_id, x["rank"], x.doc_id, x.score) for x in lexical.search(d, q, k).collect()]
    assert sorted(got, key=repr) == brute(docs, items, k)


def test_a_hot_group_of_copies_and_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 64)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 40)
    docs = [(i, "same words here") for i in range(500)] + [(500 + i, f"same w{i}") for i in range(100)]
    items = [(i, f"same words w{i}") for i in range(6)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 10)


def test_lengths_beyond_64_bits_and_empty_tables(spark):
    import numpy as np

    assert lexical.norms(np.array([10**12, 1]), 10**9, 10**12).tolist() == [50 + 50 * 10**9, 50]
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id long, text string"))
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, some).collect() == [] and lexical.search(some.withColumnRenamed("item_id", "doc_id"), items).collect() == []


def test_search_ends_before_the_lists_do(monkeypatch):
    import numpy as np

    n = 4000
    doc, term = np.tile(np.arange(n), 2), np.repeat([0, 1], n)
    shard = lexical.Shard(doc, term, np.concatenate([np.arange(n, 0, -1), np.arange(n, 0, -1)]), n, 2)
    read = []
    monkeypatch.setattr(lexical, "top", lambda s, i, k, f=lexical.top: read.append(len(s)) or f(s, i, k))
    scores, ids = shard.search(np.array([0, 1]), np.zeros(0, np.int64), np.zeros(0, np.int64), 5, np.arange(n))
    assert ids.tolist() == [0, 1, 2, 3, 4] and scores.tolist() == [2 * (n - i) for i in range(5)]
    assert sum(read) < 100
