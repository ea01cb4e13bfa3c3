import math
import random
from collections import Counter

from logloom.llm import knn


def brute(rows, k, every):
    """Rows as a multiset: repeated ids ask and are found each."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, own) in enumerate(good):
        if q is not None and q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v)), math.inf if i is None else i) for m, (i, v) in enumerate(good) if m != n and len(v) == len(own))
            out.update((q, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(scored[:k], 1))
    return out


def found(df, **more):
    return Counter((g.query_id, g["rank"], g.vec_id, g.score) for g in knn.top_k(df, **more).collect())


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 8)
    monkeypatch.setattr(knn, "LEAF", 8)
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # ties
    rows += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [math.nan] * 6), (2150, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (None, [0.5] * 6), (2200, []), (100, [0.0] * 6), (2250, [1.0, 2.0])]
    rows += [(150, [0.7] * 6), (150, [0.7] * 6), (3, [0.9] * 6), (3, [0.9] * 6)]  # repeated rows ask and are found each
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, row int")
    want = brute(rows, 5, 50)
    assert found(df, shard=40) == want
    assert found(df) == want
    assert knn.top_k(df.limit(0)).count() == 0
    assert {g.vec_id for g in knn.top_k(df.filter("vec_id in (0, 1, 2)")).collect()} == {1, 2}


def test_large_components(spark):
    """Products beyond 32 bits, and sums that doubles cannot hold."""
    r = random.Random(2)
    rows = [(i, [r.uniform(-1e6, 1e6) for _ in range(4)]) for i in range(200)] + [(500, [1e7, 0.0, 0.0, 0.0]), (501, [1e7, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df, shard=32)
    assert got == brute(rows, 5, 50) and (500, 1, 501, 2560000000**2) in got
