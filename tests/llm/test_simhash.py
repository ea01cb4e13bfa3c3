import random

import pandas as pd

from logloom.llm import graph, simhash


def brute(fps):
    """Components of fingerprints by comparing all pairs."""
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(fps))]


def near_fps(n, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(max(1, n // 8))]
    out = []
    for _ in range(n):
        x = r.choice(base)
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_match_all_pairs(spark):
    for n, block, seed in ((300, 2048, 1), (400, 4, 2), (5, 2048, 3)):
        fps = sorted(set(near_fps(n, seed)))
        want = brute(fps)
        df = spark.createDataFrame(pd.DataFrame({"fp": [signed(x) for x in fps]}))
        found = {r.node: r.root for r in graph.components(simhash.links(df, block=block)).collect()}
        got = [found.get(signed(x), signed(x)) for x in fps]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_report(spark):
    texts = ["a b c d e f", "A B\tC d e f", "", None, " \n", "x", "y z", "a b c d e f"]
    rows = [(i, t, "src", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: r for r in simhash.report(df).collect()}
    assert len(got) == 8
    assert got[0].fingerprint == got[1].fingerprint == got[7].fingerprint
    assert got[7].component_id == 0
    assert got[2].fingerprint == "0" * 16 and got[3].component_id == got[4].component_id == 2
    assert simhash.report(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and len(got) == 203


def test_one_of_each_under_null_and_repeated_ids(spark):
    r = random.Random(5)
    a, b, c, d, e = (" ".join(f"{x}{r.randrange(999)}" for _ in range(40)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (None, c), (7, c), (3, d), (3, e), (2, e), (9, a + "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((str(x.doc_id), x.text) for x in out.collect()) == sorted([("9", a), ("None", b), ("7", c), ("3", d), ("2", e)])
