import random

from logloom.llm import nearwords, simhash


def corpus(seed=4):
    r = random.Random(seed)
    rows = []
    for g in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 150))]
        for _ in range(4):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = f"x{r.randrange(9999)}"
            rows.append((len(rows), " ".join(words)))
    return rows + [(None, "a b c"), (None, "d e"), (900, "a  b C"), (901, None), (902, "")]


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_match_all_pairs(spark):
    rows = corpus()
    shingles = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        return x if up[x] == x else top(up[x])

    wide = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
                wide += bin(simhash.fingerprint_of(rows[i][1] or "") ^ simhash.fingerprint_of(rows[j][1] or "")).count("1") > 3
    assert wide > 10
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i])
    want = sorted(str(min(g, key=lambda x: (x[0] is None, x[0] or 0))[0]) for g in groups.values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (256, 2):
        assert sorted(str(x.doc_id) for x in nearwords.one_of_each(df, block).collect()) == want
    assert nearwords.one_of_each(df.limit(0)).count() == 0


def test_near_fingerprints_are_linked(spark):
    same = "x y z " * 60
    rows = [(1, same + "p q r s t"), (2, same + "u v w m n"), (3, "a text of its own that has nothing to do with them"), (4, None)]
    a, b = (simhash.fingerprint_of(t) for _, t in rows[:2])
    assert bin(a ^ b).count("1") <= 3 and len(sets(rows[0][1]) & sets(rows[1][1])) < 0.8 * len(sets(rows[0][1]) | sets(rows[1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in nearwords.one_of_each(df).collect()) == [1, 3, 4]
    chain = nearwords.rooted(df, distance=0).filter("doc_id < 3").select("root").distinct().count()
    assert chain == (1 if a == b else 2)
