import numpy as np
from pyspark.sql import functions as F

from logloom.llm import mixing


def test_rake_meets_marginals():
    r = np.random.default_rng(1)
    mass = r.integers(0, 1000, (5, 4, 3)).astype(float)
    targets = [np.array([0.1, 0.2, 0.3, 0.2, 0.2]), np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.3, 0.3, 0.4])]
    weight, p = mixing.rake(mass, targets, 0.2)
    kept = p * mass
    assert abs(kept.sum() - 0.2 * mass.sum()) < 1
    for axis, want in enumerate(targets):
        got = kept.sum(axis=tuple(a for a in range(3) if a != axis)) / kept.sum()
        assert np.abs(got - want).max() < 1e-6
    assert (p <= 1).all() and np.allclose(weight * 0.2, p)
    assert (mixing.rake(np.zeros((2, 2, 2)), [np.ones(2)] * 3, 0.5)[1] == 0.5).all()


def test_sample_follows_probabilities(spark):
    rows = [(i, f"word{i} " * (1 + i % 7), "src0" if i % 3 else "new", ["en", "de", None][i % 3], 1.5) for i in range(6000)]
    rows += [(None, None, None, None, None), (1, "", "src0", "en", 0.0), (1, "", "src0", "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight double")
    got = mixing.report(docs)
    assert got.count() == len(rows)
    by = got.groupBy("probability").agg(F.count("*").alias("n"), F.avg(F.col("sampled").cast("int")).alias("share")).filter("n > 500").collect()
    assert by and all(abs(r["share"] - r["probability"]) < 0.06 for r in by)
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    assert mixing.report(docs.limit(0)).count() == 0


def plain_topic(text):
    n = max(len(text), 1)
    if "licens" in text.lower():
        return "licensed"
    if sum(c in "#$%&*+=<>@[]^_`{|}~\\/!" for c in text) / n > 0.08:
        return "symbols"
    return "lines" if n / (text.count("\n") + 1) < 300 else "prose"


def test_matches_plain_fitting(spark):
    """Categories, tokens, targets and probabilities by a plain loop over the documents; ids, texts and names repeat."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(900):
        text = " ".join(r.choice(["licence", "license", "word", "#$%", "x\ny"], p=[0.02, 0.01, 0.9, 0.04, 0.03]) for _ in range(r.integers(0, 200)))
        rows.append((int(i // 2) if i % 7 else None, text if i % 50 else None, ["hot", "hot", "b", "c", None][r.integers(0, 5)], ["en", "en", "fr"][r.integers(0, 3)], "z"))
    rows.append((901, "very long " * 60_000, "b", "fr", "z"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    cells = {}
    for _, text, source, lang, _ in rows:
        key = (source, lang, plain_topic(text or ""))
        cells[key] = cells.get(key, 0) + len((text or "").split())
    total = sum(cells.values())
    shares, keep = [], 0.6 * total
    for a in range(3):
        names = {k[a] for k in cells}
        tokens = {x: sum(n for k, n in cells.items() if k[a] == x) for x in names}
        roots = {x: (n / total) ** 0.5 for x, n in tokens.items() if n}
        shares.append({x: v / sum(roots.values()) for x, v in roots.items()})
    p = dict.fromkeys((k for k, n in cells.items() if n), 0.6)
    for _ in range(500):
        for a in range(3):
            now = {x: sum(p[k] * cells[k] for k in p if k[a] == x) for x in shares[a]}
            p = {k: min(1.0, v * shares[a][k[a]] * keep / now[k[a]]) for k, v in p.items()}
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    seen = {(g.source, g.lang, g.topic): g.probability for g in got}
    for k, v in p.items():
        assert abs(seen[tuple(x if x is not None else "*" for x in k)] - v) < 1e-6
    assert sorted(g.n_tokens for g in got) == sorted(len((x[1] or "").split()) for x in rows)
    kept = mixing.mixed(docs.drop("lang"))
    assert kept.columns == ["doc_id", "text", "source", "topic"] and 0 < kept.count() < len(rows)
