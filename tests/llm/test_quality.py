import random

import numpy as np

from logloom.llm import quality


def test_em_finds_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(20000) < 0.8
    accuracy = [0.95, 0.9, 0.7, 0.85, 0.6]
    votes = np.stack([np.where(r.random(20000) < 0.3, 0, np.where((r.random(20000) < a) == truth, 1, -1)) for a in accuracy], axis=1)
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates, prior = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.03
    found = [rates[1, j, 2] / (rates[1, j, 2] + rates[1, j, 0]) for j in range(5)]
    assert np.abs(np.array(found) - accuracy).max() < 0.05
    assert ((post[index.ravel()] > 0.5) == truth).mean() > 0.93


def test_report_separates(spark):
    r = random.Random(3)
    good = [". ".join(" ".join(r.choice(["alpha", "beta", "gamma", "delta", "over", "under"]) + r.choice("abc") for _ in range(9)).capitalize() for _ in range(8)) + "." for _ in range(300)]
    bad = [" ".join(r.choice(["ALPHA", "BETA", "X"]) + r.choice(["###", "$$$", ",!!"]) for _ in range(60)) for _ in range(80)]
    rows = [(i, t, 1.0) for i, t in enumerate(good + bad)] + [(None, "", 1.0), (7, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = quality.report(df).collect()
    assert len(got) == len(rows)
    assert sum(g.keep for g in got if g.doc_id is not None and g.doc_id < 300) >= 290
    assert sum(g.keep for g in got if g.doc_id is not None and g.doc_id >= 300) <= 4
    assert quality.report(df.limit(0)).count() == 0


def test_weak_labels_match_plain_em(spark):
    """Posteriors by a plain loop over the documents, without patterns; columns that clash are replaced."""
    r = random.Random(9)
    texts = [" ".join(r.choice(["alpha", "beta.", "GAMMA", "##$", "beta."]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += ["one line\n" * 9, "", None, texts[0], "very long text. " * 40_000]
    votes = [quality.labellers(t or "") for t in texts]
    post = []
    for v in votes:
        cast = [x for x in v if x]
        post.append(min(0.95, max(0.05, 0.95 - sum(x < 0 for x in cast) / max(1, len(cast)))))
    for _ in range(quality.ROUNDS):
        rates = []
        for c in (0, 1):
            w = [p if c else 1 - p for p in post]
            rates.append([[(sum(x for x, v in zip(w, votes) if v[j] == vote) + 1) / (sum(w) + 3) for vote in (-1, 0, 1)] for j in range(7)])
        prior = min(0.98, max(0.02, sum(post) / len(post)))
        new = []
        for v in votes:
            like = [1 - prior, prior]
            for j, x in enumerate(v):
                like = [like[c] * rates[c][j][x + 1] for c in (0, 1)]
            new.append(like[1] / sum(like))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-7
        if done:
            break
        post = new
    df = spark.createDataFrame([(i, t, "old", "x") for i, t in enumerate(texts)], "doc_id long, text string, score string, weak_label string")
    got = {g.doc_id: g for g in quality.scored(df).collect()}
    assert max(abs(got[i].weak_label - p) for i, p in enumerate(post)) < 1e-5
    assert quality.scored(df).columns == ["doc_id", "text", "weak_label", "score"]
