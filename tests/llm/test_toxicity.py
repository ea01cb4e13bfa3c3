import random

from pyspark.sql import functions as F

from logloom.llm import toxicity


def rows(seed=5, n=500):
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    bad = ["idiot", "moron", "scumbag"]
    out = []
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(30)]
        toxic = int(r.random() < 0.3)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(bad))
        out.append((i, " ".join(words), toxic))
    return out


def test_learns_and_tolerates_gaps(spark):
    data = rows()
    odd = [(1001, "the er an id.iot on the mo-ron re idiot"), (1002, "thon m o r o n re i d i o t"), (1003, "an idxiot er moroon scum-bag"), (1004, ""), (1005, None), (None, "thereon an"), (1004, "")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in data] + [(i, t, 0.1) for i, t in odd], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in data] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(data) + len(odd) and all(0 <= g.score <= 1 for g in got)
    truth = {i: x for i, _, x in data}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert len(held) > 50 and sum(g.predicted == truth[g.doc_id] for g in held) >= 0.97 * len(held)
    by = {g.doc_id: g for g in got}
    assert by[1001].predicted == by[1002].predicted == by[1003].predicted == 1
    assert by[1004].predicted == by[1005].predicted == by[None].predicted == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter(F.col("doc_id") == 1001).count() == 0
    assert kept.filter("doc_id < 1000 and score = 0.5").count() == kept.filter("doc_id < 1000").count() > 0


def test_kernel_matches_plain_subsequences():
    """The normalised kernel against all triples of characters within the span, by plain loops."""

    def bag(word):
        w, out = f"^{word}$", {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    key = (w[i], w[j], w[k])
                    out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i - 2)
        return out

    words = ["idiot", "idxiot", "moron", "tom", "aab", "abaab"]
    codes, _ = toxicity._codes(words)
    norms = toxicity._norms(codes)
    for i, a in enumerate(words):
        row = toxicity._apply(toxicity._explicit(codes, norms, i), codes, norms)
        for j, b in enumerate(words):
            x, y = bag(a), bag(b)

            def occurrences(word):
                w = f"^{word}$"
                return sum(toxicity.DECAY ** (2 * (k - i - 2)) for i in range(len(w)) for j in range(i + 1, len(w)) for k in range(j + 1, min(len(w), i + toxicity.SPAN)))

            want = sum(v * y.get(k, 0.0) for k, v in x.items()) / (occurrences(a) * occurrences(b)) ** 0.5
            assert abs(row[j] - want) < 1e-6


def test_very_long_texts_and_words(spark):
    data = rows(seed=6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(2000, "the er " * 60_000 + "idiot moron idiot scumbag"), (2001, "x" * 300_000), (2000, "the er")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in data] + [(2001, 0)], "doc_id long, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(data) + 3 and all(0 <= g.score <= 1 for g in got)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.report(docs, labels).collect()] == [0.0, 0.0]
    assert toxicity.report(docs.limit(0), labels).count() == 0
