import random
import re

from logloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_of(text):
    words = WORD.findall(lower(text))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return words, places


def met(words, templates=licenses.TEMPLATES, threshold=0.8):
    """Best containment of each template by trying every block."""
    best = {}
    for text in templates:
        run = WORD.findall(lower(text))
        tokens, size = set(run), -(-len(run) * 3 // 2)
        for at in range(0, max(1, len(words))):
            share = len(tokens & set(words[at : at + size])) / len(tokens)
            if share >= threshold - 1e-12:
                best[text] = max(best.get(text, 0), share)
    return best


def test_matches_brute_force(spark):
    r = random.Random(6)
    notices = [*licenses.TEMPLATES, *licenses.PHRASES, "GNU GENERAL public-License", "cc  by cc by"]
    texts = [None, "", "...", "CC BY", "É mit LICENSE é"]
    for _ in range(250):
        words = [r.choice(["the", "of", "license", "été", "under", "x1", "copy", "terms", "\n"]) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            notice = r.choice(notices).split()
            if r.random() < 0.5:
                notice = [w for w in notice if r.random() < 0.9]
            at = r.randint(0, len(words))
            words[at:at] = notice
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {g.doc_id: g for g in licenses.scanned(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words, places = base_of(t or "")
        best = met(words)
        labels = {x for _, x in places}
        g = got[i]
        assert (g.n_words, g.n_base, g.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (g.first_word, g.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert g.labels == ",".join(sorted(labels | {licenses.TEMPLATES[k] for k in best}))
        assert abs(g.score - (1.0 if places else max(best.values(), default=0.0))) < 1e-12
    assert licenses.scanned(df.limit(0)).count() == 0


def test_long_templates_ties_and_repeats(spark):
    """Templates of hundreds of words given as a table, at any offset, in a long text; rows repeat and ids are null."""
    r = random.Random(8)
    long = " ".join(f"t{r.randint(0, 400)}" for _ in range(700))
    table = {long: "long", "one two": "pair", "...": "none"}
    cut = [w for w in long.split() if r.random() < 0.93]
    few = [w for w in long.split() if r.random() < 0.6]
    filler = ["filler"] * 5000
    texts = [" ".join(filler + cut + filler * 20), " ".join(few), "two x one", "two x x one", " ".join(cut[::-1])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (2, texts[2])]
    df = spark.createDataFrame([(i, t, "l") for i, t in rows], "doc_id long, text string, labels string")
    templates = spark.createDataFrame(list(table.items()), "text string, label string")
    got = sorted(((g.doc_id if g.doc_id is not None else -1, g.labels, round(g.score, 9)) for g in licenses.scanned(df, templates).collect()))
    want = []
    for i, t in rows:
        best = met(WORD.findall(lower(t)), {long: 0, "one two": 0})
        want.append((-1 if i is None else i, ",".join(sorted(table[k] for k in best)), round(max(best.values(), default=0.0), 9)))
    assert got == sorted(want) and {x[1] for x in want} == {"long", "", "pair"}
