import hashlib
import random
import zlib
from collections import defaultdict

from logloom.llm import repeats


def brute(texts, length):
    """Removed flags of each byte, from a table of all windows."""
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for i, d in enumerate(data):
        for s in range(len(d) - length + 1):
            seen[d[s : s + length]].append((i, s))
    gone = [[False] * len(d) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = [True] * length
    out = []
    for d, g in zip(data, gone):
        spans = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
        out.append((len(d), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(d, g) if not x)).hexdigest()))
    return out


def corpus(seed, n=60, size=300):
    r = random.Random(seed)
    alphabet = "abcdé "
    passages = ["".join(r.choice(alphabet) for _ in range(r.randint(30, 160))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append("".join(r.choice(alphabet) for _ in range(r.randint(0, size // 4))))
            if r.random() < 0.6:
                p = r.choice(passages)
                a = r.randint(0, 20)
                parts.append(p[a : len(p) - r.randint(0, 20)])
        texts.append("".join(parts))
    return texts + ["", None, "x" * 150, texts[0], texts[0], "ab" * 90, "x" * 49]


def compare(spark, texts, length, gram, hot=128):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, k1 string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cleaned(df, length, gram, False, hot).select("row.doc_id", "cut.*").collect()}
    want = brute(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] > 0 for w in want) > 5


def test_matches_brute_force(spark):
    compare(spark, corpus(1), 50, 16)


def test_hot_anchors_match_brute_force(spark):
    """Every anchor as if very many places shared it."""
    compare(spark, corpus(2), 40, 12, hot=0)


def test_text_goes_and_empty_table(spark):
    t = "abcdefghij" * 50
    df = spark.createDataFrame([(1, t + "A tail of its own", 0), (2, "Head. " + t, 0), (3, None, 0), (4, t * 2, 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert got[1].text == "A tail of its own" and got[2].text == "Head. " and got[3].text is None
    assert 4 not in got and got[1].n_chars == 17
    assert repeats.report(df.limit(0)).count() == 0


def test_copies_of_a_text_give_its_spans_once(spark):
    r = random.Random(8)
    passage, *rest = ("".join(r.choice("abcdefgh ") for _ in range(160)) for _ in range(60))
    texts = [x + passage + x[::-1] for x in rest] + [rest[0] + passage + rest[0][::-1]] * 3000
    keyed = spark.createDataFrame([(zlib.crc32(t.encode()), len(t), t) for t in texts], "k1 long, k2 long, text string")
    found = repeats.repeated_spans(keyed, 50, 16)
    rows = found.collect()
    assert len(rows) == len(set(rows)) < 2000
    compare(spark, texts[:60] + texts[-200:], 50, 16)


def test_passages_of_short_words_go(spark):
    """51 words of 101 to 250 bytes go, 50 words stay; words count lower-cased, between any white space."""
    r = random.Random(11)

    def short(n):
        return [r.choice("abcdefghé") + r.choice(["", "x", "yz"]) for _ in range(n)]

    rows, want = [], {}
    for g in range(12):
        n = 51 if g % 2 else 50
        passage = short(n) if g > 1 else [r.choice("abcdefgh") for _ in range(n)]
        for k in range(3):
            head, tail = ([f"{c}É{len(rows)}_{i}" for i in range(9)] for c in "ht")
            middle = "\n ".join(passage).upper() if k == 1 else " ".join(passage)
            text = f"{' '.join(head)} {middle} {' '.join(tail)}"
            want[len(rows)] = f"{' '.join(head)}  {' '.join(tail)}" if n == 51 else text
            rows.append((len(rows), text))
    for text in (" ".join(short(51)), " ".join(short(50))):
        for _ in range(2):
            want[len(rows)] = text if len(text.split()) < 51 else None
            rows.append((len(rows), text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in repeats.without_repeats(df, words=51).collect()}
    assert [got.get(i) for i in want] == list(want.values())


def test_very_long_texts_and_clashing_columns(spark):
    """A passage on both sides of a chunk's border of a text over 1 MiB, and input columns named like inner ones."""
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh") for _ in range(900))
    head = "".join(r.choices("abcdefghij klmnop", k=repeats.CHUNK - 500))
    tail = "".join(r.choices("abcdefghij klmnop", k=300_000))
    texts = [head + passage + tail, passage[:600], passage[250:] + "X", tail[:390]]
    names = ["cut", "row", "k1", "spans", "kind", "_text", "_before"]
    df = spark.createDataFrame([(i, t, *[7 * i] * len(names)) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = {x.doc_id: x for x in repeats.without_repeats(df).collect()}
    assert got[0].text == head + tail and 1 not in got and got[2].text == "X" and got[3].text == tail[:390]
    assert got[2].asDict() == {"doc_id": 2, "text": "X"} | dict.fromkeys(names, 14)
    both = {x.doc_id: x for x in repeats.report(df).collect()}
    assert both[0].n_removed == 900 and both[0].n_spans == 1 and both[1].n_removed == 600
