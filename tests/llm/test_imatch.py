import hashlib

from logloom.llm import imatch


def test_report_follows_the_definition(spark):
    texts = ["abc def ghi jkl", "", None, "été " * 40, "x y z", "abc def ghi jkl", "one two three four five six", "!!!"]
    ids = [5, 3, 9, 1, 7, 12, 20, None]
    df = spark.createDataFrame([(i, t, "f") for i, t in zip(ids, texts)], "doc_id long, text string, fingerprint string")
    got = imatch.report(df).collect()
    order = sorted(range(len(ids)), key=lambda i: -(ids[i] if ids[i] is not None else -1))
    by = {g.doc_id: g for g in got}
    assert len(got) == len(ids)
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        c = len(t) // 3
        edited = t[: len(t) - c] + nxt[:c]
        g = by[ids[i]]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        if edited == t:
            assert g.near_edited == 1 and g.fingerprint == g.edited_fingerprint
    assert by[5].fingerprint == by[12].fingerprint and by[3].fingerprint == by[9].fingerprint != by[7].fingerprint
    assert imatch.report(df.limit(0)).count() == 0
    assert imatch.report(df.filter("doc_id = 5")).first().near_next == 1.0


def test_edits_are_nearer_than_strangers(spark):
    import random

    r = random.Random(2)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    vocabulary = ["".join(r.choice(syllables) for _ in range(3)) for _ in range(900)]
    df = spark.createDataFrame([(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(30, 200)))) for i in range(300)], "doc_id long, text string")
    got = imatch.report(df).collect()
    assert sum(g.near_edited > g.near_next for g in got) > 0.85 * len(got)


def test_next_over_many_ranges(spark):
    ids = [*range(0, 3000, 7), 10**9, 10**12, -5, None, 14]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    order = sorted(((i if i is not None else -(1 << 63), f"t{k}") for k, i in enumerate(ids)), key=lambda x: (-x[0], x[1]))
    want = {order[k][1]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    for ranges, parts in ((8, 1), (8, 5), (64, 3)):
        got = {r.text: r.next_text for r in imatch.with_next(df, ["text"], ranges, parts).collect()}
        assert got == want


def test_fingerprints_match_plain_python(spark):
    """Frequencies, lexicon, fingerprints and likeness by plain loops, with ties, repeated rows and a very long text."""
    import random

    import regex
    import xxhash

    def h64(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 2, 30, 90]))) for _ in range(260)] + ["Wörter, W1!", None, "?!", "lone " * 50_000]
    texts += [texts[2], texts[2]]
    rows = [(i // 2, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, edited string")

    def terms(text):
        return {h64(w.encode()) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}

    counts = {}
    for t in texts:
        for h in terms(t or ""):
            counts[h] = counts.get(h, 0) + 1
    total = len(texts)
    words = {h for h, n in counts.items() if imatch.BAND[0] * total <= n <= imatch.BAND[1] * total}
    assert {x.h % (1 << 64) for x in imatch.lexicon(df, total).collect()} == words and len(words) > 50
    size = 1 << max(12, (16 * len(words)).bit_length())
    places = {(h >> 21 * j) & (size - 1) for h in words for j in range(3)}

    def of_array(values):
        seed = 42
        for v in values:
            seed = h64(v.to_bytes(8, "little"), seed)
        return f"{seed:016x}"[:8]

    def fingerprint(text):
        found = terms(text)
        own = {h for h in found if all((h >> 21 * j) & (size - 1) in places for j in range(3))} or found or {h64(text.encode())}
        own = sorted(own, key=signed)
        codes = []
        for family in range(imatch.FAMILIES):
            for level in range(1, imatch.LEVELS + 1):
                kept = [h for h in own if (h >> 6 * family) & ((1 << 2 * level) - 1) == 0]
                codes.append(of_array(kept) if kept else "-")
        if set(codes) == {"-"}:
            codes = [hashlib.sha256(text.encode()).hexdigest()[:8]]
        return " ".join(codes)

    def likeness(a, b):
        x, y = a.split(" "), b.split(" ")
        x, y = x + [""] * (len(y) - len(x)), y + [""] * (len(x) - len(y))
        used = [(p, q) for p, q in zip(x, y) if (p, q) != ("-", "-")]
        return 1.0 if a == b else sum(p == q for p, q in used) / len(used) if used else 0.0

    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        c = len(t) // 3
        edited = t[: len(t) - c] + nxt[:c]
        own, changed = fingerprint(t), fingerprint(edited)
        want.append((i, len(t), own, changed, round(likeness(own, changed), 9), round(likeness(own, fingerprint(nxt)), 9)))
    got = [(g.doc_id, g.n_chars, g.fingerprint, g.edited_fingerprint, round(g.near_edited, 9), round(g.near_next, 9)) for g in imatch.report(df).collect()]
    assert sorted(got) == sorted(want)
