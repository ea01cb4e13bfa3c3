import random
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from logloom.llm import packing, simhash, toxicity  # noqa: E402


def sample(seed=9):
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ou", "st", "ing"]

    def words(n):
        return ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]

    passage = " ".join(words(120))
    rows, labels = [], []
    for i in range(240):
        toxic = int(i % 4 == 0)
        w = words(r.randint(20, 120))
        for _ in range(4 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scum"]))
        text = " ".join(w) + ("\n" + passage if i % 10 == 1 else "")
        rows.append((i, text, r.choice(["en", "de", None]), f"src{i % 5}", len(text)))
        labels.append((i, 1, toxic))
    rows += [(1000 + i, rows[i][1], "en", "src0", rows[i][4]) for i in range(1, 60, 2)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "src1", 0)]
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = sample()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/out{i}")
        seen[name] = docs.collect()
        if i < 4:
            assert docs.columns == columns
    toxic = {i for i, _, t in labels if t}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert len(kept & toxic) <= 3 and len({i for i in range(240)} - toxic - kept) <= 3
    # one of each group of near-duplicates, by all pairs of fingerprints
    fps = {r.doc_id: simhash.fingerprint_of(r.text or "") for r in seen["toxicity"]}
    ids, left = sorted(fps), {r.doc_id for r in seen["simhash_near_dedup"]}
    up = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if up[a] < up[b] and bin(fps[a] ^ fps[b]).count("1") <= 3:
                    up[b], changed = up[a], True
    assert left == {i for i in ids if up[i] == i}
    # the passage that documents share is gone from all of them
    before = {r.doc_id: r.text or "" for r in seen["simhash_near_dedup"]}
    after = {r.doc_id: r.text or "" for r in seen["suffix_array_dedup"]}
    data = {i: t.encode() for i, t in before.items()}
    starts = defaultdict(list)
    for i, d in data.items():
        for s in range(len(d) - 399):
            starts[d[s : s + 400]].append((i, s))
    gone = defaultdict(set)
    for places in starts.values():
        if len(places) > 1:
            for i, s in places:
                gone[i].update(range(s, s + 400))
    assert len(gone) > 3
    for i, d in data.items():
        want = bytes(b for k, b in enumerate(d) if k not in gone[i]).decode()
        assert after.get(i, "") == want
    mixed = {r.doc_id for r in seen["mixing"]}
    assert mixed <= set(after) and 0 < len(mixed) < len(after)
    packed = seen["best_fit_packing"]
    assert {r.doc_id for r in packed} == mixed
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.CAPACITY
    assert toxicity.TOXIC_ROWS


def test_run_is_the_stages(spark, tmp_path):
    rows, labels = sample(10)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
