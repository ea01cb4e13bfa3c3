import random
import zlib

import numpy as np
import pytest

from logloom.llm import coder

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("seed", range(6))
def test_round_trip(seed):
    r = np.random.default_rng(seed)
    n = [0, 1, 5, 3000, 20000, 4096][seed]
    base = r.integers(0, 49408, 300)
    ids = base[(r.zipf(1.3, n) % 300)] if seed % 2 else np.where(r.random(n) < 0.1, r.integers(0, 1 << 16, n), 7)
    blocks, crcs = coder.encode(ids, 512)
    assert (coder.decode(blocks, crcs, n, 512) == ids).all()
    if n > 1000:
        assert sum(map(len, blocks)) < 2 * n
        with pytest.raises(ValueError):
            coder.decode([blocks[0][:6] + b"\x55\xaa\x55" + blocks[0][9:], *blocks[1:]], crcs, n, 512)


def test_repeats_cost_little():
    ids = np.tile(np.random.default_rng(1).integers(0, 50000, 50), 200)
    blocks, _ = coder.encode(ids, 2048)
    assert sum(map(len, blocks)) < len(ids) // 3


def test_a_block_is_decoded_alone():
    ids = np.random.default_rng(4).integers(0, 1 << 16, 5000) >> np.random.default_rng(5).integers(0, 14, 5000)
    blocks, crcs = coder.encode(ids, 1000)
    for i in (3, 0, 4):
        assert (coder.decode([blocks[i]], [crcs[i]], 1000, 1000) == ids[1000 * i : 1000 * i + 1000]).all()


def test_many_records_and_very_long_texts(spark, tmp_path):
    """Records that follow others in their part, and texts longer than a record."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(7)
    texts = [" ".join(r.choice(["one", "two|", "|", "three <|endoftext|> x", "trois,"]) for _ in range(n)) for n in [40] * 90 + [30_000, 0, 5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    coder.write(df, f"{tmp_path}/ids", path, block=64, record=1000)
    assert spark.read.parquet(f"{tmp_path}/ids").filter("seq > 1 and before > 0").count() > 1
    got = {x.doc_id: x for x in coder.read(spark, f"{tmp_path}/ids", block=64).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_report(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(2)
    texts = [" ".join(r.choice(["Thion", "er,", "été", "an", "re."]) for _ in range(r.randint(0, 80))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(3 * i, x, 1) for i, x in enumerate(texts)] + [(3, texts[1], 1), (None, "a", 1)], "doc_id long, text string, start int").repartition(5)
    got = coder.report(df, path).collect()
    rows = sorted([(3 * i, x or "") for i, x in enumerate(texts)] + [(3, texts[1]), (-1, "a")])
    start, want = 0, []
    for i, x in rows:
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.start, g.n_tokens, g.ids_crc32) for g in got) == want
    assert coder.report(df.limit(0), path).count() == 0
