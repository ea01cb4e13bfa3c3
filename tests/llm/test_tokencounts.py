"""Token counts against the tokenizer library."""

import random

import pytest

from logloom.llm import tokencounts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "", " ", "\n", "  two  spaces\n\n and  tabs\t\tx", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "it's we'LL 'll 'S", "\x1c\x1d\x85 x",
    "aaaaaaaa" * 300, "0123456789" * 200, "é漢字\U0001f600 ²½", "\U0001f600" * 50, "՘a ͸", "x" * 30_000, " end ", "a  b　c",
]


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]


def texts():
    r = random.Random(3)
    parts = ["a", "b", " ", " ", "\n", "'s", "1", "²", "é", "漢", "\U0001f600", "the", "!!", "\t", "<|endoftext|>", "\r", "\x1f", "՘", "ing", "Th"]
    return ODD + ["".join(r.choice([*parts, chr(r.randrange(0x20, 0xD7FF)), chr(r.randrange(0x10000, 0x10FFFF))]) for _ in range(r.randrange(60))) for _ in range(1500)]


@pytest.mark.parametrize("small", [False, True])
def test_counts_are_the_library_s(spark, monkeypatch, small):
    if small:  # texts are taken in slices and memos emptied
        for name, n in (("LONG", 20), ("SLICE", 7), ("MEMO", 50)):
            monkeypatch.setattr(tokencounts, name, n)
    data = texts()
    assert tokencounts.Counter(PATH).counts(data) == library(data)


def test_report(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(ODD)] + [(None, None, 1, "x"), (None, "a b", 1, "x"), (1, "a b", 1, None), (1, "a b", 1, None), (9, "long words " * 100_000, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, over_limit string").repartition(3)
    got = tokencounts.report(docs, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    plain = [t or "" for _, t, *_ in rows]
    want = [(d, len(t.encode()), n, n > 512) for (d, *_), t, n in zip(rows, plain, library(plain), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert tokencounts.report(docs.limit(0), PATH).collect() == []
    assert tokencounts.with_counts(docs, PATH, limit=1).columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]


def test_a_vocabulary_whose_ranks_are_not_in_order_is_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    m = spec["model"]["merges"]
    m[0], m[-1] = m[-1], m[0]
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        tokencounts.Merges(str(path))


def test_overlapping_pairs_merge_from_the_left():
    counts = tokencounts.Merges(PATH).counts
    words = [b" " * n for n in range(1, 40)] + [b"a" * n for n in range(1, 40)]
    assert counts(words).tolist() == library([w.decode() for w in words])
