"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from logloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos long, grp string, steps string, top string, _left long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fanout):
    """The root of nodes and each one's siblings, level by level, with the places of its own node among them."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, q in enumerate(at):
            run = nodes[q // fanout * fanout :][: fanout]
            ways[i].append((run, q % fanout))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [q // fanout for q in at]
    return nodes[0], ways


def brute(rows, fanout=3):
    per = {}
    for r in rows:
        per.setdefault(r[1], []).append((r[0], leaf(*r[:5]), r))
    keys = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    subs, ways = [], {}
    for s in keys:
        per[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, way = tree([x[1] for x in per[s]], fanout)
        subs.append(root)
        ways[s] = way
    root, high = tree(subs, fanout)
    out = []
    for s, sub, up in zip(keys, subs, high, strict=True):
        for (doc_id, own, r), way in zip(per[s], ways[s], strict=True):
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            node = leaf(*r[:4], r[4].replace("\n", "") if r[4] is not None else None) if bad else own
            proof = ""
            for run, q in way + up:
                proof += "".join(x for j, x in enumerate(run) if j != q)
                node = h(*(node if j == q else x for j, x in enumerate(run)))
            out.append((doc_id, own, sub, root, h(proof), node, node == root))
    return sorted(out, key=repr)


def rows():
    out = [(i, "hot", "en", i, f"line {i}\nnext") for i in range(40)]
    out += [(i, f"s{i % 5}", None if i % 3 else "de", None, "é" * i) for i in range(40, 60)]
    out += [(None, None, None, None, None), (None, "hot", "en", 3, "x\n"), (None, "hot", "en", 3, "x\n"), (7, "hot", "en", 7, "again"), (90, "", "", 0, ""), (91, "long", "en", 1, "a b\n" * 200_000)]
    return out


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_is_that_of_a_plain_tree(spark, levels):
    data = rows()
    docs = spark.createDataFrame([(*r, -1, "x", "y", "z", 4) for r in data], SCHEMA)
    want = brute(data)
    if levels == merkle.LEVELS:
        got = merkle.report(docs)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    leaves = docs.select("doc_id", "source", merkle.leaf_of(*[F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    got = merkle.manifest(leaves, levels=levels)
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("steps"))), merkle.folded(F.col("leaf"), F.col("steps")))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*w[:5], w[3]) for w in want), key=repr)


def test_tampering_is_seen_where_line_feeds_went(spark):
    data = [(i, "a", "en", 1, "x\ny" if i % 2 else "xy") for i in range(30)]
    got = merkle.report(spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string"))
    assert {r.doc_id for r in got.collect() if not r.verified} == {i for i in range(1, 30, 2) if zlib.crc32(str(i).encode()) % 2 == 0}


def test_one_row_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    (one,) = merkle.report(docs).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h()
    assert merkle.report(docs.limit(0)).collect() == []
