import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tessera.llm import simhash as S
from tessera.llm.components import connected

from .helpers import crowded, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d", "É é ß x  y\tz\v\f\rq", "a b c a b c a b c", "w" * 3000 + " x y z " * 50])
def test_fingerprint(text):
    assert S.fingerprint(text.encode() if text is not None else None) == brute_fingerprint(text)


def components(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(x) for x in range(n)]


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    points = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for _ in range(3)], np.zeros(1, np.uint64)]))
    tree = S.Tree(points, 8)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(points)))
    a, b = tree.near(points, 2)
    want = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def _links(spark, points, **limits):
    old = {k: getattr(S, k) for k in limits}
    try:
        for k, v in limits.items():
            setattr(S, k, v)
        df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
        return {r["node"]: r["component"] for r in connected(S.links(df)).collect()}
    finally:
        for k, v in old.items():
            setattr(S, k, v)


@pytest.mark.parametrize("limits", [{}, {"SHARD": 16, "MIN_DEPTH": 2, "SAMPLE": 128}, {"BLOCK": 20, "MIN_DEPTH": 1, "SHARD": 1000}])
def test_components_across_shards_and_blocks(spark, limits):
    rng = np.random.default_rng(4)
    chain = [int(rng.integers(0, 1 << 62))]
    for k in range(20):  # a chain of two-bit steps
        chain.append(chain[-1] ^ (3 << 3 * k))
    ball = [5 ^ (1 << k) for k in range(60)]  # a dense group
    points = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64), np.array(chain + ball + [0], np.uint64)]))
    near = np.argwhere(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    order = np.argsort(points.view(np.int64))
    rank = np.argsort(order)
    low = components(len(points), [(int(rank[a]), int(rank[b])) for a, b in near])
    signed = np.sort(points.view(np.int64))
    want = {int(signed[k]): int(signed[low[k]]) for k in range(len(points)) if low.count(low[k]) > 1}
    assert _links(spark, points, **limits) == want


@pytest.mark.parametrize("few", [0, None])
def test_connected_at_random(spark, few):
    rng = np.random.default_rng(6)
    pairs = [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(80)]
    names = sorted({x for p in pairs for x in p})
    at = {x: k for k, x in enumerate(names)}
    low = components(len(names), [(at[a], at[b]) for a, b in pairs])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(pairs, "a long, b long").repartition(7), few).collect()}
    assert got == {x: names[low[at[x]]] for x in linked}
    assert connected(spark.createDataFrame([], "a long, b long"), few).collect() == []


def test_query(spark):
    text = " ".join(f"word{k}" for k in range(300))
    docs = documents(spark, [text, text + " more", "quite another text of some words", text, None, ""], ids=[7, 5, 3, 9, 2, 1])
    rows = {r["doc_id"]: r for r in S.simhash_query(crowded(docs)).collect()}
    prints = {k: int(r["fingerprint"], 16) for k, r in rows.items()}
    assert prints[7] == brute_fingerprint(text) and prints[2] == prints[1] == 0
    for k, r in rows.items():
        assert len(r["fingerprint"]) == 16
        direct = [j for j in rows if (prints[j] ^ prints[k]).bit_count() <= 2]
        assert r["component_id"] <= min(direct)
    assert rows[9]["component_id"] == rows[7]["component_id"] and rows[2]["component_id"] == 1 and rows[3]["component_id"] == 3


def test_odd_rows_and_one_of_each_group(spark):
    docs = documents(spark, ["same text here"] * 5 + [None, None, "other words stay"], ids=[4, 4, None, 2, 2, None, None, 8])
    rows = S.simhash_query(docs).collect()
    assert len(rows) == 8
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 4)} == {2}
    out = S.distinct_documents(crowded(docs))
    assert out.columns == crowded(docs).columns
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect())
    assert kept == [("2", "same text here"), ("8", "other words stay"), ("None", "None")]
    assert S.simhash_query(docs.limit(0)).collect() == [] and S.distinct_documents(docs.limit(0)).count() == 0
