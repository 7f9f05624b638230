import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import substrings as S

from .helpers import crowded, documents


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(n))


def found(spark, texts, **more):
    return S.repeated(documents(spark, texts, **more)).collect()


def shingles(words):
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_units(spark):
    rng = np.random.default_rng(0)
    para, passage = prose(rng, 40), prose(rng, 55)
    words = para.split()
    near = " ".join(words[:20] + ["changed"] + words[21:])  # 5 of 36 shingles differ: 31 / 41 < 0.8
    nearer = " ".join(words[:-1] + ["end"])  # 35 / 37
    texts = [f"{prose(rng, 30)}\n{para}", f"{para}\n{prose(rng, 60)}", f"{prose(rng, 25)}\n{nearer}", near, f"{prose(rng, 33)} {passage} {prose(rng, 20)}", f"{prose(rng, 9)} {passage.upper()} {prose(rng, 70)}", prose(rng, 200), prose(rng, 12), "short line\nshort line"]
    rows = {(r["doc_id"], r["unit"], r["start"], r["n_words"], r["cluster_doc"], r["cluster_start"], r["kept"]) for r in found(spark, texts)}
    assert rows == {
        (0, "paragraph", 30, 40, 0, 30, True), (1, "paragraph", 0, 40, 0, 30, False), (2, "paragraph", 25, 40, 0, 30, False),
        (4, "passage", 33, 55, 4, None, True), (5, "passage", 9, 55, 4, None, False),
    }


def brute_passages(texts):
    """Word positions that windows of PASSAGE words cover which stand elsewhere, too."""
    from collections import Counter

    words = [(t or "").lower().split() for t in texts]
    window = lambda w, k: " ".join(w[k : k + S.PASSAGE])
    n = Counter(window(w, k) for w in words for k in range(len(w) - S.PASSAGE + 1))
    return {(d, j) for d, w in enumerate(words) for k in range(len(w) - S.PASSAGE + 1) if n[window(w, k)] > 1 for j in range(k, k + S.PASSAGE)}


def test_passages_cover_exactly_what_repeats(spark):
    rng = np.random.default_rng(3)
    pool = [prose(rng, int(n)) for n in (50, 51, 60, 90, 200, 49, 30)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 6)):
            p = pool[rng.integers(len(pool))].split()
            cut = slice(int(rng.integers(0, 20)), len(p) - int(rng.integers(0, 20))) if rng.random() < 0.4 else slice(None)
            parts += [" ".join(p[cut]), prose(rng, int(rng.integers(0, 40)))]
        texts.append(" ".join(parts))
    rows = [r for r in found(spark, texts) if r["unit"] == "passage"]
    got = {(r["doc_id"], j) for r in rows for j in range(r["start"], r["start"] + r["n_words"])}
    assert got == brute_passages(texts)
    # each window that repeats is kept once
    words = [t.split() for t in texts]
    kept = {}
    for r in rows:
        if r["kept"]:
            for k in range(r["start"], r["start"] + r["n_words"] - S.PASSAGE + 1):
                w = " ".join(words[r["doc_id"]][k : k + S.PASSAGE])
                kept.setdefault(w, []).append(r["doc_id"])
    assert all(len(set(d)) == 1 for d in kept.values())


@pytest.mark.parametrize("n", [50, 51, 60, 120])
def test_any_long_passage_has_a_common_seed(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        passage = prose(rng, n)
        sides = []
        for _ in range(2):
            t = S.Texts([f"{prose(rng, rng.integers(0, 40))} {passage} {prose(rng, rng.integers(0, 40))}".encode()], S._Words())
            sides.append(set(t.hashes(t.seeds(t.shingles()), S.SEED).tolist()))
        assert sides[0] & sides[1]


def test_anchors_are_windows_minima():
    rng = np.random.default_rng(5)
    for n in (0, 5, 29, 30, 31, 64, 200):
        h = rng.integers(0, 50, n, dtype=np.uint64)
        want = {k for s in range(n - S.WINDOW + 1) for k in range(s, s + S.WINDOW) if h[k] == h[s : s + S.WINDOW].min()}
        assert set(S.anchors(h).tolist()) == want


def test_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(6)
    a, b = prose(rng, 30), prose(rng, 70)
    one, two = S.Texts([a.encode(), b.encode()], S._Words()), S.Texts([None, b"", b.upper().encode(), b"x y"], S._Words())
    for size in (5, 20, 50):
        assert (one.hashes(np.arange(30, 100 - size), size) == two.hashes(np.arange(0, 70 - size), size)).all()
    assert len(set(one.hashes(np.arange(0, 96), 5).tolist())) == 96


def test_wrapped_lines_are_one_paragraph(spark):
    rng = np.random.default_rng(8)
    words = prose(rng, 90).split()
    wrap = lambda w: "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12))
    rows = found(spark, [f"{prose(rng, 20)}\n{wrap(words)}\n\n{prose(rng, 14)}", f"{wrap([*words[:-1], 'other'])}\n{prose(rng, 30)}", wrap(prose(rng, 60).split())])
    got = {(r["doc_id"], r["start"], r["n_words"], r["kept"]) for r in rows if r["unit"] == "paragraph"}
    assert got == {(0, 20, 90, True), (1, 0, 90, False)}


def test_recall_and_exactness(spark):
    """Every pair of paragraphs at 0.8 or more is connected, none below unless by a chain."""
    rng = np.random.default_rng(7)
    paras = []
    for _ in range(25):
        words = prose(rng, 60).split()
        paras.append(words)
        for _ in range(5):
            copy = list(words)
            for k in rng.integers(0, len(copy), rng.integers(1, 4)):
                copy[k] = "x" + str(rng.integers(100000))
            paras.append(copy)
    sets = [shingles(p) for p in paras]
    n = len(paras)
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if S.jaccard(sets[a], sets[b]) >= S.JACCARD and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    rows = [r for r in found(spark, [" ".join(p) for p in paras]) if r["unit"] == "paragraph"]
    got = {r["doc_id"]: r["cluster_doc"] for r in rows}
    want = {k: label[k] for k in range(n) if label.count(label[k]) > 1}
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.99 * len(want) and set(got) <= set(want)
    assert {d for d, c in got.items() if d == c} == {r["doc_id"] for r in rows if r["kept"]}


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_blocks_find_what_stars_miss(spark, monkeypatch, block):
    """One bucket of several components, whose members link with the largest one or with each other."""
    monkeypatch.setattr(S, "BLOCK", block)
    base, far = [f"w{k}" for k in range(40)], [f"v{k}" for k in range(40)]
    texts = [[f"q{k}" for k in range(40)], base, [*base[:-1], "z"], [f"u{k}" for k in range(40)], far, [*far[:-1], "z"], ["a", *far[1:]], ["b", *base[1:]]]
    sets = [sorted(hash(x) for x in shingles(t)) for t in texts]
    members = spark.createDataFrame([(0, 0, k, 0) for k in range(len(texts))], "band int, value int, cid long, first long")
    held = spark.createDataFrame(list(enumerate(sets)), "cid long, shingles array<long>")
    for parts in ([], [(1, 1), (2, 1), (7, 1)], [(4, 4), (5, 4), (6, 4)]):
        links = S._left_over(members, spark.createDataFrame(parts, "node long, component long"), held).collect()
        label = {k: k for k in range(len(texts))} | dict(parts)
        for r in links:
            a, b = label[r["a"]], label[r["b"]]
            label = {k: a if v == b else v for k, v in label.items()}
        groups = {}
        for k, v in label.items():
            groups.setdefault(v, set()).add(k)
        assert sorted(map(sorted, groups.values())) == [[0], [1, 2, 7], [3], [4, 5, 6]]


def test_repeated_rows_and_copies(spark):
    """Of each cluster one row is kept, whatever repeats."""
    rng = np.random.default_rng(2)
    words = prose(rng, 40).split()
    para, near = " ".join(words), " ".join([*words[:-1], "end"])
    rows = found(spark, [para, para, near, near, para], ids=[3, 3, 4, 5, None])
    by = {}
    for r in rows:
        by.setdefault(r["unit"], []).append((r["doc_id"], r["cluster_doc"], r["kept"]))
    assert sorted(by["text"], key=str) == sorted([(3, 3, True), (3, 3, False), (None, 3, False), (4, 4, True), (5, 4, False)], key=str)
    assert sorted(by["paragraph"]) == [(3, 3, True), (4, 3, False)]
    assert sorted(map(str, found(spark, [para, para, near, near, para], ids=[3, 3, 4, 5, None]))) == sorted(map(str, rows))


def test_copies_that_are_not_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [prose(rng, 60) for _ in range(6)]
    docs = [texts[k % 6] if k < 9 else f"{prose(rng, 5)} {texts[k % 6]}" for k in range(15)]
    want = sorted(map(str, found(spark, docs)))
    monkeypatch.setattr(S, "MOST_COPIES", 0)
    assert sorted(map(str, found(spark, docs))) == want and want


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    para, long = prose(rng, 20), prose(rng, 30000)
    docs = documents(spark, [None, "", para, f"{para}\n{para}", " \n ", " \n ", "w", long, f"x {long}"], ids=[None, None, None, 3, 3, 4, 4, 5, 6])
    rows = S.repeated(crowded(docs).drop("start", "unit")).collect()
    got = sorted((r["unit"], r["doc_id"] is None, r["doc_id"], r["start"], r["n_words"], r["cluster_doc"], r["kept"]) for r in rows)
    long_line = [("paragraph", False, 5, 0, 30000, 5, True), ("paragraph", False, 6, 0, 30001, 5, False)]
    assert got == [("paragraph", False, 3, 0, 20, 3, True), ("paragraph", False, 3, 20, 20, 3, False), *long_line, ("paragraph", True, None, 0, 20, 3, False), ("passage", False, 5, 0, 30000, 5, True), ("passage", False, 6, 1, 30000, 5, False)]
    assert S.repeated(docs.limit(0)).collect() == []
    assert S.repeated(docs.withColumn("text", F.lit(None).cast("string"))).collect() == []
