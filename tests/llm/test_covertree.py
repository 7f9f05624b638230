import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import covertree as C

from .test_simhash import components


def cloud(rng, n=60, dim=16):
    base = C.unit(rng.standard_normal((n, dim)))
    near = [base[k] + 0.12 * C.unit(rng.standard_normal((1, dim)))[0] * rng.random() for k in rng.integers(0, n, 3 * n)]
    dense = [base[0] + 0.05 * C.unit(rng.standard_normal((1, dim)))[0] for _ in range(40)]
    edge = [base[1] + s * C.unit(rng.standard_normal((1, dim)))[0] for s in np.linspace(0.3, 0.6, 40)]
    return np.concatenate([base, near, dense, edge, base[:5], 3 * base[5:8]]).astype(np.float32)


def brute(x, ids, threshold=0.9):
    u = C.unit(x)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    order = np.argsort(ids)
    low = components(len(x), [tuple(sorted((int(np.where(order == a)[0][0]), int(np.where(order == b)[0][0])))) for a, b in np.argwhere(np.triu(link))])
    rank = np.argsort(order)
    return {int(i): (int(link[k].sum()), int(ids[order[low[rank[k]]]])) for k, i in enumerate(ids)}


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 24}, {"BLOCK": 10, "CELLS": 3}, {"BLOCK": 40, "LOCAL": 4, "PRODUCT": 64}])
def test_against_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(C, k, v)
    rng = np.random.default_rng(8)
    x = cloud(rng)
    ids = rng.permutation(len(x)) + 100
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int")
    rows = C.near_vectors(df.repartition(3)).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}
    assert len(rows) == len(x) and got == brute(x, ids)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_tree_covers():
    rng = np.random.default_rng(1)
    x = C.unit(rng.standard_normal((500, 3)))
    tree = C.CoverTree(x, 200)
    assert tree.levels == sorted(tree.levels) and tree.levels[0] == 1 and tree.levels[-1] == len(tree.centers)
    width = 2.0
    for n in tree.levels[1:-1]:
        gaps = C._apart(tree.centers[:n], tree.centers[:n]) + 9 * np.eye(n)
        cover = C._apart(tree.centers, tree.centers[:n]).min(1).max()
        assert gaps.min() >= cover - 1e-9  # a net: apart by what it covers within
        width = min(width, gaps.min())
    leaf, far = tree.assign(x)
    radius = np.full(len(tree.centers), -1.0)
    np.maximum.at(radius, leaf, far)
    may = C.dual(tree, radius, tree, radius, 0.1)
    i, j = np.nonzero(C._apart(x, x) <= 0.1)
    assert may[leaf[i], leaf[j]].all()  # nothing near is pruned
    assert may.mean() < 0.5  # and in few dimensions most pairs of nodes are


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [2.0, 0.0], None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0, 0.0], [1.0, 0.0, 0.01], [1e-30, 1e-30], [1e30, 1e30], [-0.0, 1.0], [0.0, 1.0]]
    ids = [3, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None, None]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("vec", "n", "cls", "kept", "node", "component", "n_links")})
    rows = C.near_vectors(df).collect()
    assert len(rows) == len(ids)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows if r["vec_id"] is not None}
    assert got[3] == (1, 2, False) and got[2] == (1, 2, True)
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False)
    assert got[12] == (1, 12, True) and got[13] == (1, 12, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9))
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in rows if r["vec_id"] is None] == [(1, None, True)] * 2
    assert C.near_vectors(df.limit(0)).collect() == []


def test_repeated_rows_link(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (5, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in C.near_vectors(df).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (5, 2, 1, False)]


def test_rounding_loses_no_link():
    """A centre, a near copy of it and a query just over the threshold from the copy: a ball of computed radius 0 holds both."""
    rng = np.random.default_rng(12)
    lost = 0
    for _ in range(400):
        centre = C.unit(rng.standard_normal((1, 64)))
        copy = C.unit(centre + 1.2e-8 * C.unit(rng.standard_normal((1, 64))))
        away = rng.standard_normal((1, 64))
        away = C.unit(away - (away @ copy.T) * copy)
        query = C.unit(0.9 * copy + np.sqrt(1 - 0.81) * away)
        step = 1e-17
        while (query * copy).sum() < 0.9:
            query, step = C.unit(query + step * copy), step * 2
        x = C._Side(np.arange(2), np.ones(2, np.int64), np.concatenate([centre, copy]))
        y = C._Side(np.arange(2, 3), np.ones(1, np.int64), query)
        found = {(int(x.ids[a]), int(y.ids[b])) for i, j in C.compare(x, y, 0.9) for a, b in zip(i, j, strict=True)}
        want = {(k, 2) for k, v in enumerate((centre, copy)) if (v[0] * query[0]).sum() >= 0.9}
        lost += bool(want - found)
    assert not lost
