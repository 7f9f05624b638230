import duckdb
import pytest

from tessera.llm import mixing

from .helpers import crowded, documents


def fill(sizes, weights, cap=3):
    """Targets by repeated resharing."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_ and total > 1e-9:
        w = sum(weights[k] for k in open_)
        over = {k for k in open_ if out[k] + total * weights[k] / w >= cap * sizes[k]}
        if not over:
            for k in open_:
                out[k] += total * weights[k] / w
            break
        share = {k: total * weights[k] / w for k in open_}
        total = 0.0
        for k in list(open_):
            out[k] += share[k]
            if out[k] > cap * sizes[k]:
                total += out[k] - cap * sizes[k]
                out[k] = cap * sizes[k]
        open_ -= {k for k in over if out[k] >= cap * sizes[k]}
    return out


@pytest.mark.parametrize("lengths", [{"a": [5] * 40, "b": [7] * 30, "c": [3] * 50}, {"a": [2], "b": [900] * 20, "c": [11, 13], None: [4] * 9}, {"a": [50], "b": [1]}])
def test_targets_and_taken(spark, lengths):
    texts, sources = [], []
    for s, ns in lengths.items():
        for k, n in enumerate(ns):
            texts.append(" ".join(f"w{k}" for _ in range(n)))
            sources.append(s)
    rows = mixing.mix_query(documents(spark, texts, sources)).collect()
    order = sorted((s for s in lengths if s is not None)) + ([None] if None in lengths else [])
    sizes = [sum(lengths[s]) for s in order]
    want = fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))])
    assert sum(want) == pytest.approx(sum(sizes))
    by = {s: [] for s in order}
    for r in rows:
        by[sources[r["doc_id"]]].append(r)
    for s, size, target in zip(order, sizes, want, strict=True):
        assert {r["source_size"] for r in by[s]} == {size}
        assert by[s][0]["target"] == pytest.approx(target)
        assert sum(r["taken"] for r in by[s]) == int(target + 1e-9)
        assert all(r["taken"] <= 3 * r["size"] for r in by[s])
        epochs = int(target / size)
        assert all(r["taken"] >= epochs * r["size"] for r in by[s])  # whole epochs come first


def test_keys_match_a_sorted_sample(spark):
    """The fractional part is a prefix of the order of keys, across several buckets."""
    n = 9000
    docs = documents(spark, ["one two three" if k % 3 else "one #### %%%% $$$$" for k in range(n)] + ["x " * 4000], ["a"] * n + ["b"])
    rows = {r["doc_id"]: r for r in mixing.mix_query(docs).collect()}
    keys = {r["doc_id"]: r["_key"] for r in mixing.sized(docs, "doc_id").collect()}
    own = sorted(range(n), key=keys.get)
    extra = [rows[k]["taken"] - (rows[k]["target"] // rows[k]["source_size"]) * rows[k]["size"] for k in own]
    whole = [e == rows[k]["size"] for e, k in zip(extra, own, strict=True)]
    first = whole.index(False) if False in whole else n
    assert all(whole[:first]) and sum(extra[first + 1 :]) == 0
    # symbols lower the weight: such documents come later on average
    rank = {k: i for i, k in enumerate(own)}
    assert sum(rank[k] for k in range(0, n, 3)) / (n / 3) > sum(rank[k] for k in range(1, n, 3)) / (n / 3)


def test_oracle_of_sizes(spark):
    texts = ["a  b\tc\nd\ve\ff\rg", "", None, " ", "x\u00a0y z", "\u2003"]
    got = {r["doc_id"]: r["size"] for r in mixing.mix_query(documents(spark, texts)).collect()}
    assert got == {0: 7, 1: 0, 2: 0, 3: 0, 4: 2, 5: 1}
    assert duckdb.sql("select len(regexp_extract_all('a  b', '[^\\x20\\x09-\\x0D]+'))").fetchall()[0][0] == 2


def test_odd_rows(spark):
    docs = documents(spark, [None, "a b", "a b", "", "c"], [None, "s", "s", None, None], ids=[None, 1, 1, 2, None])
    rows = mixing.mix_query(crowded(docs)).collect()
    assert len(rows) == 5 and sum(r["taken"] for r in rows) <= 5
    assert mixing.mix_query(docs.limit(0)).collect() == []
    assert sorted(map(str, mixing.mix_query(docs).collect())) == sorted(map(str, rows))  # reruns agree


def test_documents_are_repeated(spark):
    docs = documents(spark, ["a b c d"] * 3 + ["p q r s t u v w x y"] * 30, ["a"] * 3 + ["b"] * 30)
    mixed = mixing.mixed_documents(crowded(docs).drop("size"))
    assert mixed.columns == crowded(docs).drop("size").columns
    rows = mixed.collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_query(docs).collect()}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert got == {k: v for k, v in taken.items() if v}


def test_many_rows_of_one_key(spark):
    """Rows without an id share one key: they enter by size, and equal ones are numbered over all pieces of the table."""
    n = 1200
    texts = [" ".join(["w"] * (1 + k % 3)) for k in range(n)]
    ids = [None if k % 3 else k for k in range(n)]
    docs = documents(spark, texts + ["x " * 700], ["a"] * n + ["b"], ids=[*ids, n]).repartition(5)
    sized = {}
    for r in mixing.sized(docs, "doc_id").collect():
        sized.setdefault(r["_source"], []).append((r["_key"], -1 if r["doc_id"] is None else r["doc_id"], r["_size"]))
    rows = mixing.mix_query(docs).collect()
    by = {r["source_size"]: r["target"] for r in rows}
    want = []
    for found in sized.values():
        size = sum(x[2] for x in found)
        epochs, left = int(by[size] // size), int(by[size]) - int(by[size] // size) * size
        for _, i, k in sorted(found):
            want.append((i, k, epochs * k + max(0, min(k, left))))
            left -= k
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["taken"]) for r in rows) == sorted(want)


@pytest.mark.parametrize("size", [1, 4])
def test_budget_ends_among_equal_rows(spark, size):
    texts = ["w " * size] * 90
    docs = documents(spark, texts + ["x " * (size * 50 + 1)], ["a"] * 90 + ["b"], ids=[None] * 90 + [1]).repartition(4)
    rows = mixing.mix_query(docs).collect()
    own = [r for r in rows if r["doc_id"] is None]
    assert len(own) == 90 and sum(r["taken"] for r in own) == int(own[0]["target"])
    kept = mixing.mixed_documents(docs).where("source = 'a'").collect()
    assert sum(len(r["text"].split()) for r in kept) == int(own[0]["target"])
