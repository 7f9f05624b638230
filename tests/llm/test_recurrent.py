import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import recurrent as R

from .helpers import crowded, documents


def corpus(rng, n):
    """Pairs of words follow each other; some words are rare."""
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.integers(3, 60)):
            k = int(rng.integers(0, 20))
            words += [f"left{k}", f"Right{k}"]
            if rng.random() < 0.1:
                words.append(f"rare{rng.integers(0, 5000)}")
        out.append(" ".join(words))
    return out


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + ["\n"]


def test_base_and_model(spark, monkeypatch):
    monkeypatch.setattr(R, "KNOWN", 1500)
    rng = np.random.default_rng(0)
    texts = corpus(rng, 700)
    rows = R.score_documents(documents(spark, texts).repartition(2)).collect()
    held = {k: crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))}
    counts = Counter(t for k, x in enumerate(texts) if not held[k] for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(t in counts for t in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)
    out = [r for r in rows if r["held_out"]]
    per = lambda c: sum(r[c] for r in out) / sum(r["n_tokens"] for r in out)
    assert per("score") > per("base_score") + 0.15  # it has learnt what follows


def small():
    words = [b"\n", *[f"w{k}".encode() for k in range(R.M + 300)]]
    counts = np.arange(len(words), 0, -1).astype(float)
    shares = np.ones(R.ENDINGS)
    for w, c in zip(words[R.M :], counts[R.M :], strict=True):
        shares[R.ending(w)] += c + 1
    return R.Words(words, counts, shares), words, counts, shares


def test_probabilities_sum_to_one():
    own, words, counts, shares = small()
    p = R.initial(own)
    rng = np.random.default_rng(1)
    for k in p:
        p[k] = p[k] + rng.standard_normal(p[k].shape).astype(np.float32) * 0.1
    h = rng.standard_normal((1, R.HIDDEN)).astype(np.float32)
    total = 0.0
    for k in range(len(words)):
        number = np.array([k])
        _, kind = own.inputs(number)
        log, _ = R.outputs(p, h, kind, number)
        total += math.exp(log[0]) * (1 if k < R.M else (counts[k] + 1) / shares[R.ending(words[k])])
    for c in range(R.ENDINGS):  # the share of words that weren't counted
        log, _ = R.outputs(p, h, np.array([R.M // R.S + c]), np.array([-1 - c]))
        total += math.exp(log[0]) / shares[c]
    assert total == pytest.approx(1, abs=1e-4)


def test_gradients():
    own, *_ = small()
    rng = np.random.default_rng(2)
    p = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float64) for k, v in R.initial(own).items()}
    number = rng.integers(0, R.M + 200, (5, 3))
    seen, kind = own.inputs(np.vstack([number[-1:], number[:-1]]))[0], own.inputs(number)[1]
    valid = np.array([[True] * 3] * 4 + [[True, False, False]])
    h = rng.standard_normal((3, R.HIDDEN))

    def loss(q):
        _, _, total = R.backpropagate(q, seen, kind, number, valid, h)
        return -total / valid.sum()

    grads, _, _ = R.backpropagate(p, seen, kind, number, valid, h)
    for k in p:
        flat = p[k].reshape(-1)
        used = np.flatnonzero(np.abs(grads[k].reshape(-1)) > 1e-4)
        for at in rng.choice(used, min(4, len(used)), replace=False):
            old, eps = flat[at], 1e-4
            flat[at] = old + eps
            up = loss(p)
            flat[at] = old - eps
            down = loss(p)
            flat[at] = old
            assert grads[k].reshape(-1)[at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-4)


def test_state_is_carried_over_windows():
    own, words, *_ = small()
    p = R.initial(own)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, R.M + 200, n) for n in (1, 31, 32, 33, 200, 64)]
    got = R.scores(p, own, docs)
    for d, g in zip(docs, got, strict=True):
        table, h, last, total = p["embed"] @ p["wx"] + p["b"], np.zeros((1, R.HIDDEN), np.float32), R._START, 0.0
        for x in d:
            h = R.step(p, table[[last]], h)[0]
            seen, kind = own.inputs(np.array([x]))
            total += R.outputs(p, h, kind, np.array([x]))[0][0]
            last = seen[0]
        assert g == pytest.approx(total / math.log(10), rel=1e-4)


def test_odd_rows(spark):
    docs = documents(spark, [None, "", "a b", "a b", "x " * 3000, "Q"], ids=[None, 1, 2, 2, 3, 4])
    rows = R.score_documents(crowded(docs)).collect()
    assert len(rows) == 6 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (None, 1)] == [1, 1]
    assert R.score_documents(docs.limit(0)).collect() == []


def test_every_token_trains(spark, monkeypatch):
    """Each token of each document is a target once a round, and the state goes on through a document only."""
    texts = ["", None, "a b c", " ".join(f"w{k % 50}" for k in range(500)), "x " * 200]
    docs = documents(spark, texts).coalesce(1)
    words = R.Words([b"a", R.END], np.array([1, 5]), np.array([0.5, 0.5]))
    real = R.backpropagate
    seen = []

    def spy(p, inputs, kind, number, valid, h):
        seen.append((int(valid.sum()), [bool((h[k] == 0).all()) == bool(inputs[0, k] == R._START) for k in range(len(h))]))
        return real(p, inputs, kind, number, valid, h)

    monkeypatch.setattr(R, "backpropagate", spy)
    monkeypatch.setattr(R, "BATCH", 2)

    class Here:
        """mapInArrow in this process."""

        def __init__(self, df):
            self.df = df

        def select(self, *columns):
            return Here(self.df.select(*columns))

        def mapInArrow(self, run, schema):
            return spark.createDataFrame(pa.Table.from_batches(run(iter(self.df.toArrow().to_batches()))).to_pandas(), schema)

    class Value:
        def __init__(self, value):
            self.value = value

    R.train_round(Here(docs), Value(words), Value(R.flat(R.initial(words))), 0)
    assert sum(n for n, _ in seen) == sum(len(R.tokens_of(t and t.encode())) for t in texts)
    assert all(all(same) for _, same in seen)


def test_columns_are_numbered_like_texts():
    """Whole columns at once: white space at the ends, words of one byte and of many, other scripts, rare ones, no end known."""
    texts = [None, "", " \t", "  A b\x0bB ", "é a\x85b É W7 w7", "w3 unseen w999999 x Ж unseen", "Q" * 70_000, "w5"]
    for known in ([R.END, b"a", b"w5", b"w7", *[f"w{k}".encode() for k in range(10, R.M + 300)]], [b"a", b"w3"], []):
        words = R.Words(known, np.ones(len(known)), np.ones(R.ENDINGS))
        numbers, cuts, rare, rare_cuts = words.texts(pa.array(["cut off", *texts]).slice(1))
        rank = {w: k for k, w in enumerate(known)}
        for k, t in enumerate(texts):
            own = R.tokens_of(t and t.encode())
            assert numbers[cuts[k] : cuts[k + 1]].tolist() == [rank.get(w, -1 - R.ending(w)) for w in own]
            assert [w.encode() for w in rare[rare_cuts[k] : rare_cuts[k + 1]].to_pylist()] == [w for w in own if w not in rank]


def test_outputs_of_many_rows():
    """Rows in blocks by class, some not valid: the same as one softmax after the other, and gradients of the sum of losses."""
    own, words, *_ = small()
    rng = np.random.default_rng(4)
    p = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float64) for k, v in R.initial(own).items()}
    for n in (1, 300, 7000):
        number = np.where(rng.random(n) < 0.4, rng.integers(0, 5, n), rng.integers(-R.ENDINGS, len(words), n))
        h, valid, kind = rng.standard_normal((n, R.HIDDEN)), rng.random(n) < 0.8, own.inputs(number)[1]
        want, by = np.zeros(n), np.zeros_like(h)
        grads, slow = ({k: np.zeros(s) for k, s in R.SHAPES.items()} for _ in range(2))
        for i in np.flatnonzero(valid):
            for weights, bias, target in [("wc", "bc", kind[i])] + [("ww", "bw", number[i] % R.S)] * bool(kind[i] < R.M // R.S):
                at = slice(kind[i] * R.S, (kind[i] + 1) * R.S) if weights == "ww" else slice(None)
                w = p[weights].T if weights == "wc" else p[weights][at]
                x = np.exp(w @ h[i] + p[bias][at])
                x /= x.sum()
                want[i] += math.log(x[target])
                x[target] -= 1
                by[i] += x @ w
                slow[bias][at] += x
                part = np.outer(x, h[i])
                slow[weights][at] += part.T if weights == "wc" else part
        logs, dh = R.outputs(p, h, kind, number, grads, valid)
        assert np.allclose(logs, want) and np.allclose(dh, by) and all(np.allclose(grads[k], slow[k]) for k in grads)
        assert np.allclose(R.outputs(p, h, kind, number, None, valid)[0], want)
