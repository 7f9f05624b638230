import os

import numpy as np
import pytest

from tessera.llm import sentencepieces as P

from .helpers import crowded, documents

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no piece model here")


@pytest.fixture(scope="module")
def pieces():
    return P.load()


def ids(pieces, text):
    return np.frombuffer(pieces.encode([text.encode()])[0], np.int32).tolist()


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def library():
    """The public library with the same pieces and scores, as a unigram model."""
    import struct

    import sentencepiece

    found, out, k = P.read_pieces(P.MODEL), b"", 0
    scores = P.zipf_scores(found)
    with open(P.MODEL, "rb") as f:
        data = f.read()
    for number, kind, value in P.fields(data):
        if number == 1:
            piece, of = found[k]
            body = b"\x0a" + varint(len(piece)) + piece + b"\x15" + struct.pack("<f", scores[k]) + b"\x18" + varint(of)
            k += 1
        elif number == 2:
            body = b"".join(varint(n << 3 | t) + (varint(1 if n == 3 else v) if t == 0 else varint(len(v)) + v if t == 2 else v) for n, t, v in P.fields(value))
        else:
            body = value
        out += varint(number << 3 | 2) + varint(len(body)) + body if kind == 2 else varint(number << 3 | kind) + varint(value)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


TEXTS = ["Hello world, this is a test.", "  two  spaces   here ", "line\n\n\nbreaks\tand tabs", "naïve façade über ñandú", "日本語と中文 mixed", "emoji 😀😃 and \u0000 zero", "x" * 200, "The internationalization of ununununium", "", " ", "a", "1234567890 3.14159", "​﻿"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library_and_back(pieces, library, text):
    got = ids(pieces, text)
    assert pieces.decode(got) == text.encode()
    want = library.encode(text)
    score = lambda seq: sum(float(pieces.scores[i]) for i in seq)
    assert got == want or len(got) == len(want) and score(got) == pytest.approx(score(want), rel=1e-6)  # ties may fall either way


def test_random_round_trips(pieces):
    rng = np.random.default_rng(0)
    alphabet = list("abe \n▁é語😀.%") + ["the", " and", "\r"]
    for _ in range(200):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pieces.decode(ids(pieces, text)) == text.encode()


def test_many_and_alone_agree(pieces):
    units = [b" the", b" internationalization", "é".encode(), b"\xff", b" " * 7, b"zzzzqqqq" * 8, "日本語と".encode() * 3]
    assert [pieces._alone([u.replace(b" ", P.MARK)])[0] for u in units] == [pieces._many([u.replace(b" ", P.MARK)], len(u.replace(b" ", P.MARK)))[0] for u in units]


def test_viterbi_is_best():
    toy = [(b"<unk>", 2)] + [(f"<0x{k:02X}>".encode(), 6) for k in range(256)] + [(p.encode(), 1) for p in ("▁", "a", "b", "ab", "ba", "aba", "▁a", "bb")]
    scores = np.zeros(len(toy), np.float32)
    scores[257:] = [-3, -2, -2.5, -3, -3.5, -4.9, -2.2, -4]
    own = P.Pieces(toy, scores)

    def best(u):
        if not u:
            return 0.0, ()
        found = [(float(scores[k]) + best(u[len(p) :])[0], (k, *best(u[len(p) :])[1])) for k, (p, kind) in enumerate(toy) if kind == 1 and u.startswith(p)]
        return max(found) if found else (-1e9, ())

    for text in ("abab", "aabba", "bbbb", "abaaba", "b"):
        got = np.frombuffer(own.encode([text.encode()])[0], np.int32).tolist()
        assert sum(float(scores[k]) for k in got) == pytest.approx(best("▁".encode() + text.encode())[0], abs=1e-5)


def test_query(spark):
    texts = [None, "", "some text", "some text", "a▁b  c\n" * 300]
    df = P.encode_documents(crowded(documents(spark, texts, ids=[None, 1, 2, 2, 3])).drop("ids"), "doc_id")
    rows = df.collect()
    assert [r["round_trip"] for r in rows] == [True] * 5
    assert rows[0]["ids"] is None and rows[0]["n_tokens"] == 0 and rows[1]["ids"] == [] and rows[2] == rows[3]
    assert all(r["n_tokens"] == len(r["ids"] or []) for r in rows) and rows[4]["n_byte_tokens"] >= 900
    assert P.encode_documents(documents(spark, ["x"]).limit(0), "doc_id").collect() == []


def test_cache_is_bounded(monkeypatch, pieces):
    monkeypatch.setattr(P, "CACHE", 50)
    for k in range(20):
        text = " ".join(f"w{k}x{j}" for j in range(30))
        assert pieces.decode(ids(pieces, text)) == text.encode()
    assert len(pieces._cache) <= 60
