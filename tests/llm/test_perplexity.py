import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import perplexity as P

from .helpers import crowded, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "a a a", "a a a a", "x y z x y z", "a b\na b\n\n a b\n", "\n\n", "é # * ünï\u00a0code\r\nline\r\nline\r\n", "a b c d e a b c", "w " * 500, "\ud83d\ude00 <b>|&$%</b> \x1c\x85 q"])
def test_base_counts(text):
    text = text and text.encode("utf-16", "surrogatepass").decode("utf-16")
    assert P.base_counts(text) == brute(text)


def test_base_counts_at_random():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(rng.choice(list("ab #\n\t"), rng.integers(0, 60)))
        assert P.base_counts(text) == brute(text)


def _kneser_ney(counts):
    """The same model, defined recursively over tuples."""
    levels = {4: counts}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discounts, contexts = {}, {}
    for n, c in levels.items():
        of = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] and of[1] else 0.5
        discounts[n] = [min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.05), k - 0.05) if of[k - 1] else 0.5 * k for k in (1, 2, 3)]
        contexts[n] = {}
        for g, v in c.items():
            contexts[n].setdefault(g[:-1], []).append(v)

    def p(g):
        n = len(g)
        if not n:
            return 1 / P.CLASSES
        seen = contexts[n].get(g[:-1])
        if seen is None:
            return p(g[1:])
        d = lambda v: discounts[n][min(int(v), 3) - 1]
        v = levels[n].get(g, 0)
        return (v - d(v) if v else 0) / sum(seen) + sum(map(d, seen)) / sum(seen) * p(g[1:])

    return p


def test_model_against_definition(spark):
    texts = ["the cat sat on the mat", "a cat, a hat.", "THE end #1", "mat hat cat sat"] * 3
    counts = Counter()
    for t in texts:
        c = [0, 0, 0, *(int(P.TABLE[min(ord(x), 65535)]) for x in t)]
        counts.update(tuple(c[k : k + 4]) for k in range(len(t)))
    model = P.train(documents(spark, texts))
    p = _kneser_ney(counts)
    for t in ["the cat", "zzz##", "A man sat"]:
        codes, lengths = P.ngrams([t])
        c = [0, 0, 0, *(int(P.TABLE[min(ord(x), 65535)]) for x in t)]
        want = [math.log(p(tuple(c[k : k + 4]))) for k in range(len(t))]
        assert lengths.tolist() == [len(t)] and model.score(codes) == pytest.approx(want, abs=1e-4)
    for context in [(0, 0, 0), (21, 9, 6), (63, 62, 61)]:  # probabilities of all classes sum to one
        codes = np.array([context[0] << 18 | context[1] << 12 | context[2] << 6 | k for k in range(64)], np.uint32)
        assert np.exp(model.score(codes)).sum() == pytest.approx(1, abs=1e-4)


def test_model_of_units_against_definition(spark, monkeypatch):
    """Characters that share a class, and one of two units, are told apart."""
    texts = ["кот на окне", "тот кот", "The tHE \U0001f600", "окно"] * 3
    monkeypatch.setattr(P, "CLASSES", 1 << P.UNITS)
    units = lambda t: [10, 10, 10, *np.frombuffer(t.encode("utf-16-le"), np.uint16).tolist()]
    counts = Counter(tuple(units(t)[k : k + 4]) for t in texts for k in range(len(units(t)) - 3))
    model, p = P.train(documents(spark, texts), bits=P.UNITS), _kneser_ney(counts)
    for t in ["кот", "нтк #", "\U0001f600 tHe"]:
        codes, lengths = P.ngrams([t, "x"], P.UNITS)
        want = [math.log(p(tuple(units(t)[k : k + 4]))) for k in range(len(units(t)) - 3)]
        assert lengths.tolist() == [len(want), 1] and model.score(codes[: len(want)]) == pytest.approx(want, abs=1e-4)


def test_letters_of_one_class_are_told_apart(spark):
    """Letters of clean texts replaced at random: in Cyrillic by the one 16 places on, of capitals by any other."""
    rng = np.random.default_rng(6)
    syllables = ["ка", "го", "ни", "де", "ла", "ми", "во", "за", "ре", "бо"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    clean = [" ".join(word() for _ in range(rng.integers(80, 400))) for _ in range(120)]
    clean += [t.translate({ord(c): ord("A") + k for k, c in enumerate("кагониделмвзрб")}) for t in clean[:60]]
    junk = ["".join(c if c == " " or rng.random() < 0.5 else chr(0x430 + (ord(c) - 0x430 + 16) % 32) for c in t) for t in clean[:3]]
    junk += ["".join(c if c == " " else chr(65 + rng.integers(26)) for c in t) for t in clean[120:123]]
    rows = {r["doc_id"]: r for r in P.quality_query(documents(spark, clean + junk, langs=["ru"] * 120 + ["xx"] * 60 + ["ru"] * 3 + ["xx"] * 3)).collect()}
    assert not any(r["base_failed"] for r in rows.values())
    assert sum(rows[k]["kept"] for k in range(180)) >= 178 and not any(rows[k]["kept"] for k in range(180, 186))


def test_bands_reject_junk_and_keep_clean(spark):
    rng = np.random.default_rng(3)
    syllables = ["the", "an", "re", "ing", "tion", "er", "st", "ou", "nd", "ha"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    clean = [". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(rng.integers(6, 40))) for _ in range(200)]
    junk = [" ".join("".join(rng.choice(list("qxzjkvbw0123456789#%"), 8)) for _ in range(90)) for _ in range(4)]
    rows = {r["doc_id"]: r for r in P.quality_query(documents(spark, clean + junk, langs=["en"] * 150 + ["de"] * 50 + ["en"] * 4)).collect()}
    assert sum(rows[k]["kept"] for k in range(200)) >= 198
    assert not any(rows[k]["kept"] for k in range(200, 204))


def test_symbol_junk_neither_trains_nor_passes(spark):
    """One document in eight has symbols after a third of its words, which are otherwise those of the clean ones."""
    rng = np.random.default_rng(4)
    syllables = ["the", "an", "re", "ing", "tion", "er", "st", "ou", "nd", "ha"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    junk = lambda: " ".join(word() + (rng.choice(["***", "%%%", "&&&", "$$$"]) if k % 3 == 0 else "") for k in range(150))
    clean = [". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(rng.integers(6, 40))) for _ in range(210)]
    rows = {r["doc_id"]: r for r in P.quality_query(documents(spark, clean + [junk() for _ in range(30)])).collect()}
    assert not any(rows[k]["base_failed"] for k in range(240))
    assert sum(rows[k]["kept"] for k in range(210)) >= 208
    assert not any(rows[k]["kept"] for k in range(210, 240))


def test_odd_rows(spark):
    docs = documents(spark, [None, "", "a b c", "x y " * 100, "word " * 60, "one"], langs=[None, None, "en", "en", None, "xx"], ids=[None, 1, 1, 2, 3, 4])
    rows = P.quality_query(crowded(docs)).collect()
    assert len(rows) == 6 and all(r["base_failed"] and not r["kept"] for r in rows)
    assert P.quality_query(docs.limit(0)).collect() == []
    kept = P.clean_documents(crowded(docs))
    assert kept.columns == crowded(docs).columns and kept.count() == 0
