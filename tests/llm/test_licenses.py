import math
import re
from collections import Counter

import pytest

from tessera.llm import licenses as L

from .helpers import documents

MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."


def terms(text):
    return re.findall("[a-z0-9]+", text.lower())


def brute(files):
    """path to (cosine, license) by the plain formulas."""
    known = {t for _, s in L.TEMPLATES for t in terms(s)}
    n = len(files)
    df = Counter(t for text in files.values() for t in set(terms(text or "")) & known)
    idf = lambda t: math.log((n + 1) / ((df[t] if t in known else 0) + 1)) + 1
    vector = lambda s: {t: c * idf(t) for t, c in Counter(terms(s)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for path, text in files.items():
        parts = re.split(L.BREAK, text or "")
        blocks = [p for p in [*(x for x in parts if "\n" in x), *([text] if len(parts) > 1 else [])] if len(terms(p)) <= L.MOST_TERMS]
        for line in [*(text or "").split("\n"), *blocks]:
            if re.search(L.TRIGGER, line.lower()):
                a = vector(line)
                for name, s in L.TEMPLATES:
                    b = vector(s)
                    c = sum(x * b.get(t, 0) for t, x in a.items()) / norm(a) / norm(b)
                    if c >= L.COSINE:
                        out[path] = max(out.get(path, (0, "")), (round(c, 9), name))
    return out


def run(spark, files):
    return {r["path"]: r for r in L.scan(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}


def test_cosine_and_inheritance(spark):
    files = {
        "a/LICENSE": f"{MIT}",
        "a/x.txt": "plain words",
        "a/b/y.txt": "more words",
        "a/b/own.txt": f"some text\n{GPL}\nother text of many more words than the statement itself has in all",
        "a/b/c/LICENSE.txt": GPL,
        "a/b/c/d/z.txt": "deep",
        "ab/q.txt": "not below a",
        "r.txt": "root",
        "a/odd.txt": "Licensed Under the APACHE license -- version 2.0!",
        "a/no.txt": "a licence to do as you like, for all who come and go here at any time",
    }
    got = run(spark, files)
    own = {p: (r["cosine"], r["license"]) for p, r in got.items() if r["how"] == "own"}
    want = brute(files)
    assert set(own) == set(want)
    for p, (c, name) in want.items():
        assert own[p][1] == name and own[p][0] == pytest.approx(c, abs=1e-8)
    inherited = {p: (r["license"], r["folder"]) for p, r in got.items() if r["how"] == "inherited"}
    assert set(got) == set(files) and {p for p, r in got.items() if r["how"] == "none"} == {"ab/q.txt", "r.txt"}
    assert inherited == {"a/x.txt": ("MIT", "a"), "a/b/y.txt": ("MIT", "a"), "a/no.txt": ("MIT", "a"), "a/b/c/d/z.txt": ("GPL-3.0", "a/b/c")}


def test_root_license_file(spark):
    got = run(spark, {"LICENSE": MIT, "a/b.txt": "x"})
    assert got["a/b.txt"]["license"] == "MIT" and got["a/b.txt"]["folder"] == ""


def test_every_template_matches_itself(spark):
    got = run(spark, {f"p{k}": s for k, (_, s) in enumerate(L.TEMPLATES) if re.search(L.TRIGGER, s.lower())})
    assert all(got[f"p{k}"]["how"] == "own" for k, (_, s) in enumerate(L.TEMPLATES) if f"p{k}" in got)
    assert {r["license"] for r in got.values()} == {n for n, _ in L.TEMPLATES}


def wrapped(text, n, start=""):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) >= n:
            lines.append(start + line)
            line = ""
        line += (" " if line else "") + w
    return "\n".join([*lines, start + line])


def test_license_files_headers_and_tags(spark):
    texts = dict(L.TEXTS)
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + "\n\n".join(wrapped(p, 79) for p in texts["MIT"].split("\n\n"))
    gpl = wrapped(texts["GPL-3.0"].split("\n\n")[0], 70, "# ")
    files = {
        "p/LICENSE": mit,
        "p/src/a.py": "code",
        "r/LICENSE": wrapped(texts["BSD-3-Clause"].split("\n\n")[0], 60),
        "r/b.c": "int main",
        "s/header.c": f"/*\n{wrapped(texts['Apache-2.0'], 70, ' * ')}\n */\n\nint x = 1;\n" + "more code of no matter here\n" * 40,
        "t/gpl.py": f"#!/usr/bin/python\n#\n{gpl}\n#\n\n" + "import this and that, then go on with it\n" * 30,
        "u/tag.py": "# SPDX-License-Identifier: Apache-2.0\n" + "x = y\n" * 50,
        "v/COPYING": "\n\n".join(wrapped(p, 72) for p in texts["BSD-3-Clause"].split("\n\n")),
        "v/c.txt": "text",
        "w/none.txt": "a permission to go, and a copyright of his own",
    }
    got = run(spark, files)
    own = {p: (r["cosine"], r["license"]) for p, r in got.items() if r["how"] == "own"}
    want = brute(files)
    assert {p: n for p, (_, n) in own.items()} == {p: n for p, (_, n) in want.items()}
    assert {p: got[p]["license"] for p in files} == {
        "p/LICENSE": "MIT", "p/src/a.py": "MIT", "r/LICENSE": "BSD-2-Clause", "r/b.c": "BSD-2-Clause", "s/header.c": "Apache-2.0", "t/gpl.py": "GPL-3.0",
        "u/tag.py": "Apache-2.0", "v/COPYING": got["v/COPYING"]["license"], "v/c.txt": got["v/COPYING"]["license"], "w/none.txt": None,
    }
    assert got["v/COPYING"]["license"].startswith("BSD") and got["p/src/a.py"]["folder"] == "p"


def test_long_texts_are_compared_whole(spark):
    """A license that stands in a text often enough is as near to it as the license itself, however long the text."""
    texts = dict(L.TEXTS)
    longest = max(len(terms(t)) for _, t in L.TEMPLATES)
    grant = texts["MIT"].split("\n\n")[0]
    block = wrapped(" ".join([grant] * (4 * longest // len(terms(grant)) + 1)), 24)
    files = {"a/header.c": f"{block}\n\nint x;", "b/all.txt": "\n\n".join(wrapped(" ".join([p] * 2), 24, "- so ") for p in [*texts["BSD-3-Clause"].split("\n\n")] * 4), "c/y.c": "int y;"}
    assert all(len(terms(t)) > 3 * longest for p, t in files.items() if p != "c/y.c")
    got = run(spark, files)
    own = {p: (r["cosine"], r["license"]) for p, r in got.items() if r["how"] == "own"}
    assert own == {p: (pytest.approx(c, abs=1e-8), n) for p, (c, n) in brute(files).items()}
    assert own["a/header.c"][1] == "MIT" and got["c/y.c"]["how"] == "none"


def test_odd_rows(spark):
    docs = documents(spark, [None, "", MIT, MIT, f"{MIT}\n" + "word " * 50, "license " * 3000], sources=[None, "s", "s", "s", None, "t"], ids=[1, 2, 3, 3, None, 5])
    rows = L.license_query(docs).collect()
    assert {r["license"] for r in rows if r["how"] != "none"} == {"MIT"} and {r["doc_id"] for r in rows if r["how"] == "own"} == {3, None}
    assert 2 in {r["doc_id"] for r in rows if r["how"] == "inherited"}
    assert L.license_query(docs.limit(0)).collect() == []
    empty = spark.createDataFrame([(None, MIT), ("x", None)], "path string, text string")
    assert [(r["path"], r["license"]) for r in L.scan(empty).collect()] == [("x", None)]
