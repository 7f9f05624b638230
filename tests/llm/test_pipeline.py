import numpy as np

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.common import materialize

from .helpers import crowded, documents


def prose(rng, n):
    syllables = ["the", "an", "re", "ing", "tion", "er", "st", "ou", "nd", "ha"]
    words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)]
    return ". ".join(" ".join(words[k : k + 9]) for k in range(0, n, 9))


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    texts = [prose(rng, int(rng.integers(60, 200))) for _ in range(120)]
    texts[5] += " token = 0123456789abcdef0123456789abcdef"
    texts[7] = texts[3]
    texts[9] = "too short"
    texts[11] = None
    docs = documents(spark, texts, sources=["a" if k % 3 else "b" for k in range(120)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out, _ = materialize(stage(spark, seen[-1], str(tmp_path)), name)
        seen.append(out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scans", "source_mixing", "sentencepieces"]
    assert all(df.columns == columns for df in seen[:-1])
    kept = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in seen]
    assert {9, 11} & kept[1] == set() and len(kept[1]) >= 115
    assert kept[2] == kept[1] - {7} and kept[3] == kept[2] and kept[4] <= kept[3]
    text = seen[3].where("doc_id = 5").first()["text"]
    assert "[SECRET]" in text and "0123456789abcdef" not in text
    size = lambda df, s: sum(len(r["text"].split()) for r in df.where(f"source = '{s}'").collect())
    total = size(seen[3], "a") + size(seen[3], "b")
    assert abs(size(seen[4], "a") - total * 5 / 7) <= 1 and abs(size(seen[4], "b") - total * 2 / 7) <= 1
    last = seen[5].collect()
    assert len(last) == seen[4].count() and all(r["round_trip"] for r in last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


def test_registered():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing columns and empty tables go through all stages."""
    rng = np.random.default_rng(1)
    texts = [prose(rng, int(rng.integers(60, 120))) for _ in range(40)]
    texts[0] = texts[1] = None
    texts[2] = ""
    texts[4] = texts[3]
    docs = crowded(documents(spark, texts, sources=[None if k % 5 == 0 else "a" for k in range(40)], langs=[None if k % 2 else "en" for k in range(40)], ids=[None if k % 7 == 6 else 3 if k == 4 else k for k in range(40)]))
    for start in (docs, docs.limit(0)):
        at = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            at, _ = materialize(stage(spark, at, ""), name)
            assert k == 4 or at.columns == docs.columns
        rows = at.collect()
        assert (len(rows) > 0) == (start is docs) and all(r["round_trip"] for r in rows)
