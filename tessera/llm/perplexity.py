"""Quality rules: base counts and the perplexity under a character n-gram model with modified Kneser-Ney smoothing.

Characters count as they are: a text's symbols are its UTF-16 units of UNITS = 16 bits, so an n-gram of ORDER = 4 is a
collision-free 64-bit hash, whatever the script. The model has as many entries as the corpus has different n-grams. With
BITS = 6 characters fall into 64 classes instead, and it has at most 2 ** 24. Spark counts the highest order over all whole
texts; lower orders follow from it (continuation counts). The model is kept as sorted arrays of hashes with aligned log
probabilities, looked up by binary search.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pieces, small_batches

ORDER = 4
BITS = 6
CLASSES = 1 << BITS
UNITS = 16
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MIN_WORDS = 50
#: Bands of log perplexity around a language's median: so many interquartile ranges (of at least MIN_IQR nats) below and
#: above, and for the chance in short texts SHORT nats over the root of the number of characters.
BELOW, ABOVE, MIN_IQR, SHORT = 3.0, 3.0, 0.02, 1.0
#: The model and the bands come from documents that pass the base rules and whose symbols a character lie at most ABOVE
#: interquartile ranges over their language's median (MIN_SHARE at least): text full of symbols is judged, not learnt.
MIN_SHARE = 0.01
_BUFFER = 1 << 22


def _classes() -> np.ndarray:
    t = np.empty(1 << 16, np.uint8)
    t[:] = 48 + np.arange(1 << 16) % 16
    t[:128] = 46
    t[[10, 11, 12, 13]] = 0
    t[[9, 32]] = 1
    for c in range(26):
        t[97 + c] = 2 + c
        t[65 + c] = 47
    t[48:58] = 28
    for k, c in enumerate(SYMBOLS):
        t[ord(c)] = 29 + k
    for k, group in enumerate((".", ",", "!", "?", "\"'`", "-", "_/\\", ":;", "()[]{}")):
        for c in group:
            t[ord(c)] = 37 + k
    return t


TABLE = _classes()


def _kind(bits: int) -> type:
    """What holds an n-gram of symbols of so many bits."""
    return np.uint32 if ORDER * bits <= 32 else np.uint64


def ngrams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each symbol of each text (three line ends stand before it); each text's length in
    symbols: UTF-16 units if bits is UNITS, else classes of characters."""
    pad, kind = "\n" * (ORDER - 1), _kind(bits)
    if bits == UNITS:
        coded = [t.encode("utf-16-le", "surrogatepass") for t in texts]
        lengths = np.fromiter(map(len, coded), np.int64, len(texts)) // 2
        between = pad.encode("utf-16-le")
        cls = np.frombuffer(between + between.join(coded), np.uint16).astype(kind)
    else:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = TABLE[np.minimum(points, (1 << 16) - 1)].astype(kind)
    codes = cls[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        codes |= cls[ORDER - 1 - back : len(cls) - back] << kind(bits * back)
    keep = np.ones(len(codes), bool)  # not the line ends between texts
    ends = np.cumsum(lengths + ORDER - 1)[:-1]
    for back in range(1, ORDER):
        keep[ends - back] = False
    return codes[keep], lengths


def _unique(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


def _quartiles(rows: DataFrame, by: str, value: Column, step: float) -> DataFrame:
    """by, q1, q2, q3 of values in bins of `step`: counts by bin, so that no task holds a group and reruns agree."""
    bins = rows.groupBy(by, F.floor(value / step).alias("bin")).agg(F.count("*").alias("n")).where("bin is not null")
    group = Window.partitionBy(by)
    bins = bins.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    return bins.groupBy(by).agg(*[(F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bin"))) * step).alias(f"q{k}") for k in (1, 2, 3)])


def symbol_limits(docs: DataFrame) -> DataFrame:
    """_g, _limit: the most symbols a character of the documents of each language that train the model."""
    size = F.length("_text")
    share = (size - F.length(F.translate("_text", SYMBOLS, ""))) / F.greatest(size, F.lit(1))
    rows = docs.select(F.col("lang").cast("string").alias("_g"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return _quartiles(rows, "_g", share, 1e-4).select("_g", F.greatest(F.col("q2") + ABOVE * (F.col("q3") - F.col("q1")), F.lit(MIN_SHARE)).alias("_limit"))


def count_ngrams(docs: DataFrame, limits: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """code, n over all whole texts, with limits of those that train; a task holds about _BUFFER different n-grams at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[np.ndarray] = []

        def flush() -> None:
            if waiting:
                found.append(_unique(np.concatenate(waiting)))
                waiting.clear()

        def sent() -> Iterator[pa.RecordBatch]:
            codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            n = np.bincount(back, np.concatenate([k for _, k in found])).astype(np.int64)
            found.clear()
            for at in range(0, len(codes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + (1 << 16)].astype(np.int64)), pa.array(n[at : at + (1 << 16)])], ["code", "n"])

        for b in pieces(batches):
            texts = [t for t, most in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and (most is None or _trains(t, most))]
            for part in _parts(texts):
                waiting.append(ngrams(part, bits)[0])
                if sum(map(len, waiting)) >= _BUFFER:
                    flush()
                    if sum(len(c) for c, _ in found) >= _BUFFER:
                        yield from sent()
        flush()
        if found:
            yield from sent()

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("_lang"))
    rows = rows.withColumn("_limit", F.lit(None).cast("double")) if limits is None else rows.join(F.broadcast(limits), F.col("_lang").eqNullSafe(F.col("_g")))
    return rows.select("text", "_limit").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _parts(texts: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of whole texts of about `most` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


class KneserNey:
    """Interpolated modified Kneser-Ney from the counts of the highest order."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, bits: int = BITS):
        self.bits, kind = bits, _kind(bits)
        codes = codes.astype(kind)
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(np.float64)
        levels = [(codes, counts)]
        for n in range(ORDER - 1, 0, -1):  # continuation counts: how many characters come before
            levels.append(tuple(x.astype(t) for x, t in zip(np.unique(levels[-1][0] & kind((1 << bits * n) - 1), return_counts=True), (kind, np.float64), strict=True)))
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        lower = np.full(1 << bits, -np.log(1 << bits))
        for n, (grams, c) in enumerate(reversed(levels), 1):
            of = [float((c == k).sum()) for k in (1, 2, 3, 4)]
            y = of[0] / (of[0] + 2 * of[1]) if of[0] and of[1] else 0.5
            discounts = [min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.05), k - 0.05) if of[k - 1] else 0.5 * k for k in (1, 2, 3)]
            d = np.select([c <= 1, c < 3], discounts[:2], discounts[2])
            contexts, at = np.unique(grams >> kind(bits), return_inverse=True)
            total = np.bincount(at, c)
            left = np.bincount(at, d) / total
            below = lower[grams] if n == 1 else self._look(self.tables, grams & kind((1 << bits * (n - 1)) - 1))
            p = np.log((c - d) / total[at] + left[at] * np.exp(below))
            self.tables.append((grams, p.astype(np.float32), contexts.astype(kind), np.log(left).astype(np.float32)))

    def _look(self, tables, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each n-gram after the others; n is the number of tables."""
        n = len(tables)
        if not n:
            return np.full(len(codes), -np.log(1 << self.bits))
        grams, p, contexts, left = tables[-1]
        at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
        out = p[at].astype(np.float64)
        miss = np.flatnonzero(grams[at] != codes)
        if len(miss):
            h = codes[miss] >> _kind(self.bits)(self.bits)
            k = np.minimum(np.searchsorted(contexts, h), len(contexts) - 1)
            out[miss] = np.where(contexts[k] == h, left[k], 0.0) + self._look(tables[:-1], codes[miss] & _kind(self.bits)((1 << self.bits * (n - 1)) - 1))
        return out

    def score(self, codes: np.ndarray) -> np.ndarray:
        return self._look(self.tables, codes)


def train(docs: DataFrame, limits: DataFrame | None = None, bits: int = BITS) -> KneserNey | None:
    """None if no text holds a character, or with limits none trains. A count for each different n-gram comes to the driver."""
    found = count_ngrams(docs, limits, bits).toArrow()
    return KneserNey(found["code"].to_numpy(), found["n"].to_numpy(), bits) if found.num_rows else None


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    found = text.encode("utf-8", "surrogatepass").split()
    n = len(found)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0
    repeated = 0
    if n > 3:
        ids = np.fromiter(map(defaultdict(count().__next__).__getitem__, found), np.int64, n)
        keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:] if ids.max() < 1 << 21 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if same.any():
            twice = np.zeros(n, bool)
            hit = np.zeros(n - 2, bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            for k in range(3):
                twice[k : n - 2 + k] |= hit
            repeated = int(twice.sum())
    lines, dup = text.split("\n"), 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += 1
            elif line.strip(SPACES):
                seen.add(line)
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated


def _trains(text: str, limit: float) -> bool:
    """The base rules hold and the symbols lie within the limit."""
    if sum(map(text.count, SYMBOLS)) > limit * len(text):
        return False
    n_words, _, _, _, n_repeat_words = base_counts(text)
    return n_words >= MIN_WORDS and n_repeat_words * 100 <= n_words * 50


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, model: KneserNey | None, *keep: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns `keep`, _lang, the base counts and log_perplexity (null for a text without characters). A text that is
    kept goes through Python once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.coalesce(F.length(text), F.lit(0)).alias("_chars"), F.col(lang).cast("string").alias("_lang"), *([] if text in keep else [F.col(text).cast("string")]))
    at, schema = rows.columns.index(text), T.StructType([f for f in rows.schema if f.name != text or text in keep])
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("log_perplexity", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in pieces(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            values: list[float | None] = []
            for part in _parts(texts):
                codes, lengths = ngrams(part, model.bits if model else BITS)
                full = np.flatnonzero(lengths)
                found = [None] * len(part)
                if model and len(full):
                    # each text's own sum, whatever stands beside it
                    sums = np.add.reduceat(model.score(codes), (np.cumsum(lengths) - lengths)[full])
                    for k, x, n in zip(full.tolist(), sums.tolist(), lengths[full].tolist(), strict=True):
                        found[k] = -x / n
                values += found
            found = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(schema) - len(COUNTS) - 1], *map(pa.array, found.T.copy()), pa.array(values, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def bands(rows: DataFrame) -> DataFrame:
    """_l, low, high: the band of each language, from its documents that train the model (_trained), or where it has none
    from all that pass the base rules."""
    passed = rows.where(~F.col("base_failed"))
    trained = _quartiles(passed.where("_trained"), "_lang", F.col("log_perplexity"), 1e-4)
    others = _quartiles(passed, "_lang", F.col("log_perplexity"), 1e-4).select(F.col("_lang").alias("_l"), *[F.col(f"q{k}").alias(f"o{k}") for k in (1, 2, 3)])
    both = others.join(trained, F.col("_l").eqNullSafe(F.col("_lang")), "left").select("_l", *[F.coalesce(f"q{k}", f"o{k}").alias(f"q{k}") for k in (1, 2, 3)])
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(MIN_IQR))
    return both.select("_l", (F.col("q2") - BELOW * spread).alias("low"), (F.col("q2") + ABOVE * spread).alias("high"))


def quality(docs: DataFrame, *keep: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns `keep` of all documents with the base counts, base_failed, log_perplexity and kept.

    Kept: the base rules hold and the perplexity lies in the language's band. A null text has no words (it fails the
    base rules); a null language is a language of its own. Rows are judged each on its own, so copies are judged alike;
    very long texts are counted whole; an empty table gives none."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    limits, _ = materialize(symbol_limits(plain), "quality-limits")
    model = train(plain, limits, UNITS) or train(plain, bits=UNITS)
    rows, _ = materialize(judged(docs, model, *keep, text=text, lang=lang).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)), "quality")
    trained = ~F.col("base_failed") & (F.col("n_symbols") <= F.col("_limit") * F.col("_chars"))
    rows = rows.join(F.broadcast(limits), F.col("_lang").eqNullSafe(F.col("_g"))).withColumn("_trained", trained).drop("_g", "_limit")
    of, _ = materialize(bands(rows.select("_lang", "base_failed", "_trained", "log_perplexity")), "quality-bands")
    slack = SHORT / F.sqrt(F.greatest(F.col("_chars"), F.lit(1)))
    inside = F.col("log_perplexity").between(F.col("low") - slack, F.col("high") + slack)
    # a row a language: the names of languages are short codes, and their number doesn't grow with the texts
    return rows.join(of, F.col("_lang").eqNullSafe(F.col("_l")), "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("_l", "_lang", "_chars", "_trained", "low", "high")


def quality_query(docs: DataFrame) -> DataFrame:
    return quality(docs, "doc_id").select("doc_id", *COUNTS, "base_failed", "kept", "log_perplexity")


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs' own columns, without the documents that the rules reject (null, empty and short texts among them); repeated
    rows stay or go alike, and an empty table stays one."""
    names = docs.columns
    own = [f"_c{k}" for k in range(len(names))]
    rows = quality(docs.toDF(*own), *own, text=own[names.index("text")], lang=own[names.index("lang")])
    return rows.where("kept").select(*[F.col(c).alias(n) for c, n in zip(own, names, strict=True)])
