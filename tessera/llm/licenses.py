"""License scans in DataFrame operations only: TF-IDF cosine of license statements, header blocks and whole files to
templates, then inheritance from the nearest ancestor directory that holds a license file.

Templates are whole license texts and standard headers, each of their paragraphs, titles, short statements and SPDX tags. What is
compared with them: each line, each paragraph of several lines (blank lines and lines without letters or digits part them, so a
comment's header is one) and, if it has several paragraphs, the whole file - of those that hold a trigger word."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .license_texts import STATEMENTS, TEXTS


def _templates_of() -> tuple[tuple[str, str], ...]:
    """License and text of every template; of equal texts the first one counts."""
    names = dict.fromkeys(n for n, _ in (*TEXTS, *STATEMENTS))
    found: dict[str, str] = {}
    for name, text in TEXTS:
        for part in (text, *text.split("\n\n")):
            found.setdefault(part, name)
    for name, text in (*STATEMENTS, *((n, f"SPDX-License-Identifier: {n}") for n in names)):
        found.setdefault(text, name)
    return tuple((name, text) for text, name in found.items())


TEMPLATES = _templates_of()
#: A line, paragraph or file with one of these is a statement to look at; it is compared whole.
TRIGGER = r"licen[sc]e|copyright|copyleft|warrant|public domain|creative commons|spdx|unencumbered|redistribut|permission"
#: What stands between paragraphs: a line without letters and digits.
BREAK = r"\n[^A-Za-z0-9\n]*\n"
COSINE = 0.75
#: A file whose license statements make up this share of its words is a license file: it speaks for its directory.
FILE_SHARE = 0.5
SPLIT = "[^a-z0-9]+"
#: Terms of a paragraph or file that is compared whole, for the SQL: as many as an array can hold, so that none is left out (a
#: license that repeats is as near to its template as one that doesn't).
MOST_TERMS = (1 << 31) - 1


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def _templates(spark) -> DataFrame:
    rows = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(TEMPLATES)], "template int, license string, statement string")
    return rows.select("template", "license", F.explode(terms(F.col("statement"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").cast("double").alias("tf"))


def statements(files: DataFrame) -> DataFrame:
    """_file, kind (0 line, 1 paragraph, 2 file), line of every statement of every whole text that holds a trigger word."""
    telling = lambda x: F.lower(x).rlike(TRIGGER)
    of = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("line")))
    parts = F.split(F.col("text"), BREAK)
    lines = F.filter(F.split(F.col("text"), "\n"), telling)
    blocks = F.filter(parts, lambda x: x.contains("\n") & telling(x))
    whole = F.when(F.size(parts) > 1, F.array("text")).otherwise(F.array().cast("array<string>"))
    found = files.where(telling(F.col("text"))).select("_file", F.explode(F.concat(of(0, lines), of(1, blocks), of(2, whole))).alias("s"))
    return found.select("_file", "s.kind", "s.line")


def term_weights(files: DataFrame) -> tuple[DataFrame, float]:
    """term, idf, and the idf of a term that no text holds, for the templates' terms, with document frequencies over all
    whole texts. Fewer rows than the templates have words."""
    spark = files.sparkSession
    known = [r[0] for r in _templates(spark).select("term").distinct().orderBy("term").collect()]
    held = F.array_intersect(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), SPLIT), F.array(*[F.lit(t) for t in known]))
    # the empty term stands for the text itself
    counts = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    of = {r["term"]: r["count"] for r in counts}
    n = of.get("", 0)
    idf = lambda df: math.log((n + 1) / (df + 1)) + 1
    return spark.createDataFrame([(t, idf(of.get(t, 0))) for t in known], "term string, idf double"), idf(0)


def matched(files: DataFrame) -> DataFrame:
    """_file, kind, line, license, cosine: each statement with its best template, if the cosine reaches COSINE.

    A term that no template has counts in a statement's length with the idf of a term that no text holds."""
    spark = files.sparkSession
    weights, top = term_weights(files)
    found, _ = materialize(statements(files).distinct(), "license-lines")
    # equal statements are compared once: one may stand in a third of all files; their terms carry a number, not the text
    lines, texts = materialize(found.select("line").distinct().withColumn("id", F.monotonically_increasing_id()), "license-texts")
    vectors = _templates(spark).join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = vectors.join(norms, "template").select("template", "license", F.col("term").alias("t"), (F.col("w") / F.col("norm")).alias("tw"))
    mine = lines.select("id", F.explode(terms(F.col("line"))).alias("term")).groupBy("id", "term").agg(F.count("*").cast("double").alias("tf"))
    mine = mine.join(F.broadcast(weights), "term", "left").select("id", "term", F.col("idf").isNotNull().alias("known"), (F.col("tf") * F.coalesce("idf", F.lit(top))).alias("w"))
    mine, path = materialize(mine, "license-terms")
    squares = F.col("w") * F.col("w")
    length = mine.groupBy("id").agg(F.sqrt(F.sum(squares)).alias("norm"), F.sqrt(F.sum(F.when(F.col("known"), squares).otherwise(0.0))).alias("inner"))
    # no cosine is over the share of the templates' terms
    length = length.where(F.col("inner") >= (COSINE - 1e-9) * F.col("norm")).select(F.col("id").alias("l"), "norm")
    # templates don't grow with the files
    near = mine.where("known").join(length, F.col("id") == F.col("l")).join(F.broadcast(vectors), F.col("term") == F.col("t"))
    scored = near.groupBy("id", "license", "template").agg((F.sum(F.col("w") * F.col("tw")) / F.max("norm")).alias("cosine"))
    best = scored.groupBy("id").agg(F.max(F.struct(F.round("cosine", 9).alias("cosine"), F.col("license").alias("license"))).alias("b")).where(F.col("b.cosine") >= COSINE)
    best, _ = materialize(lines.join(best, "id").select("line", "b"), "license-best")
    release(path, texts)
    return found.select("_file", "kind", F.col("line").alias("own")).join(best, F.col("own") == F.col("line")).select("_file", "kind", "line", F.col("b.license").alias("license"), F.col("b.cosine").alias("cosine"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all above it, the root ('') too."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(files: DataFrame) -> DataFrame:
    """files: path, text. One row per path: path, license, cosine, line, how (own, inherited or none), folder.

    A path's license is its best matching statement (on ties the name that sorts last, then the larger text). A license
    file - its lines, its paragraphs or its whole text that match make up FILE_SHARE of its words, or its name is LICENSE or
    COPYING - gives its license to all files below its folder that have none and no nearer license file. Null paths are left
    out, null and empty texts hold no statement, very long ones are compared whole, too, repeated rows of a path count as one
    file, an empty table gives no rows."""
    files = files.where(F.col("path").isNotNull()).select(F.col("path").cast("string").alias("_file"), F.col("text").cast("string").alias("text"))
    own = matched(files)
    words = F.coalesce(F.regexp_count(F.col("line"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    best = F.max(F.struct("cosine", "license", "line"))
    by_kind = own.groupBy("_file", "kind").agg(best.alias("b"), F.sum(words).alias("_words"))
    own, _ = materialize(by_kind.groupBy("_file").agg(F.max("b").alias("b"), F.max("_words").alias("_words")), "licenses")
    sizes = files.select(F.col("_file").alias("f"), F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("size"))
    speaking = own.join(sizes, F.col("_file") == F.col("f"), "left_outer").where((F.col("_words") >= FILE_SHARE * F.col("size")) | F.col("_file").rlike(r"(?i)(^|/)(licen[sc]e|copying)[^/]*$"))
    given = speaking.groupBy(directory(F.col("_file")).alias("folder")).agg(F.max("b").alias("g"))
    plain = files.select(F.col("_file").alias("path")).distinct().join(own.select("_file"), F.col("path") == F.col("_file"), "left_anti").withColumn("_dir", directory(F.col("path")))
    folders = plain.select(F.col("_dir").alias("d")).distinct().withColumn("above", F.explode(ancestors(F.col("d"))))
    nearest = folders.join(given, F.col("above") == F.col("folder")).groupBy("d").agg(F.max_by(F.struct("folder", "g"), F.length("above")).alias("n"))
    how = F.when(F.col("n").isNull(), "none").otherwise("inherited")
    inherited = plain.join(nearest, F.col("_dir") == F.col("d"), "left").select("path", F.col("n.g.license").alias("license"), F.col("n.g.cosine").alias("cosine"), F.col("n.g.line").alias("line"), how.alias("how"), F.col("n.folder").alias("folder"))
    direct = own.select(F.col("_file").alias("path"), F.col("b.license").alias("license"), F.col("b.cosine").alias("cosine"), F.col("b.line").alias("line"), F.lit("own").alias("how"), directory(F.col("_file")).alias("folder"))
    return direct.unionByName(inherited)


def license_query(docs: DataFrame) -> DataFrame:
    """documents as files source/lang/doc_id: doc_id, license, cosine, line, how, folder of every file; those without a license have nulls."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    found = scan(docs.select(path.alias("path"), "text"))
    return found.select(F.expr("try_cast(regexp_extract(path, '[^/]*$', 0) AS bigint)").alias("doc_id"), "license", "cosine", "line", "how", "folder")
