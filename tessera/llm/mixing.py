"""Mixing sources to target weights: Efraimidis-Spirakis sampling in DataFrame operations only.

Each document draws u from its id and gets the exponential key -ln(u) / w, w its quality weight; in the order of keys
a source's documents form a weighted sample without replacement. A source first takes all its documents as often as the
target holds the source whole (complete epochs); the rest of the target is filled by the documents of smallest key, and
the one that crosses the budget enters with its first words only, so that each source meets its target to the word.

The prefix sum never sorts a source in one task. Weights have few levels, so the distribution of keys in a source is
known from its counts by level, and each document falls by its key into one of n / ROWS equally filled buckets. Sums of
buckets are prefix-summed. In the one bucket that crosses the budget, rows are counted by key, id and size, and these
counts are sorted: they give the place of the cut, with which every document is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_JAVA, materialize, release

WEIGHTS = (5, 2, 1)
CAP = 3
LEVELS = 4
ROWS = 2000


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def level_of(text: str = "text") -> Column:
    """Quality level 0 (best) to 3 by the share of symbols in the text; a document of level k weighs 2 ** -k."""
    symbols = F.length(text) - F.length(F.translate(F.col(text), "#*$%&|<>", ""))
    return F.coalesce(
        F.when(symbols * 100 <= F.length(text), 0).when(symbols * 25 <= F.length(text), 1).when(symbols * 10 <= F.length(text), 2).otherwise(3),
        F.lit(0),
    ).cast("int")


def draw(id_column: str = "doc_id", seed: str = "mix") -> Column:
    """u in (0, 1) from the id's MD5: the same in every run and on every engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """docs' columns `keep`, with _source, _size, _level and _key."""
    return docs.select(*keep, F.col("source").cast("string").alias("_source"), F.col("doc_id").alias("_id"), size_of().alias("_size"), level_of().alias("_level"), draw().alias("_u")).withColumn(
        "_key", -F.ln("_u") * F.pow(F.lit(2.0), F.col("_level"))
    )


def source_targets(rows: DataFrame, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """One row per source: _source, source_size, n by level, target. Water-filling: sources sorted by how soon they reach
    their cap; the capped ones are the first whose share at the running level exceeds it."""
    by = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"), *[F.sum((F.col("_level") == k).cast("long")).alias(f"_n{k}") for k in range(LEVELS)])
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("_rank", F.row_number().over(order) - 1)
    by = by.withColumn("_w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    by = by.withColumn("_ratio", (cap * F.col("source_size")).cast("double") / F.col("_w"))
    filling = Window.orderBy("_ratio", "_rank")
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))).cast("double") / F.sum("_w").over(onward)
    by = by.withColumn("_level_at", level).withColumn("_capped", F.col("_level_at") > F.col("_ratio"))
    final = F.min(F.when(~F.col("_capped"), F.struct("_ratio", "_rank", "_level_at"))).over(every)["_level_at"]
    return by.withColumn("target", F.when(F.col("_capped"), (cap * F.col("source_size")).cast("double")).otherwise(final * F.col("_w"))).drop("_w", "_ratio", "_level_at", "_capped", "_rank")


def _budgets(targets: DataFrame) -> DataFrame:
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return targets.withColumn("_epochs", epochs).withColumn("_rest", F.floor("target").cast("long") - F.col("_epochs") * F.col("source_size"))


def _bucket() -> Column:
    """The share of the source's documents with smaller keys, as expected from its counts by level, in n / ROWS steps."""
    n = sum((F.col(f"_n{k}") for k in range(1, LEVELS)), F.col("_n0")).cast("double")
    below = sum((F.col(f"_n{k}") * (1 - F.exp(-F.col("_key") * 2.0**-k)) for k in range(1, LEVELS)), F.col("_n0") * (1 - F.exp(-F.col("_key"))))
    return F.floor(below / n * F.ceil(n / ROWS)).cast("long")


def _cuts(narrow: DataFrame, info: DataFrame) -> DataFrame:
    """Where each source's budget ends in the order by _key, _id, _size: _c (the source), _ck, _ci, _cs (there), _left (words
    left for the rows that stand there) and _ties (how many do). Rows that stand at one place are counted, not sorted."""
    inside = narrow.join(info, F.col("_source").eqNullSafe(F.col("_s"))).where(_bucket() == F.col("_crossing"))
    places = inside.groupBy("_s", "_key", "_id", "_size").agg(F.count("*").alias("_ties"), F.first(F.col("_rest") - F.col("_before")).alias("_room"))
    own = F.col("_ties") * F.col("_size")
    left = F.col("_room") + own - F.sum(own).over(Window.partitionBy("_s").orderBy("_key", "_id", "_size"))
    places = places.withColumn("_left", left).where((F.col("_left") >= 0) & (F.col("_left") < own))
    return places.select(F.col("_s").alias("_c"), F.col("_key").alias("_ck"), F.col("_id").alias("_ci"), F.col("_size").alias("_cs"), "_left", "_ties")


def _numbered(tied: DataFrame) -> DataFrame:
    """The rows at each source's cut with _tie, their number from 0, counted by pieces of the table: however many rows share
    a place, no task sorts more than a piece. Written first, so that a row keeps its number."""
    tied, _ = materialize(tied.withColumn("_uid", F.monotonically_increasing_id()), "mix-ties")
    tied = tied.withColumn("_piece", F.shiftright("_uid", 33))
    counts = tied.groupBy(F.col("_source").alias("_t"), F.col("_piece").alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_t", "_p", (F.sum("_n").over(Window.partitionBy("_t").orderBy("_p")) - F.col("_n")).alias("_earlier"))
    found = tied.join(before, F.col("_source").eqNullSafe(F.col("_t")) & (F.col("_piece") == F.col("_p")))
    own = F.row_number().over(Window.partitionBy("_source", "_piece").orderBy("_uid")) - 1
    return found.withColumn("_tie", own + F.col("_earlier")).drop("_uid", "_piece", "_t", "_p", "_earlier")


def mix(rows: DataFrame, narrow: DataFrame | None = None, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """rows (of sized()) with source_size, target, taken and _part: words taken of the copy that enters in part (else 0).

    narrow: the same documents from sized(docs), already written; without it one is written here. Nulls: a null text is
    empty, a null source is a source of its own and comes last, a null id draws as the empty id. Rows of one id have one
    key; they enter by size, and of equal sizes any of them is cut, which doesn't show in the result: so many rows without
    an id, or of one id, are counted and never sorted. An empty table gives no rows."""
    own = None
    if narrow is None:
        narrow, own = materialize(rows.select("_source", "_id", "_size", "_level", "_u", "_key"), "mix-sizes")
    info, _ = materialize(_budgets(source_targets(narrow, weights, cap)), "mix-sources")
    sums = narrow.join(info, narrow["_source"].eqNullSafe(info["_source"])).select(info["_source"], _bucket().alias("_bucket"), "_size", "_rest").groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"), F.first("_rest").alias("_rest"))
    upto = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket"))
    crossing = sums.withColumn("_before", upto - F.col("_sum")).where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_sum") > F.col("_rest")))
    info = info.withColumnRenamed("_source", "_s")
    crossing = crossing.select(F.col("_source").alias("_b"), F.col("_bucket").alias("_crossing"), "_before")
    info, _ = materialize(info.join(crossing, F.col("_s").eqNullSafe(F.col("_b")), "left").drop("_b"), "mix-budgets")
    cuts = info.join(_cuts(narrow, info), F.col("_s").eqNullSafe(F.col("_c")), "left").select("_s", "source_size", "target", "_epochs", "_ck", "_ci", "_cs", "_left", "_ties")
    info, _ = materialize(cuts, "mix-cuts")
    if own:
        release(own)
    here, cut = (F.struct(*[F.col(c).alias(n) for c, n in zip(names, "kis", strict=True)]) for names in (("_key", "_id", "_size"), ("_ck", "_ci", "_cs")))
    open_ = F.col("_ck").isNull()  # a source without words
    placed = rows.join(info, F.col("_source").eqNullSafe(F.col("_s")))
    every = placed.withColumn("_tie", F.lit(0).cast("long"))
    if not info.where("_ties > 1").isEmpty():
        tied = ~open_ & here.eqNullSafe(cut) & (F.col("_ties") > 1)
        every = every.where(~F.coalesce(tied, F.lit(False))).unionByName(_numbered(placed.where(tied)))
    at_cut = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_left") - F.col("_tie") * F.col("_size"))).cast("long")
    every = every.withColumn("_fraction", F.when(open_ | (here < cut), F.col("_size")).when(here.eqNullSafe(cut), at_cut).otherwise(0).cast("long"))
    return every.withColumn("taken", F.col("_epochs") * F.col("_size") + F.col("_fraction")).withColumn("_part", F.when(F.col("_fraction") < F.col("_size"), F.col("_fraction")).otherwise(0))


def mix_query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; see mix() for odd rows."""
    narrow, _ = materialize(sized(docs, "doc_id"), "mix-docs")
    return mix(narrow, narrow).select("doc_id", F.col("_size").alias("size"), "source_size", F.round("target", 6).alias("target"), "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with docs' own columns: each document as often as it is taken; the copy that enters in part holds
    its first words, single-spaced. Documents without words carry no weight and stay once where they stand in an epoch."""
    names = docs.columns
    rows = mix(sized(docs.withColumn("_row", F.struct(*names)), "_row"))
    copies = F.when(F.col("_size") == 0, F.col("_epochs")).otherwise(F.floor(F.col("taken") / F.greatest(F.col("_size"), F.lit(1)))).cast("int")
    first = F.array_join(F.slice(F.split(F.regexp_replace(F.col("_row.text"), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), F.col("_part").cast("int")), " ")
    full = F.array_repeat(F.struct(F.lit(False).alias("cut")), copies)
    parts = F.when(F.col("_part") > 0, F.array(F.struct(F.lit(True).alias("cut")))).otherwise(F.array().cast("array<struct<cut:boolean>>"))
    out = rows.select("_row", "_part", F.explode(F.concat(full, parts)).alias("_copy"))
    text = F.when(F.col("_copy.cut"), first).otherwise(F.col("_row.text"))
    return out.select(*[(text if c == "text" else F.length(text).cast("long") if c == "n_chars" else F.col(f"_row.`{c}`")).alias(c) for c in names])
