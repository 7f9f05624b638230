"""Image collections: selection by hierarchy and name, labels from annotations, pairing and spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_images(images: DataFrame, include: dict[str, list], exclude: dict[str, list], include_name: list[str] = (), exclude_name: list[str] = ()) -> DataFrame:
    """images: one row per image with project_id, dataset_id, image_id, name. Included by any level, then excluded by any
    level, then by patterns that are searched for in the name in either case."""

    def any_of(chosen: dict[str, list]) -> Column:
        out = F.lit(False)
        for level, ids in chosen.items():
            if ids:
                out = out | F.col(f"{level}_id").isin(*ids)
        return out

    def named(patterns) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | F.col("name").rlike(f"(?i){p}")
        return out

    rows = images.where(any_of(include) & ~any_of(exclude))
    if include_name:
        rows = rows.where(named(include_name))
    if exclude_name:
        rows = rows.where(~named(exclude_name))
    return rows.dropDuplicates(["image_id"])


def select_by_tables(images: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """The same with ids in tables: semi and anti joins."""
    return images.join(include, "image_id", "left_semi").join(exclude, "image_id", "left_anti")


def labels_wide(annotations: DataFrame, labels: list[str], order: str) -> DataFrame:
    """annotations: image_id, name, value. One column per label; names match in either case, the last value by `order` wins."""
    return annotations.groupBy("image_id").agg(*[F.max_by(F.when(F.lower("name") == label.lower(), F.col("value")), F.when(F.lower("name") == label.lower(), F.col(order))).alias(label) for label in labels])


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def label_table(images: DataFrame, annotations: DataFrame, labels: list[str], order: str, extension: str) -> DataFrame:
    """image_id, name, labels, path; images without any of the labels are left out."""
    wide = labels_wide(annotations, labels, order).where(" or ".join(f"`{x}` is not null" for x in labels))
    return images.select("image_id", "name").join(wide, "image_id").withColumn("path", F.concat("name", F.lit(f".{extension}")))


def zip_lists(lists: DataFrame, group: str, name: str) -> DataFrame:
    """The k-th names of all groups side by side, as far as the shortest group goes. Names of one group are numbered by a
    window over that group: a group is one list of files."""
    numbered = lists.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(name)))
    groups = lists.agg(F.countDistinct(group).alias("groups"))
    rows = numbered.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(group, name))).alias("l"))
    return rows.join(F.broadcast(groups), F.size("l") == F.col("groups")).select("k", F.transform("l", lambda s: s[name]).alias("names"))


#: Rows that a cell has at most in one piece of neighbours().
CROWD = 4096


def neighbours(points: DataFrame, radius: float) -> DataFrame:
    """a, b: b lies within radius of a (not on it) and has the smaller r. points: id, x, y, r. Two cells of the grid that touch
    meet once: points go to their own cell and to four of the eight around it, and each two that meet are a pair one way or
    the other. The join sorts and never broadcasts points; cells of more than CROWD rows are cut into pieces, to each of which
    all points of the cell go, so no task holds more of a cell than a piece."""
    size = radius * 1.001  # a hair wider, so that rounding loses no pair
    cell = lambda c: F.floor(F.greatest(F.least(F.col(c) / size, F.lit(1e12)), F.lit(-1e12)))
    own = points.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("r").alias("ar"), cell("x").alias("gx"), cell("y").alias("gy"))
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    spread = points.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("r").alias("br"), cell("x").alias("cx"), cell("y").alias("cy"), F.explode(moves).alias("m"))
    spread = spread.select("b", "bx", "by", "br", (F.col("cx") + F.col("m.i")).alias("gx"), (F.col("cy") + F.col("m.j")).alias("gy"), ((F.col("m.i") == 0) & (F.col("m.j") == 0)).alias("home"))
    # a row for CROWD rows at most
    crowded = F.broadcast(spread.groupBy("gx", "gy").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("gx", "gy", F.ceil(F.col("n") / CROWD).alias("pieces")))
    pieces = F.coalesce("pieces", F.lit(1))
    own = own.join(crowded, ["gx", "gy"], "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("pieces")
    spread = spread.join(crowded, ["gx", "gy"], "left").withColumn("piece", F.pmod(F.xxhash64("b", "bx", "by"), pieces)).drop("pieces")
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    below = F.col("br") < F.col("ar")
    met = own.join(spread.hint("merge"), ["gx", "gy", "piece"]).where((d2 > 0) & (d2 < radius * radius) & (below | (~F.col("home") & (F.col("ar") < F.col("br")))))
    return met.select(F.when(below, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(below, F.col("b")).otherwise(F.col("a")).alias("b"))


def points_in_tiles(points: DataFrame, size: float) -> DataFrame:
    """Each point with its half-open tile: arithmetic instead of a range join."""
    return points.withColumn("ty", F.floor(F.col("y") / size)).withColumn("tx", F.floor(F.col("x") / size))


def match_layout(files: DataFrame, layout: DataFrame) -> DataFrame:
    """Files (file) whose name holds the layout's title. Every piece of a name that is as long as some title is a join key,
    so no pair is compared in vain; titles have few lengths, which come to the driver."""
    lengths = [r[0] for r in layout.select(F.length("title").alias("n")).distinct().collect() if r[0]]

    def pieces_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("file") - n + 1, F.lit(1))), lambda k: F.substring(F.col("file"), k, F.lit(n)))

    pieces = [pieces_of(n) for n in lengths]
    keyed = files.withColumn("_piece", F.explode(F.array_distinct(F.concat(*pieces) if pieces else F.array().cast("array<string>"))))
    return keyed.join(layout, F.col("_piece") == F.col("title")).drop("_piece")


def stage_positions(tiles: DataFrame, pixel_size_um: dict[str, float]) -> DataFrame:
    """Tiles with stage positions in pixels (sx, sy): their translations in micrometers, x_um and y_um."""
    return tiles.withColumns({f"{a}_um": F.col(f"s{a}") * pixel_size_um[a] for a in "xy"})


def annotations_by_type(annotations: DataFrame, kind: str, order: str) -> DataFrame:
    """image_id, type, items: an image's annotations (name, value) of each type, in order."""
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "name", "value")))
    rows = annotations.groupBy("image_id", F.col(kind).alias("type")).agg(items.alias("items"))
    return rows.withColumn("items", F.transform("items", lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"))))


def first_of(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The first row of each group: the series, image or node that counts where a file holds several."""
    names = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r"))
    return picked.select(*by, *[F.col(f"_r.`{c}`").alias(c) for c in names])


def by_norm(points: DataFrame, *axes: str) -> DataFrame:
    """Points in the order of their distance from the origin, with it."""
    return points.withColumn("norm", F.sqrt(sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0])))).orderBy("norm")


def external_metadata(images: DataFrame, records: DataFrame) -> DataFrame:
    """images (image_id, title) with the first of the records (title, ord and more) of the same title, in either case."""
    own = first_of(records.withColumn("_t", F.lower("title")).drop("title"), ["_t"], "ord")
    return images.join(own, F.lower("title") == F.col("_t"), "left").drop("_t")
