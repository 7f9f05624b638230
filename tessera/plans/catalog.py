"""All queries over the given tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, metadata, pixels, units
from ..operators import collection, compose, measure, resample, slicing
from . import access, planner
from .views import E8_SQL, E_SQL, L_SQL, V_SQL, embedding_bytes, embedding_image, event_volume, order_volume, table

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def register(f):
        _found[f.__name__] = (f, sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums differ in their last digits by order."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# regions, axes, tiles


@query(f"WITH {E_SQL} SELECT y, x, v FROM e WHERE x >= 8 AND x < 40 AND y >= 100 AND y < 200")
def slice_region(spark, sf_dir):
    return slicing.slice_region(embedding_image(spark, sf_dir), x=(8, 40), y=(100, 200))


@query(f"WITH {E_SQL} SELECT y, x, v FROM e WHERE x >= 5 AND x < 30 AND y >= 50")
def slice_micrometers(spark, sf_dir):
    return slicing.slice_micrometers(embedding_image(spark, sf_dir), {"x": 0.5, "y": 0.25}, x=(2.5, 15.0), y=(12.5, -1.0))


@query(f"""WITH {E_SQL}, n AS (SELECT CAST(max(y) + 1 AS BIGINT) AS n FROM e), a AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM e GROUP BY 1, 2),
r AS (SELECT y - 12 AS y, x - 2 AS x, v FROM a WHERE x >= 2 AND x < 24 AND y >= 12 AND y < 72),
kx AS (SELECT i, unnest(generate_series(CAST(floor(i / (22.0::DOUBLE / 18)) AS INTEGER), least(CAST(ceil((i + 1) / (22.0::DOUBLE / 18)) AS INTEGER) - 1, 17))) AS o FROM generate_series(0, 21) g(i)),
wx AS (SELECT i, o, least(i + 1.0, (o + 1) * (22.0::DOUBLE / 18)) - greatest(i * 1.0, o * (22.0::DOUBLE / 18)) AS w FROM kx), hx AS (SELECT y, o AS x, sum(v * w) / sum(w) AS v FROM r JOIN wx ON x = i WHERE w > 1e-12 GROUP BY 1, 2),
ky AS (SELECT i, unnest(generate_series(CAST(floor(i / (60.0::DOUBLE / 50)) AS INTEGER), least(CAST(ceil((i + 1) / (60.0::DOUBLE / 50)) AS INTEGER) - 1, 49))) AS o FROM generate_series(0, 59) g(i)),
wy AS (SELECT i, o, least(i + 1.0, (o + 1) * (60.0::DOUBLE / 50)) - greatest(i * 1.0, o * (60.0::DOUBLE / 50)) AS w FROM ky)
SELECT CAST(o AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(sum(v * w) / sum(w), 6) AS v FROM hx JOIN wy ON y = i WHERE w > 1e-12 GROUP BY 1, 2""")
def region_at_pixel_size(spark, sf_dir):
    """Pixels of 0.5 micrometers wanted at 1.2: level 1 is read and resized by 5 / 6."""
    px = embedding_image(spark, sf_dir)
    n = _height(px)
    levels = spark.createDataFrame([(0, k, 64 >> k, n >> k, 0.5 / 1.2) for k in range(3)], "image_id long, level int, size_x long, size_y long, target double")
    best = planner.best_level(levels).first()
    pyramid = resample.pyramid(px, 2).where(F.col("level") == best["level"]).drop("level")
    sizes = {"x": 64 >> best["level"], "y": n >> best["level"]}
    return _rounded(access.resized_region(pyramid, sizes, (best["factor_x"], best["factor_y"]), x=(2, 20), y=(10, 60)), "v")


@query(f"WITH {L_SQL} SELECT z, c, y, x, v FROM l WHERE t = 3")
def redimension_drop_t(spark, sf_dir):
    return slicing.redimension(order_volume(spark, sf_dir), "zcyx", t=3)


@query(f"WITH {E_SQL} SELECT CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS z, y, x, v FROM e")
def redimension_add_axes(spark, sf_dir):
    return slicing.redimension(embedding_image(spark, sf_dir), "tczyx")


@query("""WITH s AS (SELECT p_partkey AS image_id, p_size * 100 AS size_x, p_size * 80 AS size_y FROM part)
SELECT image_id, CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx, CAST(ty * 256 AS BIGINT) AS y0, CAST(tx * 512 AS BIGINT) AS x0, CAST(least(256, size_y - ty * 256) AS BIGINT) AS h, CAST(least(512, size_x - tx * 512) AS BIGINT) AS w
FROM s, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(size_y / 256.0) AS INTEGER) - 1)) AS ty) a, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(size_x / 512.0) AS INTEGER) - 1)) AS tx) b""")
def tile_grid(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 100).cast("long").alias("size_x"), (F.col("p_size") * 80).cast("long").alias("size_y"))
    return slicing.tile_grid(sizes, 256, 512).drop("size_x", "size_y")


@query(f"WITH {E_SQL} SELECT CAST(y // 16 AS BIGINT) AS ty, CAST(x // 16 AS BIGINT) AS tx, count(*) AS n, min(v) AS v_min, max(v) AS v_max, round(avg(v), 6) AS v_mean FROM e GROUP BY 1, 2")
def tile_stats(spark, sf_dir):
    return _rounded(slicing.tile_stats(embedding_image(spark, sf_dir), 16, 16), "v_mean")


@query(f"""WITH {E8_SQL}, g AS (SELECT y, x, v, y // 32 AS ty, x // 32 AS tx FROM e8)
SELECT CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx, CAST(max(y % 32) + 1 AS BIGINT) AS h, CAST(max(x % 32) + 1 AS BIGINT) AS w, count(*) AS n, CAST(sum(v * ((y % 32) * 32 + x % 32 + 1)) AS DOUBLE) AS digest FROM g GROUP BY 1, 2""")
def tile_pack(spark, sf_dir):
    packed = slicing.pack(embedding_bytes(spark, sf_dir), 32, 32)
    digest = F.aggregate(F.transform("data", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return packed.select("ty", "tx", "h", "w", F.size("data").cast("long").alias("n"), digest.alias("digest"))


@query(f"WITH {E8_SQL} SELECT y, x, CAST(v AS DOUBLE) AS v FROM e8 WHERE y >= 40 AND y < 90 AND x >= 10 AND x < 50")
def tile_region(spark, sf_dir):
    packed = slicing.pack(embedding_bytes(spark, sf_dir), 32, 32)
    return slicing.slice_region(slicing.unpack(slicing.covering(packed, 32, 32, 40, 90, 10, 50), 32, 32), y=(40, 90), x=(10, 50))


def _height(px) -> int:
    return int(slicing.shape(px, "y").first()[0])


@query(f"""WITH {E_SQL}, n AS (SELECT max(y) + 1 AS n FROM e), gy AS (SELECT n, unnest(generate_series(0, n + 19)) AS y FROM n), g AS (SELECT n, y, unnest(generate_series(0, 69)) AS x FROM gy)
SELECT g.y, g.x, e.v FROM g JOIN e ON e.y = least(g.y, n - 1) AND e.x = least(g.x, 63)""")
def edge_pad(spark, sf_dir):
    px = embedding_image(spark, sf_dir)
    n = _height(px)
    return slicing.reshape(px, n, 64, n + 20, 70)


@query(f"WITH {L_SQL}, g AS (SELECT a.y, b.x FROM generate_series(0, 49) a(y), generate_series(0, 10) b(x)) SELECT g.y, g.x, coalesce(s.v, 0) AS v FROM g LEFT JOIN (SELECT y, x, v FROM l WHERE t = 0 AND c = 0 AND z = 6) s USING (y, x)")
def grid_fill(spark, sf_dir):
    return slicing.fill(slicing.slice_region(order_volume(spark, sf_dir), t=0, c=0, z=6), {"y": 50, "x": 11})


@query(f"WITH {L_SQL} SELECT max(t) + 1 AS size_t, max(c) + 1 AS size_c, max(z) + 1 AS size_z, max(y) + 1 AS size_y, max(x) + 1 AS size_x FROM l")
def image_shape(spark, sf_dir):
    return slicing.shape(order_volume(spark, sf_dir))


# resampling


@query(f"WITH {E_SQL} SELECT CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, round(avg(v), 6) AS v FROM e GROUP BY 1, 2")
def block_mean(spark, sf_dir):
    return _rounded(resample.block_mean(embedding_image(spark, sf_dir), 2, 2), "v")


@query(f"WITH {E_SQL} SELECT CAST(y // 4 AS BIGINT) AS y, CAST(x // 4 AS BIGINT) AS x, max(v) AS v FROM e GROUP BY 1, 2")
def block_max(spark, sf_dir):
    return resample.block_max(embedding_image(spark, sf_dir), 4, 4)


@query(f"WITH {E_SQL} SELECT CAST(y // 7 AS BIGINT) AS y, CAST(x // 5 AS BIGINT) AS x, round(sum(v) / 35, 6) AS v FROM e GROUP BY 1, 2")
def block_mean_zero_padded(spark, sf_dir):
    return _rounded(resample.block_mean_zero_padded(embedding_image(spark, sf_dir), 7, 5), "v")


@query(f"""WITH {E8_SQL}, a AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM e8 GROUP BY 1, 2), b AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM a GROUP BY 1, 2)
SELECT 0 AS level, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(v AS DOUBLE) AS v FROM e8 UNION ALL SELECT 1, CAST(y AS BIGINT), CAST(x AS BIGINT), round(v, 6) FROM a UNION ALL SELECT 2, CAST(y AS BIGINT), CAST(x AS BIGINT), round(v, 6) FROM b""")
def pyramid_recursive(spark, sf_dir):
    px = embedding_bytes(spark, sf_dir)
    return _rounded(resample.pyramid(px.withColumn("v", F.col("v").cast("double")), 2).select("level", "y", "x", "v"), "v")


@query(f"""WITH {E_SQL} SELECT 0 AS level, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, v FROM e UNION ALL SELECT 1, CAST(y // 2 AS BIGINT), CAST(x // 2 AS BIGINT), v FROM e WHERE y % 2 = 0 AND x % 2 = 0
UNION ALL SELECT 2, CAST(y // 4 AS BIGINT), CAST(x // 4 AS BIGINT), v FROM e WHERE y % 4 = 0 AND x % 4 = 0""")
def pyramid_nearest(spark, sf_dir):
    return resample.pyramid(embedding_image(spark, sf_dir), 2, nearest=True).select("level", "y", "x", "v")


_SIZES = "SELECT p_partkey AS image_id, CAST(p_size * 100 AS BIGINT) AS size_x, CAST(p_size * 80 AS BIGINT) AS size_y FROM part"


def _sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 100).cast("long").alias("size_x"), (F.col("p_size") * 80).cast("long").alias("size_y"))


@query(f"SELECT image_id, CAST(k AS INTEGER) AS level, greatest(CAST(round_even(size_x / pow(3, k), 0) AS BIGINT), 1) AS size_x, greatest(CAST(round_even(size_y / pow(3, k), 0) AS BIGINT), 1) AS size_y FROM ({_SIZES}), generate_series(1, 5) g(k)")
def pyramid_sizes_round(spark, sf_dir):
    return resample.pyramid_sizes(_sizes(spark, sf_dir), 5, 3.0).select("image_id", "level", "size_x", "size_y")


@query(f"SELECT image_id, CAST(k AS INTEGER) AS level, CAST(trunc(size_x / pow(3, k)) AS BIGINT) AS size_x, CAST(trunc(size_y / pow(3, k)) AS BIGINT) AS size_y FROM ({_SIZES}), generate_series(1, 5) g(k)")
def pyramid_sizes_trunc(spark, sf_dir):
    return resample.pyramid_sizes(_sizes(spark, sf_dir), 5, 3.0, truncate=True).select("image_id", "level", "size_x", "size_y")


@query(f"SELECT image_id, CAST(k AS INTEGER) AS level, greatest(CAST(round_even(size_x / pow(2, k), 0) AS BIGINT), 1) AS size_x, CASE WHEN z > 1 THEN greatest(CAST(round_even(z / pow(2, k), 0) AS BIGINT), 1) ELSE z END AS size_z FROM (SELECT *, image_id % 40 AS z FROM ({_SIZES})), generate_series(1, 4) g(k)")
def pyramid_sizes_volume(spark, sf_dir):
    sizes = _sizes(spark, sf_dir).withColumn("size_z", F.col("image_id") % 40)
    return resample.pyramid_sizes(sizes, 4, 2.0, ("size_x",), volumetric=True).select("image_id", "level", "size_x", "size_z")


_DRAW = "CAST('0x' || substr(md5('0:{a}:' || image_id || ':' || k), 1, 12) AS BIGINT) % greatest(size_{a} - {n} + 1, 1)"


@query(f"SELECT image_id, CAST(k AS INTEGER) AS k, {_DRAW.format(a='y', n=256)} AS y0, {_DRAW.format(a='x', n=512)} AS x0 FROM ({_SIZES}), generate_series(0, 4) g(k)")
def random_patches(spark, sf_dir):
    return slicing.patches(_sizes(spark, sf_dir), 5, 256, 512)


_LEVELS = f"SELECT image_id, CAST(k AS INTEGER) AS level, greatest(CAST(round_even(size_x / pow(2, k), 0) AS BIGINT), 1) AS size_x, greatest(CAST(round_even(size_y / pow(2, k), 0) AS BIGINT), 1) AS size_y FROM ({_SIZES}), generate_series(0, 5) g(k)"


def _levels(spark, sf_dir):
    sizes = _sizes(spark, sf_dir)
    return sizes.withColumn("level", F.lit(0)).unionByName(resample.pyramid_sizes(sizes, 5, 2.0))


@query(f"""WITH v AS (SELECT *, 0.05 + (image_id % 19) / 20.0 AS target FROM ({_LEVELS})), f AS (SELECT *, size_x / first_value(size_x) OVER w AS fx, size_y / first_value(size_y) OVER w AS fy FROM v WINDOW w AS (PARTITION BY image_id ORDER BY level)),
k AS (SELECT * FROM f WHERE level = 0 OR (fx > target AND fy > target) OR (abs(fx - target) <= 1e-8 + 1e-4 * target AND abs(fy - target) <= 1e-8 + 1e-4 * target))
SELECT image_id, arg_max(level, level) AS level, round(arg_max(target / fx, level), 6) AS factor_x, round(arg_max(target / fy, level), 6) AS factor_y FROM k GROUP BY image_id""")
def best_level(spark, sf_dir):
    levels = _levels(spark, sf_dir).withColumn("target", 0.05 + (F.col("image_id") % 19) / 20.0)
    return _rounded(planner.best_level(levels), "factor_x", "factor_y")


@query(f"""WITH s AS (SELECT image_id, level, (300.0 / size_x + 300.0 / size_y) / 2 AS scale FROM ({_LEVELS})), k AS (SELECT image_id, level, row_number() OVER (PARTITION BY image_id ORDER BY scale DESC, level) AS n FROM s WHERE scale <= 1 AND scale > 0)
SELECT p.image_id, coalesce(k.level, 0) AS level FROM (SELECT DISTINCT image_id FROM s) p LEFT JOIN k ON k.image_id = p.image_id AND k.n = 1""")
def best_size(spark, sf_dir):
    return planner.best_size(_levels(spark, sf_dir), 300.0, 300.0)


@query(f"""WITH {E_SQL}, k AS (SELECT y, v, x, unnest(generate_series(CAST(floor(x / (64.0 / 24)) AS INTEGER), least(CAST(ceil((x + 1) / (64.0 / 24)) AS INTEGER) - 1, 23))) AS o FROM e),
w AS (SELECT y, o, v, least(x + 1.0, (o + 1) * (64.0::DOUBLE / 24)) - greatest(x * 1.0, o * (64.0::DOUBLE / 24)) AS w FROM k)
SELECT y, CAST(o AS BIGINT) AS x, round(sum(v * w) / sum(w), 6) AS v FROM w WHERE w > 1e-12 GROUP BY 1, 2""")
def resize_area(spark, sf_dir):
    return _rounded(resample.area_resize(embedding_image(spark, sf_dir), "x", 64, 24), "v")


@query(f"""WITH {E_SQL}, o AS (SELECT o, (o + 0.5) * (64.0::DOUBLE / 100) - 0.5 AS c FROM generate_series(0, 99) g(o)), j AS (SELECT o, c, CAST(floor(c) AS INTEGER) + k AS j FROM o, generate_series(-2, 3) g(k)),
w AS (SELECT o, least(greatest(j, 0), 63) AS i, CASE WHEN abs(c - j) <= 1 THEN 1.25 * abs(c - j) * abs(c - j) * abs(c - j) - 2.25 * abs(c - j) * abs(c - j) + 1 WHEN abs(c - j) < 2 THEN -0.75 * abs(c - j) * abs(c - j) * abs(c - j) + 3.75 * abs(c - j) * abs(c - j) - 6 * abs(c - j) + 3 ELSE 0 END AS w FROM j)
SELECT y, CAST(o AS BIGINT) AS x, round(sum(v * w), 6) AS v FROM w JOIN e ON e.x = w.i GROUP BY 1, 2""")
def resize_cubic(spark, sf_dir):
    return _rounded(resample.resize(embedding_image(spark, sf_dir), 500, 64, 500, 100), "v")


_KERNEL = ", ".join(f"({k - 4}, {w!r}::DOUBLE)" for k, w in enumerate(resample.gaussian(1.0)))


@query(f"""WITH {E_SQL}, k(d, w) AS (VALUES {_KERNEL}), n AS (SELECT max(y) + 1 AS n FROM e),
a AS (SELECT e.y, o.x, sum(e.v * k.w) AS v FROM generate_series(0, 63) o(x), k JOIN e ON e.x = CASE WHEN o.x + k.d < 0 THEN -1 - (o.x + k.d) WHEN o.x + k.d > 63 THEN 127 - (o.x + k.d) ELSE o.x + k.d END GROUP BY 1, 2),
o AS (SELECT n, unnest(generate_series(0, n - 1)) AS y FROM n), t AS (SELECT o.y, k.w, CASE WHEN o.y + k.d < 0 THEN -1 - (o.y + k.d) WHEN o.y + k.d >= n THEN 2 * n - 1 - (o.y + k.d) ELSE o.y + k.d END AS i FROM o, k)
SELECT t.y, CAST(a.x AS BIGINT) AS x, round(sum(a.v * t.w), 6) AS v FROM t JOIN a ON a.y = t.i GROUP BY 1, 2""")
def blur(spark, sf_dir):
    px = embedding_image(spark, sf_dir)
    return _rounded(resample.blur(px, 1.0, _height(px), 64), "v")


# values


@query(f"WITH {V_SQL} SELECT c, round(quantile_cont(v::DOUBLE, 0.001), 6) AS q0, round(quantile_cont(v::DOUBLE, 0.999), 6) AS q1 FROM w GROUP BY c")
def quantile_window(spark, sf_dir):
    return _rounded(measure.channel_quantiles(event_volume(spark, sf_dir), [0.001, 0.999], "c"), "q0", "q1")


@query(f"""WITH {E8_SQL}, a AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM e8 GROUP BY 1, 2) SELECT CAST(x % 3 AS BIGINT) AS c, round(quantile_cont(v::DOUBLE, 0.001), 6) AS q0, round(quantile_cont(v::DOUBLE, 0.999), 6) AS q1 FROM a GROUP BY 1""")
def channel_window(spark, sf_dir):
    return _rounded(measure.channel_windows(resample.pyramid(embedding_bytes(spark, sf_dir), 1).withColumn("c", F.col("x") % 3)), "q0", "q1")


@query(f"WITH {E_SQL} SELECT y, x, round(greatest(least((v - -0.25::DOUBLE) / (0.3::DOUBLE - -0.25::DOUBLE), 1.0), 0.0), 9) AS v FROM e")
def normalise(spark, sf_dir):
    return _rounded(embedding_image(spark, sf_dir).withColumn("v", pixels.normalise(F.col("v"), -0.25, 0.3)), "v", digits=9)


@query(f"WITH {E8_SQL} SELECT y, x, v / 255.0::DOUBLE AS f, CAST(trunc((v / 255.0::DOUBLE) * 65535) AS INTEGER) AS i FROM e8")
def int_float_roundtrip(spark, sf_dir):
    f = pixels.int_to_float(F.col("v"), "uint8")
    return embedding_bytes(spark, sf_dir).select("y", "x", f.alias("f"), pixels.float_to_int(f, "uint16").alias("i"))


@query(f"WITH {E8_SQL} SELECT y, x, CAST(v - 128 AS BIGINT) AS s, CAST(v AS BIGINT) AS u FROM e8")
def sign_convert(spark, sf_dir):
    s = pixels.convert_sign(F.col("v"), "uint8", "int8")
    return embedding_bytes(spark, sf_dir).select("y", "x", s.alias("s"), pixels.convert_sign(s, "int8", "uint8").alias("u"))


@query(f"""WITH {E8_SQL}, q AS (SELECT x % 4 AS c, quantile_cont(v::DOUBLE, 0.05) AS q0, quantile_cont(v::DOUBLE, 0.95) AS q1 FROM e8 GROUP BY 1)
SELECT CAST(c AS BIGINT) AS c, y, x, round(greatest(least((v - q0) / (q1 - q0), 1.0), 0.0), 9) AS v FROM e8 JOIN q ON c = x % 4""")
def stretch(spark, sf_dir):
    px = embedding_bytes(spark, sf_dir).select((F.col("x") % 4).alias("c"), "y", "x", "v")
    return _rounded(compose.stretch(px, measure.channel_quantiles(px, [0.05, 0.95], "c"), "c"), "v", digits=9).select("c", "y", "x", "v")


@query(f"""WITH {E_SQL}, a AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM e GROUP BY 1, 2), q AS (SELECT x % 3 AS c, quantile_cont(v, 0.001) AS q0, quantile_cont(v, 0.999) AS q1 FROM a GROUP BY 1)
SELECT CAST(g.c AS BIGINT) AS c, 0.0::DOUBLE AS start, 65535.0::DOUBLE AS "end", round(CASE g.c WHEN 1 THEN 5.0 ELSE coalesce(q0, 0.0) END, 6) AS min, round(CASE g.c WHEN 1 THEN 7.0 ELSE coalesce(q1, 65535.0) END, 6) AS max FROM generate_series(0, 3) g(c) LEFT JOIN q ON q.c = g.c""")
def display_window(spark, sf_dir):
    levels = resample.pyramid(embedding_image(spark, sf_dir), 1).withColumn("c", F.col("x") % 3)
    given = spark.createDataFrame([(0, None, None), (1, 5.0, 7.0), (2, None, None), (3, None, None)], "c long, min double, max double")
    return _rounded(measure.display_windows(levels, given, "uint16"), "min", "max")


# channels


@query(f"WITH {E8_SQL} SELECT CAST(x % 3 AS BIGINT) AS c, y, x, CAST(trunc(greatest(least((CAST(v AS DOUBLE) * 257 - 1000.0) / (60000.0 - 1000.0), 1.0), 0.0) * 65535) AS INTEGER) AS v FROM e8")
def render_rgb(spark, sf_dir):
    px = embedding_bytes(spark, sf_dir).select((F.col("x") % 3).alias("c"), "y", "x", (F.col("v").cast("double") * 257).alias("v"))
    return compose.render_rgb(px, "uint16", 1000.0, 60000.0)


_COLORS = [(0, 0.0, 255.0, 1.0, 0.0, 0.0, 1.0), (1, 20.0, 220.0, 0.0, 1.0, 0.5, 0.5), (2, 10.0, 250.0, 0.25, 0.0, 1.0, 0.0)]


@query(f"""WITH {E8_SQL}, k(c, low, high, red, green, blue, alpha) AS (VALUES {", ".join(str(c) for c in _COLORS)}), p AS (SELECT x % 3 AS c, y, x // 3 AS x, v FROM e8),
s AS (SELECT y, x, greatest(least((v - low::DOUBLE) / (high::DOUBLE - low::DOUBLE), 1.0), 0.0) * (CASE WHEN alpha = 0 THEN 1.0::DOUBLE ELSE alpha::DOUBLE END) AS a, red::DOUBLE AS red, green::DOUBLE AS green, blue::DOUBLE AS blue FROM p JOIN k USING (c))
SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(floor(sum(a * red) / 2.5::DOUBLE * 255 + 1e-9) AS INTEGER) AS r, CAST(floor(sum(a * green) / 2.5::DOUBLE * 255 + 1e-9) AS INTEGER) AS g, CAST(floor(sum(a * blue) / 2.5::DOUBLE * 255 + 1e-9) AS INTEGER) AS b FROM s GROUP BY 1, 2""")
def render_multichannel(spark, sf_dir):
    px = embedding_bytes(spark, sf_dir).select((F.col("x") % 3).alias("c"), "y", F.floor(F.col("x") / 3).alias("x"), "v")
    channels = spark.createDataFrame(_COLORS, "c long, low double, high double, red double, green double, blue double, alpha double")
    return compose.render(px, channels)


@query(f"WITH {E_SQL}, p AS (SELECT x % 2 AS c, y, x // 2 AS x, v FROM e) SELECT CAST(c AS BIGINT) AS c, y, CAST(x AS BIGINT) AS x, v FROM p UNION ALL SELECT CAST(c + 2 AS BIGINT), y, CAST(x AS BIGINT), -v FROM p UNION ALL SELECT CAST(4 AS BIGINT), y, x, v FROM e WHERE x < 32")
def combine_channels(spark, sf_dir):
    e = embedding_image(spark, sf_dir)
    p = e.select((F.col("x") % 2).alias("c"), "y", F.floor(F.col("x") / 2).alias("x"), "v")
    return compose.combine([(p, 2), (p.withColumn("v", -F.col("v")), 2), (e.where("x < 32").select(F.lit(0).cast("long").alias("c"), "y", "x", "v"), 1)])


@query(f"WITH {E_SQL} SELECT CAST((x + 1) % 3 AS BIGINT) AS c, y, CAST(x // 3 AS BIGINT) AS x, v FROM e")
def split_merge(spark, sf_dir):
    px = embedding_image(spark, sf_dir).select((F.col("x") % 3).alias("c"), "y", F.floor(F.col("x") / 3).alias("x"), "v")
    a, b, c = compose.split_channels(px, 3)
    return compose.merge_channels([c, a, b]).select("c", "y", "x", "v")


@query("""SELECT n_nationkey AS k, CASE WHEN lower(l) NOT IN ('', 'minisblack', 'miniswhite', 'rgb', 'palette', 'ycbcr', 'cielab') THEN l WHEN n > 1 THEN n_name || '#' || c ELSE n_name END AS label
FROM (SELECT n_nationkey, n_name, n_nationkey % 4 AS c, CASE n_nationkey % 3 WHEN 0 THEN 'RGB' WHEN 1 THEN 'DAPI' ELSE '' END AS l, 1 + n_nationkey % 2 AS n FROM nation)""")
def channel_labels(spark, sf_dir):
    k = F.col("n_nationkey")
    label = F.when(k % 3 == 0, "RGB").when(k % 3 == 1, "DAPI").otherwise("")
    return table(spark, sf_dir, "nation").select(k.alias("k"), compose.channel_label(label, F.col("n_name"), k % 4, 1 + k % 2).alias("label"))


@query("""WITH a AS (SELECT n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k, n_regionkey FROM nation)
SELECT CAST(k AS INTEGER) AS k, string_agg(n_name, '|' ORDER BY n_regionkey) AS names FROM a GROUP BY k HAVING count(*) = (SELECT count(DISTINCT n_regionkey) FROM nation)""")
def zip_pair(spark, sf_dir):
    return collection.zip_lists(table(spark, sf_dir, "nation").select("n_regionkey", "n_name"), "n_regionkey", "n_name").select("k", F.array_join("names", "|").alias("names"))


_TILES = f"{E8_SQL}, p AS (SELECT y // 50 AS tile, CAST(0 AS BIGINT) AS c, y % 50 AS y, x, v FROM e8)"


def _tiles(spark, sf_dir):
    """Vectors as tiles of 50 rows."""
    e = embedding_bytes(spark, sf_dir)
    return e.select(F.floor(F.col("y") / 50).alias("tile"), F.lit(0).cast("long").alias("c"), (F.col("y") % 50).alias("y"), "x", "v")


@query(f"WITH {_TILES} SELECT c, y, x, median(v::DOUBLE) AS v FROM p GROUP BY 1, 2, 3")
def tile_median(spark, sf_dir):
    return measure.tiles_median(_tiles(spark, sf_dir))


@query(f"""WITH {_TILES} SELECT c, y, x, 0 AS k, round(quantile_cont(v::DOUBLE, 0.05) / 255, 6) AS v FROM p GROUP BY 1, 2, 3
UNION ALL SELECT c, y, x, 1, round(quantile_cont(v::DOUBLE, 0.95) / 255, 6) FROM p GROUP BY 1, 2, 3""")
def tile_quantiles(spark, sf_dir):
    return _rounded(measure.tiles_quantiles(_tiles(spark, sf_dir), [0.05, 0.95], 255.0), "v")


@query(f"""WITH {_TILES}, m AS (SELECT c, y, x, median(v::DOUBLE) AS m FROM p GROUP BY 1, 2, 3), s AS (SELECT tile, avg(abs(v - m)) AS signal FROM p JOIN m USING (c, y, x) GROUP BY tile)
SELECT CAST(tile AS BIGINT) AS tile, round(signal, 6) AS signal FROM s WHERE signal < (SELECT avg(signal) FROM s)""")
def signal_filter(spark, sf_dir):
    px = _tiles(spark, sf_dir)
    return _rounded(measure.signal_filter(px, measure.tiles_median(px)), "signal")


@query(f"""WITH {_TILES}, d AS (SELECT y, x, quantile_cont(v / 255.0::DOUBLE, 0.05) AS d, quantile_cont(v / 255.0::DOUBLE, 0.95) AS b FROM p GROUP BY 1, 2), m AS (SELECT avg(b - d) AS m FROM d)
SELECT CAST(tile AS BIGINT) AS tile, c, y, x, round(greatest(least((v / 255.0::DOUBLE - d) * m / (b - d), 1.0), 0.0), 6) AS v FROM p JOIN d USING (y, x), m""")
def flatfield(spark, sf_dir):
    px = _tiles(spark, sf_dir).withColumn("v", pixels.int_to_float(F.col("v"), "uint8"))
    q = measure.quantiles(px, [0.05, 0.95], "y", "x")
    out = compose.flatfield(px, q.select("y", "x", F.col("q0").alias("v")), q.select("y", "x", F.col("q1").alias("v")))
    return _rounded(out.select("tile", "c", "y", "x", "v"), "v")


@query(f"""WITH {_TILES}, d AS (SELECT y, x, quantile_cont(v / 255.0::DOUBLE, 0.05) AS d, quantile_cont(v / 255.0::DOUBLE, 0.95) AS b FROM p GROUP BY 1, 2), m AS (SELECT avg(b - d) AS m FROM d)
SELECT CAST(tile AS BIGINT) AS tile, c, y, x, CAST(floor(greatest(least((v / 255.0::DOUBLE - d) * m / (b - d), 1.0), 0.0) * 255.0 + 1e-9) AS BIGINT) AS v FROM p JOIN d USING (y, x), m""")
def flatfield_bytes(spark, sf_dir):
    px = _tiles(spark, sf_dir)
    q = measure.quantiles(px.withColumn("v", pixels.int_to_float(F.col("v"), "uint8")), [0.05, 0.95], "y", "x")
    return compose.correct(px, q.select("y", "x", F.col("q0").alias("v")), q.select("y", "x", F.col("q1").alias("v")), "uint8").select("tile", "c", "y", "x", "v")


@query(f"""WITH {_TILES}, m AS (SELECT c, y, x, median(v::DOUBLE) AS m FROM p GROUP BY 1, 2, 3), s AS (SELECT tile, avg(abs(v - m)) AS signal FROM p JOIN m USING (c, y, x) GROUP BY tile),
k AS (SELECT p.* FROM p JOIN s USING (tile) WHERE signal < (SELECT avg(signal) FROM s))
SELECT c, y, x, 0 AS k, round(quantile_cont(v::DOUBLE, 0.05) / 255, 6) AS v FROM k GROUP BY 1, 2, 3 UNION ALL SELECT c, y, x, 1, round(quantile_cont(v::DOUBLE, 0.95) / 255, 6) FROM k GROUP BY 1, 2, 3""")
def normalisation_images(spark, sf_dir):
    return _rounded(measure.normalisation_images(_tiles(spark, sf_dir), [0.05, 0.95], 255.0), "v")


@query(f"WITH {E8_SQL} SELECT CAST(y % 40 AS BIGINT) AS y, x, arg_max(v, y) AS v FROM e8 GROUP BY 1, 2")
def paste_tiles(spark, sf_dir):
    px = embedding_bytes(spark, sf_dir).select((F.col("y") % 40).alias("cy"), "x", "v", F.col("y").alias("seq"))
    return compose.paste(px, "seq", "cy", "x").withColumnRenamed("cy", "y")


# comparison

_PAIR = f"""{E8_SQL}, a AS (SELECT y, x // 2 AS x, x % 2 AS c, v::DOUBLE AS v FROM e8), b AS (SELECT y, x, c, trunc(v / 16) * 16 AS v FROM a),
d AS (SELECT y, x, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d, sum((a.v - b.v) * (a.v - b.v)) AS sq, count(*) AS n FROM a JOIN b USING (y, x, c) GROUP BY 1, 2)"""


def _pair(spark, sf_dir):
    a = embedding_bytes(spark, sf_dir).select("y", F.floor(F.col("x") / 2).alias("x"), (F.col("x") % 2).alias("c"), F.col("v").cast("double").alias("v"))
    return a, a.withColumn("v", F.floor(F.col("v") / 16) * 16.0)


@query(f"WITH {_PAIR} SELECT round(max(d), 6) AS dif_max, round(avg(d), 6) AS dif_mean, round(20 * log10(255 / sqrt(sum(sq) / sum(n))), 6) AS psnr FROM d")
def compare_psnr(spark, sf_dir):
    return _rounded(measure.compare(*_pair(spark, sf_dir), ["y", "x"], 255.0), "dif_max", "dif_mean", "psnr")


@query(f"WITH {_PAIR}, t AS (SELECT y // 64 AS ty, x // 16 AS tx, max(d) AS m, avg(d) AS a, sum(sq) / sum(n) AS s FROM d GROUP BY 1, 2) SELECT round(max(m), 6) AS dif_max, round(avg(a), 6) AS dif_mean, round(20 * log10(255 / sqrt(avg(s))), 6) AS psnr FROM t")
def compare_tiled(spark, sf_dir):
    return _rounded(measure.compare_tiled(*_pair(spark, sf_dir), ["y", "x"], 255.0, 64, 16), "dif_max", "dif_mean", "psnr")


@query(f"WITH {E8_SQL} SELECT round(avg(CASE WHEN v BETWEEN 26 AND 230 THEN 1.0 ELSE 0.0 END), 6) AS used FROM e8")
def used_fraction(spark, sf_dir):
    return _rounded(measure.used_fraction(embedding_bytes(spark, sf_dir)), "used")


# units, colours, catalog

_UNITS = ["nm", "µm", "um", "mm", "cm", "m", "inch"]
_UNIT_SQL = "CASE p_size % 7 WHEN 0 THEN 'nm' WHEN 1 THEN 'µm' WHEN 2 THEN 'um' WHEN 3 THEN 'mm' WHEN 4 THEN 'cm' WHEN 5 THEN 'm' ELSE 'inch' END"


def _unit():
    return F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("p_size") % 7 + 1).cast("int"))


@query(f"SELECT p_partkey, p_retailprice * (CASE {_UNIT_SQL} WHEN 'nm' THEN 1e-3 WHEN 'mm' THEN 1e3 WHEN 'cm' THEN 1e4 WHEN 'm' THEN 1e6 ELSE 1.0 END)::DOUBLE AS um FROM part")
def units_um(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", units.micrometers(F.col("p_retailprice"), _unit()).alias("um"))


@query(f"""SELECT p_partkey, round(CASE WHEN p_size IN (0, 1) THEN NULL WHEN u = 'nm' THEN 1000.0::DOUBLE / p_size ELSE 1.0::DOUBLE / p_size END, 9) AS per_unit,
CASE u WHEN 'cm' THEN 'centimeter' WHEN 'mm' THEN 'millimeter' WHEN 'µm' THEN 'micrometer' WHEN 'um' THEN 'micrometer' WHEN 'nm' THEN 'micrometer' ELSE u END AS unit FROM (SELECT *, {_UNIT_SQL} AS u FROM part)""")
def resolution_from_pixel_size(spark, sf_dir):
    value, name = units.resolution(F.col("p_size"), _unit())
    return table(spark, sf_dir, "part").select("p_partkey", F.round(value, 9).alias("per_unit"), name.alias("unit"))


@query("SELECT p_partkey, round(round_even(p_retailprice / 7 * s, 0) / s, 9) AS rounded FROM (SELECT *, pow(10, 3 - floor(log10(abs(p_retailprice / 7)))) AS s FROM part)")
def round_significant(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(units.round_significant(F.col("p_retailprice") / 7, 4), 9).alias("rounded"))


@query("""SELECT p_partkey, CASE WHEN n <= 1024 THEN printf('%.1fB', round_even(n, 1)) WHEN n <= 1048576 THEN printf('%.1fKB', round_even(n / 1024, 1)) WHEN n <= 1073741824 THEN printf('%.1fMB', round_even(n / 1048576, 1)) ELSE printf('%.1fGB', round_even(n / 1073741824, 1)) END AS text
FROM (SELECT p_partkey, p_retailprice * pow(p_size, 3) AS n FROM part)""")
def hbytes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", units.human_bytes(F.col("p_retailprice") * F.pow(F.col("p_size"), F.lit(3.0))).alias("text"))


@query("SELECT c_custkey, CAST(CASE WHEN p >= 2147483648 THEN p - 4294967296 ELSE p END AS INTEGER) AS packed, (p >> 24) / 255.0::DOUBLE AS r, (p & 255) / 255.0::DOUBLE AS a FROM (SELECT c_custkey, CAST((c_custkey * 2654435761) % 4294967296 AS BIGINT) | 1 AS p FROM customer)")
def color_roundtrip(spark, sf_dir):
    p = (F.col("c_custkey") * 2654435761 % 4294967296).bitwiseOR(F.lit(1))
    rgba = color.int_to_rgba(F.when(p >= 1 << 31, p - (1 << 32)).otherwise(p))
    return table(spark, sf_dir, "customer").select("c_custkey", color.rgba_to_int(rgba).alias("packed"), rgba[0].alias("r"), rgba[3].alias("a"))


@query("SELECT c_custkey, printf('%02X%02X%02X', (p >> 24) & 255, (p >> 16) & 255, (p >> 8) & 255) AS hex FROM (SELECT c_custkey, CAST((c_custkey * 2654435761) % 4294967296 AS BIGINT) AS p FROM customer)")
def color_hex(spark, sf_dir):
    p = F.col("c_custkey") * 2654435761 % 4294967296
    text = color.rgba_to_hex(color.int_to_rgba(F.when(p >= 1 << 31, p - (1 << 32)).otherwise(p)))
    return table(spark, sf_dir, "customer").select("c_custkey", color.rgba_to_hex(color.hex_to_rgba(text)).alias("hex"))


@query("SELECT p_partkey, CAST(k AS INTEGER) AS level, round(p_size / (1.0::DOUBLE / pow(2, k)), 9) AS scale_x, p_size::DOUBLE AS scale_z, round(p_retailprice + (pow(2, k) - 1) * p_size / 2.0, 6) AS translation_x FROM part, generate_series(0, 3) g(k)")
def transform_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("s", 1.0 / F.pow(F.lit(2.0), F.col("level")))
    size = F.col("p_size").cast("double")
    return rows.select("p_partkey", "level", F.round(units.level_scale(size, F.col("s"), "x"), 9).alias("scale_x"), units.level_scale(size, F.col("s"), "z").alias("scale_z"), F.round(units.level_translation(F.col("p_retailprice"), size, F.col("s"), "x"), 6).alias("translation_x"))


@query("SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN degrees(p_size / 10.0) ELSE p_size / 10.0 END AS rotation FROM part")
def rotation_text(spark, sf_dir):
    text = F.concat(F.lit("Angle: "), (F.col("p_size") / 10.0).cast("string"), F.when(F.col("p_size") % 2 == 0, " rad").otherwise(" deg"))
    return table(spark, sf_dir, "part").select("p_partkey", units.rotation(text).alias("rotation"))


@query("SELECT p_partkey, p_size * 100 * 0.25::DOUBLE AS width_um, p_size * 80 * 0.5::DOUBLE AS height_um FROM part")
def physical_size(spark, sf_dir):
    both = units.physical_size(F.array((F.col("p_size") * 100).cast("double"), (F.col("p_size") * 80).cast("double"), F.lit(1.0)), F.array(F.lit(0.25), F.lit(0.5)))
    return table(spark, sf_dir, "part").select("p_partkey", both[0].alias("width_um"), both[1].alias("height_um"))


@query(f"""WITH v AS ({_LEVELS}) SELECT image_id, 'XYZCT: ' || string_agg(size_x || ' ' || size_y || ' 1 3 1', ', ' ORDER BY level) || ' Uncompressed: ' || CAST(sum(size_x * size_y * 3) AS BIGINT) AS info FROM v GROUP BY image_id""")
def image_info(spark, sf_dir):
    levels = _levels(spark, sf_dir).withColumns({"size_z": F.lit(1), "size_c": F.lit(3), "size_t": F.lit(1), "nbits": F.lit(8)})
    return measure.image_info(levels, "image_id")


@query(f"SELECT image_id, CAST(sum(size_x * size_y * 4096) AS BIGINT) AS n_bytes, sum(size_x * size_y * 4096) > 4294967296 AS big FROM ({_LEVELS}) GROUP BY image_id")
def bigtiff_rule(spark, sf_dir):
    levels = _levels(spark, sf_dir).withColumns({"size_z": F.lit(1024), "size_c": F.lit(2), "size_t": F.lit(1), "nbits": F.lit(16)})
    return measure.needs_bigtiff(levels, "image_id")


# metadata text


@query("SELECT p_partkey, string_agg(r, ';' ORDER BY i) AS runs FROM (SELECT p_partkey, trim(r) AS r, i FROM (SELECT p_partkey, unnest(l) AS r, unnest(generate_series(1, len(l))) AS i FROM (SELECT p_partkey, regexp_extract_all(p_size || 'um x ' || (p_size + 1) || 'nm, ' || p_type, '[0-9.]+|[^0-9.]+') AS l FROM part))) WHERE r NOT IN (',', '|') GROUP BY p_partkey")
def split_num(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit("um x "), (F.col("p_size") + 1).cast("string"), F.lit("nm, "), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(metadata.split_numbers(text), ";").alias("runs"))


@query("SELECT p_partkey, p_size::DOUBLE AS value_x, 'um' AS unit_x, (p_size * 2)::DOUBLE AS value_y, CASE WHEN p_size % 2 = 0 THEN 'nm' ELSE 'um' END AS unit_y FROM part")
def value_unit(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit("um "), (F.col("p_size") * 2).cast("string"), F.when(F.col("p_size") % 2 == 0, "nm").otherwise(""))
    values = metadata.values_with_units(text)
    return table(spark, sf_dir, "part").select("p_partkey", *[values[k][f].alias(f"{f}_{a}") for k, a in enumerate("xy") for f in ("value", "unit")])


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS app_mag, CASE WHEN p_name = '' THEN 'false' ELSE 'true' END AS name, NULL::VARCHAR AS missing FROM part")
def desc_map(spark, sf_dir):
    text = F.concat(F.lit("AppMag = "), F.col("p_size").cast("string"), F.lit("|Name: "), F.col("p_name"), F.lit("|nothing here"))
    m = metadata.description_map(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(m, F.lit("AppMag")).alias("app_mag"), F.try_element_at(m, F.lit("Name")).alias("name"), F.try_element_at(m, F.lit("nothing here")).alias("missing"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, p_brand AS brand FROM part")
def desc_literal(spark, sf_dir):
    text = F.concat(F.lit("{'Size': "), F.col("p_size").cast("string"), F.lit(", 'Brand': '"), F.col("p_brand"), F.lit("'}"))
    m = metadata.description_map(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(m, F.lit("Size")).alias("size"), F.try_element_at(m, F.lit("Brand")).alias("brand"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END AS n, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END, 'none') AS brand, CASE WHEN p_size > 10 THEN p_size::DOUBLE WHEN p_size % 2 = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS pixel_size FROM part")
def defaults(spark, sf_dir):
    brand = F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))
    chosen = units.chosen_pixel_size(F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).otherwise(-1.0), F.when(F.col("p_size") % 2 == 1, 0.5))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(metadata.ensure_list(brand)).alias("n"), metadata.default(brand, "none").alias("brand"), chosen.alias("pixel_size"))


@query("SELECT p_partkey, p_brand AS \"ImageWidth\", p_type AS \"65000\" FROM part")
def tag_names(spark, sf_dir):
    m = metadata.tag_names(F.create_map(F.lit(256), F.col("p_brand"), F.lit(65000), F.col("p_type")), {256: "ImageWidth", 257: "ImageLength"})
    return table(spark, sf_dir, "part").select("p_partkey", m["ImageWidth"].alias("ImageWidth"), m["65000"].alias("65000"))


@query("SELECT page_id, regexp_extract(url, '[^/]+$') LIKE '%.%' OR regexp_matches(url, '\\.zarr/?$') AS image FROM pages")
def image_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", metadata.is_image_path(F.col("url")).alias("image"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '[^/]+$'), '\\.[^.]*$', ''), '[.ome]+$', '') AS title, regexp_replace(regexp_replace(regexp_extract(url || '/home.ome.tiff', '[^/]+$'), '\\.[^.]*$', ''), '\\.ome$', '') AS strict, lower(regexp_extract(url, '\\.[^./]+$')) AS extension FROM pages")
def filetitle(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", metadata.file_title(url).alias("title"), metadata.file_title(F.concat(url, F.lit("/home.ome.tiff")), strict=True).alias("strict"), metadata.extension(url).alias("extension"))


@query("SELECT event_id, props->>'$.k' AS k, coalesce(props->>'$.a.b', 'none') AS missing FROM events")
def props_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", metadata.nested(F.col("props"), "k").alias("k"), metadata.nested(F.col("props"), "a.b", "none").alias("missing"))


@query("""SELECT event_id, strftime(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS acquired, upper(event_type) AS model, 's' AS dwell_unit FROM events""")
def map_metadata(spark, sf_dir):
    doc = F.to_json(F.struct(F.struct((F.col("event_id") + 1700000000).cast("string").alias("DateTime")).alias("Start"), F.struct(F.col("event_type").alias("Model")).alias("Instrument")))
    wanted = [("Start.DateTime", "acquired", None, "datetime"), ("Instrument.Model", "model", None, "upper"), ("Scan.DwellTimeUnit", "dwell_unit", "s")]
    return table(spark, sf_dir, "events").select("event_id", doc.alias("doc")).select("event_id", *metadata.map_metadata(F.col("doc"), wanted))


@query(
    """SELECT event_id, CAST(event_id AS VARCHAR) AS instrument_microscope_serialnumber, event_type AS instrument_microscope_model, CAST(NULL AS VARCHAR) AS instrument_microscope_manufacturer,
    event_type AS instrument_detector_model, CAST(event_id % 7 AS VARCHAR) AS instrument_detector_gain, CAST(NULL AS VARCHAR) AS instrument_detector_offset,
    strftime(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS image_acquisitiondate,
    CAST(event_id % 5 AS VARCHAR) AS image_pixels_physicalsizex, CAST(event_id % 3 AS VARCHAR) AS image_pixels_physicalsizey, CAST(NULL AS VARCHAR) AS image_pixels_physicalsizexunit, CAST(NULL AS VARCHAR) AS image_pixels_physicalsizeyunit,
    CAST(NULL AS VARCHAR) AS image_pixels_plane_exposuretime, 's' AS image_pixels_plane_exposuretimeunit,
    CAST(event_id % 11 AS VARCHAR) AS image_pixels_plane_positionx, CAST(event_id % 13 AS VARCHAR) AS image_pixels_plane_positiony, CAST(NULL AS VARCHAR) AS image_pixels_plane_positionz,
    CASE WHEN event_id % 2 = 0 THEN 'um' ELSE 'm' END AS image_pixels_plane_positionxunit, CASE WHEN event_id % 2 = 0 THEN 'um' ELSE 'm' END AS image_pixels_plane_positionyunit, CASE WHEN event_id % 2 = 0 THEN 'um' ELSE 'm' END AS image_pixels_plane_positionzunit
    FROM events"""
)
def microscope_metadata(spark, sf_dir):
    rows, at = table(spark, sf_dir, "events"), F.col("event_id")
    named = lambda **fields: F.struct(*[c.alias(k) for k, c in fields.items()])
    doc = named(
        Instrument=named(InstrumentId=at.cast("string"), InstrumentModel=F.col("event_type")),
        DetectorMetadata=named(DetectorName=F.col("event_type"), Gain=at % 7),
        Acquisition=named(AcquisitionStartDatetime=named(DateTime=(at + 1700000000).cast("string"))),
        BinaryResult=named(PixelSize=named(height=at % 5, width=at % 3)),
        Stage=named(Position=named(x=at % 11, y=at % 13), PositionUnit=F.when(at % 2 == 0, "um")),
    )
    found = rows.select("event_id", *metadata.microscope_metadata(F.to_json(doc)))
    return found.toDF(*[c.replace(".@", ".").replace(".", "_").lower() for c in found.columns])


@query("SELECT p_partkey, p_size || 'µm' AS fixed, 'µm' AS unit FROM part")
def fix_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", metadata.fix_micro(F.concat(F.col("p_size").cast("string"), F.lit("Âµm"))).alias("fixed"), metadata.fix_micro(F.lit("micron")).alias("unit"))


# collections


def _images(spark, sf_dir):
    """Regions as projects, nations as datasets, customers as images."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("project_id"), F.col("n_nationkey").alias("dataset_id"), F.col("c_custkey").alias("image_id"), F.col("c_name").alias("name"))


@query("SELECT c_custkey AS image_id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (n_regionkey = 1 OR n_nationkey IN (3, 4, 7) OR c_custkey IN (5, 6)) AND NOT (n_nationkey IN (2, 4) OR c_custkey IN (6, 9)) AND regexp_matches(c_name, 'R#.*[0-4]$', 'i') AND NOT regexp_matches(c_name, '11', 'i')")
def collection_select(spark, sf_dir):
    rows = collection.select_images(_images(spark, sf_dir), {"project": [1], "dataset": [3, 4, 7], "image": [5, 6]}, {"dataset": [2, 4], "image": [6, 9]}, ["r#.*[0-4]$"], ["11"])
    return rows.select("image_id", "name")


@query("SELECT c_custkey AS image_id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def collection_tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = collection.select_by_tables(_images(spark, sf_dir), orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("image_id")), orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("image_id")))
    return rows.select("image_id", "name")


_LABELS = "SELECT conv_id AS image_id, arg_max(CASE WHEN lower(role) = 'user' THEN text END, CASE WHEN lower(role) = 'user' THEN turn END) AS \"User\", arg_max(CASE WHEN lower(role) = 'assistant' THEN text END, CASE WHEN lower(role) = 'assistant' THEN turn END) AS \"Assistant\" FROM conversations GROUP BY 1"


def _annotations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), F.col("role").alias("name"), F.col("text").alias("value"), "turn")


@query(_LABELS)
def labels_pivot(spark, sf_dir):
    return collection.labels_wide(_annotations(spark, sf_dir), ["User", "Assistant"], "turn")


@query("WITH w AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1) SELECT label, count(*) AS n FROM w WHERE label IS NOT NULL GROUP BY 1")
def label_counts(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("label"))
    return collection.label_counts(last, "label")


@query(f'SELECT c_custkey AS image_id, c_name AS name, "User", "Assistant", c_name || \'.tiff\' AS path FROM customer JOIN ({_LABELS}) w ON w.image_id = c_custkey WHERE "User" IS NOT NULL OR "Assistant" IS NOT NULL')
def label_table(spark, sf_dir):
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_name").alias("name"))
    return collection.label_table(images, _annotations(spark, sf_dir), ["User", "Assistant"], "turn", "tiff")


@query("SELECT conv_id AS image_id, role AS type, count(*) AS n, string_agg(turn || '=' || length(text), ';' ORDER BY turn) AS items FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2")
def annotations_grouped(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("image_id"), "role", F.col("turn").cast("string").alias("name"), F.length("text").cast("string").alias("value"), "turn")
    found = collection.annotations_by_type(rows, "role", "turn")
    return found.select("image_id", "type", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda s: F.concat_ws("=", s["name"], s["value"])), ";").alias("items"))


@query("SELECT n_regionkey, arg_min(n_nationkey, n_name) AS n_nationkey, min(n_name) AS n_name FROM nation GROUP BY 1")
def first_of_group(spark, sf_dir):
    return collection.first_of(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"], "n_name")


@query("""WITH r AS (SELECT lower(n_name) AS t, n_nationkey, n_regionkey, row_number() OVER (PARTITION BY lower(n_name) ORDER BY n_nationkey) AS k FROM nation)
SELECT c_custkey AS image_id, title, r.n_nationkey AS ord, r.n_regionkey AS project FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE upper(n_name) END AS title FROM customer JOIN nation ON c_nationkey = n_nationkey) LEFT JOIN r ON lower(title) = t AND k = 1""")
def external_metadata(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    images = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("image_id"), F.when(F.col("c_custkey") % 5 == 0, "none").otherwise(F.upper("n_name")).alias("title"))
    return collection.external_metadata(images, n.select(F.col("n_name").alias("title"), F.col("n_nationkey").alias("ord"), F.col("n_regionkey").alias("project")))


_LAYOUT = "SELECT s_suppkey AS tile, CAST(s_suppkey % 9 AS BIGINT) AS sx, CAST(s_suppkey // 9 AS BIGINT) AS sy FROM supplier"


def _layout(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("tile"), (k % 9).alias("sx"), F.floor(k / 9).alias("sy"))


@query(f"WITH t AS ({_LAYOUT}), e AS (SELECT min(sx) AS x0, max(sx) AS x1, min(sy) AS y0, max(sy) AS y1 FROM t) SELECT tile, sx, sy FROM t, e WHERE sx > x0 AND sx < x1 AND sy > y0 AND sy < y1")
def layout_edges(spark, sf_dir):
    return measure.layout_edges(_layout(spark, sf_dir))


@query("SELECT p_name AS file, n_name AS title FROM (SELECT DISTINCT lower(p_type) || '_' || lower(p_brand) AS p_name FROM part), (SELECT DISTINCT lower(p_brand) AS n_name FROM part) WHERE strpos(p_name, n_name) > 0")
def layout_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    files = part.select(F.concat(F.lower("p_type"), F.lit("_"), F.lower("p_brand")).alias("file")).distinct()
    return collection.match_layout(files, part.select(F.lower("p_brand").alias("title")).distinct())


@query(f"WITH t AS ({_LAYOUT}) SELECT tile, sx * 0.65::DOUBLE AS x_um, sy * 0.65::DOUBLE AS y_um FROM t")
def stage_translation(spark, sf_dir):
    return collection.stage_positions(_layout(spark, sf_dir), {"x": 0.65, "y": 0.65}).select("tile", "x_um", "y_um")


_POINTS = "SELECT p_partkey AS id, (p_partkey * 7919 % 1009)::DOUBLE AS x, (p_partkey * 104729 % 997)::DOUBLE AS y, p_size::DOUBLE AS r FROM part"


def _points(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (k * 7919 % 1009).cast("double").alias("x"), (k * 104729 % 997).cast("double").alias("y"), F.col("p_size").cast("double").alias("r"))


@query(f"WITH p AS ({_POINTS}) SELECT id, x, y, r, round(sqrt(x * x + y * y), 9) AS norm FROM p")
def sort_by_norm(spark, sf_dir):
    return _rounded(collection.by_norm(_points(spark, sf_dir), "x", "y"), "norm", digits=9)


@query(f"WITH p AS ({_POINTS}) SELECT a.id AS a, b.id AS b FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) > 0 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 625 AND b.r < a.r")
def neighbours(spark, sf_dir):
    return collection.neighbours(_points(spark, sf_dir), 25.0)


@query(f"WITH p AS ({_POINTS}) SELECT CAST(floor(y / 128) AS BIGINT) AS ty, CAST(floor(x / 128) AS BIGINT) AS tx, count(*) AS n, max(r) AS r FROM p GROUP BY 1, 2")
def points_in_tile(spark, sf_dir):
    return collection.points_in_tiles(_points(spark, sf_dir), 128.0).groupBy("ty", "tx").agg(F.count("*").alias("n"), F.max("r").alias("r"))


@query("SELECT CAST(0 AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(c AS BIGINT) AS c, CAST(trunc(CASE c WHEN 0 THEN sin(pi() * x / 96) ELSE sin(pi() * y / 64) END * 255 + 1e-9) AS INTEGER) AS v FROM generate_series(0, 63) a(y), generate_series(0, 95) b(x), generate_series(0, 2) d(c)")
def generator_grid(spark, sf_dir):
    from ..sources import generator

    return generator.generate(spark, {"x": 96, "y": 64}, "uint8", noise=0.0)
