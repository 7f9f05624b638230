"""Scalar functions against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import color, metadata, pixels, units


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def each(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_types():
    assert pixels.type_max("uint8") == pixels.type_max("int8") == 255 and pixels.type_max("uint32") == 2**32 - 1
    assert pixels.unsigned_type("int16") == "uint16" and pixels.unsigned_type("float32") == "float32" and pixels.nbytes("uint16") == 2
    with pytest.raises(ValueError):
        pixels.type_max("float32")


def test_byte_round_trips(spark):
    f = lambda v: pixels.float_to_int(pixels.int_to_float(v, "uint8"), "uint8")
    assert each(spark, range(256), "int", f) == list(range(256))
    assert each(spark, range(-128, 128), "int", lambda v: pixels.to_unsigned(v, "int8")) == list(range(256))
    assert each(spark, range(256), "int", lambda v: pixels.convert_sign(pixels.convert_sign(v, "uint8", "int8"), "int8", "uint8")) == list(range(256))


def test_normalise(spark):
    assert each(spark, [-1.0, 0.0, 2.5, 5.0, 9.0], "double", lambda v: pixels.normalise(v, 0.0, 5.0)) == [0, 0, 0.5, 1, 1]
    assert each(spark, [1.0], "double", lambda v: pixels.normalise(v, 3.0, 3.0)) == [None]


def test_units(spark):
    rows = [(2.0, "nm", 0.002), (2.0, "µm", 2.0), (2.0, "mm", 2000.0), (2.0, "cm", 20000.0), (2.0, "m", 2e6), (2.0, "furlong", 2.0), (None, "nm", None), (2.0, None, 2.0)]
    df = spark.createDataFrame([r[:2] for r in rows], "v double, u string")
    assert [r[0] for r in df.select(units.micrometers(F.col("v"), F.col("u"))).collect()] == pytest.approx([r[2] for r in rows])
    assert each(spark, ["Nanometer", "micron", "millimetre", "CENTImeter", "inch"], "string", units.unit_name) == ["nm", "µm", "mm", "cm", "inch"]


def test_rounding(spark):
    values = [0.0, 1234.5678, -0.000123456789, 99999.96, 2.5, 1e-12]

    def plain(a, n=4):
        if a == 0:
            return a
        d = n - math.floor(math.log10(abs(a))) - 1
        return round(a, d)

    assert each(spark, values, "double", lambda v: units.round_significant(v, 4)) == pytest.approx([plain(v) for v in values], rel=1e-9)
    assert each(spark, [0.1234560000001, 0.12345678], "double", units.snap_significant) == pytest.approx([0.123456, 0.12345678])


def test_human_bytes(spark):
    values = [0.0, 1023.0, 1024.0, 1025.0, 1536.0, 1024.0**2, 1024.0**2 + 1, 5.5 * 1024**3, 3.0 * 1024**4]
    assert each(spark, values, "double", units.human_bytes) == ["0.0B", "1023.0B", "1024.0B", "1.0KB", "1.5KB", "1024.0KB", "1.0MB", "5.5GB", "3.0TB"]


def test_resolution_and_rational(spark):
    df = spark.createDataFrame([(0.5, "µm"), (2.0, "nm"), (1.0, "mm"), (0.0, "cm"), (4.0, "inch")], "s double, u string")
    value, name = units.resolution(F.col("s"), F.col("u"))
    assert [tuple(r) for r in df.select(value, name).collect()] == [(2.0, "micrometer"), (500.0, "micrometer"), (None, "millimeter"), (None, "centimeter"), (0.25, "inch")]
    assert one(spark, units.rational(F.lit(3.0), F.lit(3.0)), units.rational(F.lit(3.0), F.lit(2.0)), units.rational(F.lit(3.0), F.lit(0.0))) == (3.0, 1.5, None)


def test_rotation(spark):
    got = each(spark, ["Angle: 90 deg", "angle=1.5707963267948966 rad", "x angle -45 degree", "none"], "string", units.rotation)
    assert got[:3] == pytest.approx([90, 90, -45]) and got[3] is None


def test_levels(spark):
    assert one(spark, units.level_scale(F.lit(0.5), F.lit(0.25), "x"), units.level_scale(F.lit(0.5), F.lit(0.25), "z"), units.level_scale(F.lit(0.0), F.lit(1.0), "x"), units.level_translation(F.lit(10.0), F.lit(2.0), F.lit(0.5), "x")) == (2.0, 0.5, 1.0, 11.0)


def test_colors(spark):
    packed = [0, -1, 1, 0x7F102030, -0x01020304, 255]
    got = [r for r in each(spark, packed, "int", color.int_to_rgba)]
    for p, rgba in zip(packed, got, strict=True):
        b = (p & 0xFFFFFFFF).to_bytes(4, "big")
        assert rgba == pytest.approx([b[0] / 255, b[1] / 255, b[2] / 255, (b[3] or 255) / 255])
    assert each(spark, [p | 1 for p in packed], "int", lambda v: color.rgba_to_int(color.int_to_rgba(v))) == [p | 1 for p in packed]
    assert each(spark, ["#FF0080", "00ff7F"], "string", lambda v: color.rgba_to_hex(color.hex_to_rgba(v))) == ["FF0080", "00FF7F"]


def test_numbers_in_text(spark):
    assert each(spark, ["10um x 20.5nm", "1,2|3", "none", ""], "string", metadata.split_numbers) == [["10", "um x", "20.5", "nm"], ["1", "2", "3"], ["none"], []]
    assert each(spark, ["1.5.2 7"], "string", metadata.numbers) == [[None, 7.0]]
    got = each(spark, ["0.5um 2 nm", "1 2µm", "3 4", ""], "string", metadata.values_with_units)
    assert [[tuple(x) for x in r] for r in got] == [[(0.5, "um"), (2.0, "nm")], [(1.0, "µm"), (2.0, "µm")], [(3.0, ""), (4.0, "")], []]


def test_description(spark):
    text = "MPP = 0.5|AppMag: 20\nName=x y\tEmpty=|a: b=c\nMPP=7\nnothing"
    assert each(spark, [text], "string", metadata.description_map) == [{"MPP": "7", "AppMag": "20", "Name": "true", "Empty": "false", "a": "true"}]


def test_titles(spark):
    assert each(spark, ["/a/image.tif", "home.ome.tiff", "x/y.b.c", "plain"], "string", metadata.file_title) == ["imag", "h", "y.b", "plain"]
    assert each(spark, ["/a/image.tif", "home.ome.tiff"], "string", lambda v: metadata.file_title(v, strict=True)) == ["image", "home"]


def test_mapping(spark):
    doc = '{"a": {"b": "1700000000", "c": "x"}}'
    df = spark.createDataFrame([(doc,)], "d string")
    row = df.select(*metadata.map_metadata(F.col("d"), [("a.b", "when", None, "datetime"), ("a.c", "name", None, "upper"), ("a.z", "missing", "none")])).first()
    assert row.asDict() == {"when": "2023-11-14T22:13:20", "name": "X", "missing": "none"}
    m = F.create_map(F.lit("@k"), F.lit("v"))
    assert one(spark, metadata.attribute(m, "k"), metadata.attribute(m, "q"), metadata.fix_micro(F.lit("1Âµm")), metadata.fix_micro(F.lit("micron"))) == ("v", None, "1µm", "µm")


def test_trees(tmp_path):
    tree = metadata.unpacked({"a.b": 1, "a.c": None, "d": [2]})
    assert tree == {"a": {"b": 1, "c": None}, "d": [2]} and metadata.without_nulls(tree) == {"a": {"b": 1}, "d": 2}
    assert metadata.lookup(tree, "a.b") == 1 and metadata.lookup(tree, "a.b.c", 5) == 5 and metadata.lookup({"@x": 3}, "x") == 3
    xml = '<r a="1"><i>x</i><i>y</i><j k="2">t</j></r>'
    parsed = metadata.from_xml(xml)
    assert parsed == {"r": {"@a": "1", "i": ["x", "y"], "j": {"@k": "2", "#text": "t"}}} and metadata.from_xml(metadata.to_xml(parsed)) == parsed
    assert metadata.outline({"a": {"b": 1}}) == "a:\n  b: 1\n"
    (tmp_path / "m.json").write_text('{"a": 1}')
    (tmp_path / "m.xml").write_text(xml)
    assert metadata.read_tree(str(tmp_path / "m.json")) == {"a": 1} and metadata.read_tree(str(tmp_path / "m.xml")) == parsed
