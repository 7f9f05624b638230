"""Metadata text: numbers and units in strings, descriptions, paths, mappings, XML and JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_numbers(text: Column) -> Column:
    """Runs of digits and points in turn with runs of other text, stripped, without lone commas and bars."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("([0-9.]+|[^0-9.]+)"), F.lit(1)), lambda r: F.trim(r))
    return F.filter(runs, lambda r: ~r.isin(",", "|"))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9.]+)"), F.lit(1)), lambda r: r.try_cast("double"))


def values_with_units(text: Column) -> Column:
    """array<struct<value, unit>>; a value without a unit takes the last one of the text, else ''."""
    pattern = F.lit(r"([0-9.]+)\s*([A-Za-zµ]*)")
    values = F.regexp_extract_all(text, pattern, F.lit(1))
    units = F.regexp_extract_all(text, pattern, F.lit(2))
    named = F.filter(units, lambda u: u != "")
    last = F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(""))
    return F.zip_with(values, units, lambda v, u: F.struct(v.try_cast("double").alias("value"), F.when(u == "", last).otherwise(u).alias("unit")))


def description_map(text: Column) -> Column:
    """map<string,string> of "k: v" and "k=v" between line ends, tabs and bars; a colon goes before an equals sign. Values
    that aren't numbers become booleans: true for any text, false for none. A text in braces is a literal dictionary, whose
    values stay as they are."""
    parts = F.filter(F.split(text, r"[\r\n\t|]"), lambda p: p.contains(":") | p.contains("="))
    split = lambda p: F.when(p.contains(":"), F.split(p, ":")).otherwise(F.split(p, "="))

    def value(raw: Column) -> Column:
        v = F.trim(raw)
        whole = v.rlike(r"^[+-]?[0-9]+$")
        real = v.try_cast("double")
        return F.when(whole, v.try_cast("long").cast("string")).when(real.isNotNull(), real.cast("string")).otherwise((v != "").cast("string"))

    pairs = F.transform(parts, lambda p: F.struct(F.trim(split(p)[0]).alias("key"), value(split(p)[1]).alias("value")))
    # the last of equal keys wins
    latest = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda a, p: F.concat(F.filter(a, lambda q: q["key"] != p["key"]), F.array(p)))
    literal = F.from_json(F.translate(text, "'", '"'), "map<string,string>", {"mode": "PERMISSIVE"})
    return F.when(F.ltrim(text).startswith("{"), literal).otherwise(F.map_from_entries(latest))


def file_title(path: Column, strict: bool = False) -> Column:
    """Base name without its last extension, then without trailing characters of ".ome"; strict: only without the suffix."""
    base = F.regexp_replace(F.regexp_extract(path, r"[^/\\]+$", 0), r"\.[^.]*$", "")
    return F.regexp_replace(base, r"\.ome$" if strict else "[.ome]+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def nested(column: Column, path: str, default: str | None = None) -> Column:
    """A dotted path in JSON text."""
    value = F.get_json_object(column, "$." + path)
    return value if default is None else F.coalesce(value, F.lit(default))


#: What a mapping may do to a value.
REFORMATS = {
    "datetime": lambda c: F.date_format(F.timestamp_seconds(c.try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss"),
    "upper": F.upper,
    "lower": F.lower,
    "double": lambda c: c.try_cast("double").cast("string"),
}


def map_metadata(column: Column, mappings: Iterable[tuple]) -> list[Column]:
    """One column for each (source path, name[, default[, reformat]])."""
    out = []
    for source, name, *rest in mappings:
        default, reformat = (*rest, None, None)[:2]
        value = nested(column, source, default)
        out.append((REFORMATS[reformat](value) if reformat else value).alias(name))
    return out


#: Which field of an electron microscope's JSON gives which attribute of image XML, with units it leaves out.
MICROSCOPE = [
    ("Instrument.InstrumentId", "Instrument.Microscope.@SerialNumber"),
    ("Instrument.InstrumentModel", "Instrument.Microscope.@Model"),
    ("Instrument.Manufacturer", "Instrument.Microscope.@Manufacturer"),
    ("DetectorMetadata.DetectorName", "Instrument.Detector.@Model"),
    ("DetectorMetadata.Gain", "Instrument.Detector.@Gain"),
    ("DetectorMetadata.Offset", "Instrument.Detector.@Offset"),
    ("Acquisition.AcquisitionStartDatetime.DateTime", "Image.AcquisitionDate", None, "datetime"),
    ("BinaryResult.PixelSize.height", "Image.Pixels.@PhysicalSizeX"),
    ("BinaryResult.PixelSize.width", "Image.Pixels.@PhysicalSizeY"),
    ("BinaryResult.PixelUnitX", "Image.Pixels.@PhysicalSizeXUnit"),
    ("BinaryResult.PixelUnitY", "Image.Pixels.@PhysicalSizeYUnit"),
    ("Scan.DwellTime", "Image.Pixels.Plane.@ExposureTime"),
    ("Scan.DwellTimeUnit", "Image.Pixels.Plane.@ExposureTimeUnit", "s"),
    ("Stage.Position.x", "Image.Pixels.Plane.@PositionX"),
    ("Stage.Position.y", "Image.Pixels.Plane.@PositionY"),
    ("Stage.Position.z", "Image.Pixels.Plane.@PositionZ"),
    ("Stage.PositionUnit", "Image.Pixels.Plane.@PositionXUnit", "m"),
    ("Stage.PositionUnit", "Image.Pixels.Plane.@PositionYUnit", "m"),
    ("Stage.PositionUnit", "Image.Pixels.Plane.@PositionZUnit", "m"),
]


def microscope_metadata(column: Column) -> list[Column]:
    """The JSON text of an electron microscope as one column for each attribute of image XML, named by its dotted path."""
    return map_metadata(column, MICROSCOPE)


def attribute(m: Column, key: str) -> Column:
    """A key of a map of XML values, with or without the attribute sign."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.try_element_at(m, F.lit(f"@{key}")))


def fix_micro(text: Column) -> Column:
    """Mis-encoded micro signs."""
    return F.regexp_replace(F.regexp_replace(text, "Âµ|\\\\u00b5|&#181;", "µ"), "^micron$", "µm")


def ensure_list(value: Column) -> Column:
    """An array of one element, or of none for null."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def default(value: Column, other) -> Column:
    return F.coalesce(value, other if isinstance(other, Column) else F.lit(other))


def tag_names(tags: Column, names: Mapping[int, str]) -> Column:
    """map<int,string> by number to one by name; tags without a name keep their number."""
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(int(k)), F.lit(v))])
    return F.transform_keys(tags, lambda k, _: F.coalesce(F.try_element_at(table, k), k.cast("string")))


def is_image_path(path: Column) -> Column:
    """A file, or a folder whose name says that it is a chunked array."""
    return F.regexp_extract(path, r"[^/]+$", 0).contains(".") | path.rlike(r"\.zarr/?$")


def compact(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


# on the driver


def unpacked(pairs: Mapping[str, object]) -> dict:
    """A nested dictionary of dotted keys."""
    out: dict = {}
    for key, value in pairs.items():
        *above, last = key.split(".")
        at = out
        for name in above:
            at = at.setdefault(name, {})
        at[last] = value
    return out


def without_nulls(tree):
    """Nulls dropped, lists of one element replaced by it."""
    if isinstance(tree, dict):
        return {k: without_nulls(v) for k, v in tree.items() if v is not None}
    if isinstance(tree, list):
        return without_nulls(tree[0]) if len(tree) == 1 else [without_nulls(v) for v in tree if v is not None]
    return tree


def lookup(tree: Mapping, path: str, default=None):
    for name in path.split("."):
        if not isinstance(tree, Mapping) or (name not in tree and f"@{name}" not in tree):
            return default
        tree = tree[name] if name in tree else tree[f"@{name}"]
    return tree


def outline(tree, indent: int = 0) -> str:
    """An indented listing."""
    if not isinstance(tree, Mapping):
        return f"{'  ' * indent}{tree}\n"
    return "".join(f"{'  ' * indent}{k}:\n{outline(v, indent + 1)}" if isinstance(v, Mapping) else f"{'  ' * indent}{k}: {v}\n" for k, v in tree.items())


def from_xml(text: str) -> dict:
    """Elements as dictionaries, attributes with @, repeated elements as lists, text of mixed elements under #text."""

    def walk(e: ElementTree.Element):
        out: dict = {f"@{k}": v for k, v in e.attrib.items()}
        for child in e:
            name, value = child.tag.rpartition("}")[2], walk(child)
            out[name] = value if name not in out else [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
        body = (e.text or "").strip()
        if not out:
            return body or None
        if body:
            out["#text"] = body
        return out

    root = ElementTree.fromstring(text)
    return {root.tag.rpartition("}")[2]: walk(root)}


def to_xml(tree: Mapping) -> str:
    def build(name: str, value) -> list[ElementTree.Element]:
        out = []
        for v in value if isinstance(value, list) else [value]:
            e = ElementTree.Element(name)
            if isinstance(v, Mapping):
                for k, x in v.items():
                    if x is None:
                        continue
                    if k.startswith("@"):
                        e.set(k[1:], str(x))
                    elif k == "#text":
                        e.text = str(x)
                    else:
                        e.extend(build(k, x))
            elif v is not None:
                e.text = str(v)
            out.append(e)
        return out

    (name, value), *more = tree.items()
    if more:
        raise ValueError("an XML document has one root")
    return ElementTree.tostring(build(name, value)[0], encoding="unicode")


def read_tree(path: str) -> dict:
    """A metadata file by its extension: XML, JSON, or YAML where its library is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.lower().endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"no YAML reader for {path} is installed") from e
        return yaml.safe_load(text)
    if path.lower().endswith(".xml"):
        return from_xml(text)
    if path.lower().endswith(".json"):
        return json.loads(text)
    raise ValueError(f"no reader for {path}")
