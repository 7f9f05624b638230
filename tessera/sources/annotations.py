"""Image metadata: as XML with channels, sizes, units, planes and identifiers, without nulls; and what a file says of itself."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping

from ..functions import metadata

NAMESPACE = "http://www.openmicroscopy.org/Schemas/OME/2016-06"


def ensure_id(tree: dict, path: str, prefix: str) -> dict:
    """@ID on each element at a dotted path."""
    *above, last = path.split(".")
    at = tree
    for name in above:
        at = at.get(name, {})
    items = at.get(last)
    for k, item in enumerate(items if isinstance(items, list) else [items] if items else []):
        item.setdefault("@ID", f"{prefix}:{k}")
    return tree


def image_xml(name: str, sizes: dict[str, int], dtype: str, channels: list[dict], pixel_size: dict[str, tuple[float, str]], extra: dict | None = None, combine_rgb: bool = True, creator: str = "tessera") -> str:
    """One image. Three samples become one channel of three where combine_rgb; fewer records than samples repeat."""
    n = sizes.get("c", 1)
    if n == 3 and combine_rgb:
        records, samples = channels[:1] or [{}], 3
    else:
        records, samples = (channels + [channels[-1] if channels else {}] * n)[:n], 1
    pixels = {"@DimensionOrder": "XYCZT", "@Type": "float" if dtype == "float32" else "double" if dtype == "float64" else dtype, "Channel": [{"@Name": c.get("label"), "@SamplesPerPixel": samples, "@Color": c.get("color")} for c in records]}
    pixels |= {f"@Size{a.upper()}": sizes.get(a, 1) for a in "xyzct"}
    for a, (value, unit) in pixel_size.items():
        pixels |= {f"@PhysicalSize{a.upper()}": value, f"@PhysicalSize{a.upper()}Unit": unit}
    tree = {"OME": {"@xmlns": NAMESPACE, "@UUID": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", "@Creator": creator, "Image": {"@Name": name, "Pixels": pixels}} | (extra or {})}
    ensure_id(tree, "OME.Image", "Image")
    ensure_id(tree, "OME.Image.Pixels", "Pixels")
    ensure_id(tree, "OME.Image.Pixels.Channel", "Channel:0")
    return metadata.to_xml({"OME": {k: v for k, v in tree["OME"].items() if v is not None}})


def pixel_sizes(tree: dict) -> list[tuple[float, str]]:
    """Physical sizes along x, y and z out of parsed XML, as far as there are any; the unit is µm where it is missing."""
    pixels = metadata.lookup(tree, "OME.Image.Pixels", {})
    return [(float(v), metadata.lookup(pixels, f"PhysicalSize{a}Unit", "µm")) for a in "XYZ" if (v := metadata.lookup(pixels, f"PhysicalSize{a}"))]


def channel_records(tree: dict) -> list[dict]:
    found = metadata.lookup(tree, "OME.Image.Pixels.Channel", [])
    out = []
    for k, c in enumerate(found if isinstance(found, list) else [found]):
        samples = int(metadata.lookup(c, "SamplesPerPixel", 1))
        out.append({"label": metadata.lookup(c, "Name", "" if samples == 3 else str(k)), "samples": samples})
    return out


#: Names of photometric interpretations by their codes in TIFF.
PHOTOMETRIC = {0: "MINISWHITE", 1: "MINISBLACK", 2: "RGB", 3: "PALETTE", 6: "YCBCR", 8: "CIELAB"}


def ome_tree(description: str | None) -> dict | None:
    text = (description or "").strip()
    if not text.startswith("<") or "<OME" not in text[:4000]:
        return None
    try:
        return metadata.from_xml(text)
    except Exception:  # a description that only looks like XML
        return None


def _first(found):
    return found[0] if isinstance(found, list) else found


def pixels_tree(tree: dict, title: str | None = None) -> dict:
    """The Pixels of the image with that name (in either case), else of the first one."""
    images = metadata.lookup(tree, "OME.Image", {})
    images = images if isinstance(images, list) else [images]
    named = [i for i in images if title and str(metadata.lookup(i, "Name", "")).lower() == title.lower()]
    return metadata.lookup((named or images)[0], "Pixels", {})


def plane_sizes(page) -> tuple[dict[str, int], str]:
    """Sizes along c (in planes), z and t and the order of axes, from the description; empty where it doesn't say."""
    if tree := ome_tree(page.get("description")):
        found = pixels_tree(tree)
        sizes = {a: int(metadata.lookup(found, f"Size{a.upper()}", 1)) for a in "czt"}
        if page.get("planar", 1) != 2:
            sizes["c"] = max(1, sizes["c"] // page.get("samples", 1))
        return sizes, str(metadata.lookup(found, "DimensionOrder", "XYCZT"))
    words = key_values(page.get("description"))
    if "ImageJ" in (page.get("description") or ""):
        return {a: int(words.get(k, 1)) for a, k in (("c", "channels"), ("z", "slices"), ("t", "frames"))}, "XYCZT"
    return {}, ""


def key_values(text: str | None) -> dict[str, str]:
    """"k=v" and "k: v" of a description, by lower-case key."""
    out = {}
    for part in (text or "").replace("\r", "\n").replace("|", "\n").split("\n"):
        key, sep, value = part.partition("=" if "=" in part else ":")
        if sep:
            out[key.strip().lower()] = value.strip()
    return out


def rotation_of(tree: dict) -> float | None:
    """Degrees, from the modulo annotation along z."""
    found = metadata.lookup(pixels_tree(tree), "Modulo.ModuloAlongZ") or metadata.lookup(tree, "OME.StructuredAnnotations.XMLAnnotation.Value.Modulo.ModuloAlongZ")
    if not found or metadata.lookup(found, "Label") is None:
        return None
    value = float(str(_first(metadata.lookup(found, "Label"))).split()[0])
    return math.degrees(value) if str(metadata.lookup(found, "Unit", "")).lower().startswith("rad") else value


def file_metadata(page, tree: dict | None = None, title: str | None = None) -> dict:
    """pixel_size and position ((value, unit) by axis), channels and rotation of the first page of a TIFF file. The order of
    what counts: the XML in the file or given with it, ImageJ's keys, numbers in the description, resolution tags."""
    tree, words = tree or ome_tree(page.get("description")), key_values(page.get("description"))
    size, position, channels, rotation = {}, {}, [], None
    if tree:
        found = pixels_tree(tree, title)
        size = {a: (float(v), metadata.lookup(found, f"PhysicalSize{a.upper()}Unit", "µm")) for a in "xyz" if (v := metadata.lookup(found, f"PhysicalSize{a.upper()}"))}
        plane = _first(metadata.lookup(found, "Plane", {})) or {}
        position = {a: (float(v), metadata.lookup(plane, f"Position{a.upper()}Unit", "µm")) for a in "xyz" if (v := metadata.lookup(plane, f"Position{a.upper()}"))}
        channels, rotation = channel_records({"OME": {"Image": {"Pixels": found}}}), rotation_of(tree)
    resolution = [r[1] / r[0] for k in ("x_resolution", "y_resolution") if (r := page.get(k)) and r[0]]
    if not size and "ImageJ" in (page.get("description") or ""):
        unit = words.get("unit", "").encode().decode("unicode_escape", "replace").replace("micron", "µm")
        size = {a: (r, unit) for a, r in zip("xy", resolution, strict=False)} | ({"z": (float(words["spacing"]), unit)} if "spacing" in words else {})
    for keys in (("pixelwidth", "pixelheight"), ("mpp", "mpp")):
        if not size and all(k in words for k in keys):
            size = {a: (float(words[k].split()[0]), "µm") for a, k in zip("xy", keys, strict=True)}
    unit = {1: "", 2: "inch", 3: "cm"}.get(page.get("resolution_unit", 2), "")
    if not size:
        size = {a: (r, unit) for a, r in zip("xy", resolution, strict=False)}
    if not position:
        position = {a: (r[0] / r[1], unit) for a in "xy" if (r := page.get(f"{a}_position")) and r[1]}
    if not channels:
        label = PHOTOMETRIC.get(page.get("photometric", 1), "")
        channels = [{"label": label if page.get("samples", 1) != 3 else "", "samples": page.get("samples", 1)}]
    return {"pixel_size": size, "position": position, "channels": channels, "rotation": rotation}


def mapped_xml(tree: Mapping, sizes: dict[str, int], dtype: str, combine_rgb: bool = True) -> str:
    """Metadata that was mapped from other records (OME.Image... as dotted keys or nested), completed: sizes and type of the
    data, a channel record for each channel, identifiers, planes with their indices."""
    nested = metadata.unpacked(tree) if any("." in k for k in tree) else dict(tree)
    image = nested.setdefault("OME", {}).setdefault("Image", {})
    pixels = image.setdefault("Pixels", {})
    base = metadata.from_xml(image_xml(str(metadata.lookup(image, "Name", "image")), sizes, dtype, pixels.get("Channel") if isinstance(pixels.get("Channel"), list) else [pixels["Channel"]] if pixels.get("Channel") else [], {}, combine_rgb=combine_rgb))
    for k, v in base["OME"]["Image"]["Pixels"].items():
        if k == "Channel":
            given = pixels.get("Channel") or []
            given = given if isinstance(given, list) else [given]
            own = v if isinstance(v, list) else [v]
            pixels["Channel"] = [c | (given[j] if j < len(given) else {}) for j, c in enumerate(own)]
        else:
            pixels.setdefault(k, v)
    found = pixels.get("Plane")
    for plane in found if isinstance(found, list) else [found] if found else []:
        for a in "ZTC":
            plane.setdefault(f"@The{a}", 0)
    nested["OME"] = {"@xmlns": NAMESPACE, **{k: v for k, v in base["OME"].items() if k in ("@UUID", "@Creator")}, **nested["OME"]}
    image.setdefault("@ID", "Image:0")
    pixels.setdefault("@ID", "Pixels:0")
    return metadata.to_xml(metadata.without_nulls({"OME": nested["OME"]}))


def _attributes(record: Mapping, *lists: str) -> dict:
    """A record's values as XML attributes; a pair is a value and its unit. Nulls, and names that say unknown, stay out."""
    out = {}
    for k, v in record.items():
        if k in lists:
            continue
        value, unit = v if isinstance(v, tuple) else (v, None)
        if value is not None and not (isinstance(value, str) and value.lower() in ("", "unknown")):
            out |= {f"@{k}": value} | ({f"@{k}Unit": unit} if unit else {})
    return out


def _note(k: int, note: Mapping) -> dict:
    value = note["value"]
    if isinstance(value, list | Mapping):
        value = {"M": [{"@K": a, "#text": str(b)} for a, b in (value.items() if isinstance(value, Mapping) else value)]}
    return {"@ID": f"Annotation:{k}", "@Namespace": note.get("namespace"), "Value": value}


def record_xml(name: str, sizes: dict[str, int], dtype: str, record: Mapping, pixel_size: dict[str, tuple[float, str]] | None = None, levels: list[tuple[int, int]] = (), combine_rgb: bool = True) -> str:
    """XML of an image from what an image server keeps of it. record: objective, stage and channels and planes (dictionaries
    by the schema's attribute names, a value with a unit as a pair), acquired, description, and annotations (type, namespace,
    value; pairs become a map). levels: sizes of smaller levels, noted first among the map annotations."""
    image: dict = {"@ID": "Image:0", "@Name": name, "AcquisitionDate": record.get("acquired"), "Description": record.get("description")}
    tree: dict = {}
    if (objective := record.get("objective")) is not None:
        tree["Instrument"] = {"@ID": "Instrument:0", "Objective": {"@ID": "Objective:0"} | _attributes(objective)}
        image |= {"InstrumentRef": {"@ID": "Instrument:0"}, "ObjectiveSettings": {"@ID": "Objective:0"}}
    stage = record.get("stage")
    if stage is not None:
        image["StageLabel"] = {"@Name": stage.get("Name")}
    merged = sizes.get("c", 1) == 3 and combine_rgb
    channels = [_attributes({k: v for k, v in c.items() if not (merged and k in ("Color", "SamplesPerPixel"))}) for c in record.get("channels", ())]
    pixels: dict = {"@ID": "Pixels:0"}
    for a, (value, unit) in (pixel_size or {}).items():
        if value:
            pixels |= {f"@PhysicalSize{a.upper()}": value} | ({f"@PhysicalSize{a.upper()}Unit": unit} if unit else {})
    if channels:
        pixels["Channel"] = channels
    if planes := record.get("planes"):
        place = {k: v for k, v in (stage or {}).items() if k.startswith("Position")}
        pixels["Plane"] = [_attributes(place | dict(p)) for p in planes]
    image["Pixels"] = pixels
    tree["Image"] = image
    notes: dict[str, list] = {}
    for note in record.get("annotations", ()):
        of = notes.setdefault(note["type"], [])
        of.append(_note(len(of), note))
    if levels:
        sizes_of = {"@ID": "Annotation:Resolution:0", "@Namespace": "openmicroscopy.org/PyramidResolution", "Value": {"M": [{"@K": k, "#text": " ".join(map(str, size))} for k, size in enumerate(levels, 1)]}}
        notes["MapAnnotation"] = [sizes_of, *notes.get("MapAnnotation", [])]
    if notes:
        tree["StructuredAnnotations"] = notes
    return mapped_xml({"OME": tree}, sizes, dtype, combine_rgb)
