"""Minimum bounding rectangles and their predicates. A rectangle is a struct of xmin, ymin, xmax, ymax."""

from __future__ import annotations

import math
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "xmin double, ymin double, xmax double, ymax double"
_NUMBER = r"[-+]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|nan|inf(?:inity)?)"
_KINDS = "POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION"
_SHAPE = re.compile(rf"\b(?:{_KINDS})\b\s*(?:ZM|Z|M)?\b", re.IGNORECASE)
_TUPLE = re.compile(rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER}){{0,2}}(?=\s*[,)])", re.IGNORECASE)
#: Limits of a binary geometry: points of a line or ring, rings of a polygon, members of a collection. Fixed values.
MOST_POINTS, MOST_RINGS, MOST_MEMBERS = 1_000_000, 10_000, 100_000
MOST_DEPTH = 64


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.cast("double").alias("xmin"), ymin.cast("double").alias("ymin"), xmax.cast("double").alias("xmax"), ymax.cast("double").alias("ymax"))


def point(x: Column, y: Column) -> Column:
    return box(x, y, x, y)


def _box_of(pairs: list[tuple[float, float]]) -> dict | None:
    pairs = [p for p in pairs if math.isfinite(p[0]) and math.isfinite(p[1])]
    if not pairs:
        return None
    xs, ys = zip(*pairs, strict=True)
    return {"xmin": min(xs), "ymin": min(ys), "xmax": max(xs), "ymax": max(ys)}


def _bounds(text: str | None) -> dict | None:
    """Coordinates become P, empty shapes E; well-formed nested lists of them shrink to one P."""
    if not text or not _SHAPE.match(text.strip()):
        return None
    form = re.sub(r"\s+", "", re.sub(r"\bEMPTY\b", "E", _TUPLE.sub("P", _SHAPE.sub(" ", text)), flags=re.IGNORECASE))
    before = ""
    while form != before:
        before, form = form, re.sub(r"\([PE](?:,[PE])*\)", "P", form)
    return _box_of([(float(a), float(b)) for a, b in _TUPLE.findall(text)]) if form in ("P", "E") else None


def _binary_pairs(data: bytes) -> list[tuple[float, float]] | None:
    """All coordinate pairs of a WKB geometry, or None if it is malformed or beyond the limits."""
    at, pairs = 0, []

    def number(order: str, kind: str = "I") -> int:
        nonlocal at
        value = struct.unpack_from(order + kind, data, at)[0]
        at += struct.calcsize(kind)
        return value

    def points(order: str, n: int) -> bool:
        nonlocal at
        if n > MOST_POINTS or at + 16 * n > len(data):
            return False
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at)
        pairs.extend(zip(flat[::2], flat[1::2], strict=True))
        at += 16 * n
        return True

    open_ = [1]  # members still to read, for each collection around
    try:
        while open_:
            if not open_[-1]:
                open_.pop()
                continue
            open_[-1] -= 1
            order = "<" if number("<", "B") == 1 else ">"
            kind = number(order)
            if kind == 1:
                ok = points(order, 1)
            elif kind == 2:
                ok = points(order, number(order))
            elif kind == 3:
                rings = number(order)
                ok = rings <= MOST_RINGS and all(points(order, number(order)) for _ in range(rings))
            elif 4 <= kind <= 7:
                members = number(order)
                ok = members <= MOST_MEMBERS and len(open_) < MOST_DEPTH
                open_.append(members)
            else:
                ok = False
            if not ok:
                return None
    except struct.error:  # it ends too early
        return None
    return pairs


def _parsed(values: Column, bounds) -> Column:
    @F.pandas_udf(BOX)
    def parse(given: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bounds(x) or {} for x in given], columns=["xmin", "ymin", "xmax", "ymax"], dtype="float64")

    parsed = parse(values)
    return F.when(parsed["xmin"].isNotNull() & ~F.isnan(parsed["xmin"]), parsed)


def mbr_from_wkt(wkt: Column) -> Column:
    """The rectangle of a WKT geometry; null for malformed or empty ones. Coordinates that are not finite are skipped."""
    return _parsed(wkt, _bounds)


def mbr_from_wkb(wkb: Column, srid: bool = False) -> Column:
    """The rectangle of a WKB geometry of either byte order, after the 4 bytes of an SRID if ``srid``; null for malformed,
    empty or too large ones. Coordinates that are not finite are skipped."""
    skip = 4 if srid else 0
    return _parsed(wkb, lambda data: _box_of(_binary_pairs(data[skip:]) or []) if data else None)


def wkb_point(x: Column, y: Column) -> Column:
    """A point as WKB (little-endian)."""
    @F.pandas_udf("binary")
    def pack(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(xs, ys, strict=True)], dtype=object)

    return pack(x.cast("double"), y.cast("double"))


def intersects(a: Column, b: Column) -> Column:
    """Closed rectangles: touching edges count."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def within(inner: Column, outer: Column) -> Column:
    return (inner["xmin"] >= outer["xmin"]) & (inner["xmax"] <= outer["xmax"]) & (inner["ymin"] >= outer["ymin"]) & (inner["ymax"] <= outer["ymax"])


def contains(outer: Column, inner: Column) -> Column:
    return within(inner, outer)


def equal(a: Column, b: Column) -> Column:
    return (a["xmin"] == b["xmin"]) & (a["xmax"] == b["xmax"]) & (a["ymin"] == b["ymin"]) & (a["ymax"] == b["ymax"])


def disjoint(a: Column, b: Column) -> Column:
    return ~intersects(a, b)


def cluster_key(b: Column, low: float, high: float, bits: int = 16) -> Column:
    """A Z-order number of the rectangle's centre, for laying out files so that their statistics prune boxes."""
    def cell(v: Column) -> Column:
        return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor((v - low) / (high - low) * (1 << bits)))).cast("long")

    x, y = cell((b["xmin"] + b["xmax"]) / 2), cell((b["ymin"] + b["ymax"]) / 2)
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out + F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), 2 * k) + F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1)), 2 * k + 1)
    return out
