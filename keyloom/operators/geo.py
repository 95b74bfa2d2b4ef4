"""Geo sets: relations (key, member, h) with a 52-bit cell of interleaved longitude and latitude bits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The grid's bounds, the earth's radius in m, units in m, and the geohash alphabet.
LATITUDE = 85.05112878
RADIUS = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
CELLS = 1 << 26

#: Steps that spread 26 bits to every second bit: (shift, mask).
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(cell: Column) -> Column:
    for shift, mask in _SPREAD:
        cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask))
    return cell


def _gather(bits: Column) -> Column:
    bits = bits.bitwiseAND(F.lit(_SPREAD[-1][1]))
    for shift, mask in [*((s, m) for (s, _), (_, m) in zip(_SPREAD[::-1], _SPREAD[-2::-1], strict=False)), (16, 0x00000000FFFFFFFF)]:
        bits = bits.bitwiseOR(F.shiftright(bits, shift)).bitwiseAND(F.lit(mask))
    return bits


def _cell(value: Column, bound: float) -> Column:
    return F.least(F.greatest(F.floor((value + bound) / (2 * bound) * CELLS), F.lit(0)), F.lit(CELLS - 1)).cast("bigint")


def encode(lon: Column, lat: Column) -> Column:
    return F.shiftleft(_spread(_cell(lon, 180.0)), 1).bitwiseOR(_spread(_cell(lat, LATITUDE)))


def longitude(h: Column) -> Column:
    """The centre of the cell."""
    return (_gather(F.shiftright(h, 1)) + 0.5) / CELLS * 360.0 - 180.0


def latitude(h: Column) -> Column:
    return (_gather(h) + 0.5) / CELLS * (2 * LATITUDE) - LATITUDE


def add(places: DataFrame, seq: str | None = None) -> DataFrame:
    """GEOADD of (key, member, lon, lat) in range: the first position of a member stays, by the column ``seq``, or else its lowest cell."""
    inside = F.col("lon").between(-180, 180) & F.col("lat").between(-LATITUDE, LATITUDE)
    cells = places.where(inside).select("key", "member", encode(F.col("lon"), F.col("lat")).alias("h"), *([seq] if seq else []))
    return cells.groupBy("key", "member").agg((F.min_by("h", seq) if seq else F.min("h")).alias("h"))


def add_to(geo: DataFrame, places: DataFrame, mode: str = "", seq: str | None = None) -> DataFrame:
    """GEOADD to a geo set that is there, mode '', 'nx' (new members only) or 'xx' (known ones only): the
    relation afterwards, with ``added`` and ``changed`` (their sum is the reply of CH)."""
    if mode not in ("", "nx", "xx"):
        raise ValueError(f"no mode {mode!r}")
    both = geo.select("key", "member", F.col("h").alias("_old")).join(add(places, seq).withColumnRenamed("h", "_new"), ["key", "member"], "full")
    old, new = F.col("_old"), F.col("_new")
    cell = F.coalesce(old, new) if mode == "nx" else F.coalesce(new, old)
    out = both.select("key", "member", cell.alias("h"), old.isNull().alias("added"), (old.isNotNull() & (cell != old)).alias("changed"))
    return out.where("NOT added") if mode == "xx" else out


def positions(geo: DataFrame) -> DataFrame:
    return geo.select("key", "member", "h", longitude(F.col("h")).alias("lon"), latitude(F.col("h")).alias("lat"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres."""
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2 * RADIUS * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


def geohash(h: Column) -> Column:
    """11 characters of the cell; the last holds two bits."""
    letters = [F.substring(F.lit(ALPHABET), (F.shiftright(h, 47 - 5 * i) if i < 10 else F.shiftleft(h, 3)).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(11)]
    return F.concat(*letters)


def distance(geo: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """GEODIST by (req, key, a, b): null where a member is missing."""
    at = positions(geo)
    one = at.select("key", F.col("member").alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    two = at.select("key", F.col("member").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    both = pairs.join(one, ["key", "a"], "left").join(two, ["key", "b"], "left")
    return both.select("req", "key", "a", "b", (haversine(*(F.col(c) for c in ("lon1", "lat1", "lon2", "lat2"))) / UNITS[unit]).alias("dist"))


def _reach(lat: float, height_m: float, width_m: float, circle: bool) -> tuple[float, float]:
    """Degrees of latitude and longitude around a point within which everything lies that a search finds; 360 is all the way round."""
    up = math.degrees(height_m / RADIUS) + 1e-6
    if circle:
        edge = abs(lat) + up
        side = 360.0 if edge >= 89.9 else math.degrees(math.asin(min(1.0, math.sin(min(height_m / RADIUS, math.pi / 2)) / math.cos(math.radians(lat)))))
    else:
        across = math.sin(min(width_m / (2 * RADIUS), math.pi / 2)) / math.cos(math.radians(lat))
        side = 360.0 if across >= 1 else 2 * math.degrees(math.asin(across))
    return up, min(360.0, side + 1e-6)


def cover(lon: float, lat: float, up: float, side: float, most: int = 6) -> list[tuple[int, int]]:
    """Ranges of cells, both ends inclusive, that hold every place within the degrees around a point: of the finest
    grid whose blocks are at most ``most`` in either direction."""
    low, high = max(-LATITUDE, lat - up), min(LATITUDE, lat + up)
    for level in range(26, -1, -1):
        blocks = 1 << level
        at = lambda v: min(blocks - 1, max(0, int((v + LATITUDE) / (2 * LATITUDE) * blocks)))
        rows = range(at(low), at(high) + 1)
        west = math.floor((lon - side + 180) / 360 * blocks)
        east = math.floor((lon + side + 180) / 360 * blocks)
        columns = sorted({c % blocks for c in range(west, min(east, west + blocks - 1) + 1)}) if east - west < max(most, 2) or level < 2 else None
        if columns is not None and len(rows) <= most:
            break
    spread = lambda v: sum((v >> i & 1) << 2 * i for i in range(26))
    wide = 2 * (26 - level)
    starts = sorted((spread(x) << 1 | spread(y)) << wide for x in columns for y in rows)
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and out[-1][1] + 1 == s:
            out[-1] = (out[-1][0], s + (1 << wide) - 1)
        else:
            out.append((s, s + (1 << wide) - 1))
    return out


def search(geo: DataFrame, lon: float, lat: float, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", descending: bool = False, count: int = 0) -> DataFrame:
    """GEOSEARCH around a point, by radius or by (width, height): per key, members by distance; count 0 is no limit.

    Ranges of cells around the point are compared first, which a scan can use; only what lies in them is decoded.
    """
    reach = (radius if box is None else box[1] / 2) * UNITS[unit]
    ranges = cover(lon, lat, *_reach(lat, reach, reach if box is None else box[0] / 2 * UNITS[unit], box is None))
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | F.col("h").between(low, high)
    at = positions(geo.where(inside))
    x, y = F.lit(lon), F.lit(lat)
    at = at.withColumn("meters", haversine(x, y, F.col("lon"), F.col("lat")))
    if box is None:
        at = at.where(F.col("meters") <= reach)
    else:
        at = at.where((haversine(x, y, F.col("lon"), y) <= box[0] / 2 * UNITS[unit]) & (haversine(x, y, x, F.col("lat")) <= reach))
    order = F.col("meters").desc() if descending else F.col("meters").asc()
    at = at.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(order, "member")))
    at = at.where(F.col("rn") <= count) if count else at
    return at.select("key", (F.col("rn") - 1).cast("bigint").alias("rank"), "member", (F.col("meters") / UNITS[unit]).alias("dist"), "lon", "lat", "h")


def search_members(geo: DataFrame, asked: DataFrame, radius: float, unit: str = "m") -> DataFrame:
    """GEOSEARCH FROMMEMBER by radius, around many members (req, key, member) at once: req, key, member, near, dist.

    A join by blocks of the grid: blocks are at least as high as the radius, so what is near a
    member lies in its row or the two beside it, and in the columns that the radius spans at
    the row farthest from the equator. A missing member finds nothing.
    """
    reach = radius * UNITS[unit]
    up = math.degrees(reach / RADIUS) + 1e-6
    blocks = 1 << max(0, min(26, int(math.log2(2 * LATITUDE / up)))) if up < 2 * LATITUDE else 1
    places = positions(geo)
    row = lambda v: F.least(F.greatest(F.floor((v + LATITUDE) / (2 * LATITUDE) * blocks), F.lit(0)), F.lit(blocks - 1))
    column = lambda v: F.floor((v + 180.0) / 360.0 * blocks)
    of = asked.join(places.select("key", "member", F.col("lon").alias("lon1"), F.col("lat").alias("lat1")), ["key", "member"])
    edge = F.abs(F.col("lat1")) + up
    side = F.when(edge >= 89.9, 360.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(reach / RADIUS, math.pi / 2))) / F.cos(F.radians("lat1"))))) + 1e-6)
    west = column(F.col("lon1") - side)
    columns = F.sequence(west, F.least(column(F.col("lon1") + side), west + blocks - 1))
    of = of.withColumn("y", F.explode(F.sequence(row(F.col("lat1") - up), row(F.col("lat1") + up)))).withColumn("x", F.explode(columns))
    of = of.withColumn("x", F.pmod("x", F.lit(blocks)))
    near = places.select("key", F.col("member").alias("near"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), row(F.col("lat")).alias("y"), F.pmod(column(F.col("lon")), F.lit(blocks)).alias("x"))
    both = of.join(near, ["key", "x", "y"]).withColumn("_m", haversine(*(F.col(c) for c in ("lon1", "lat1", "lon2", "lat2"))))
    return both.where(F.col("_m") <= reach).select("req", "key", "member", "near", (F.col("_m") / UNITS[unit]).alias("dist"))


def stored(found: DataFrame, dst: str, distances: bool = False) -> DataFrame:
    """GEOSEARCHSTORE: a geo set, or a sorted set of distances."""
    return found.select(F.lit(dst).alias("key"), "member", F.col("dist").alias("score") if distances else F.col("h"))
