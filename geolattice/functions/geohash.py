"""Geohash keys: as Catalyst expressions for columns, and in plain Python for constants of a query."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the base-32 alphabet of geohashes.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
LONGEST = 12
_BITS = 30
def _cell_index(value: Column, low: float) -> Column:
    """Number of the cell, of 2^30 between low and -low, that holds the value; edges belong to the upper cell.

    Cell edges are exact doubles, so one comparison on either side mends what rounding does to the quotient.
    """
    width = -2 * low / 2**_BITS
    guess = F.floor((value - F.lit(low)) / F.lit(width))
    edge = lambda k: F.lit(low) + k.cast("double") * F.lit(width)
    mended = guess + (value >= edge(guess + 1)).cast("long") - (value < edge(guess)).cast("long")
    return mended - (mended == F.lit(2**_BITS)).cast("long")  # the uppermost edge belongs to the last cell; null stays null


def _pair_digits(first: int, second: int) -> str:
    """Digits by (bits of the axis that a digit begins with, bits of the other): their bits alternate in the digit."""
    out = []
    for a in range(2**first):
        for b in range(2**second):
            mixed = 0
            for i in range(first + second):
                mixed = mixed << 1 | (a >> (first - 1 - i // 2) & 1 if i % 2 == 0 else b >> (second - 1 - i // 2) & 1)
            out.append(ALPHABET[mixed])
    return "".join(out)


def geohash(lat: Column | str, lon: Column | str, chars: int = LONGEST) -> Column:
    """The geohash of a point; null for null, NaN or a coordinate outside the globe. Edges of cells go up.

    A digit takes three bits of one axis and two of the other, in turns, so it is one look-up in 32 characters: the
    expression stays small, and the two cell numbers are common subexpressions of all digits.
    """
    if not 1 <= chars <= LONGEST:
        raise ValueError(f"a geohash has 1 to {LONGEST} characters")
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    x, y = _cell_index(F.when(lon.between(-180.0, 180.0), lon), -180.0), _cell_index(F.when(lat.between(-90.0, 90.0), lat), -90.0)
    table, out = _pair_digits(3, 2), []
    used = {0: 0, 1: 0}  # bits taken of longitude and latitude
    for i in range(chars):
        axes = (x, y) if i % 2 == 0 else (y, x)
        parts = []
        for axis, (column, width) in zip((i % 2, 1 - i % 2), zip(axes, (3, 2), strict=True), strict=True):
            used[axis] += width
            parts.append(F.shiftright(column, _BITS - used[axis]).bitwiseAND(F.lit(2**width - 1)))
        out.append(F.substring(F.lit(table), (parts[0] * 4 + parts[1] + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def geohash_box(key: Column | str) -> Column:
    """struct<lon0, lat0, lon1, lat1> of a geohash column; null for null, empty or a character that no geohash has."""
    key = F.col(key) if isinstance(key, str) else key
    places = F.transform(F.split(key, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    begin = F.struct(*(F.lit(x).alias(n) for n, x in (("lon0", -180.0), ("lat0", -90.0), ("lon1", 180.0), ("lat1", 90.0))), F.lit(True).alias("turn"))

    def step(box: Column, place: Column) -> Column:
        # Bit by bit as nested folds, so that the expression stays small.
        return F.aggregate(F.array(*map(F.lit, (16, 8, 4, 2, 1))), box, lambda b, bit: _halve(b, place.bitwiseAND(bit) > 0))

    box = F.aggregate(places, begin, step)
    valid = (F.length(key) > 0) & ~F.exists(places, lambda p: p < 0)
    return F.when(valid, F.struct(*(box[n].alias(n) for n in ("lon0", "lat0", "lon1", "lat1"))))


def _halve(box: Column, up: Column) -> Column:
    turn = box["turn"]
    lon, lat = (box["lon0"] + box["lon1"]) / 2, (box["lat0"] + box["lat1"]) / 2
    return F.struct(
        F.when(turn & up, lon).otherwise(box["lon0"]).alias("lon0"),
        F.when(~turn & up, lat).otherwise(box["lat0"]).alias("lat0"),
        F.when(turn & ~up, lon).otherwise(box["lon1"]).alias("lon1"),
        F.when(~turn & ~up, lat).otherwise(box["lat1"]).alias("lat1"),
        (~turn).alias("turn"),
    )


# -- constants of a query -------------------------------------------------------------------------------------------


def _axis_bits(chars: int) -> tuple[int, int]:
    """Bits of longitude and latitude in so many characters."""
    return (5 * chars + 1) // 2, 5 * chars // 2


def _index(value: float, low: float, bits: int) -> int:
    width = -2 * low / 2**bits
    k = min(2**bits - 1, max(0, math.floor((value - low) / width)))
    while k < 2**bits - 1 and value >= low + (k + 1) * width:
        k += 1
    while k and value < low + k * width:
        k -= 1
    return k


def _of_indexes(x: int, y: int, chars: int) -> str:
    lon_bits, lat_bits = _axis_bits(chars)
    bits = []
    for i in range(5 * chars):
        bits.append(x >> (lon_bits - 1 - i // 2) & 1 if i % 2 == 0 else y >> (lat_bits - 1 - i // 2) & 1)
    return "".join(ALPHABET[int("".join(map(str, bits[i : i + 5])), 2)] for i in range(0, 5 * chars, 5))


def _indexes(key: str) -> tuple[int, int]:
    x = y = 0
    turn = True
    for c in key:
        place = ALPHABET.index(c)
        for bit in (16, 8, 4, 2, 1):
            if turn:
                x = x << 1 | bool(place & bit)
            else:
                y = y << 1 | bool(place & bit)
            turn = not turn
    return x, y


def encode(lat: float, lon: float, chars: int = LONGEST) -> str:
    """The geohash of one point; outside the globe there is none."""
    if not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise ValueError(f"not on the globe: lon {lon}, lat {lat}")
    lon_bits, lat_bits = _axis_bits(chars)
    return _of_indexes(_index(lon, -180.0, lon_bits), _index(lat, -90.0, lat_bits), chars)


def box(key: str) -> tuple[float, float, float, float]:
    """(lon0, lat0, lon1, lat1) of a cell."""
    if not key or any(c not in ALPHABET for c in key):
        raise ValueError(f"not a geohash: {key!r}")
    lon_bits, lat_bits = _axis_bits(len(key))
    x, y = _indexes(key)
    w, h = 360 / 2**lon_bits, 180 / 2**lat_bits
    return -180 + x * w, -90 + y * h, -180 + (x + 1) * w, -90 + (y + 1) * h


def corners(key: str) -> list[tuple[float, float]]:
    lon0, lat0, lon1, lat1 = box(key)
    return [(lon0, lat0), (lon0, lat1), (lon1, lat1), (lon1, lat0)]


def neighbours(key: str) -> list[str]:
    """The cells around: N, NE, E, SE, S, SW, W, NW. Longitude wraps; beyond a pole there is none."""
    lon_bits, lat_bits = _axis_bits(len(key))
    x, y = _indexes(key)
    out = []
    for dx, dy in ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)):
        if 0 <= y + dy < 2**lat_bits:
            near = _of_indexes((x + dx) % 2**lon_bits, y + dy, len(key))
            if near != key and near not in out:
                out.append(near)
    return out
