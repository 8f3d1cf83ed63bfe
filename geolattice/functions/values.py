"""Text, number and time conversions in the strict and the lenient manner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_double(text: Column | str) -> Column:
    """A number; anything else fails the query, and so does a null."""
    value = F.trim(_col(text))
    return F.when(F.assert_true(value.isNotNull(), "a number is missing").isNull(), value.cast("double"))


def lenient_double(text: Column | str) -> Column:
    """A number, or NaN for a null or a text that is none."""
    return F.coalesce(_col(text).try_cast("double"), F.lit(float("nan")))


def strict_long(text: Column | str) -> Column:
    return F.trim(_col(text)).cast("bigint")


def is_finite(value: Column | str) -> Column:
    """Neither null, nor NaN, nor infinite. Spark orders NaN above all numbers, so it must go before any ordering."""
    v = _col(value)
    return F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False))


def local_time_millis(text: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str | None = None) -> Column:
    """Milliseconds since the epoch of a local time, in the session's time zone or in ``zone``."""
    if zone is not None:
        return F.unix_millis(F.to_timestamp_ltz(F.concat_ws(" ", _col(text), F.lit(zone)), F.lit(f"{pattern} VV")))
    return F.unix_millis(F.to_timestamp(_col(text), pattern))


def composite_key(*parts: Column | str, separator: str = "|") -> Column:
    return F.concat_ws(separator, *map(_col, parts))


def key_bin(key: Column | str, offset: int, length: int) -> Column:
    """``length`` characters of a key from ``offset`` (from 0)."""
    if offset < 0 or length < 1:
        raise ValueError("a bin begins at 0 or later and has a character at least")
    return F.substring(_col(key), offset + 1, length)


def rounded(value: Column | str, places: int) -> Column:
    """The number of so many places that is nearest to the exact value of a double, as C prints it; halves go to even.

    Java's formats round the shortest text of a double instead: the double of -73.98495 lies above it and gives -73.9849
    here, -73.9850 there. The product with a power of ten is taken with its error, as only that tells halves from the rest.
    """
    v, ten = _col(value), float(10**places)
    size = F.abs(v)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    product = size * ten
    error = (high * ten - product) + (size - high) * ten
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    near = (whole + up.cast("long")).cast("double") / ten
    return F.when((size > 0) & (product < 2.0**52), F.when(v < 0, -near).otherwise(near)).otherwise(v)


def match_line(id_: Column | str, key: Column | str, lon: Column | str, lat: Column | str, distance: Column | str) -> Column:
    """One line of text for a match, in fixed widths."""
    return F.format_string("<QueryMatch: %4s, %12s, %3.4f, %3.4f, %2.5f >", _col(id_), _col(key), _col(lon), _col(lat), _col(distance))
