"""Geohashes and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH = 6371000.0


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Bits of longitude and latitude in turn, longitude first, five to a letter."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    cell = lambda x, low, width, n: F.least(F.lit((1 << n) - 1), F.floor((x - low) / width * (1 << n))).cast("long")
    a, b = cell(lon, -180.0, 360.0, lon_bits), cell(lat, -90.0, 180.0, lat_bits)
    letters = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for k in range(5):
            i = 5 * c + k
            source, n = (a, lon_bits) if i % 2 == 0 else (b, lat_bits)
            value = value * 2 + F.shiftright(source, n - 1 - i // 2) % 2
        letters.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*letters))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), F.lit(2))
    return 2 * EARTH * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def has_gps(lat: Column, lon: Column) -> Column:
    """Both coordinates are there and neither is 0."""
    return F.coalesce((lat != 0) & (lon != 0), F.lit(False))
