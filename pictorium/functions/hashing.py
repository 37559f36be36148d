"""Perceptual hashes of 8x8 luma planes (arrays of 64 doubles) and distances between hashes, as 64-bit integers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(flags: Column) -> Column:
    """64 booleans, most significant first, as a signed 64-bit integer."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def total(px: str | Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, x: a + x)


def average_hash(px: str) -> Column:
    """Bit where a pixel is above the mean."""
    return F.transform(F.array(F.struct(F.col(px).alias("px"), (total(px) / 64).alias("mean"))), lambda s: _bits(F.transform(s["px"], lambda x: x > s["mean"])))[0]


def difference_hash(px: str) -> Column:
    """Bit where a pixel is below its right neighbour; a row's first value follows its last."""
    right = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.get(F.col(px), F.when(k % 8 == 7, k - 7).otherwise(k + 1)))
    return _bits(F.zip_with(px, right, lambda a, b: a < b))


def wavelet_hash(px: str) -> Column:
    """Bit where a Haar low-pass coefficient of a 2x2 block is above their median; 16 bits lead, 48 zeros follow."""
    at = lambda k, d: F.get(F.col(px), (F.floor(k / 4) * 16 + k % 4 * 2 + d).cast("int"))
    low = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: (at(k, 0) + at(k, 1) + at(k, 8) + at(k, 9)) / 2)
    s = F.transform(F.array(low), lambda c: F.struct(c.alias("c"), F.array_sort(c).alias("o")))
    bits = F.transform(s, lambda x: F.transform(x["c"], lambda v: v > (x["o"][7] + x["o"][8]) / 2))[0]
    return F.shiftleft(_bits(bits), 48)


def to_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def from_hex(h: Column) -> Column:
    """A hexadecimal hash of up to 16 digits as a signed integer, null where it is not one."""
    return F.when(h.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(h, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_hamming(a: Column, b: Column, bad: Column) -> Column:
    """Distance of hexadecimal hashes; ``bad`` where one is missing, not hexadecimal or of another length."""
    return F.coalesce(F.when(F.length(a) == F.length(b), hamming(from_hex(a), from_hex(b))), bad)


def similarity_percent(distance: Column, size: int = 8) -> Column:
    return F.coalesce((1 - distance / (size * size)) * 100, F.lit(0.0))


def bands(h: Column, threshold: int) -> Column:
    """``threshold + 1`` bands that cover all 64 bits: hashes within ``threshold`` bits share one."""
    n = threshold + 1
    edges = [64 * i // n for i in range(n + 1)]
    part = lambda lo, hi: F.shiftrightunsigned(h, 64 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(i).alias("band"), part(lo, hi).alias("bits")) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])


def band_pairs(h: Column, threshold: int) -> Column:
    """Every two of ``threshold + 2`` bands that cover all 64 bits: hashes within ``threshold`` bits share such a pair."""
    n = threshold + 2
    edges = [64 * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned(h, 64 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")) for lo, hi in zip(edges, edges[1:], strict=False)]
    pairs = combinations(range(n), 2)
    return F.array(*[F.struct(F.lit(k).alias("band"), F.shiftleft(part[i], edges[j + 1] - edges[j]).bitwiseOR(part[j]).alias("bits")) for k, (i, j) in enumerate(pairs)])


#: Recommended thresholds in bits by method.
THRESHOLDS = {"dhash": 5, "ahash": 6, "whash": 4}


def recommended_threshold(method: Column) -> Column:
    out = F.lit(5)
    for name, bits in THRESHOLDS.items():
        out = F.when(method == name, bits).otherwise(out)
    return out


def common_methods(a: Column, b: Column) -> Column:
    """The hash methods that two images share, in the first one's order."""
    return F.array_intersect(a, b)
