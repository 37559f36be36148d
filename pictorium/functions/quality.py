"""Quality scores of files and keeper scores within duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points by format, knots of the size score in MB by kind, weights of metadata fields.
FORMAT_POINTS = {100: ("CR2", "CR3", "NEF", "ARW", "DNG", "RAF", "ORF", "RW2", "PEF", "SRW"), 90: ("TIFF", "TIF"), 85: ("PNG",), 80: ("HEIC", "HEIF"), 70: ("JPEG", "JPG"), 60: ("WEBP",), 50: ("BMP",), 40: ("GIF",)}
RAW_KINDS = ("CR2", "CR3", "NEF", "ARW", "DNG")
TIFF_KINDS = ("TIFF", "TIF")
SIZE_KNOTS = {"raw": ((0, 0), (20, 80), (50, 100)), "tiff": ((0, 0), (10, 80), (30, 100)), "other": ((0, 0), (0.5, 40), (2, 70), (10, 100))}
METADATA_WEIGHTS = {"camera_make": 15, "camera_model": 15, "lens_model": 10, "focal_length": 10, "aperture": 10, "shutter_speed": 10, "iso": 10, "latitude": 10, "longitude": 10}


def format_score(fmt: Column) -> Column:
    out = F.when(F.coalesce(fmt, F.lit("")) == "", 50)
    for points, kinds in FORMAT_POINTS.items():
        out = out.when(F.upper(fmt).isin(*kinds), points)
    return out.otherwise(50)


def resolution_score(width: Column, height: Column) -> Column:
    """Piecewise linear in megapixels, 100 from 33 on; missing or not positive: 0."""
    mp = width * height / 1e6
    return (
        F.when(F.coalesce((width <= 0) | (height <= 0), F.lit(True)), 0.0)
        .when(mp >= 33, 100.0)
        .when(mp >= 20, 90 + (mp - 20) / 13 * 10)
        .when(mp >= 8, 80 + (mp - 8) / 12 * 10)
        .when(mp >= 2, 60 + (mp - 2) / 6 * 20)
        .when(mp >= 1, 40 + (mp - 1) * 20)
        .otherwise(mp * 40)
    )


def size_score(size_bytes: Column, fmt: Column) -> Column:
    """Linear between the knots of the kind, in MB; missing or not positive: 0."""
    mb = size_bytes / (1024.0 * 1024.0)

    def along(knots):
        out = F.when(mb >= knots[-1][0], float(knots[-1][1]))
        for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
            out = out.when(mb >= x0, y0 + (mb - x0) / (x1 - x0) * (y1 - y0))
        return out

    kind = F.upper(F.coalesce(fmt, F.lit("")))
    return F.when(F.coalesce(size_bytes <= 0, F.lit(True)), 0.0).when(kind.isin(*RAW_KINDS), along(SIZE_KNOTS["raw"])).when(kind.isin(*TIFF_KINDS), along(SIZE_KNOTS["tiff"])).otherwise(along(SIZE_KNOTS["other"]))


def completeness(fields: list[tuple[int, Column]]) -> Column:
    """Percent of the weights whose flag holds."""
    total = sum(w for w, _ in fields)
    score = F.lit(0)
    for w, flag in fields:
        score = score + F.when(flag, w).otherwise(0)
    return score * 100.0 / total


def overall(fmt: Column, resolution: Column, size: Column, metadata: Column) -> Column:
    return F.round(0.40 * fmt + 0.35 * resolution + 0.15 * size + 0.10 * metadata, 2)


def bands(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def compare(first: Column, second: Column) -> Column:
    """-1 where the first score is better, 1 where the second is, 0 where they are equal."""
    return F.signum(second - first).cast("int")
