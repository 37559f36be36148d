"""Paths, names, sizes and other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by kind, placeholders that stand for no value, characters that file names may not hold.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif", ".raw", ".cr2", ".nef", ".arw", ".dng", ".orf", ".rw2", ".pef", ".sr2", ".raf")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg", ".3gp", ".mts", ".m2ts")
PLACEHOLDERS = ("0", "65535", "255", "40", "Unknown", "unknown", "")
BAD_NAME_CHARS = r'[<>:"/\\|?*]'
MAGIC = {"FFD8FF": "jpeg", "89504E470D0A1A0A": "png", "47494638": "gif", "49492A00": "tiff", "4D4D002A": "tiff"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_type(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*IMAGE_EXTENSIONS), "image").when(e.isin(*VIDEO_EXTENSIONS), "video").otherwise("unknown")


def without_placeholder(value: Column) -> Column:
    return F.when(~value.isin(*PLACEHOLDERS), value)


def format_bytes(n: Column) -> Column:
    """1024-steps with two decimals; 0 is ``0 B``."""
    out = F.when(n <= 0, F.lit("0 B"))
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        size = n / float(1024**k)
        out = out.when((size < 1024) | F.lit(unit == "TB"), F.format_string(f"%.2f {unit}", F.bround(size, 2)))
    return out


def safe_filename(name: Column) -> Column:
    clean = F.substring(F.trim(F.regexp_replace(name, BAD_NAME_CHARS, "_"), F.lit(". ")), 1, 255)
    return F.when(F.coalesce(clean, F.lit("")) == "", "unnamed").otherwise(clean)


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"[-+]?\d*\.?\d+", 0).try_cast("double")


def first_integer(text: Column) -> Column:
    return F.regexp_extract(text, r"[-+]?\d+", 0).try_cast("long")


def shutter_speed(x: Column) -> Column:
    """Seconds as photographers write them: ``1/250``, ``2s``, ``1.5s``; null where not positive."""
    whole = x == F.floor(x)
    return F.when(x <= 0, None).when((x >= 1) & whole, F.concat(F.floor(x).cast("string"), F.lit("s"))).when(x >= 1, F.concat(F.format_string("%.1f", x), F.lit("s"))).otherwise(F.concat(F.lit("1/"), F.round(1 / x).cast("long").cast("string")))


def camera_key(make: Column, model: Column) -> Column:
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return F.concat(known(make), F.lit(":"), known(model))


def corruption_severity(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.contains("truncated"), "minor").when(low.contains("broken data stream"), "moderate").otherwise("severe")


def magic_kind(content: Column) -> Column:
    """The kind that a file's first bytes tell, null where none is known."""
    head = F.hex(F.substring(content, 1, 8))
    out = None
    for prefix, kind in MAGIC.items():
        out = F.when(head.startswith(prefix), kind) if out is None else out.when(head.startswith(prefix), kind)
    return out


def first_filled(*values: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


#: Where videos tell their width, height and codec, by priority.
WIDTH_FIELDS = ("ImageWidth", "SourceImageWidth", "VideoWidth", "ExifImageWidth")
HEIGHT_FIELDS = ("ImageHeight", "SourceImageHeight", "VideoHeight", "ExifImageHeight")
CODEC_FIELDS = ("CompressorName", "VideoCodecID", "VideoCodec", "CompressorID", "FileType")


def video_size(exif: Column) -> Column:
    """``width, height`` of a video's map of fields; null unless both are there and positive."""
    number = lambda f: F.nullif(first_integer(F.try_element_at(exif, F.lit(f))), F.lit(0))
    width, height = F.coalesce(*map(number, WIDTH_FIELDS)), F.coalesce(*map(number, HEIGHT_FIELDS))
    return F.when((width > 0) & (height > 0), F.struct(width.alias("width"), height.alias("height")))


def video_codec(exif: Column, path: Column) -> Column:
    """The codec that a video's map of fields names, else its extension without the dot."""
    named = [F.try_element_at(exif, F.lit(f)) for f in CODEC_FIELDS]
    known = [F.when(~F.lower(c).isin("", "unknown", "none"), c) for c in named]
    return F.coalesce(*known, F.substring(extension(path), 2, 20))
