"""Capture dates: parsing, resolution by source, plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted EXIF formats, in order; file-name patterns with the order of their groups; default dates of cameras.
EXIF_FORMATS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd", "yyyy-MM-dd")
NAME_PATTERNS = ((r"(\d{4})-(\d{2})-(\d{2})[_\s](\d{2}):?(\d{2}):?(\d{2})", "ymdHMS"), (r"(\d{4})-(\d{2})-(\d{2})", "ymd"), (r"(\d{4})_(\d{2})_(\d{2})", "ymd"), (r"(\d{4})(\d{2})(\d{2})", "ymd"), (r"(\d{2})-(\d{2})-(\d{4})", "mdy"))
EXIF_FIELDS = ("DateTimeOriginal", "CreateDate", "ModifyDate", "DateCreated", "DateTime", "FileModifyDate", "MediaCreateDate", "TrackCreateDate")
EXIF_PREFIXES = ("", "EXIF:", "File:", "Composite:", "QuickTime:", "XMP:")
DEFAULT_DATES = ("2000-01-01", "1970-01-01", "1980-01-01")


def seconds(ts: Column | str) -> Column:
    """Whole seconds since the epoch of a timestamp without time zone, read as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def exif_date(text: Column) -> Column:
    """The first format that fits; an offset at the end is dropped, not applied."""
    bare = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz") for f in EXIF_FORMATS])


def name_date(path: Column) -> Column:
    """The first pattern in the file's stem that is a valid date."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    found = []
    for pattern, order in NAME_PATTERNS:
        part = {c: F.regexp_extract(stem, pattern, i + 1) for i, c in enumerate(order)}
        time = F.concat_ws(":", *[part[c] for c in "HMS"]) if "H" in part else F.lit("00:00:00")
        found.append(F.try_to_timestamp(F.concat(F.concat_ws("-", *[part[c] for c in "ymd"]), F.lit(" "), time), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))
    return F.coalesce(*found)


def directory_date(path: Column) -> Column:
    """``YYYY-MM`` or ``YYYY`` of the nearest part of the path that has one anywhere, from the file name upward."""
    parts = F.reverse(F.split(path, "/"))

    def of(p: Column) -> Column:
        y, m = F.regexp_extract(p, r"(\d{4})-(\d{2})", 1), F.regexp_extract(p, r"(\d{4})-(\d{2})", 2)
        year = F.regexp_extract(p, r"(\d{4})", 1)
        plausible = lambda x: (x != "") & F.coalesce(F.try_to_number(x, F.lit("9999")).between(1900, 2100), F.lit(False))
        month = (m != "") & F.coalesce(F.try_to_number(m, F.lit("99")).between(1, 12), F.lit(False))
        return F.when(plausible(y) & month, F.concat_ws("-", y, m)).when(plausible(year), year)

    return F.get(F.filter(F.transform(parts, of), lambda x: x.isNotNull()), F.lit(0))


def suspicious(ts: Column, as_of: Column) -> Column:
    """In the future, before 1990 or a camera's default date."""
    return (ts > as_of) | (F.year(ts) < 1990) | F.date_format(ts, "yyyy-MM-dd").isin(*DEFAULT_DATES)


def exif_field(exif: Column, field: str) -> Column:
    """The first prefix under which ``field`` holds a date, from a map of EXIF texts."""
    return F.coalesce(*[exif_date(F.try_element_at(exif, F.lit(p + field))) for p in EXIF_PREFIXES])


def best_date(exif: Column, path: Column, created: Column) -> Column:
    """``ts, source, confidence``: capture fields, other EXIF fields, file name, directory, file system."""
    def pick(ts: Column, source: str, confidence: int) -> Column:
        return F.when(ts.isNotNull(), F.struct(ts.alias("ts"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))

    first = [pick(exif_field(exif, f), "exif", 95) for f in ("DateTimeOriginal", "CreateDate", "MediaCreateDate")]
    other = [pick(exif_field(exif, f), "exif_other", 85) for f in EXIF_FIELDS if f not in ("DateTimeOriginal", "CreateDate", "MediaCreateDate", "FileModifyDate")]
    where = directory_date(path)
    directory = F.try_to_timestamp(F.when(F.length(where) == 4, F.concat(where, F.lit("-01-01"))).otherwise(F.concat(where, F.lit("-01"))), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    return F.coalesce(*first, *other, pick(name_date(path), "filename", 70), pick(directory, "directory", 50), pick(created, "filesystem", 30))
