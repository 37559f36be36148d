"""Plans for reorganising files into dated folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folder layouts and naming strategies.
LAYOUTS = {"YYYY-MM": "yyyy-MM", "YYYY/MM": "yyyy/MM", "YYYY-MM-DD": "yyyy-MM-dd", "YYYY": "yyyy", "YYYY/MM-DD": "yyyy/MM-dd", "FLAT": None}
NAMINGS = ("date_time_checksum", "date_time_original", "original", "checksum", "time_checksum")


def directory(base: str, date: Column, status: Column, layout: str) -> Column:
    """Null without a date; rejected images go below ``_rejected``."""
    top = F.when(status == "rejected", F.lit(f"{base}/_rejected")).otherwise(F.lit(base))
    form = LAYOUTS[layout]
    return F.when(date.isNotNull(), F.concat(top, F.lit("/"), F.date_format(date, form)) if form else top)


def file_name(path: Column, date: Column, checksum: Column, naming: str) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    whole, short = F.concat(checksum, suffix), F.concat(F.substring(checksum, 1, 8), suffix)
    stamp = lambda form, rest: F.concat(F.date_format(date, form), F.lit("_"), rest)
    dated = {"date_time_checksum": (stamp("yyyy-MM-dd_HHmmss", short), whole), "time_checksum": (stamp("HHmmss", short), whole), "date_time_original": (stamp("yyyy-MM-dd_HHmmss", name), name)}
    if naming in dated:
        return F.when(date.isNotNull(), dated[naming][0]).otherwise(dated[naming][1])
    return name if naming == "original" else whole


def plan(images: DataFrame, base: str, layout: str = "YYYY-MM", naming: str = "date_time_checksum") -> DataFrame:
    """``id, source_path, target, action``: names that clash get ``_001``, ``_002``; files already under ``base`` or without a date are skipped."""
    t = images.select("id", "source_path", "checksum", directory(base, F.col("selected_date"), F.col("status_id"), layout).alias("dir"), file_name(F.col("source_path"), F.col("selected_date"), F.col("checksum"), naming).alias("name"))
    nth = F.row_number().over(W.partitionBy("dir", "name").orderBy("id")) - 1
    ext = F.regexp_extract("name", r"(\.[^./]+)$", 1)
    stem = F.expr("substring(name, 1, length(name) - length(regexp_extract(name, '(\\\\.[^./]+)$', 1)))")
    named = F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat(stem, F.format_string("_%03d", F.col("n")), ext))
    action = F.when(F.col("dir").isNull(), "no_date").when(F.col("source_path").startswith(base + "/"), "skip").otherwise("copy")
    return t.withColumn("n", nth).select("id", "source_path", F.when(F.col("dir").isNotNull(), F.concat("dir", F.lit("/"), named)).alias("target"), action.alias("action"))


