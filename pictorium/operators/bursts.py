"""Burst sessions over capture times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..functions.text import camera_key

NAME = r"^([A-Za-z_]+)(\d+)"


def same_place(lat: Column, lon: Column, lat0: Column, lon0: Column, metres: float = 10.0) -> Column:
    """True where either place is missing; else equal to six geohash letters or within ``metres``."""
    missing = lat.isNull() | lon.isNull() | lat0.isNull() | lon0.isNull()
    return missing | (geo.geohash(lat, lon, 6) == geo.geohash(lat0, lon0, 6)) | (geo.haversine(lat, lon, lat0, lon0) <= metres)


def name_follows(path: Column, before: Column, reach: int = 5) -> Column:
    """True where either name has no number; else the same prefix and numbers at most ``reach`` apart."""
    stem = lambda p: F.element_at(F.split(p, "/"), -1)
    prefix, number = (lambda p: F.regexp_extract(stem(p), NAME, 1)), (lambda p: F.try_to_number(F.regexp_extract(stem(p), NAME, 2), F.lit("999999999999")))
    unknown = (prefix(path) == "") | (prefix(before) == "")
    return unknown | F.coalesce((prefix(path) == prefix(before)) & (F.abs(number(path) - number(before)) <= reach), F.lit(False))


def numbered(shots: DataFrame, gap: float, check_place: bool = True, check_name: bool = True) -> DataFrame:
    """Shots with ``run``, the number of the camera's run they are in: a run goes on while gap, place and name allow."""
    key = camera_key(F.col("camera_make"), F.col("camera_model"))
    by = W.partitionBy("camera").orderBy("ts", "image_id")
    s = shots.withColumn("camera", key).withColumn("sec", dates.seconds("ts"))
    cont = (F.col("sec") - F.lag("sec").over(by)) <= gap
    if check_place:
        cont &= same_place(F.col("latitude"), F.col("longitude"), F.lag("latitude").over(by), F.lag("longitude").over(by))
    if check_name:
        cont &= name_follows(F.col("source_path"), F.lag("source_path").over(by))
    s = s.withColumn("breaks", F.when(cont, 0).otherwise(1))
    return s.withColumn("run", F.sum("breaks").over(by)).drop("breaks")


def detect(shots: DataFrame, gap: float, least: int = 3, shortest: float = 0.5, select: str = "quality", check_place: bool = True, check_name: bool = True) -> DataFrame:
    """``camera, run, image_count, start_time, end_time, duration_seconds, best_image_id`` of every burst."""
    s = numbered(shots, gap, check_place, check_name)
    pos = F.row_number().over(W.partitionBy("camera", "run").orderBy("ts", "image_id")) - 1
    g = s.withColumn("pos", pos).groupBy("camera", "run")
    n = F.count("*")
    ids = F.array_sort(F.collect_list(F.struct("pos", "image_id")))
    best = {"quality": F.max_by("image_id", F.struct(F.coalesce("quality_score", F.lit(float("-inf"))), -F.col("pos"))), "first": F.element_at(ids, 1)["image_id"], "middle": F.element_at(ids, F.floor(n / 2).cast("int") + 1)["image_id"]}[select]
    b = g.agg(n.alias("image_count"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), (F.max("sec") - F.min("sec")).alias("duration_seconds"), best.alias("best_image_id"))
    return b.where((F.col("image_count") >= least) & (F.col("duration_seconds") >= shortest))


def members(shots: DataFrame, gap: float, least: int = 3, shortest: float = 0.5) -> DataFrame:
    """``camera, run, image_id, burst_sequence`` of the images in bursts."""
    s = numbered(shots, gap)
    g = W.partitionBy("camera", "run")
    s = s.withColumn("n", F.count("*").over(g)).withColumn("length", F.max("sec").over(g) - F.min("sec").over(g)).where((F.col("n") >= least) & (F.col("length") >= shortest))
    return s.select("camera", "run", "image_id", (F.row_number().over(g.orderBy("ts", "image_id")) - 1).alias("burst_sequence"))


def merge_adjacent(bursts: DataFrame, gap: float) -> DataFrame:
    """Bursts of one camera whose gap to the one before is at most ``gap``, as one; the first one's best image stays."""
    by = W.partitionBy("camera").orderBy("start_time", "run")
    apart = dates.seconds(F.col("start_time")) - dates.seconds(F.lag("end_time").over(by))
    m = bursts.withColumn("merged", F.sum(F.when(apart <= gap, 0).otherwise(1)).over(by))
    return m.groupBy("camera", "merged").agg(F.sum("image_count").alias("image_count"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.min_by("best_image_id", "start_time").alias("best_image_id"))


def apply_selection(images: DataFrame, burst_id, chosen: list) -> DataFrame:
    """Status of a burst's images after a choice: chosen ones active, others rejected."""
    return images.where(F.col("burst_id") == burst_id).select("id", F.when(F.col("id").isin(chosen), "active").otherwise("rejected").alias("status_id"))


def with_previous(shots: DataFrame, keys: list[str]) -> DataFrame:
    """Shots with ``before``, the image before it in time with the same ``keys``."""
    return shots.withColumn("before", F.lag("image_id").over(W.partitionBy(*keys).orderBy("ts", "image_id")))


def with_images(bursts: DataFrame, images: DataFrame) -> DataFrame:
    """Bursts of which one of ``images`` is a member."""
    return bursts.join(images, "burst_id", "left_semi")


#: sort key: order of bursts; ties by id
ORDERS = {"newest": lambda: F.desc_nulls_last("start_time"), "oldest": lambda: F.asc_nulls_last("start_time"), "largest": lambda: F.desc("image_count")}


def listing(bursts: DataFrame, images: DataFrame, make: str | None = None, model: str | None = None, min_images: int | None = None) -> DataFrame:
    """Bursts with an image that is not rejected, by camera and size where given."""
    b = bursts
    for column, value in (("camera_make", make), ("camera_model", model)):
        b = b.where(F.col(column) == value) if value else b
    b = b.where(F.col("image_count") >= min_images) if min_images else b
    return with_images(b, images.where(F.coalesce("status_id", F.lit("")) != "rejected"))


def page(bursts: DataFrame, sort: str = "newest", limit: int = 50, offset: int = 0) -> DataFrame:
    order = ORDERS.get(sort, ORDERS["newest"])
    return bursts.orderBy(order(), F.desc_nulls_last("start_time"), "burst_id").offset(offset).limit(limit)


def of_burst(images: DataFrame, burst_id) -> DataFrame:
    """A burst's images, best quality first, then in sequence."""
    return images.where(F.col("burst_id") == burst_id).orderBy(F.desc_nulls_last("quality_score"), "burst_sequence", "id")


def details(bursts: DataFrame, images: DataFrame) -> DataFrame:
    """``burst_id, members``: id and whether it is the best, in sequence."""
    m = images.join(bursts.select("burst_id", "best_image_id"), "burst_id")
    row = F.struct("burst_sequence", "id", F.coalesce(F.col("id") == F.col("best_image_id"), F.lit(False)).alias("is_best"))
    return m.groupBy("burst_id").agg(F.array_sort(F.collect_list(row)).alias("members"))


def apply_all(images: DataFrame, bursts: DataFrame) -> DataFrame:
    """Status of every image of the bursts that have a best one: that active, others rejected."""
    m = images.join(bursts.where("best_image_id is not null").select("burst_id", "best_image_id"), "burst_id")
    return m.select("id", "burst_id", F.when(F.col("id") == F.col("best_image_id"), "active").otherwise("rejected").alias("status_id"))


def set_best(bursts: DataFrame, burst_id, image_id) -> DataFrame:
    """Bursts after a choice by hand."""
    this = F.col("burst_id") == burst_id
    return bursts.withColumns({"best_image_id": F.when(this, image_id).otherwise(F.col("best_image_id")), "selection_method": F.when(this, "manual").otherwise(F.col("selection_method"))})


def statistics(bursts: DataFrame) -> DataFrame:
    """``bursts, images, mean, largest, cameras``; a burst whose make or model is null has no camera."""
    return bursts.agg(F.count("*").alias("bursts"), F.coalesce(F.sum("image_count"), F.lit(0)).alias("images"), F.avg("image_count").alias("mean"), F.max("image_count").alias("largest"), F.count_distinct(F.concat("camera_make", F.lit(" "), "camera_model")).alias("cameras"))


def summary(bursts: DataFrame) -> DataFrame:
    """Mean size and duration, 0 without bursts."""
    return bursts.agg(F.round(F.coalesce(F.avg("image_count"), F.lit(0)), 1).alias("size"), F.round(F.coalesce(F.avg("duration_seconds"), F.lit(0)), 2).alias("seconds"))
