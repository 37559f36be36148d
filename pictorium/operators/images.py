"""Filtered, sorted and paged image listings, facets, timelines and map clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


@dataclass(frozen=True)
class ImageFilter:
    """Conditions that must all hold; a value that is None, 0 or empty sets none."""

    catalog_id: int | None = None
    path: str | None = None
    file_type: str | None = None
    camera_make: str | None = None
    camera_model: str | None = None
    lens: str | None = None
    focal_length: int | None = None
    aperture: float | None = None
    has_gps: bool | None = None
    date_from: str | None = None
    date_to: str | None = None
    min_width: int | None = None
    min_height: int | None = None
    status: str | None = None

    def condition(self) -> Column:
        c = F.lit(True)
        if self.catalog_id is not None:
            c &= F.col("catalog_id") == self.catalog_id
        if self.path:
            c &= F.col("source_path").ilike(f"%{self.path}%")
        for name, value in (("file_type", self.file_type), ("camera_make", self.camera_make), ("camera_model", self.camera_model), ("lens_model", self.lens), ("status_id", self.status), ("aperture", self.aperture)):
            if value:
                c &= F.col(name) == value
        if self.focal_length:
            c &= F.round(F.col("focal_length").cast("decimal(20,6)")) == self.focal_length
        if self.has_gps is not None:
            gps = geo.has_gps(F.col("latitude"), F.col("longitude"))
            c &= gps if self.has_gps else ~gps
        if self.date_from:
            c &= F.col("selected_date") >= F.lit(self.date_from).cast("timestamp_ntz")
        if self.date_to:
            c &= F.col("selected_date") <= F.lit(self.date_to).cast("timestamp_ntz")
        if self.min_width:
            c &= F.col("width") >= self.min_width
        if self.min_height:
            c &= F.col("height") >= self.min_height
        return c


def select_images(images: DataFrame, f: ImageFilter) -> DataFrame:
    return images.where(f.condition())


#: sort key: columns; dates and cameras put nulls last either way, others first when descending
SORT_KEYS = {"date": ["selected_date"], "filename": ["source_path"], "size": ["size_bytes"], "camera": ["camera_make", "camera_model"], "created_at": ["created_at"]}


def ordering(sort_by: str, descending: bool) -> list[Column]:
    last = sort_by not in ("filename", "size", "created_at")
    cols = SORT_KEYS.get(sort_by, SORT_KEYS["date"])
    if descending:
        return [*((F.desc_nulls_last if last else F.desc_nulls_first)(c) for c in cols), F.asc("id")]
    return [*(F.asc_nulls_last(c) for c in cols), F.asc("id")]


def page(images: DataFrame, f: ImageFilter, sort_by: str = "date", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page; ties are broken by id."""
    return select_images(images, f).orderBy(*ordering(sort_by, descending)).offset(offset).limit(limit)


def with_tags(images: DataFrame, image_tags: DataFrame, having: bool) -> DataFrame:
    return images.join(image_tags, images["id"] == image_tags["image_id"], "left_semi" if having else "left_anti")


def any_tag(images: DataFrame, image_tags: DataFrame, tags: DataFrame, names: list[str]) -> DataFrame:
    hit = image_tags.join(tags.where(F.col("name").isin(names)), "tag_id")
    return images.join(hit, images["id"] == hit["image_id"], "left_semi")


def all_tags(images: DataFrame, image_tags: DataFrame, tags: DataFrame, names: list[str]) -> DataFrame:
    hit = image_tags.join(tags.where(F.col("name").isin(names)), "tag_id").groupBy("image_id").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(set(names)))
    return images.join(hit, images["id"] == hit["image_id"], "left_semi")


def near(images: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Within a box of ``km`` around a point."""
    import math

    dy, dx = km / 111.0, km / (111.0 * abs(math.cos(math.radians(lat))) + 0.001)
    return images.where(F.col("latitude").between(lat - dy, lat + dy) & F.col("longitude").between(lon - dx, lon + dx))


def in_view(images: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Within bounds, which apply only if none of them is 0."""
    if not (south and north and west and east):
        return images
    return images.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def located(images: DataFrame) -> DataFrame:
    return images.where(geo.has_gps(F.col("latitude"), F.col("longitude")))


def grid_clusters(images: DataFrame, cell: float, limit: int = 1000) -> DataFrame:
    """``cy, cx, n, lat, lon`` of the fullest cells of ``cell`` degrees."""
    g = located(images).groupBy(F.floor(F.col("latitude") / cell).alias("cy"), F.floor(F.col("longitude") / cell).alias("cx"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("latitude"), 6).alias("lat"), F.round(F.avg("longitude"), 6).alias("lon")).orderBy(F.desc("n"), "cy", "cx").limit(limit)


def geohash_clusters(images: DataFrame, precision: int, limit: int = 1000) -> DataFrame:
    g = located(images).groupBy(geo.geohash(F.col("latitude"), F.col("longitude"), precision).alias("geohash"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("latitude"), 6).alias("lat"), F.round(F.avg("longitude"), 6).alias("lon")).orderBy(F.desc("n"), "geohash").limit(limit)


def timeline(images: DataFrame, unit: str, as_of_year: int) -> DataFrame:
    """``bucket, n, n_gps`` by day, week (from Monday), month or year, for plausible dates."""
    ok = F.col("selected_date").between(F.lit("1900-01-01").cast("timestamp_ntz"), F.lit(f"{as_of_year + 1}-12-31").cast("timestamp_ntz"))
    g = images.where(ok).groupBy(F.date_trunc(unit, "selected_date").cast("timestamp_ntz").alias("bucket"))
    return g.agg(F.count("*").alias("n"), F.count_if(geo.has_gps(F.col("latitude"), F.col("longitude"))).alias("n_gps"))


def facet(images: DataFrame, column: str) -> DataFrame:
    return images.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def catalog_stats(images: DataFrame) -> DataFrame:
    return images.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("file_type") == "image").alias("n_images"),
        F.count_if(F.col("file_type") == "video").alias("n_videos"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.round(F.coalesce(F.sum("size_bytes"), F.lit(0)) / float(1024**3), 2).alias("total_gb"),
        F.min("created_at").cast("string").alias("first_added"),
        F.max("created_at").cast("string").alias("last_added"),
    )


#: Size buckets in MB.
SIZE_BUCKETS = ((0, 1, "< 1 MB"), (1, 5, "1-5 MB"), (5, 10, "5-10 MB"), (10, 20, "10-20 MB"), (20, 50, "20-50 MB"), (50, None, "> 50 MB"))


def size_bucket(size: Column) -> Column:
    out = None
    for _, hi, name in SIZE_BUCKETS:
        if hi is None:
            return out.otherwise(name)
        cond = size < hi * 1024 * 1024
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def histogram(planes: DataFrame, pixels: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """``image_id, bin, n`` of an array of pixel values."""
    p = planes.select("image_id", F.explode(pixels).alias("x"))
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("x") - low) / (high - low) * bins))).cast("int")
    return p.groupBy("image_id", b.alias("bin")).agg(F.count("*").alias("n"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def run_history(runs: DataFrame, at: str, value: str, kept: int = 10, recent: int = 5) -> DataFrame:
    """Mean of the last ``kept`` runs and the trend of the newest against the mean of the last ``recent``."""
    from pyspark.sql import Window as W

    r = runs.orderBy(F.desc(at)).limit(kept).withColumn("r", F.row_number().over(W.orderBy(F.desc(at))))
    last = F.max(F.when(F.col("r") == 1, F.col(value)))
    return r.agg(F.count("*").alias("runs"), F.round(F.avg(value), 6).alias("mean"), F.round(last - F.avg(F.when(F.col("r") <= recent, F.col(value))), 6).alias("trend"))


def plausibly_dated(images: DataFrame, as_of_year: int) -> DataFrame:
    """Dated from 1900 to the end of the year after ``as_of_year``."""
    return images.where(F.col("selected_date").between(F.lit("1900-01-01").cast("timestamp_ntz"), F.lit(f"{as_of_year + 1}-12-31").cast("timestamp_ntz")))


def surely_dated(images: DataFrame, least: int = 70) -> DataFrame:
    """What burst detection takes: a date of ``least`` confidence."""
    return images.where((F.col("confidence") >= least) & F.col("selected_date").isNotNull())


def comparable(images: DataFrame) -> DataFrame:
    """Images outside bursts with all three hashes, the difference hash not all zeros."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return images.where((F.col("file_type") == "image") & F.col("burst_id").isNull() & filled("dhash") & (F.col("dhash") != "0" * 16) & filled("ahash") & filled("whash"))


def lacking(images: DataFrame, column: str, force: bool = False) -> DataFrame:
    """Images whose ``column`` is null or an empty text; all with ``force``."""
    return images if force else images.where(F.coalesce(F.col(column).cast("string"), F.lit("")) == "")


def database_status(status: Column) -> Column:
    """The stored status of a workflow status: complete and archived are archived, all else active."""
    return F.when(status.isin("complete", "archived"), "archived").otherwise("active")


#: Former sort keys; ties by id.
FORMER_ORDERS = {"date": lambda: F.desc_nulls_last("selected_date"), "path": lambda: F.asc("source_path"), "size": lambda: F.desc("size_bytes"), "id": lambda: F.asc("id")}


def former_page(images: DataFrame, sort_by: str = "date", limit: int = 50, offset: int = 0) -> DataFrame:
    return images.orderBy(FORMER_ORDERS.get(sort_by, FORMER_ORDERS["date"])(), "id").offset(offset).limit(limit)


def by_id(images: DataFrame, image_id) -> DataFrame:
    return images.where(F.col("id") == image_id)


def counts(images: DataFrame) -> DataFrame:
    """``total, n_images, n_videos, no_date, problematic``: what is small or without a date is problematic."""
    no_date = F.col("selected_date").isNull()
    return images.agg(F.count("*").alias("total"), F.count_if(F.col("file_type") == "image").alias("n_images"), F.count_if(F.col("file_type") == "video").alias("n_videos"), F.count_if(no_date).alias("no_date"), F.count_if(problem().isNotNull()).alias("problematic"))


def problem(small: int = 1000) -> Column:
    """What is wrong with an image: ``no_date``, ``small``, or null."""
    return F.when(F.col("selected_date").isNull(), "no_date").when(F.col("width") < small, "small")


def problems(images: DataFrame, category: str | None = None) -> DataFrame:
    p = images.withColumn("category", problem())
    return p.where(F.col("category").isNotNull() if category is None else F.col("category") == category)


def review_queue(images: DataFrame, least: int = 30) -> DataFrame:
    """``id, reason, priority, created_at``: images of low confidence or without a date; the less sure, the more urgent."""
    low = F.col("confidence") < least
    q = images.where(low | F.col("selected_date").isNull())
    return q.select("id", F.when(low, "low_confidence").otherwise("no_date").alias("reason"), (100 - F.col("confidence")).alias("priority"), "created_at")


def review_view(queue: DataFrame, images: DataFrame) -> DataFrame:
    """The queue with ``detail``: the confidence where that is low, else the path; most urgent first by :func:`review_page`."""
    i = images.select("id", "source_path", "confidence")
    detail = F.when(F.col("reason") == "low_confidence", F.col("confidence").cast("string")).otherwise(F.col("source_path"))
    return queue.join(i, "id").withColumn("detail", detail)


def review_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("reason").agg(F.count("*").alias("n"))


def review_page(queue: DataFrame, limit: int, reason: str | None = None) -> DataFrame:
    q = queue if reason is None else queue.where(F.col("reason") == reason)
    return q.orderBy(F.desc("priority"), "created_at").limit(limit)


def tag_counts(images: DataFrame, image_tags: DataFrame) -> DataFrame:
    """Images with ``tag_count``, 0 without tags."""
    n = image_tags.groupBy("image_id").agg(F.count("*").alias("_n"))
    return images.join(n, images["id"] == n["image_id"], "left").withColumn("tag_count", F.coalesce("_n", F.lit(0))).drop("_n", "image_id")


def having_all(images: DataFrame, links: DataFrame, column: str, n: int) -> DataFrame:
    """Images whose rows of ``links`` (``image_id``) have ``n`` different values of ``column``."""
    full = links.groupBy("image_id").agg(F.count_distinct(column).alias("_n")).where(F.col("_n") == n)
    return images.join(full, images["id"] == full["image_id"], "left_semi")


def dashboard(images: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """One row: files, images, videos, bytes, hash coverage in percent, groups, members, unreviewed groups, bytes that are not primary."""
    from .duplicates import redundant

    hashed = F.count_if(F.coalesce("dhash", F.lit("")) != "")
    i = images.agg(F.count("*").alias("total"), F.count_if(F.col("file_type") == "image").alias("n_images"), F.count_if(F.col("file_type") == "video").alias("n_videos"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.round(F.coalesce(100.0 * hashed / F.count("*"), F.lit(0.0)), 1).alias("hash_coverage"))
    g = redundant(groups, members, images).agg(F.count_distinct("group_id").alias("n_groups"), F.count("image_id").alias("n_duplicates"), F.count_distinct(F.when(~F.col("reviewed"), F.col("group_id"))).alias("needs_review"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("savings"))
    return i.join(F.broadcast(g))  # one row each


def counters(images: DataFrame, tags: DataFrame, groups: DataFrame) -> DataFrame:
    """``n, bytes, n_tags, n_groups``."""
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    return images.agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).join(one(tags, "n_tags")).join(one(groups, "n_groups"))


def snapshot(images: DataFrame, phase: str) -> DataFrame:
    """One row for a table of snapshots: files and bytes at a phase."""
    return images.agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).withColumn("phase", F.lit(phase))


def scan_statistics(images: DataFrame, samples: int = 50, width: int = 200) -> DataFrame:
    """``files, bytes, largest, samples``: the largest file's path and the first paths of unknown type, cut to ``width``."""
    total = images.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max_by("source_path", F.struct("size_bytes", "id")).alias("largest"))
    bad = images.where("file_type = 'unknown'").select("source_path").orderBy("source_path").limit(samples)
    return total.join(F.broadcast(bad.agg(F.array_sort(F.collect_list(F.substring("source_path", 1, width))).alias("samples"))))


def cache_statistics(files: DataFrame, cap: float) -> DataFrame:
    """``n, bytes, used``: percent of ``cap`` in use."""
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).withColumn("used", F.round(100.0 * F.col("bytes") / cap, 2))


def evicted(files: DataFrame, cap: float, share: float = 0.9) -> DataFrame:
    """Files to delete, oldest access (``created_at``, then id) first, until at most ``share`` of ``cap`` is in use; none up to ``cap``."""
    from .ordered import sum_before

    total = files.agg(F.sum("size_bytes").alias("_total"))
    f = sum_before(files, ["created_at", "id"], F.col("size_bytes"), "_before").join(F.broadcast(total))  # one row
    return f.where((F.col("_total") > cap) & (F.col("_total") - F.col("_before") > share * cap)).drop("_total", "_before")
