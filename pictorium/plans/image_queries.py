"""Listings, facets, timelines, maps, statistics and scalar functions over images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, geo, hashing, quality, text
from ..operators import images as I
from ..operators.images import ImageFilter
from .registry import add

GPS = "(latitude is not null and longitude is not null and latitude <> 0 and longitude <> 0)"
FILTERS = {
    "f01_catalog": (ImageFilter(catalog_id=1), "catalog_id = 1"),
    "f02_path": (ImageFilter(path="SRC1/img_0000_"), "source_path ilike '%SRC1/img_0000_%'"),
    "f03_type": (ImageFilter(file_type="video"), "file_type = 'video'"),
    "f04_camera": (ImageFilter(camera_make="en", camera_model="src3", lens="L1"), "camera_make = 'en' and camera_model = 'src3' and lens_model = 'L1'"),
    "f05_focal": (ImageFilter(focal_length=24), "round(focal_length::decimal(20, 6)) = 24"),
    "f06_aperture": (ImageFilter(aperture=2.8), "aperture = 2.8"),
    "f07_gps": (ImageFilter(has_gps=True), GPS),
    "f07_no_gps": (ImageFilter(has_gps=False), f"not {GPS}"),
    "f08_dates": (ImageFilter(date_from="2021-02-03", date_to="2022-05-06"), "selected_date >= '2021-02-03' and selected_date <= '2022-05-06'"),
    "f09_size": (ImageFilter(min_width=3000, min_height=2000), "width >= 3000 and height >= 2000"),
    "f26_status": (ImageFilter(status="rejected", min_width=0), "status_id = 'rejected'"),
}
for _name, (_f, _where) in FILTERS.items():
    add(_name, lambda v, f=_f: I.select_images(v.images, f).select("id", "source_path"), f"select id, source_path from images where {_where}")

ORDERS = {"date": "selected_date {} nulls last", "filename": "source_path {}", "size": "size_bytes {}", "camera": "camera_make {} nulls last, camera_model {} nulls last", "created_at": "created_at {}"}
for _key, _order in ORDERS.items():
    for _desc in (True, False):
        _word = "desc" if _desc else "asc"
        add(f"o01_{_key}_{_word}", lambda v, k=_key, d=_desc: I.page(v.images, ImageFilter(catalog_id=1), k, d, 20, 10).select("id"), f"select id from images where catalog_id = 1 order by {_order.format(_word, _word)}, id limit 20 offset 10")
add("o02_count", lambda v: I.select_images(v.images, FILTERS["f08_dates"][0]).agg(F.count("*").alias("total")), f"select count(*) as total from images where {FILTERS['f08_dates'][1]}")

add("f10_has_tags", lambda v: I.with_tags(v.images, v.image_tags, True).select("id"), "select id from images where exists (select 1 from image_tags t where t.image_id = id)")
add("f10_no_tags", lambda v: I.with_tags(v.images, v.image_tags, False).select("id"), "select id from images where not exists (select 1 from image_tags t where t.image_id = id)")
_EN = "select tag_id from tags where category like 'Brand#1%'"
add("f11_any_tag", lambda v: I.any_tag(v.images, v.image_tags, v.tags.withColumn("name", F.substring("category", 1, 7)), ["Brand#1"]).select("id"), f"select id from images where id in (select image_id from image_tags where tag_id in ({_EN}))")
add("f11_all_tags", lambda v: I.all_tags(v.images, v.image_tags, v.tags.withColumn("name", F.col("category")), ["Brand#11", "Brand#12"]).select("id"), "select id from images where (select count(distinct category) from image_tags join tags using (tag_id) where image_id = id and category in ('Brand#11', 'Brand#12')) = 2")
add("f13_near", lambda v: I.near(v.images, 10.0, 20.0, 3000.0).select("id"), "select id from images where latitude between 10 - 3000 / 111.0 and 10 + 3000 / 111.0 and longitude between 20 - 3000 / (111.0 * abs(cos(radians(10))) + 0.001) and 20 + 3000 / (111.0 * abs(cos(radians(10))) + 0.001)")
add("f14_view", lambda v: I.in_view(v.images, -20.0, 40.0, -100.0, 50.0).select("id"), "select id from images where latitude between -20 and 40 and longitude between -100 and 50")
add("f14_view_zero", lambda v: I.in_view(v.images, 0.0, 40.0, -100.0, 50.0).select("id"), "select id from images")
add("f16_burst_input", lambda v: I.surely_dated(v.images).select("id"), "select id from images where confidence >= 70 and selected_date is not null")
_VALID = "file_type = 'image' and burst_id is null and dhash is not null and dhash <> '' and dhash <> '0000000000000000' and ahash is not null and ahash <> '' and whash is not null and whash <> ''"
add("f17_valid_hash", lambda v: I.comparable(v.images).select("id"), f"select id from images where {_VALID}")
add("f18_needs_hash", lambda v: I.lacking(v.images, "dhash").select("id"), "select id from images where dhash is null or dhash = ''")
add("f19_untagged", lambda v: I.with_tags(v.images.where("file_type = 'image'"), v.image_tags, False).orderBy("id").limit(25).select("id"), "select id from images where file_type = 'image' and id not in (select image_id from image_tags) order by id limit 25")
add("f20_undescribed", lambda v: I.lacking(v.images, "description").select("id"), "select id from images where description is null or description = ''")
add("f21_needs_quality", lambda v: I.lacking(v.images, "quality_score").select("id"), "select id from images where quality_score is null")
add("f33_db_status", lambda v: v.images.select("id", I.database_status(F.col("status_id")).alias("db")), "select id, case when status_id = 'archived' then 'archived' else 'active' end as db from images")
add("f34_needs_preview", lambda v: v.images.where(text.extension(F.col("source_path")).isin(".cr2", ".heic")).join(v.image_tags, F.col("id") == F.col("image_id"), "left_anti").select("id"), "select id from images where lower(regexp_extract(source_path, '(\\.[^./]+)$', 1)) in ('.cr2', '.heic') and id not in (select image_id from image_tags)")
add("f36_placeholder", lambda v: v.images.select("id", text.without_placeholder((F.col("iso") - 60).cast("string")).alias("v")), "select id, case when (iso - 60)::varchar in ('0', '65535', '255', '40', 'Unknown', 'unknown', '') then null else (iso - 60)::varchar end as v from images")

add("a01_catalog_stats", lambda v: I.catalog_stats(v.images), "select count(*) as total, count(*) filter (where file_type = 'image') as n_images, count(*) filter (where file_type = 'video') as n_videos, coalesce(sum(size_bytes), 0)::bigint as total_bytes, round(coalesce(sum(size_bytes), 0)::double / 1073741824, 2) as total_gb, min(created_at)::varchar as first_added, max(created_at)::varchar as last_added from images")
for _c in ("camera_make", "camera_model", "lens_model", "focal_length", "aperture", "file_type"):
    add(f"a02_facet_{_c}", lambda v, c=_c: I.facet(v.images, c), f"select {_c} as value, count(*) as n from images where {_c} is not null group by 1")
add("a02_ranges", lambda v: v.images.agg(F.min("selected_date").cast("string").alias("first"), F.max("selected_date").cast("string").alias("last"), F.count_if(geo.has_gps(F.col("latitude"), F.col("longitude"))).alias("n_gps")), f"select min(selected_date)::varchar as first, max(selected_date)::varchar as last, count(*) filter (where {GPS}) as n_gps from images")
add("a05_grid", lambda v: I.grid_clusters(v.images, 10.0), f"select floor(latitude / 10)::bigint as cy, floor(longitude / 10)::bigint as cx, count(*) as n, round(avg(latitude), 6) as lat, round(avg(longitude), 6) as lon from images where {GPS} group by 1, 2 order by n desc, cy, cx limit 1000")


def geohash_sql(precision: int) -> str:
    bits = 5 * precision
    lon, lat = (bits + 1) // 2, bits // 2
    cell = lambda x, low, width, n: f"least({(1 << n) - 1}, floor(({x} - {low}) / {width} * {1 << n}))::bigint"
    a, b = cell("longitude", "-180e0", "360e0", lon), cell("latitude", "-90e0", "180e0", lat)
    letter = lambda c: f"substr('{geo.BASE32}', 1 + ({' + '.join(f'(({a if (5 * c + k) % 2 == 0 else b}) >> {(lon if (5 * c + k) % 2 == 0 else lat) - 1 - (5 * c + k) // 2}) % 2 * {1 << (4 - k)}' for k in range(5))})::integer, 1)"
    return " || ".join(letter(c) for c in range(precision))


for _p in (4, 6):
    add(f"a04_geohash_{_p}", lambda v, p=_p: I.geohash_clusters(v.images, p), f"select {geohash_sql(_p)} as geohash, count(*) as n, round(avg(latitude), 6) as lat, round(avg(longitude), 6) as lon from images where {GPS} group by 1 order by n desc, geohash limit 1000")
add("x34_geohash", lambda v: v.images.select("id", geo.geohash(F.col("latitude"), F.col("longitude"), 7).alias("geohash")), f"select id, case when latitude is not null then {geohash_sql(7)} end as geohash from images")
add("f12_geohash_prefix", lambda v: v.images.where(geo.geohash(F.col("latitude"), F.col("longitude"), 4).startswith("s")).select("id"), f"select id from images where latitude is not null and starts_with({geohash_sql(4)}, 's')")
add("s34_backfill_geohash", lambda v: v.images.where(geo.has_gps(F.col("latitude"), F.col("longitude"))).select("id", F.to_json(F.struct("id", geo.geohash(F.col("latitude"), F.col("longitude"), 7).alias("geohash"))).alias("metadata")), f"""select id, '{{"id":' || id || ',"geohash":"' || {geohash_sql(7)} || '"}}' as metadata from images where {GPS}""")
for _u in ("day", "week", "month", "year"):
    add(f"a06_timeline_{_u}", lambda v, u=_u: I.timeline(v.images, u, 2025).withColumn("bucket", F.col("bucket").cast("string")), f"select date_trunc('{_u}', selected_date)::timestamp::varchar as bucket, count(*) as n, count(*) filter (where {GPS}) as n_gps from images where selected_date between '1900-01-01' and '2026-12-31' group by 1")
add("a13_quality_bands", lambda v: v.images.where("quality_score is not null").groupBy(quality.bands(F.col("quality_score")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("quality_score")).cast("int").alias("average")), "select case when quality_score >= 80 then 'excellent' when quality_score >= 60 then 'good' when quality_score >= 40 then 'fair' else 'poor' end as band, count(*) as n, round(avg(quality_score))::int as average from images where quality_score is not null group by 1")
_MB = 1024 * 1024
add("a14_size_buckets", lambda v: v.images.groupBy(I.size_bucket(F.col("size_bytes")).alias("bucket")).agg(F.count("*").alias("n")), f"select case when size_bytes < {_MB} then '< 1 MB' when size_bytes < {5 * _MB} then '1-5 MB' when size_bytes < {10 * _MB} then '5-10 MB' when size_bytes < {20 * _MB} then '10-20 MB' when size_bytes < {50 * _MB} then '20-50 MB' else '> 50 MB' end as bucket, count(*) as n from images group by 1")
add("a14_by_year", lambda v: v.images.where("selected_date is not null").groupBy(F.year("selected_date").alias("year")).agg(F.count("*").alias("n")), "select year(selected_date)::int as year, count(*) as n from images where selected_date is not null group by 1")
add("a15_dashboard", lambda v: I.dashboard(v.images, v.groups, v.members), "select *, (select count(*) from groups) as n_groups, (select count(*) from members) as n_duplicates, (select count(*) from groups where not reviewed) as needs_review, (select coalesce(sum(size_bytes), 0)::bigint from members m join groups g using (group_id) join images i on i.id = m.image_id and i.id <> g.primary_image_id) as savings from (select count(*) as total, count(*) filter (where file_type = 'image') as n_images, count(*) filter (where file_type = 'video') as n_videos, sum(size_bytes)::bigint as bytes, round(100.0::double * count(*) filter (where dhash <> '') / count(*), 1) as hash_coverage from images)")
add("a16_counts", lambda v: I.counts(v.images), "select count(*) as total, count(*) filter (where file_type = 'image') as n_images, count(*) filter (where file_type = 'video') as n_videos, count(*) filter (where selected_date is null) as no_date, count(*) filter (where selected_date is null or width < 1000) as problematic from images")
add("a20_counters", lambda v: I.counters(v.images, v.tags, v.groups), "select (select count(*) from images) as n, (select sum(size_bytes)::bigint from images) as bytes, (select count(*) from tags) as n_tags, (select count(*) from groups) as n_groups")
add("a22_largest", lambda v: v.images.groupBy("file_type").agg(F.max_by("id", F.struct("size_bytes", -F.col("id"))).alias("largest"), F.sum("size_bytes").alias("bytes")), "select file_type, arg_max(id, size_bytes * 1000000000 - id) as largest, sum(size_bytes)::bigint as bytes from images group by 1")

_MPX = "(width * height / 1e6)"
add("x17_format", lambda v: v.images.select("id", quality.format_score(F.col("format")).alias("s")), "select id, case format when 'CR2' then 100 when 'PNG' then 85 when 'HEIC' then 80 when 'JPEG' then 70 else 50 end as s from images")
_RES = f"case when {_MPX} >= 33 then 100 when {_MPX} >= 20 then 90 + ({_MPX} - 20) / 13 * 10 when {_MPX} >= 8 then 80 + ({_MPX} - 8) / 12 * 10 when {_MPX} >= 2 then 60 + ({_MPX} - 2) / 6 * 20 when {_MPX} >= 1 then 40 + ({_MPX} - 1) * 20 else {_MPX} * 40 end"
add("x18_resolution", lambda v: v.images.select("id", F.round(quality.resolution_score(F.col("width"), F.col("height")), 6).alias("s")), f"select id, round({_RES}, 6) as s from images")
_SZ = "(size_bytes / 1048576e0)"
_SIZE = f"case when size_bytes <= 0 then 0 when format = 'CR2' then case when {_SZ} >= 50 then 100 when {_SZ} >= 20 then 80 + ({_SZ} - 20) / 30 * 20 else {_SZ} / 20 * 80 end when {_SZ} >= 10 then 100 when {_SZ} >= 2 then 70 + ({_SZ} - 2) / 8 * 30 when {_SZ} >= 0.5 then 40 + ({_SZ} - 0.5) / 1.5 * 30 else {_SZ} / 0.5 * 40 end"
add("x19_size", lambda v: v.images.select("id", F.round(quality.size_score(F.col("size_bytes"), F.col("format")), 6).alias("s")), f"select id, round(({_SIZE})::double, 6) as s from images")
_FIELDS = [(w, c) for c, w in quality.METADATA_WEIGHTS.items()]
_META = " + ".join(f"case when {c} is not null then {w} else 0 end" for w, c in _FIELDS if c != "shutter_speed")
add("x20_completeness", lambda v: v.images.select("id", quality.completeness([(w, F.col(c).isNotNull() if c != "shutter_speed" else F.lit(False)) for w, c in _FIELDS]).alias("s")), f"select id, ({_META})::double as s from images")
add(
    "x21_overall",
    lambda v: v.images.select("id", F.floor(quality.overall(quality.format_score(F.col("format")), quality.resolution_score(F.col("width"), F.col("height")), quality.size_score(F.col("size_bytes"), F.col("format")), quality.completeness([(w, F.col(c).isNotNull() if c != "shutter_speed" else F.lit(False)) for w, c in _FIELDS]))).cast("int").alias("s")),
    f"select id, floor(round(0.40 * case format when 'CR2' then 100 when 'PNG' then 85 when 'HEIC' then 80 when 'JPEG' then 70 else 50 end + 0.35 * ({_RES}) + 0.15 * ({_SIZE})::double + 0.10 * ({_META}), 2))::int as s from images",
)
add("x29_suspicious", lambda v: v.images.where(dates.suspicious(F.col("selected_date"), F.lit("2023-06-01").cast("timestamp_ntz"))).select("id"), "select id from images where selected_date > '2023-06-01' or year(selected_date) < 1990 or strftime(selected_date, '%Y-%m-%d') in ('2000-01-01', '1970-01-01', '1980-01-01')")
add("x40_bytes", lambda v: v.images.select("id", text.format_bytes(F.col("size_bytes")).alias("s")), "select id, case when size_bytes <= 0 then '0 B' when size_bytes < 1024 then format('{:.2f} B', size_bytes::double) when size_bytes < 1048576 then format('{:.2f} KB', size_bytes / 1024e0) when size_bytes < 1073741824 then format('{:.2f} MB', size_bytes / 1048576e0) else format('{:.2f} GB', size_bytes / 1073741824e0) end as s from images")
add("x40_safe_name", lambda v: v.images.select("id", text.safe_filename(F.concat(F.lit(". "), F.col("source_path"), F.lit("?. "))).alias("s")), "select id, trim(regexp_replace('. ' || source_path || '?. ', '[<>:\"/\\\\|?*]', '_', 'g'), '. ') as s from images")
add("x41_camera_key", lambda v: v.images.select("id", text.camera_key(F.col("camera_make"), F.col("camera_model")).alias("k")), "select id, coalesce(nullif(camera_make, ''), 'unknown') || ':' || coalesce(nullif(camera_model, ''), 'unknown') as k from images")
add("x02_hex_hamming", lambda v: v.images.select("id", hashing.hex_hamming(F.col("dhash"), F.col("ahash"), F.lit(999)).alias("d")), "select id, coalesce(case when length(dhash) = length(ahash) and length(dhash) = 16 then bit_count(xor(('0x' || dhash)::ubigint, ('0x' || ahash)::ubigint)) end, 999)::int as d from images")
add("x03_video_hamming", lambda v: v.images.select("id", hashing.hex_hamming(F.nullif("dhash", F.lit("")), F.col("whash"), F.lit(None).cast("int")).alias("d")), "select id, case when length(dhash) = 16 then bit_count(xor(('0x' || dhash)::ubigint, ('0x' || whash)::ubigint)) end::int as d from images")
add("x05_similarity", lambda v: v.images.select("id", hashing.similarity_percent(hashing.hex_hamming(F.col("dhash"), F.col("ahash"), F.lit(None).cast("int"))).alias("s")), "select id, coalesce((1 - case when length(dhash) = 16 and ahash is not null then bit_count(xor(('0x' || dhash)::ubigint, ('0x' || ahash)::ubigint)) end / 64.0::double) * 100, 0) as s from images")
add("x31_shutter", lambda v: v.images.select("id", text.shutter_speed(F.when(F.col("id") % 4 == 0, 0.0).when(F.col("id") % 4 == 1, 2.0).when(F.col("id") % 4 == 2, 1.5).otherwise(1.0 / (F.col("id") + 1))).alias("s")), "select id, case id % 4 when 0 then null when 1 then '2s' when 2 then '1.5s' else '1/' || (id + 1) end as s from images")
add("x35_haversine", lambda v: v.images.where("latitude is not null").select("id", F.round(geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(10.0), F.lit(20.0)), 2).alias("m")), "select id, round(2 * 6371000 * atan2(sqrt(pow(sin(radians(10 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(10)) * pow(sin(radians(20 - longitude) / 2), 2)), sqrt(1 - (pow(sin(radians(10 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(10)) * pow(sin(radians(20 - longitude) / 2), 2)))), 2) as m from images where latitude is not null")
add("x26_name_date", lambda v: v.images.select("id", dates.name_date(F.concat(F.lit("/x/IMG_"), F.date_format("selected_date", "yyyyMMdd"), F.lit(".jpg"))).cast("string").alias("d")), "select id, date_trunc('day', selected_date)::timestamp::varchar as d from images")
_DATED = "case id % 6 when 0 then '/p/' || {ym} || '/a/x.jpg' when 1 then '/p/Trip ' || {ym} || '/a.jpg' when 2 then '/p/x/IMG_' || {ymd} || '.jpg' when 3 then '/Summer' || {y} || '/b.jpg' when 4 then '/p/' || {y} || '-13/1234-05/c9999.jpg' else '/p/no/date.jpg' end"
_PART = "case when try_cast(regexp_extract(x, '(\\d{4})-(\\d{2})', 1) as int) between 1900 and 2100 and try_cast(regexp_extract(x, '(\\d{4})-(\\d{2})', 2) as int) between 1 and 12 then regexp_extract(x, '(\\d{4})-(\\d{2})', 0) when try_cast(regexp_extract(x, '\\d{4}') as int) between 1900 and 2100 then regexp_extract(x, '\\d{4}') end"
add("x27_directory_date", lambda v: v.images.select("id", dates.directory_date(F.expr(_DATED.format(ym="date_format(selected_date, 'yyyy-MM')", ymd="date_format(selected_date, 'yyyy-MM-dd')", y="date_format(selected_date, 'yyyy')"))).alias("d")), "select id, list_filter(list_transform(list_reverse(string_split(" + _DATED.format(ym="strftime(selected_date, '%Y-%m')", ymd="strftime(selected_date, '%Y-%m-%d')", y="strftime(selected_date, '%Y')") + ", '/')), lambda x: " + _PART + "), lambda y: y is not null)[1] as d from images")
