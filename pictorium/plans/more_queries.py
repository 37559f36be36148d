"""Remaining sources, views, scalars and job queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, geo, hashing, quality, text
from ..operators import bursts as B
from ..operators import duplicates as D
from ..operators import images as I
from ..operators import jobs as J
from ..operators import organize as R
from ..operators import tags as T
from ..sources import storage as S
from .registry import add

_AT = lambda: F.lit("1995-06-17 00:00:00").cast("timestamp_ntz")

# sources and mutations
add("s02_discovery_counts", lambda v: S.discover(v.images.select(F.concat(F.when(F.col("id") % 9 == 0, "/@eaDir").otherwise(""), "source_path").alias("path"))).agg(F.count_if(F.col("reason") == "synology").alias("synology"), F.count_if(F.col("reason").isNull()).alias("media")), "select count(*) filter (where id % 9 = 0) as synology, count(*) filter (where id % 9 <> 0 and source_path not like '%.txt') as media from images")
add("s03_incremental", lambda v: v.images.where(text.extension(F.col("source_path")).isin(".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".heic", ".raw", ".mp4", ".mov", ".avi", ".mkv")).select("id"), "select id from images where lower(regexp_extract(source_path, '(\\.[^./]+)$', 1)) in ('.jpg', '.png', '.heic', '.mp4')")
_NAMED = "'/d/IMG_' || {d} || '.jpg'"
add("s07_records", lambda v: v.images.where("file_type <> 'unknown'").select("id", "checksum", text.file_type(F.col("source_path")).alias("t"), dates.name_date(F.expr(_NAMED.format(d="date_format(selected_date, 'yyyyMMdd')"))).cast("string").alias("d")), "select id, checksum, file_type as t, date_trunc('day', selected_date)::timestamp::varchar as d from images where file_type <> 'unknown'")
add("s09_merge", lambda v: S.merge_incomplete(v.images.where("id < 200").groupBy("checksum").agg(F.min("quality_score").alias("quality_score"), (F.min("id") % 2 == 0).alias("hashed")), v.images.where("id >= 200").groupBy("checksum").agg(F.max("quality_score").alias("quality_score"), F.lit(True).alias("hashed")), ["quality_score"], ["hashed"]), "select a.checksum, coalesce(a.q, b.q) as quality_score, a.h or coalesce(b.h, false) as hashed from (select checksum, min(quality_score) as q, min(id) % 2 = 0 as h from images where id < 200 group by 1) a left join (select checksum, max(quality_score) as q, true as h from images where id >= 200 group by 1) b using (checksum)")
add("s12_by_id", lambda v: I.by_id(v.images, 42).select("id", "checksum"), "select id, checksum from images where id = 42")
add("s13_update", lambda v: S.updated(v.images.select("id", "status_id", "quality_score"), v.images.where("id % 4 = 1").select("id", F.lit("active").alias("status_id")), "id", ["status_id"]), "select id, case when id % 4 = 1 then 'active' else status_id end as status_id, quality_score from images")
add("s19_replace_groups", lambda v: v.pairs.groupBy(F.col("image_1").alias("group_id")).agg(F.min("a_distance").alias("d")).select("group_id", D.as_percent(F.when(F.col("group_id") % 2 == 0, (100 - F.col("d")) / 100.0).otherwise((100 - F.col("d")).cast("double"))).alias("confidence")), "select image_1 as group_id, floor(case when image_1 % 2 = 0 then (100 - min(a_distance)) / 100.0::double * 100 else 100 - min(a_distance) end)::int as confidence from pairs group by 1")
add("s26_corruption", lambda v: v.images.select(text.corruption_severity(F.when(F.col("id") % 3 == 0, "image file is Truncated (3 bytes)").when(F.col("id") % 3 == 1, "broken data stream when reading").otherwise("cannot identify")).alias("severity")).groupBy("severity").agg(F.count("*").alias("n")), "select case id % 3 when 0 then 'minor' when 1 then 'moderate' else 'severe' end as severity, count(*) as n from images group by 1")
add("s28_previews", lambda v: v.images.where((F.col("file_type") == "image") & text.extension(F.col("source_path")).isin(".cr2", ".nef", ".arw", ".dng", ".heic", ".heif", ".tif", ".tiff")).join(v.images.where("id % 5 = 0").select("checksum"), "checksum", "left_anti").select("id"), "select id from images where file_type = 'image' and (source_path like '%.CR2' or source_path like '%.heic') and checksum not in (select checksum from images where id % 5 = 0)")
add("s29_json_round_trip", lambda v: S.deserialised(S.serialised(v.images, "id", ["width", "height", "camera_make"]), "id", "width long, height long, camera_make string"), "select id, width, height, camera_make from images")
add("s30_catalogs", lambda v: S.catalogs(v.images.where("catalog_id <> 1")), "select catalog_id, count(*) as n from images where catalog_id <> 1 group by 1")
add("s32_snapshot", lambda v: I.snapshot(v.images, "scan").unionByName(I.snapshot(v.images.where("file_type = 'image'"), "images")), "select count(*) as n, sum(size_bytes)::bigint as bytes, 'scan' as phase from images union all select count(*), sum(size_bytes)::bigint, 'images' from images where file_type = 'image'")
add("s35_migrate_pairs", lambda v: v.pairs.hint("merge").join(v.jobs, F.col("image_1") == F.col("job_id")).select(F.greatest("image_1", "image_2").alias("hi"), F.least("image_1", "image_2").alias("lo"), "job_type"), "select greatest(image_1, image_2) as hi, least(image_1, image_2) as lo, job_type from pairs join jobs on image_1 = job_id")
add("s36_backfill", lambda v: v.images.select("id", S.first_directory(F.col("lens_model"), F.array("camera_make", "camera_model")).alias("d")), "select id, coalesce(lens_model, [camera_make, camera_model][1], '-') as d from images")

# filters, joins, sorts
add("f15_realistic", lambda v: I.plausibly_dated(v.images, 2021).select("id"), "select id from images where selected_date between '1900-01-01' and '2022-12-31'")
_PROBLEM = "case when selected_date is null then 'no_date' when width < 1000 then 'small' end"
add("f27_problems", lambda v: I.problems(v.images).select("id", "category"), f"select id, {_PROBLEM} as category from images where {_PROBLEM} is not null")
_QUEUE = "select id, case when confidence < 30 then 'low_confidence' when selected_date is null then 'no_date' end as reason, 100 - confidence as priority, created_at from images where confidence < 30 or selected_date is null"
add("f28_review_queue", lambda v: I.review_view(I.review_queue(v.images), v.images).select("id", "reason", "detail"), f"select q.id, reason, case reason when 'low_confidence' then confidence::varchar else source_path end as detail from ({_QUEUE}) q join images using (id)")
add("j18_review_view", lambda v: I.review_counts(I.review_queue(v.images)), f"select reason, count(*) as n from ({_QUEUE}) group by 1")
add("o08_review_order", lambda v: I.review_page(I.review_queue(v.images), 25).select("id", "priority"), f"select id, priority from ({_QUEUE}) order by priority desc, created_at limit 25")
add("f31_prefix", lambda v: J.settings(v.jobs.select(F.concat(F.lit("job_timing_"), "job_type").alias("key"), "job_id"), "job_timing_s"), "select 'job_timing_' || job_type as key, job_id from jobs where starts_with(job_type, 's')")
add("f35_reorganize", lambda v: R.plan(v.images, "/photos/src1").where("action = 'copy'").select("id"), "select id from images where selected_date is not null and not starts_with(source_path, '/photos/src1/')")
add("j03_semi", lambda v: B.with_images(v.bursts, v.images.where("status_id = 'active'")).select("burst_id"), "select burst_id from bursts b where exists (select 1 from images i where i.burst_id = b.burst_id and status_id = 'active')")
add("j04_anti", lambda v: I.with_tags(v.images, v.image_tags.where("confidence > 0.8"), False).select("id"), "select id from images where id not in (select image_id from image_tags where confidence > 0.8)")
add("j05_all_sources", lambda v: I.having_all(v.images, v.image_tags, "source", 3).select(F.col("id").alias("image_id")), "select id as image_id from images where (select count(distinct source) from image_tags t where t.image_id = id) = 3")
add("j07_theta", lambda v: D.redundant(v.groups, v.members, v.images).select("group_id", "image_id", "size_bytes"), "select g.group_id, m.image_id, i.size_bytes from groups g left join members m on g.group_id = m.group_id left join images i on m.image_id = i.id and i.id <> g.primary_image_id")
add("j19_tag_count_view", lambda v: I.tag_counts(v.images, v.image_tags).select("id", F.col("tag_count").alias("n")), "select id, count(t.tag_id) as n from images left join image_tags t on t.image_id = id group by 1")
add("o03_legacy", lambda v: I.former_page(v.images, limit=40).select("id"), "select id from images order by selected_date desc nulls last, id limit 40")

# aggregations
add("a17_severity", lambda v: v.images.groupBy(text.corruption_severity(F.when(F.col("id") % 5 == 0, "truncated").otherwise("x")).alias("severity")).agg(F.count("*").alias("n")), "select case when id % 5 = 0 then 'minor' else 'severe' end as severity, count(*) as n from images group by 1")
add("a25_scan", lambda v: I.scan_statistics(v.images, 5).withColumn("samples", F.array_join("samples", ",")), "select count(*) as files, sum(size_bytes)::bigint as bytes, arg_max(source_path, size_bytes * 1000000000 + id) as largest, array_to_string(list_sort(list(source_path) filter (where file_type = 'unknown'))[1:5], ',') as samples from images")
add("a27_history", lambda v: I.run_history(v.jobs.select(F.col("job_id").alias("at"), (F.col("job_id") % 13).alias("rate")), "at", "rate"), "with r as (select job_id % 13 as rate, row_number() over (order by job_id desc) as r from jobs qualify r <= 10) select count(*) as runs, round(avg(rate), 6) as mean, round(max(rate) filter (where r = 1) - avg(rate) filter (where r <= 5), 6) as trend from r")
add("a28_chord", lambda v: J.monitor(v.jobs, _AT()), "select count(*) filter (where status = 'SUCCESS') as ok, count(*) filter (where status = 'FAILURE') as failed, count(*) filter (where status not in ('SUCCESS', 'FAILURE')) as remaining, (count(*) filter (where status = 'SUCCESS') * 100 // count(*))::int as percent from jobs where updated_at >= '1995-06-17'")
add("a29_transactions", lambda v: J.transaction_states(v.batches, "parent_job_id"), "select parent_job_id, count(*) as operations, count(*) filter (where status = 'COMPLETED') as completed, count(*) filter (where status = 'FAILED') as failed, bool_and(status = 'COMPLETED') as is_complete, bool_or(status = 'FAILED') as has_failures from batches group by 1")
add("a31_imports", lambda v: v.batches.groupBy("parent_job_id").agg(F.round(100.0 * F.sum("processed_count") / F.sum("items_count"), 2).alias("percent"), (dates.seconds(F.max("started_at")) - dates.seconds(F.min("started_at"))).alias("seconds")), "select parent_job_id, round(100.0::double * sum(processed_count) / sum(items_count), 2) as percent, (epoch(max(started_at)) - epoch(min(started_at)))::bigint as seconds from batches group by 1")
add("a32_cache", lambda v: I.cache_statistics(v.images, 1e10), "select count(*) as n, sum(size_bytes)::bigint as bytes, round(100.0::double * sum(size_bytes) / 1e10, 2) as used from images")
add("a33_histogram", lambda v: I.histogram(v.variants, "px", -4.0, 4.0), "select image_id, least(255, greatest(0, floor((x + 4) / 8 * 256)))::int as bin, count(*) as n from (select image_id, unnest(px) as x from variants) group by 1, 2")

# windows, sets, scalars
add("w03_names", lambda v: v.images.select("id", B.name_follows(F.col("source_path"), F.concat(F.lit("/z/IMG_"), F.lpad((F.col("id") - F.col("id") % 9).cast("string"), 6, "0"), F.lit(".jpg"))).alias("follows")), "select id, id % 9 <= 5 as follows from images")
add("w12_config", lambda v: S.latest(v.jobs.select(F.concat(F.lit("job_timing_"), "job_type").alias("key"), "job_id", "updated_at"), ["key"], ["updated_at", "job_id"]).select("key", "job_id"), "select 'job_timing_' || job_type as key, job_id from jobs qualify row_number() over (partition by job_type order by updated_at desc, job_id desc) = 1")
_METHODS = lambda c, k: F.filter(F.array(F.lit("ahash"), F.lit("dhash"), F.lit("whash")), lambda m, i: (c + i) % k != 0)
add("u03_common_methods", lambda v: v.images.select("id", F.array_join(hashing.common_methods(_METHODS(F.col("id"), 3), _METHODS(F.col("id"), 2)), ",").alias("m")), "select id, array_to_string(list_filter(['ahash', 'dhash', 'whash'], lambda m, i: (id + i - 1) % 3 <> 0 and (id + i - 1) % 2 <> 0), ',') as m from images")
add("u05_new_hashes", lambda v: D.absent(v.hashes.where("image_id % 3 = 0").select("image_id"), v.hashes.where("image_id % 4 = 0"), "image_id"), "select image_id from hashes where image_id % 3 = 0 and image_id % 4 <> 0")
_OVERLAP = lambda v: v.images.where("id % 100 < 37").select(F.floor(F.col("id") / 10).alias("group_id"), F.col("id").alias("image_id")).unionByName(v.images.where("id % 100 < 37").select((F.floor((F.col("id") + 5) / 10) + 1_000_000_000).alias("group_id"), F.col("id").alias("image_id")))
add("u06_merge", lambda v: D.merge_groups(_OVERLAP(v)).select("image_id", "component"), "select id as image_id, min(id) over (partition by id // 100) as component from images where id % 100 < 37")
add("x01_hamming", lambda v: v.images.where(F.length("dhash") == 16).select("id", hashing.hamming(hashing.from_hex(F.col("dhash")), hashing.from_hex(F.col("whash"))).alias("d")), "select id, bit_count(xor(('0x' || dhash)::ubigint, ('0x' || whash)::ubigint))::int as d from images where length(dhash) = 16")
add("x04_script_hamming", lambda v: v.images.select("id", F.coalesce(hashing.hamming(hashing.from_hex(F.nullif("dhash", F.lit(""))), hashing.from_hex(F.col("ahash"))), F.lit(999)).alias("d")), "select id, coalesce(case when length(dhash) = 16 then bit_count(xor(('0x' || dhash)::ubigint, ('0x' || ahash)::ubigint)) end, 999)::int as d from images")
add("x06_similar", lambda v: v.pairs.select("image_1", "image_2", (F.col("a_distance") <= 3).alias("s")), "select image_1, image_2, a_distance <= 3 as s from pairs")
add("x08_best", lambda v: v.pairs.select("image_1", "image_2", F.array_min(F.array(F.struct(F.col("a_distance").alias("d"), F.lit("ahash").alias("m")), F.struct(F.col("d_distance").alias("d"), F.lit("dhash").alias("m"))))["m"].alias("best")), "select image_1, image_2, case when a_distance <= d_distance then 'ahash' else 'dhash' end as best from pairs")
add("x09_thresholds", lambda v: v.table("region").select("r_regionkey", hashing.recommended_threshold(F.try_element_at(F.array(*map(F.lit, ("dhash", "ahash", "whash", "phash"))), F.col("r_regionkey").cast("int") + 1)).alias("t")), "select r_regionkey, case r_regionkey when 0 then 5 when 1 then 6 when 2 then 4 else 5 end as t from region")
add("x10_hex", lambda v: v.images.select("id", hashing.to_hex(F.col("id") * 1_000_003).alias("h")), "select id, lpad(lower(to_hex(id * 1000003)), 16, '0') as h from images")
add("x14_combined", lambda v: v.hashes.select("image_id", F.concat(hashing.to_hex(F.col("ahash")), hashing.to_hex(F.col("dhash"))).alias("h")), "select image_id, lpad(lower(to_hex(ahash)), 16, '0') || lpad(lower(to_hex(dhash)), 16, '0') as h from hashes")
add("x22_compare", lambda v: v.images.select("id", quality.compare(F.coalesce("quality_score", F.lit(0)), F.lit(50)).alias("c")), "select id, sign(50 - coalesce(quality_score, 0))::int as c from images")
_TEXT = "case id % 4 when 0 then {c} || ' ' || {t} when 1 then {d} || ' ' || {t} || '+02:00' when 2 then {c} else 'never' end"
add("x24_exif_dates", lambda v: v.images.select("id", dates.exif_date(F.expr(_TEXT.format(c="date_format(created_at, 'yyyy:MM:dd')", d="date_format(created_at, 'yyyy-MM-dd')", t="date_format(created_at, 'HH:mm:ss')"))).cast("string").alias("d")), "select id, case id % 4 when 3 then null when 2 then date_trunc('day', created_at)::timestamp else created_at end::varchar as d from images")
_EXIF = lambda: F.create_map(F.when(F.col("id") % 2 == 0, "EXIF:DateTimeOriginal").otherwise("XMP:ModifyDate"), F.date_format("created_at", "yyyy:MM:dd HH:mm:ss"))
add("x25_exif_fields", lambda v: v.images.select("id", dates.exif_field(_EXIF(), "DateTimeOriginal").cast("string").alias("d")), "select id, case when id % 2 = 0 then created_at::varchar end as d from images")
add("x28_best_date", lambda v: v.images.select("id", dates.best_date(_EXIF(), F.col("source_path"), F.col("created_at")).alias("b")).select("id", "b.source", "b.confidence"), "select id, case when id % 2 = 0 then 'exif' else 'exif_other' end as source, case when id % 2 = 0 then 95 else 85 end as confidence from images")
add("x30_numbers", lambda v: v.images.select("id", text.first_number(F.concat(F.lit("f/"), F.col("aperture").cast("string"), F.lit(" mm"))).alias("f"), text.first_integer(F.concat(F.lit("ISO "), F.col("iso").cast("string"))).alias("i")), "select id, aperture as f, iso as i from images")
add("x32_first_value", lambda v: v.images.select("id", text.first_filled(F.col("description"), F.nullif(F.col("camera_make"), F.lit("en")), F.lit("none")).alias("s")), "select id, coalesce(nullif(description, ''), nullif(camera_make, 'en'), 'none') as s from images")
_VIDEO = lambda: F.create_map(F.when(F.col("id") % 3 == 0, "VideoWidth").otherwise("ImageWidth"), F.col("width").cast("string"), F.lit("ImageHeight"), F.when(F.col("id") % 5 == 0, "none").otherwise(F.concat("height", F.lit(" px"))), F.lit("SourceImageHeight"), F.when(F.col("id") % 2 == 0, F.col("height").cast("string")).otherwise("0"), F.when(F.col("id") % 4 == 0, "CompressorName").otherwise("VideoCodec"), F.when(F.col("id") % 7 == 0, "Unknown").otherwise("HEVC"))
add("x33_resolution", lambda v: v.images.select("id", text.video_size(_VIDEO()).alias("r"), text.video_codec(_VIDEO(), F.col("source_path")).alias("codec")).select("id", "r.width", "r.height", "codec"), "select id, case when id % 5 <> 0 or id % 2 = 0 then width end as width, case when id % 5 <> 0 or id % 2 = 0 then height end as height, case when id % 7 = 0 then substr(lower(regexp_extract(source_path, '(\\.[^./]+)$', 1)), 2) else 'HEVC' end as codec from images")
add("s27_thumbnail_path", lambda v: v.images.select("id", S.thumbnail_path("/catalog/thumbnails/", F.col("checksum"), "small").alias("p")), "select id, '/catalog/thumbnails/small/' || checksum || '.jpg' as p from images")
add("s06_verified", lambda v: v.table("pages").select("page_id", S.verified("html", F.upper(S.checksum(F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise("")))).alias("ok")), "select page_id, sha256(html) = sha256(case when page_id % 3 = 0 then html else '' end) as ok from pages")
add("s33_edited", lambda v: S.edited(v.images.select("id", F.lit('{"rotation":90}').alias("edit")), v.images.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, '{"rotation":180}').alias("edit"))).select("id", S.edits(F.col("edit")).alias("edit")), """select id, case when id % 6 = 0 then '{"rotation":180}' when id % 3 = 0 then '{"version":1}' else '{"rotation":90}' end as edit from images""")
add("x37_merged_texts", lambda v: v.images.select("id", S.merged_json(F.when(F.col("id") % 2 == 0, '{"a":"1","b":"2"}'), F.when(F.col("id") % 3 == 0, '{"b":"3"}')).alias("j")), """select id, case when id % 6 = 0 then '{"a":"1","b":"3"}' when id % 2 = 0 then '{"a":"1","b":"2"}' when id % 3 = 0 then '{"b":"3"}' else '{}' end as j from images""")
add("s19_replaced", lambda v: D.replaced(v.groups.select("group_id", F.lit(90).alias("confidence"), (F.col("group_id") % 2).cast("int").alias("catalog_id")), v.images.where("id < 50").select(F.col("id").alias("group_id"), (F.col("id") / 50).alias("confidence")), 1), "select group_id, 90 as confidence, (group_id % 2)::int as catalog_id from groups where group_id % 2 <> 1 union all select id, floor(id / 50.0::double * 100)::int, 1 from images where id < 50")
add("x37_merge_json", lambda v: v.images.select("id", F.to_json(F.map_concat(F.create_map(F.lit("a"), F.col("width")), F.create_map(F.lit("b"), F.col("height")))).alias("j")), """select id, '{"a":' || width || ',"b":' || height || '}' as j from images""")
add("x38_date_parts", lambda v: v.images.select("id", F.year("created_at").alias("y"), dates.seconds("created_at").alias("epoch"), F.date_trunc("month", "created_at").cast("timestamp_ntz").cast("string").alias("m")), "select id, year(created_at)::int as y, epoch(created_at)::bigint as epoch, date_trunc('month', created_at)::timestamp::varchar as m from images")
add("x39_texts", lambda v: v.images.select("id", F.concat_ws(",", F.coalesce("camera_make", F.lit("?")), F.when(F.array_contains(F.array(F.lit("en"), F.lit("de")), F.col("camera_make")), "known").otherwise("other")).alias("s")), "select id, coalesce(camera_make, '?') || ',' || case when camera_make in ('en', 'de') then 'known' else 'other' end as s from images")
add("x44_magic", lambda v: v.images.select("id", text.magic_kind(F.unhex(F.when(F.col("id") % 3 == 0, "FFD8FFE000104A46").when(F.col("id") % 3 == 1, "89504E470D0A1A0A00").otherwise("00000000"))).alias("k")), "select id, case id % 3 when 0 then 'jpeg' when 1 then 'png' end as k from images")
add("x45_severity", lambda v: v.images.select("id", text.corruption_severity(F.when(F.col("id") % 2 == 0, "Broken Data Stream").otherwise("TRUNCATED file")).alias("s")), "select id, case when id % 2 = 0 then 'moderate' else 'minor' end as s from images")
add("x46_bits", lambda v: v.images.select("id", F.bit_count(hashing.from_hex(F.col("whash"))).alias("ones")), "select id, bit_count(('0x' || whash)::ubigint)::int as ones from images")
add("x20_weights", lambda v: v.images.select("id", F.round(quality.completeness([(1, F.col("lens_model").isNotNull()), (2, geo.has_gps(F.col("latitude"), F.col("longitude")))]), 4).alias("s")), "select id, round((case when lens_model is not null then 1 else 0 end + case when latitude <> 0 and longitude <> 0 then 2 else 0 end) * 100.0::double / 3, 4) as s from images")

# duplicates, bursts, vectors, tags, jobs
add("d02_segment_components", lambda v: D.components(v.pairs.where("a_distance <= 2")), "with recursive e as (select image_1 as u, image_2 as v from pairs where a_distance <= 2 union select image_2, image_1 from pairs where a_distance <= 2), r as (select u, v from e union select r.u, e.v from r join e on r.v = e.u) select u as node, least(u, min(v)) as component from r group by u")
add("d09_persist", lambda v: v.members.join(D.primaries(v.members, v.images).select("group_id", F.col("image_id").alias("primary_image_id")), "group_id").select("group_id", "image_id", (F.col("image_id") == F.col("primary_image_id")).alias("is_primary")), "with p as (select group_id, image_id as p from members join images on image_id = id qualify row_number() over (partition by group_id order by quality_score desc nulls last, image_id) = 1) select group_id, image_id, image_id = p as is_primary from members join p using (group_id)")
add("d12_scored", lambda v: D.primaries(v.members, v.images).select("group_id", "image_id").join(D.date_conflicts(v.members, v.images), "group_id"), "with p as (select group_id, image_id from members join images on image_id = id qualify row_number() over (partition by group_id order by quality_score desc nulls last, image_id) = 1) select group_id, image_id, (select count(distinct selected_date::date) > 1 from members m join images on m.image_id = id where m.group_id = p.group_id) as needs_review from p")
add("d14_compared", lambda v: v.hashes.select("image_id").join(v.pairs.select(F.explode(F.array("image_1", "image_2")).alias("image_id")).distinct().withColumn("hit", F.lit(True)), "image_id", "left").select("image_id", F.coalesce("hit", F.lit(False)).alias("compared")), "select image_id, image_id in (select image_1 from pairs union select image_2 from pairs) as compared from hashes")
add("d15_job", lambda v: D.components(D.consensus(D.similar_pairs(v.hashes, 5))).groupBy("component").agg(F.count("*").alias("n")), "with recursive e as (select image_1 as u, image_2 as v from pairs where a_distance <= 5 and d_distance <= 5 union select image_2, image_1 from pairs where a_distance <= 5 and d_distance <= 5), r as (select u, v from e union select r.u, e.v from r join e on r.v = e.u), c as (select u, least(u, min(v)) as component from r group by u) select component, count(*) as n from c group by 1")
add("d16_serial", lambda v: D.exact_groups(v.images).agg(F.count("*").alias("exact")).join(D.similar_pairs(v.hashes, 3, "all").agg(F.count("*").alias("similar"))), "select (select count(*) from groups) as exact, (select count(*) from pairs where a_distance <= 3 and d_distance <= 3) as similar")
add("b04_set_best", lambda v: B.set_best(v.bursts.withColumn("selection_method", F.lit("quality")), 20, 25).select("burst_id", F.col("best_image_id").alias("best"), F.col("selection_method").alias("method")), "select burst_id, case when burst_id = 20 then 25 else best_image_id end as best, case when burst_id = 20 then 'manual' else 'quality' end as method from bursts")
add("b05_job", lambda v: B.detect(v.shots.where("confidence >= 70"), 43200, check_place=False, check_name=False).agg(F.count("*").alias("n"), F.sum("image_count").alias("images")), "with s as (select *, camera_model as cam, coalesce(camera_make, 'unknown') as mk, epoch(date_trunc('second', ts))::bigint as sec from shots where confidence >= 70), b as (select *, case when sec - lag(sec) over w <= 43200 then 0 else 1 end as br from s window w as (partition by mk, cam order by ts, image_id)), r as (select *, sum(br) over (partition by mk, cam order by ts, image_id) as run from b), g as (select count(*) as c from r group by mk, cam, run having count(*) >= 3 and max(sec) - min(sec) >= 0.5) select count(*) as n, sum(c)::bigint as images from g")
add("v06_index", lambda v: D.absent(v.hashes.select("image_id"), v.hashes.where("vec_id % 5 = 0"), "image_id").agg(F.count("*").alias("valid")), "select count(*) as valid from hashes where vec_id % 5 <> 0")
add("t04_parse", lambda v: T.answers(v.images.select("id", F.concat(F.lit('```json\n{"cat": 0.'), (F.col("id") % 10).cast("string"), F.lit(', "dog": 0.9}\n```')).alias("reply")), "id", "reply", ["cat", "bird"], 0.5).select("id", "tag"), "select id, 'cat' as tag from images where id % 10 >= 5")
add("t11_resume", lambda v: T.remaining(v.images, v.image_tags, 100).select("id"), "select id from images where file_type = 'image' and id > 100 and id not in (select image_id from image_tags)")
add("r03_conflicts", lambda v: R.plan(v.images.withColumn("source_path", F.expr("'/a/' || cast(id % 3 as string) || '/IMG_' || cast(id % 40 as string) || '.jpg'")), "/o", "FLAT", "original").where("action = 'copy'").select("id", "target"), "with t as (select id, case when selected_date is not null then case when status_id = 'rejected' then '/o/_rejected' else '/o' end end as d, 'IMG_' || (id % 40)::varchar as stem from images), r as (select *, row_number() over (partition by d, stem order by id) - 1 as n from t) select id, d || '/' || stem || case when n = 0 then '' else '_' || lpad(n::varchar, 3, '0') end || '.jpg' as target from r where d is not null")
add("r05_counters", lambda v: R.plan(v.images, "/photos/src1", "YYYY/MM").groupBy("action").agg(F.count("*").alias("n")), "select case when selected_date is null then 'no_date' when starts_with(source_path, '/photos/src1/') then 'skip' else 'copy' end as action, count(*) as n from images group by 1")
add("m02_claim", lambda v: J.claimed(v.batches, "w1").groupBy("status").agg(F.count("*").alias("n"), F.count("worker_id").alias("claimed")), "select case when take then 'RUNNING' else status end as status, count(*) as n, count(*) filter (where take) as claimed from (select status, status = 'PENDING' and row_number() over (partition by parent_job_id, status order by batch_number) = 1 as take from batches) group by 1")
add("m03_cancelled", lambda v: J.cancelled(v.batches, v.jobs), "select parent_job_id, batch_number from batches where status = 'CANCELLED'")
add("m04_latest_progress", lambda v: S.latest(v.batches.select("parent_job_id", "batch_number", "processed_count", "_metadata.file_path", "_metadata.row_index"), ["parent_job_id"], ["batch_number"], ["file_path", "row_index"]).select("parent_job_id", "processed_count"), "select parent_job_id, processed_count from batches qualify row_number() over (partition by parent_job_id order by batch_number desc) = 1")
add("m08_recovery", lambda v: J.recovery(v.batches, _AT(), 60), "select parent_job_id, case when count(*) filter (where status in ('PENDING', 'RUNNING')) = 0 then 'finalize' when count(*) filter (where status = 'PENDING' or status = 'RUNNING' and started_at < timestamp '1995-06-17' - interval 60 minute) > 0 then 'dispatch' else 'wait' end as action from batches group by 1")
add("m09_requeue", lambda v: J.requeue(v.batches, 2), "select parent_job_id, count(*) as failures from batches where status = 'FAILED' group by 1 having count(*) >= 2")

# stored logs and indexes, schemas, processors
_LOG = lambda v: v.batches.select(F.col("parent_job_id").cast("string").alias("transaction_id"), F.col("batch_number").cast("long").alias("position"), F.lit("/a").alias("source"), F.concat(F.lit("/b/"), F.col("batch_number").cast("string")).alias("target"), F.lower("status").alias("status"))


def _saved(v, df, save, load):
    path = S.shared_path(v.spark, "saved")
    save(df, path)
    return load(v.spark, path)


add("s25_transaction_log", lambda v: _saved(v, _LOG(v), S.save_log, S.load_log), "select parent_job_id::varchar as transaction_id, case when bool_and(status = 'COMPLETED') over w then 'completed' when bool_or(status = 'FAILED') over w then 'failed' else 'pending' end as transaction_status, batch_number::bigint as position, '/a' as source, '/b/' || batch_number::varchar as target, lower(status) as status from batches window w as (partition by parent_job_id)")
add("s24_saved_index", lambda v: _saved(v, v.hashes.select("image_id", hashing.to_hex(F.col("ahash")).alias("ahash"), hashing.to_hex(F.col("dhash")).alias("dhash")), S.save_index, S.load_index), "select image_id, lpad(lower(to_hex(ahash)), 16, '0') as ahash, lpad(lower(to_hex(dhash)), 16, '0') as dhash from hashes")


def _passed(v):
    v.table("nation").createOrReplaceTempView("passed_nation")
    return S.run_sql(v.spark, "select n_nationkey, n_name from passed_nation where n_regionkey = ? and n_name like ?", 1, "%A%")


add("s18_passthrough", _passed, "select n_nationkey, n_name from nation where n_regionkey = 1 and n_name like '%A%'")


@J.processor("count_types")
def _count_types(images):
    return images.groupBy("file_type").agg(F.count("*").alias("n"))


add("m07_processor", lambda v: J.run_job("count_types", v.images), "select file_type, count(*) as n from images group by 1")
