"""Tags, duplicates, bursts, jobs, vectors, reorganisation and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import bursts as B
from ..operators import duplicates as D
from ..operators import images as I
from ..operators import jobs as J
from ..operators import ordered as O
from ..operators import organize as R
from ..operators import tags as T
from ..operators import vectors as V
from ..sources import storage as S
from .registry import add

# tags
add("a03_tag_listing", lambda v: T.listing(v.tags, v.image_tags, 2), "select tag_id, name, category, count(image_id) as image_count, round(avg(confidence), 8) as avg_confidence from tags left join image_tags using (tag_id) group by all having count(image_id) >= 2")
add("f32_tags_by_name", lambda v: T.listing(v.tags, v.image_tags, 0, "Brand#12", "1").select("tag_id", "image_count"), "select tag_id, count(image_id) as image_count from tags left join image_tags using (tag_id) where category = 'Brand#12' and name ilike '%1%' group by all")
add("j02_tag_counts", lambda v: T.listing(v.tags, v.image_tags).select("tag_id", "image_count"), "select tag_id, (select count(*) from image_tags i where i.tag_id = t.tag_id) as image_count from tags t")
add("j06_tag_sources", lambda v: T.source_counts(v.image_tags), "select tag_id, string_agg(source || '=' || n, ',' order by source || '=' || n) as sources from (select tag_id, source, count(*) as n from image_tags group by all) group by 1")
add(
    "j06_tag_sources_compat",
    lambda v: v.tags.join(v.image_tags.select("tag_id", "image_id"), "tag_id", "left").join(v.image_tags.groupBy("tag_id").agg(F.count_distinct("source").alias("fan")), "tag_id", "left").groupBy("tag_id").agg((F.count("image_id") * F.coalesce(F.max("fan"), F.lit(1))).alias("image_count")),
    "select t.tag_id, count(i.image_id) as image_count from tags t left join image_tags i using (tag_id) left join (select tag_id, source from image_tags group by all) s on s.tag_id = t.tag_id group by 1",
)
add("a03_categories", lambda v: v.tags.groupBy("category").agg(F.count_distinct("tag_id").alias("n")), "select category, count(distinct tag_id) as n from tags group by 1")
add("j01_tags_of_images", lambda v: T.of_images(v.image_tags, v.tags), "select image_id, string_agg(name, ',' order by confidence desc, name) as tags from image_tags join tags using (tag_id) group by 1")
add("o09_top_tags", lambda v: T.top_per_image(v.image_tags, 2).select("image_id", "tag_id", "rank"), "select image_id, tag_id, row_number() over (partition by image_id order by confidence desc, tag_id)::int as rank from image_tags qualify rank <= 2")
add("a18_tag_statistics", lambda v: T.statistics(v.image_tags), "select source, count(*) as n, count(distinct image_id) as images from image_tags group by 1")
add("a19_common_tags", lambda v: T.most_common(v.image_tags, v.tags, 15), "select name, count(*) as n from image_tags join tags using (tag_id) group by name, tag_id order by n desc, name limit 15")
add("o05_tags_sorted", lambda v: T.listing(v.tags, v.image_tags).orderBy(F.desc("image_count"), "name").limit(30).select("name", "image_count"), "select name, count(image_id) as image_count from tags left join image_tags using (tag_id) group by tag_id, name order by image_count desc, name limit 30")
add(
    "t03_merge_backends",
    lambda v: T.merge_backends(v.image_tags.where("tag_id % 3 <> 0").select("image_id", "tag_id", "confidence"), v.image_tags.where("tag_id % 3 <> 1").select("image_id", "tag_id", (F.col("confidence") * 0.5).alias("confidence")), threshold=0.45),
    "select image_id, tag_id, round(case when a is not null and b is not null then a * 0.4 + b * 0.6 else coalesce(a, b) end, 6) as confidence, case when a is not null and b is not null then 'combined' when a is not null then 'a' else 'b' end as source from (select image_id, tag_id, confidence as a from image_tags where tag_id % 3 <> 0) full join (select image_id, tag_id, confidence * 0.5 as b from image_tags where tag_id % 3 <> 1) using (image_id, tag_id) where round(case when a is not null and b is not null then a * 0.4 + b * 0.6 else coalesce(a, b) end, 6) >= 0.45",
)
add("u02_tag_union", lambda v: T.name_union(v.image_tags.where("source = 'clip'"), v.image_tags.where("source = 'manual'")), "select tag_id from image_tags where source = 'clip' union select tag_id from image_tags where source = 'manual'")
add(
    "t02_propagate",
    lambda v: T.propagate(v.table("customer").select(F.col("c_custkey").alias("image_id"), F.col("c_nationkey").cast("long").alias("tag"), (F.col("c_custkey") % 10 / 10.0).alias("confidence")), v.table("nation").select(F.col("n_nationkey").cast("long").alias("child"), (F.col("n_regionkey") + 100).cast("long").alias("ancestor")), 0.8, 0.3),
    "select image_id, tag, round(max(confidence), 6) as confidence from (select c_custkey as image_id, c_nationkey::bigint as tag, c_custkey % 10 / 10.0::double as confidence from customer union all select c_custkey, (n_regionkey + 100)::bigint, c_custkey % 10 / 10.0::double * 0.8 from customer join nation on c_nationkey = n_nationkey) group by 1, 2 having round(max(confidence), 6) >= 0.3",
)
_TREE = lambda v: v.table("region").select(F.col("r_name").alias("name"), F.lit("region").alias("category"), F.lit(None).cast("string").alias("parent")).unionByName(v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.lit("nation").alias("category"), F.col("r_name").alias("parent")))
add("t05_paths", lambda v: T.paths(_TREE(v)), "select r_name as name, r_name as path from region union all select n_name, r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey")
add("t05_roots", lambda v: T.children(T.roots(_TREE(v)).unionByName(_TREE(v).where("parent is not null"))), "select r_name as name, count(n_name) as children from region left join nation on r_regionkey = n_regionkey group by 1 union all select n_name, 0 from nation")
_KNOWN = lambda v: v.table("nation").where("n_nationkey < 10").select((F.col("n_nationkey").cast("long") + 1).alias("tag_id"), F.col("n_name").alias("name"), F.lit("nation").alias("category"))
add("t06_sync", lambda v: T.sync_taxonomy(_KNOWN(v), _TREE(v)), "with tree as (select r_name as name, 'region' as category, null::varchar as parent from region union all select n_name, 'nation', r_name from nation join region on n_regionkey = r_regionkey), known as (select n_nationkey::bigint + 1 as tag_id, n_name as name from nation where n_nationkey < 10), every as (select tag_id, k.name, 'nation' as category, false as inserted from known k union all select 10 + row_number() over (order by name), name, category, true from tree where name not in (select name from known)) select e.tag_id, e.name, e.category, p.tag_id as parent_id, e.inserted from every e left join tree t using (name) left join every p on p.name = t.parent")
add("t06_second_sync", lambda v: T.sync_taxonomy(T.sync_taxonomy(_KNOWN(v), _TREE(v)).select("tag_id", "name", "category"), _TREE(v)).agg(F.count("*").alias("n"), F.count_if("inserted").alias("inserted")), "select (select count(*) from region) + (select count(*) from nation) as n, 0::bigint as inserted")
add("t07_upsert", lambda v: T.upsert(v.image_tags, v.image_tags.where("image_id % 5 = 0").withColumn("confidence", F.lit(0.25))).select("image_id", "tag_id", F.round("confidence", 6).alias("confidence")), "select image_id, tag_id, case when image_id % 5 = 0 then 0.25 else round(confidence, 6) end::double as confidence from image_tags")
add("t08_images_with_tag", lambda v: T.images_with(v.image_tags, 7, 0.7).select("image_id"), "select image_id from image_tags where tag_id = 7 and confidence >= 0.7")
add("t09_any", lambda v: T.images_with_any(v.image_tags, v.tags, ["Brand#11", "Brand#12"], "category"), "select distinct image_id from image_tags join tags using (tag_id) where category in ('Brand#11', 'Brand#12')")
add("t09_all", lambda v: T.images_with_all(v.image_tags, v.tags, ["Brand#11", "Brand#12", "no brand"], "category"), "select image_id from image_tags join tags using (tag_id) where category in ('Brand#11', 'Brand#12') group by 1 having count(distinct category) = 2")
add("t10_search", lambda v: T.containing(v.tags, "10").select("tag_id", "name"), "select tag_id, name from tags where name ilike '%10%'")
add("s16_tag_ids", lambda v: v.tags.where("category = 'Brand#11'").join(v.image_tags, "tag_id", "left").groupBy("tag_id").agg(F.max("confidence").alias("c")).select("tag_id", F.round("c", 6).alias("c")), "select tag_id, round(max(confidence), 6) as c from tags left join image_tags using (tag_id) where category = 'Brand#11' group by 1")
_SYNONYMS = lambda v: v.tags.select("tag_id", F.concat(F.lit("no. "), "tag_id").alias("synonym")).unionByName(v.tags.select("tag_id", F.lit("Thing").alias("synonym")))
add("t10_synonyms", lambda v: T.search(v.tags, _SYNONYMS(v), "THING").select("tag_id", "hit"), "select tag_id, 'synonym' as hit from tags")
add("t08_tags_of_image", lambda v: T.tags_with(v.image_tags, v.tags, 7, 0.1), "select tag_id, name, round(confidence, 3) as confidence from image_tags join tags using (tag_id) where image_id = 7 and confidence >= 0.1")
add("t05_by_name", lambda v: T.named(_TREE(v), "Asia").select("name", "category"), "select r_name as name, 'region' as category from region where lower(r_name) = 'asia'")
add("s16_get_or_create", lambda v: T.stored(_KNOWN(v), _TREE(v).select("name", "category")), "select n_nationkey::bigint + 1 as tag_id, n_name as name, 'nation' as category from nation where n_nationkey < 10 union all select 10 + row_number() over (order by name), name, category from (select n_name as name, 'nation' as category from nation where n_nationkey >= 10 union all select r_name, 'region' from region)")

# duplicates
add("a21_exact", lambda v: D.exact_groups(v.images).select("checksum", F.array_join("ids", ",").alias("ids")), "select checksum, string_agg(id::varchar, ',' order by id) as ids from images group by 1 having count(*) > 1")
add("a22_exact_groups", lambda v: D.exact_groups(v.images).select(F.concat(F.lit("exact_"), F.substring("checksum", 1, 16)).alias("gid"), F.size("ids").alias("n")), "select 'exact_' || substr(checksum, 1, 16) as gid, count(*)::int as n from images group by checksum having count(*) > 1")
add("x11_ahash", lambda v: v.hashes.select("image_id", hashing.to_hex(F.col("ahash")).alias("h")), "select image_id, lpad(lower(to_hex(ahash)), 16, '0') as h from hashes")
add("x12_dhash", lambda v: v.hashes.select("image_id", hashing.to_hex(F.col("dhash")).alias("h")), "select image_id, lpad(lower(to_hex(dhash)), 16, '0') as h from hashes")
add(
    "x13_whash",
    lambda v: v.variants.select("image_id", hashing.to_hex(hashing.wavelet_hash("px")).alias("h")),
    """with ll as (select image_id, list_transform(range(0, 16), lambda k: (px[1 + k // 4 * 16 + k % 4 * 2] + px[2 + k // 4 * 16 + k % 4 * 2] + px[9 + k // 4 * 16 + k % 4 * 2] + px[10 + k // 4 * 16 + k % 4 * 2]) / 2) as c from variants)
    select image_id, lpad(lower(to_hex(list_sum(list_transform(range(1, 17), lambda k: case when c[k] > (list_sort(c)[8] + list_sort(c)[9]) / 2 then (1::hugeint << (64 - k)) else 0::hugeint end))::ubigint)), 16, '0') as h from ll""",
)
add("j10_pairs", lambda v: v.pairs, "select * from pairs")
add("j11_pairs_all", lambda v: D.similar_pairs(v.hashes, 8, "all"), "select a.image_id as image_1, b.image_id as image_2, bit_count(xor(a.ahash, b.ahash))::int as a_distance, bit_count(xor(a.dhash, b.dhash))::int as d_distance from hashes a join hashes b on a.image_id < b.image_id and bit_count(xor(a.ahash, b.ahash)) <= 8 and bit_count(xor(a.dhash, b.dhash)) <= 8")
add("j12_nearest", lambda v: D.nearest(v.pairs, 2).select("query", "other", "rank"), "select image_1 as query, image_2 as other, row_number() over (partition by image_1 order by a_distance, image_2)::int as rank from (select image_1, image_2, a_distance from pairs union all select image_2, image_1, a_distance from pairs) qualify rank <= 2")
add("j13_lookup", lambda v: v.hashes.join(F.broadcast(v.hashes.where("image_id = 0").select(F.col("ahash").alias("q")))).select("image_id", hashing.hamming(F.col("ahash"), F.col("q")).alias("d")).orderBy("d", "image_id").limit(10), "select image_id, bit_count(xor(ahash, (select ahash from hashes where image_id = 0)))::int as d from hashes order by d, image_id limit 10")
add("d13_consensus", lambda v: D.consensus(v.pairs), "select * from pairs where a_distance <= 5 and d_distance <= 5")
add("w07_segments", lambda v: D.segments(v.pairs.withColumn("distance", F.col("a_distance") + F.col("d_distance") * 4)).select("image_1", "image_2", F.col("segment").cast("int").alias("segment")), "with d as (select distinct a_distance + d_distance * 4 as d from pairs), s as (select d, sum(j) over (order by d)::int as segment from (select d, case when d - lag(d) over (order by d) > 2 then 1 else 0 end as j from d)) select image_1, image_2, segment from pairs join s on s.d = a_distance + d_distance * 4")
_REACH = "with recursive e as (select image_1 as u, image_2 as v from pairs union select image_2, image_1 from pairs), r as (select u, v from e union select r.u, e.v from r join e on r.v = e.u)"
add("d01_components", lambda v: D.components(v.pairs), f"{_REACH} select u as node, least(u, min(v)) as component from r group by u")
add("d08_transitive", lambda v: D.grouped(v.pairs.withColumn("distance", F.least("a_distance", "d_distance")), "transitive"), f"{_REACH} select least(u, min(v)) as group_id, u as image_id from r group by u")
for _s in ("constrained", "clique", "star"):
    add(f"d0{dict(constrained=5, clique=6, star=4)[_s]}_{_s}", lambda v, s=_s: D.grouped(v.pairs.withColumn("distance", F.least("a_distance", "d_distance")), s))
add("d03_merge", lambda v: D.merge_groups(v.members), "select image_id, min(image_id) over (partition by group_id) as component from members")
add("d07_complete", lambda v: D.complete_cliques(v.hashes.select((F.col("vec_id")).alias("group_id"), "image_id"), v.pairs), "select vec_id as group_id, count(p.image_1) = 6 as complete from hashes h left join pairs p on p.image_1 = h.image_id and p.image_2 // 4 = h.vec_id group by 1")
add("d11_metrics", lambda v: v.pairs.select("image_1", "image_2", F.round((hashing.similarity_percent(F.col("a_distance")) + hashing.similarity_percent(F.col("d_distance"))) / 2, 6).alias("overall")), "select image_1, image_2, round(((1 - a_distance / 64.0::double) * 100 + (1 - d_distance / 64.0::double) * 100) / 2, 6) as overall from pairs")
add("x43_confidence", lambda v: v.pairs.select("image_1", "image_2", D.confidence(F.col("a_distance")).alias("c")), "select image_1, image_2, greatest(0, 100 - 10 * a_distance)::int as c from pairs")
add("x42_pair_key", lambda v: v.pairs.select(F.concat_ws(":", F.least("image_1", "image_2"), F.greatest("image_1", "image_2")).alias("k")), "select least(image_1, image_2) || ':' || greatest(image_1, image_2) as k from pairs")
add("x07_any_all", lambda v: v.pairs.select("image_1", "image_2", F.exists(F.array("a_distance", "d_distance"), lambda x: x <= 2).alias("any2"), F.forall(F.array("a_distance", "d_distance"), lambda x: x <= 5).alias("all5")), "select image_1, image_2, a_distance <= 2 or d_distance <= 2 as any2, a_distance <= 5 and d_distance <= 5 as all5 from pairs")
add("w08_primary", lambda v: D.primaries(v.members, v.images).select("group_id", "image_id"), "select group_id, image_id from members join images on image_id = id qualify row_number() over (partition by group_id order by quality_score desc nulls last, image_id) = 1")
_SCORE = "0.5 * case when coalesce(quality_score, 0) = 0 then 50 else quality_score end + case when selected_date is null then 15 else 30 * (1 - least(floor((epoch(selected_date) - min(epoch(selected_date)) over g) / 86400) / 365, 0.5)) end + 20.0::double * (width * height) / max(width * height) over g"
add("x23_keeper_scores", lambda v: D.keeper_scores(v.members, v.images).select("group_id", "image_id", "score"), f"select group_id, image_id, round({_SCORE}, 6) as score from members join images on image_id = id window g as (partition by group_id)")
add("w09_keepers", lambda v: D.keepers(v.members, v.images).select("group_id", "image_id"), f"with s as (select group_id, image_id, round({_SCORE}, 6) as score, selected_date, size_bytes from members join images on image_id = id window g as (partition by group_id)) select group_id, image_id from s qualify row_number() over (partition by group_id order by score desc, selected_date asc nulls last, size_bytes desc, image_id) = 1")
add("w10_group_features", lambda v: D.group_features(v.members, v.images).select("group_id", F.col("oldest").cast("string").alias("oldest"), F.col("pixels").alias("px")), "select group_id, min(selected_date)::varchar as oldest, max(width * height) as px from members join images on image_id = id group by 1")
add("w13_date_conflict", lambda v: D.date_conflicts(v.members, v.images), "select group_id, count(distinct selected_date::date) > 1 as needs_review from members join images on image_id = id group by 1")
add("a07_group_list", lambda v: D.largest_groups(D.group_listing(v.groups, v.members), 20).select("group_id", F.col("member_count").alias("n")), "select group_id, count(image_id) as n from groups left join members using (group_id) group by 1 order by n desc, group_id limit 20")
_J07 = "groups g left join members m on g.group_id = m.group_id left join images i on m.image_id = i.id and i.id <> g.primary_image_id"
add("a08_duplicate_stats", lambda v: D.group_statistics(v.groups, v.members, v.images), f"select count(distinct g.group_id) as total, count(distinct g.group_id) filter (where reviewed) as reviewed, coalesce(sum(size_bytes), 0)::bigint as savings from {_J07}")
add("a08_duplicate_stats_compat", lambda v: v.groups.join(v.members, "group_id", "left").agg(F.count_if("reviewed").alias("reviewed_groups")), f"select count(*) filter (where reviewed) as reviewed_groups from {_J07}")
add("j08_members", lambda v: D.group_details(v.members, v.images).select("group_id", "image_id", "source_path", "similarity_score"), "select group_id, image_id, source_path, similarity_score from members join images on image_id = id")
add("j09_types", lambda v: D.group_overview(v.groups, v.members, v.images), "select group_id, string_agg(distinct i.file_type, ',' order by i.file_type) as types, count(*) as n, any_value(p.source_path) as primary_path from groups g join members m using (group_id) join images i on m.image_id = i.id left join images p on p.id = g.primary_image_id group by 1")
add("f29_unreviewed", lambda v: D.filtered_groups(v.groups, False, "exact").select("group_id"), "select group_id from groups where not reviewed and similarity_type = 'exact'")
add("a23_detector", lambda v: D.detector_statistics(v.members), "select count(*) as groups, sum(n)::bigint as duplicates, (sum(n) - count(*))::bigint as redundant from (select count(*) as n from members group by group_id)")
add("a34_group_sizes", lambda v: D.group_sizes(v.members), "select min(n) as low, max(n) as high, round(avg(n), 6) as mean from (select count(*) as n from members group by group_id)")
add("a24_contamination", lambda v: D.burst_contamination(v.members, v.images), "select count(distinct group_id) as groups, count(distinct case when burst_id is not null then group_id end) as with_bursts from members join images on image_id = id")
add("j21_cleaned", lambda v: D.without_bursts(v.members, v.images).select("group_id", "image_id"), "select group_id, image_id from members where image_id not in (select id from images where burst_id is not null) qualify count(*) over (partition by group_id) >= 2")
add("j20_uncompared", lambda v: D.uncompared(v.hashes.select("image_id"), v.pairs), "select image_id from hashes where image_id not in (select image_1 from pairs union all select image_2 from pairs)")
add("j14_index_diff", lambda v: D.index_difference(v.images.where("id % 2 = 0"), v.images.where("id % 3 = 0"), "id").withColumn("ratio", F.round("ratio", 6)), "select missing, extra, round((missing + extra) / n, 6) as ratio, (missing + extra) / n > 0.1 as needs_rebuild from (select count(*) filter (where id % 2 = 0 and id % 3 <> 0) as missing, count(*) filter (where id % 3 = 0 and id % 2 <> 0) as extra, count(*) filter (where id % 2 = 0)::double as n from images)")
add("u01_missing", lambda v: D.absent(v.images.where("id % 2 = 0").select("id"), v.images.where("id % 3 = 0"), "id"), "select id from images where id % 2 = 0 except select id from images where id % 3 = 0")
add("j16_inside_groups", lambda v: D.inside(v.pairs, v.hashes.where("vec_id % 2 = 0")).select("image_1", "image_2"), "select image_1, image_2 from pairs where image_1 // 4 % 2 = 0 and image_2 // 4 % 2 = 0")
add("j17_enrich", lambda v: D.enriched(v.pairs.select("image_1", "image_2"), v.hashes, "dhash").withColumnRenamed("distance", "d"), "select image_1, image_2, d_distance as d from pairs")
add("d10_auto_tags", lambda v: D.group_tags(v.members, v.images, v.images.where("id % 4 = 0").select(F.col("id").alias("image_id"), F.concat(F.lit("dup-"), F.substring("dhash", 1, 8)).alias("tag"))), "select image_id, 'dup-' || substr(dhash, 1, 8) as tag from members join images on image_id = id where length(dhash) >= 8 and image_id % 4 <> 0")
add("d17_group_confidence", lambda v: D.group_confidence(v.members), "select group_id, round(avg(similarity_score), 6) as confidence from members group by 1")
add("s15_canonical", lambda v: S.canonical_pairs(v.pairs.select(F.when(F.col("image_1") % 2 == 0, F.col("image_2")).otherwise(F.col("image_1")).alias("image_1"), F.when(F.col("image_1") % 2 == 0, F.col("image_1")).otherwise(F.col("image_2")).alias("image_2"), F.col("a_distance").alias("distance")), "distance"), "select image_1, image_2, a_distance as distance from pairs")

# bursts
_RUN = """with s as (select *, coalesce(nullif(camera_make, ''), 'unknown') || ':' || coalesce(nullif(camera_model, ''), 'unknown') as camera, epoch(date_trunc('second', ts))::bigint as sec from shots),
b as (select *, case when sec - lag(sec) over w <= {gap} then 0 else 1 end as br from s window w as (partition by camera order by ts, image_id)),
r as (select *, sum(br) over (partition by camera order by ts, image_id)::bigint as run from b),
q as (select *, row_number() over (partition by camera, run order by ts, image_id) - 1 as pos from r),
g as (select camera, run, count(*) as image_count, min(ts) as start_time, max(ts) as end_time, max(sec) - min(sec) as duration_seconds, first(image_id order by quality_score desc nulls last, pos) as best, first(image_id order by pos) as head from q group by 1, 2 having count(*) >= 3 and max(sec) - min(sec) >= 0.5)"""
for _h in (1, 4, 12):
    add(f"w01_bursts_{_h}h", lambda v, h=_h: B.detect(v.shots, h * 3600, check_place=False, check_name=False).select("camera", "run", "image_count", "duration_seconds", F.col("best_image_id").alias("best")), _RUN.format(gap=_h * 3600) + " select camera, run, image_count, duration_seconds, best from g")
add("w04_first", lambda v: B.detect(v.shots, 14400, select="first", check_place=False, check_name=False).select("camera", "run", F.col("best_image_id").alias("head")), _RUN.format(gap=14400) + " select camera, run, head from g")
_PLACE = "(latitude is null or longitude is null or lag(latitude) over w is null or lag(longitude) over w is null or (floor((longitude + 180) / 360 * 32768) = floor((lag(longitude) over w + 180) / 360 * 32768) and floor((latitude + 90) / 180 * 32768) = floor((lag(latitude) over w + 90) / 180 * 32768)) or 2 * 6371000.0::double * asin(least(1, sqrt(power(sin(radians(latitude - lag(latitude) over w) / 2), 2) + cos(radians(latitude)) * cos(radians(lag(latitude) over w)) * power(sin(radians(longitude - lag(longitude) over w) / 2), 2)))) <= 10)"
_NEXT = "(regexp_extract(source_path, '([A-Za-z_]+)(\\d+)[^/]*$', 1) = lag(regexp_extract(source_path, '([A-Za-z_]+)(\\d+)[^/]*$', 1)) over w and abs(regexp_extract(source_path, '([A-Za-z_]+)(\\d+)[^/]*$', 2)::bigint - lag(regexp_extract(source_path, '([A-Za-z_]+)(\\d+)[^/]*$', 2)::bigint) over w) <= 5)"
_NUMBERED = lambda v: v.shots.withColumn("source_path", F.expr("'/s/IMG_' || cast(image_id div 400 as string) || '.jpg'"))
add("w02_w03_bursts", lambda v: B.detect(_NUMBERED(v), 200_000, least=2).select("camera", "run", "image_count"), _RUN.format(gap=200_000).replace("<= 200000 then 0", f"<= 200000 and {_PLACE} and {_NEXT} then 0").replace("from shots)", "from (select * replace ('/s/IMG_' || (image_id // 400)::varchar || '.jpg' as source_path) from shots))").replace("count(*) >= 3", "count(*) >= 2") + " select camera, run, image_count from g")
add("w06_members", lambda v: B.members(v.shots.withColumn("latitude", F.lit(None).cast("double")).withColumn("source_path", F.lit("x")), 14400).select("camera", "image_id", F.col("burst_sequence").cast("int").alias("seq")), _RUN.format(gap=14400) + " select camera, image_id, pos::int as seq from q join g using (camera, run)")
add("w05_merge", lambda v: B.merge_adjacent(B.detect(v.shots, 3600, check_place=False, check_name=False), 43200).select("camera", "image_count"), _RUN.format(gap=3600) + ", m as (select *, sum(case when epoch(date_trunc('second', start_time)) - epoch(date_trunc('second', before)) <= 43200 then 0 else 1 end) over (partition by camera order by start_time, run) as merged from (select *, lag(end_time) over (partition by camera order by start_time, run) as before from g)) select camera, sum(image_count)::bigint as image_count from m group by camera, merged")
add("j15_adjacent", lambda v: B.with_previous(v.shots, ["camera_model"]).select("image_id", "camera_model", "before"), "select image_id, camera_model, lag(image_id) over (partition by camera_model order by ts, image_id) as before from shots")
add("b01_burst_list", lambda v: B.listing(v.bursts, v.images).select("burst_id", "image_count"), "select burst_id, image_count from bursts b where exists (select 1 from images i where i.burst_id = b.burst_id and status_id <> 'rejected')")
add("b01_burst_members", lambda v: B.details(v.bursts, v.images).select("burst_id", F.array_join(F.transform("members", lambda x: x["id"]), ",").alias("ids")), "select burst_id, string_agg(id::varchar, ',' order by burst_sequence, id) as ids from images where burst_id is not null group by 1")
add("b02_apply", lambda v: B.apply_selection(v.images, 20, [23, 25]), "select id, case when id in (23, 25) then 'active' else 'rejected' end as status_id from images where burst_id = 20")
add("b03_batch_apply", lambda v: B.apply_all(v.images, v.bursts).groupBy(F.col("status_id").alias("status")).agg(F.count("*").alias("n")), "select case when id = best_image_id then 'active' else 'rejected' end as status, count(*) as n from images join bursts using (burst_id) group by 1")
add("f30_burst_filter", lambda v: B.listing(v.bursts, v.images, make="de", min_images=3).select("burst_id"), "select burst_id from bursts b where camera_make = 'de' and image_count >= 3 and exists (select 1 from images i where i.burst_id = b.burst_id and status_id <> 'rejected')")
add("o04_largest_bursts", lambda v: B.page(v.bursts, "largest", 15).select("burst_id"), "select burst_id from bursts order by image_count desc, start_time desc nulls last, burst_id limit 15")
add("o07_burst_order", lambda v: B.of_burst(v.images, 20).select("id"), "select id from images where burst_id = 20")
add("a09_burst_stats", lambda v: B.statistics(v.bursts).withColumn("mean", F.round("mean", 6)), "select count(*) as bursts, sum(image_count)::bigint as images, round(avg(image_count), 6) as mean, max(image_count) as largest, count(distinct camera_make || ' ' || camera_model) as cameras from bursts")
add("a10_burst_summary", lambda v: B.summary(v.bursts), "select round(coalesce(avg(image_count), 0), 1) as size, round(coalesce(avg(duration_seconds), 0), 2) as seconds from bursts")

# jobs
_EFFECTIVE = "case when status = 'PENDING' then 'queued' when status in ('STARTED', 'PROGRESS') then 'running' when status = 'SUCCESS' and result_status in ('dispatched', 'processing') then 'running' when status in ('FAILURE', 'STALE') then 'failed' when status in ('REVOKED', 'TERMINATED') then 'killed' when status = 'SUCCESS' then 'completed' else 'running' end"
add("f24_effective", lambda v: v.jobs.select("job_id", J.effective_status(F.col("status"), F.col("result_status")).alias("s")), f"select job_id, {_EFFECTIVE} as s from jobs")
add("f25_page", lambda v: J.with_effective(v.jobs, ("completed", "failed")).orderBy(F.desc("updated_at"), "job_id").offset(5).limit(20).select("job_id", F.col("effective").alias("s")), f"select job_id, {_EFFECTIVE} as s from jobs where s in ('completed', 'failed') order by updated_at desc, job_id limit 20 offset 5")
_PROG = "select parent_job_id, count(*) as total, count(*) filter (where status = 'COMPLETED') as completed, count(*) filter (where status = 'FAILED') as failed, count(*) filter (where status = 'RUNNING') as running, count(*) filter (where status = 'PENDING') as pending, count(*) filter (where status = 'CANCELLED') as cancelled, sum(items_count)::bigint as items, sum(processed_count)::bigint as processed, sum(error_count)::bigint as errors from batches group by 1"
add("a11_progress", lambda v: J.progress(v.batches).drop("overall"), f"select *, floor(processed * 100 / items)::int as percent, completed + failed + cancelled = total as is_complete from ({_PROG})")
add("a12_overall", lambda v: J.progress(v.batches).groupBy("overall").agg(F.count("*").alias("n")), f"select case when cancelled > 0 then 'CANCELLED' when completed = total then 'SUCCESS' when failed > 0 and completed + failed = total then 'FAILURE' when running + completed > 0 then 'PROGRESS' else 'UNKNOWN' end as overall, count(*) as n from ({_PROG}) group by 1")
_AT = lambda: F.lit("1995-06-17 00:00:00").cast("timestamp_ntz")
add("f22_stale", lambda v: J.stale_batches(v.batches, _AT(), 60).select("parent_job_id", "batch_number"), "select parent_job_id, batch_number from batches where status = 'RUNNING' and started_at < timestamp '1995-06-17' - interval 60 minute")
add("f23_stale_jobs", lambda v: J.stale_jobs(v.jobs, _AT()).select("job_id"), "select job_id from jobs where status in ('PROGRESS', 'PENDING') and updated_at < '1995-06-17'")
add("u04_dispatch", lambda v: J.to_dispatch(v.batches, _AT(), 60), "select parent_job_id, batch_number from batches where status = 'RUNNING' and started_at < timestamp '1995-06-17' - interval 60 minute union select parent_job_id, batch_number from batches where status = 'PENDING'")
add("m06_batch_plan", lambda v: v.jobs.select("job_id", J.batch_plan(F.col("job_id") % 9000, (F.col("job_id") % 50 + 1) / 100.0).cast("long").alias("size")), "select job_id, case when job_id % 9000 <= s then job_id % 9000 else s end::bigint as size from (select job_id, greatest(10, least(5000, floor(30 / ((job_id % 50 + 1) / 100.0::double)))) as s from jobs)")
add("m01_batches", lambda v: O.sliced(v.images.select("id"), "id", 250).groupBy("batch").agg(F.count("*").alias("n")), "select batch, count(*) as n from (select floor((row_number() over (order by id) - 1) / 250)::int as batch from images) group by 1")
add("w11_ema", lambda v: J.smoothed_timing(v.jobs.withColumn("v", F.col("job_id") % 17).withColumn("at", F.col("job_id")), ["job_type"], "at", "v").select("job_type", F.round("ema", 6).alias("ema")), "with recursive o as (select job_type, (job_id % 17)::double as v, row_number() over (partition by job_type order by job_id) as r, count(*) over (partition by job_type) as n from jobs) select job_type, round(sum(v * case when r = 1 then power(0.7::double, n - 1) else 0.3 * power(0.7::double, n - r) end), 6) as ema from o group by 1")
add("s14_latest", lambda v: S.latest(v.jobs, ["job_type"], ["updated_at", "job_id"]).select("job_type", "job_id"), "select job_type, job_id from jobs qualify row_number() over (partition by job_type order by updated_at desc, job_id desc) = 1")
add("o06_recent_jobs", lambda v: J.recent(v.jobs, 5).select("job_id"), "select job_id from jobs order by updated_at desc, job_id desc limit 5")
add("a30_rollup", lambda v: J.rolled_up(v.batches, "status", ["processed_count", "error_count"]), "select status, sum(processed_count)::bigint as processed_count, sum(error_count)::bigint as error_count from batches group by 1")
add("a26_bottlenecks", lambda v: J.bottlenecks(J.operation_statistics(v.batches, "status", "items_count", "processed_count"), 20.0).select("status"), "select status from (select status, 100 * sum(items_count)::double / sum(sum(items_count)) over () as share from batches group by 1) where share >= 20")
add("a26_slowest", lambda v: J.slowest(J.operation_statistics(v.batches, "status", "items_count", "processed_count"), "status", 2).select("status", "total"), "select status, sum(items_count)::bigint as total from batches group by 1 order by total desc, status limit 2")
add("a30_first_errors", lambda v: J.first_errors(v.batches.where("error_count > 0"), "status", ["started_at", "parent_job_id", "batch_number"]).select("status", "parent_job_id", "batch_number"), "select status, parent_job_id, batch_number from batches where error_count > 0 qualify row_number() over (partition by status order by started_at, parent_job_id, batch_number) <= 10")
add("m10_bulk_delete", lambda v: J.without(v.jobs, ("completed", "failed")).select("job_id"), "select job_id from jobs where status not in ('SUCCESS', 'FAILURE', 'STALE')")
add("a26_share", lambda v: J.operation_statistics(v.batches, "status", "items_count", "processed_count").withColumns({"mean": F.round("mean", 6), "share": F.round("share", 4)}), "select status, count(*) as runs, sum(items_count)::bigint as total, min(items_count) as low, max(items_count) as high, round(sum(items_count)::double / sum(processed_count), 6) as mean, round(100 * sum(items_count)::double / sum(sum(items_count)) over (), 4) as share from batches group by 1")

# vectors
add("v02_similar", lambda v: V.similar_to(v.table("embeddings"), 3, 0.2, 20).select("vec_id", F.round("similarity", 6).alias("s")), "select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 3)), 6) as s from embeddings where vec_id <> 3 and list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 3)) >= 0.2 order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 3)) desc, vec_id limit 20")
_Q = [((i * 37) % 11 - 5) / 5 for i in range(64)]
add("v01_search", lambda v: V.search(v.table("embeddings"), _Q, 0.1, 50).select("vec_id", F.round("similarity", 6).alias("s")), f"select vec_id, round(c, 6) as s from (select vec_id, list_cosine_similarity(embedding::double[], {_Q}::double[]) as c from embeddings) where c >= 0.1 order by c desc, vec_id limit 50")
add("v04_resize", lambda v: v.table("embeddings").select("vec_id", F.round(V.dot(V.resized(F.col("embedding"), 70), V.resized(F.col("embedding"), 70)), 4).alias("n"), F.size(V.resized(F.col("embedding"), 70)).alias("size")), "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as n, 70 as size from embeddings")
_CENTERS = lambda v: v.table("embeddings").where("vec_id < 10").select(F.concat(F.lit("t"), "vec_id").alias("tag"), F.col("embedding").alias("center"))
add("t01_zero_shot", lambda v: V.zero_shot(v.table("embeddings"), _CENTERS(v), 0.1, 3), "select e.vec_id, 't' || c.vec_id as tag, round(list_cosine_similarity(e.embedding::double[], c.embedding::double[]), 6) as similarity from embeddings e, (select * from embeddings where vec_id < 10) c where similarity >= 0.1 qualify row_number() over (partition by e.vec_id order by similarity desc, tag) <= 3")

# reorganisation
_FORMS = {"YYYY-MM": "%Y-%m", "YYYY/MM": "%Y/%m", "YYYY-MM-DD": "%Y-%m-%d", "YYYY": "%Y", "YYYY/MM-DD": "%Y/%m-%d", "FLAT": None}
for _k, (_layout, _form) in enumerate(_FORMS.items()):
    add(f"r01_layout_{_k}", lambda v, x=_layout: v.images.select("id", R.directory("/out", F.col("selected_date"), F.col("status_id"), x).alias("dir")), f"select id, case when selected_date is not null then case when status_id = 'rejected' then '/out/_rejected' else '/out' end{f''' || '/' || strftime(selected_date, '{_form}')''' if _form else ''} end as dir from images")
_EXT = "regexp_extract(source_path, '(\\.[^./]+)$', 1)"
_BASE = "string_split(source_path, '/')[-1]"
_DATED = {"date_time_checksum": (f"strftime(selected_date, '%Y-%m-%d_%H%M%S') || '_' || substr(checksum, 1, 8) || {_EXT}", f"checksum || {_EXT}"), "date_time_original": (f"strftime(selected_date, '%Y-%m-%d_%H%M%S') || '_' || {_BASE}", _BASE), "original": (_BASE, _BASE), "checksum": (f"checksum || {_EXT}", f"checksum || {_EXT}"), "time_checksum": (f"strftime(selected_date, '%H%M%S') || '_' || substr(checksum, 1, 8) || {_EXT}", f"checksum || {_EXT}")}
for _naming, (_a, _b) in _DATED.items():
    add(f"r02_{_naming}", lambda v, x=_naming: v.images.select("id", R.file_name(F.col("source_path"), F.col("selected_date"), F.col("checksum"), x).alias("name")), f"select id, case when selected_date is not null then {_a} else {_b} end as name from images")
add("r04_plan", lambda v: R.plan(v.images, "/photos/src1", "YYYY", "checksum"), f"select id, source_path, case when dir is not null then dir || '/' || case when n = 0 then name else checksum || printf('_%03d', n) || {_EXT} end end as target, case when dir is null then 'no_date' when starts_with(source_path, '/photos/src1/') then 'skip' else 'copy' end as action from (select *, row_number() over (partition by dir, name order by id) - 1 as n from (select *, checksum || {_EXT} as name, case when selected_date is not null then case when status_id = 'rejected' then '/photos/src1/_rejected/' else '/photos/src1/' end || strftime(selected_date, '%Y') end as dir from images))")

# storage
add("s01_discovery", lambda v: S.discover(v.images.select(F.col("source_path").alias("path"))).groupBy(F.coalesce("reason", F.lit("media")).alias("reason")).agg(F.count("*").alias("n")), "select case when source_path like '%.txt' then 'unsupported' else 'media' end as reason, count(*) as n from images group by 1")
add("s05_file_type", lambda v: v.images.select("id", text.file_type(F.col("source_path")).alias("t")), "select id, file_type as t from images")
add("s06_checksum", lambda v: v.table("pages").select("page_id", S.checksum("html").alias("c")), "select page_id, sha256(html) as c from pages")
add("s08_scan", lambda v: S.scan_actions(v.images, v.images.where("id % 3 = 0").groupBy("checksum").agg((F.min("id") % 2 == 0).alias("incomplete"))).select("checksum", "id", "action"), "select checksum, min(i.id) as id, case when any_value(e.checksum) is null then 'insert' when bool_or(incomplete) then 'update' else 'skip' end as action from images i left join (select checksum, min(id) % 2 = 0 as incomplete from images where id % 3 = 0 group by 1) e using (checksum) group by checksum")
add("s10_image_id", lambda v: v.images.select("id", S.image_id(F.col("catalog_id"), F.col("checksum")).alias("k")), "select id, sha256(catalog_id || ':' || checksum) as k from images")
add("s11_insert_absent", lambda v: S.insert_absent(v.images.where("id < 300").select("checksum"), v.images.where("id >= 300").select("checksum"), ["checksum"]), "select checksum from images where id < 300 union all select checksum from images where id >= 300 and checksum not in (select checksum from images where id < 300)")
add("s17_cascade", lambda v: S.without_catalog(v.image_tags, v.images, 1).select("image_id", "tag_id"), "select image_id, tag_id from image_tags where image_id not in (select id from images where catalog_id = 1)")
add("s20_groups", lambda v: D.with_members(v.groups, v.members).withColumn("ids", F.array_join("ids", ",")), "select group_id, string_agg(image_id::varchar, ',' order by image_id) as ids, any_value(g.confidence) / 100.0::double as confidence from members join groups g using (group_id) group by 1")
add("s21_export_duplicates", lambda v: D.recommendations(v.groups, v.members).select("group_id", "image_id", "action"), "select group_id, image_id, case when image_id = primary_image_id then 'keep' else 'delete' end as action from members join groups using (group_id)")
add("s22_export_images", lambda v: v.images.orderBy(*I.ordering("date", True)).select("id", "source_path", F.col("selected_date").cast("string").alias("taken")), "select id, source_path, selected_date::varchar as taken from images")
add("s23_orientation", lambda v: v.images.select("id", S.orientation(F.col("id") % 4 * 90, F.col("id") % 8 >= 4).alias("o")), "select id, case when id % 8 < 4 then [1, 6, 3, 8][id % 4 + 1] else [2, 7, 4, 5][id % 4 + 1] end as o from images")
add("s33_edits", lambda v: v.images.select("id", S.edits(F.when(F.col("id") % 3 == 0, F.lit("{}"))).alias("edit")), "select id, coalesce(case when id % 3 = 0 then '{}' end, '{\"version\":1}') as edit from images")
add("x36_json", lambda v: v.table("events").select("event_id", S.json_field(F.when(F.col("event_id") % 7 == 0, '{"k": "bad"}').otherwise(F.col("props")), "$.k", "int").alias("k")), "select event_id, try_cast(json_extract_string(case when event_id % 7 = 0 then '{\"k\": \"bad\"}' else props end, '$.k') as int) as k from events")
add("o10_evict", lambda v: I.evicted(v.images, 1_500_000_000).select("id"), "select id from (select id, sum(size_bytes) over () as total, sum(size_bytes) over (order by created_at, id) - size_bytes as before from images) where total > 1500000000 and total - before > 0.9 * 1500000000")


def _listed(v):
    vectors = v.table("embeddings")
    centers = V.list_centers(vectors, 8)
    index = S.checkpointed(V.in_lists(vectors, centers))
    return V.list_search(index, vectors.where("vec_id % 50 = 0"), centers, len(centers), 5)


add("v05_list_index", _listed, "select a.vec_id as query, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) desc, b.vec_id) as r from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id qualify r <= 5")
