"""Catalog views over the driver tables, each as a DataFrame and as SQL for the oracle.

Only arithmetic, ``sha256``, string and date functions are used, so both forms give the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: column: expression, or (Spark, DuckDB) where the dialects differ
IMAGES = {
    "id": "doc_id",
    "catalog_id": "doc_id % 2",
    "source_path": "'/photos/' || source || '/IMG_' || lpad(cast(doc_id as string), 6, '0') || (case doc_id % 6 when 0 then '.jpg' when 1 then '.CR2' when 2 then '.mp4' when 3 then '.png' when 4 then '.heic' else '.txt' end)",
    "file_type": "case doc_id % 6 when 2 then 'video' when 5 then 'unknown' else 'image' end",
    "format": "case doc_id % 6 when 0 then 'JPEG' when 1 then 'CR2' when 3 then 'PNG' when 4 then 'HEIC' when 5 then '' end",
    "checksum": ("sha2(text, 256)", "sha256(text)"),
    "size_bytes": "n_chars * 1000",
    "camera_make": "case when doc_id % 13 = 0 then null else lang end",
    "camera_model": "source",
    "lens_model": "case when doc_id % 4 = 3 then null else 'L' || cast(doc_id % 4 as string) end",
    "focal_length": "case when doc_id % 9 = 0 then null else cast(doc_id % 60 as double) + 0.5 * (doc_id % 2) end",
    "aperture": "case doc_id % 4 when 0 then 1.8e0 when 1 then 2.8e0 when 2 then 4.0e0 else 5.6e0 end",
    "iso": "100 * (1 + doc_id % 32)",
    "width": "640 + (doc_id * 37) % 7000",
    "height": "480 + (doc_id * 53) % 4000",
    "selected_date": ("case when doc_id % 11 = 0 then null else timestampadd(SECOND, (doc_id * 104729) % 86400, timestampadd(DAY, (doc_id * 7919) % 1460, timestamp_ntz '2020-01-01 00:00:00')) end", "case when doc_id % 11 = 0 then null else timestamp '2020-01-01' + to_days(cast((doc_id * 7919) % 1460 as integer)) + to_seconds((doc_id * 104729) % 86400) end"),
    "confidence": "(doc_id * 31) % 101",
    "latitude": "case when doc_id % 3 = 0 then null when doc_id % 17 = 0 then 0e0 else ((doc_id * 7919) % 17000) / 100e0 - 85e0 end",
    "longitude": "case when doc_id % 3 = 0 then null when doc_id % 17 = 0 then 0e0 else ((doc_id * 104729) % 36000) / 100e0 - 180e0 end",
    "status_id": "case doc_id % 4 when 0 then 'active' when 1 then 'rejected' when 2 then 'archived' else 'flagged' end",
    "quality_score": "case when doc_id % 6 = 0 then null else (doc_id * 37) % 101 end",
    "description": "case doc_id % 5 when 0 then null when 1 then '' else 'about ' || source end",
    "created_at": ("timestampadd(MINUTE, doc_id, timestamp_ntz '2024-01-01 00:00:00')", "timestamp '2024-01-01' + to_minutes(doc_id)"),
    "burst_id": "case when doc_id % 10 < 3 then null else doc_id - doc_id % 10 end",
    "burst_sequence": "case when doc_id % 10 < 3 then null else doc_id % 10 - 3 end",
    "dhash": ("case when doc_id % 19 = 0 then '' when doc_id % 23 = 0 then '0000000000000000' when doc_id % 29 = 0 then null else substr(sha2(text, 256), 1, 16) end", "case when doc_id % 19 = 0 then '' when doc_id % 23 = 0 then '0000000000000000' when doc_id % 29 = 0 then null else substr(sha256(text), 1, 16) end"),
    "ahash": ("case when doc_id % 31 = 0 then null else substr(sha2(text, 256), 17, 16) end", "case when doc_id % 31 = 0 then null else substr(sha256(text), 17, 16) end"),
    "whash": ("substr(sha2(text, 256), 33, 16)", "substr(sha256(text), 33, 16)"),
}
SHOTS = {
    "image_id": "event_id",
    "ts": ("cast(ts as timestamp_ntz)", "ts"),
    "camera_make": "case when user_id % 7 = 0 then null else 'make' || cast(user_id % 5 as string) end",
    "camera_model": "cast(user_id as string)",
    "quality_score": "value",
    "source_path": "'/s/IMG_' || lpad(cast(event_id as string), 6, '0') || '.jpg'",
    "latitude": "case when event_id % 4 = 0 then null else (user_id % 50) + (event_id % 3) / 100000e0 end",
    "longitude": "case when event_id % 4 = 0 then null else (user_id % 80) + (event_id % 3) / 100000e0 end",
    "status_id": "case when event_id % 3 = 0 then 'rejected' else 'active' end",
    "confidence": "event_id * 13 % 101",
}
TAGS = {"tag_id": "p_partkey", "name": "p_name || ' ' || cast(p_partkey as string)", "category": "p_brand"}
IMAGE_TAGS = {"image_id": "l_orderkey", "tag_id": "l_partkey", "confidence": "max(1 - 5 * l_discount)", "source": "min(case l_returnflag when 'A' then 'clip' when 'N' then 'manual' else 'ollama' end)"}
JOBS = {
    "job_id": "o_orderkey",
    "job_type": "case o_orderkey % 4 when 0 then 'scan' when 1 then 'tag' when 2 then 'quality' else 'detect' end",
    "status": "case o_orderstatus when 'F' then 'SUCCESS' when 'O' then 'PROGRESS' else case when o_orderkey % 2 = 0 then 'FAILURE' else 'PENDING' end end",
    "result_status": "case o_orderkey % 5 when 0 then 'completed_with_errors' when 1 then 'failed' end",
    "worker_failures": "case o_orderkey % 7 when 0 then 3 when 1 then 0 end",
    "updated_at": ("cast(o_orderdate as timestamp_ntz)", "cast(o_orderdate as timestamp)"),
}
BATCHES = {
    "parent_job_id": "l_orderkey",
    "batch_number": "l_linenumber",
    "status": "case l_linestatus when 'F' then 'COMPLETED' else case l_returnflag when 'R' then 'FAILED' when 'A' then 'CANCELLED' else case when l_partkey % 2 = 0 then 'RUNNING' else 'PENDING' end end end",
    "items_count": "cast(l_quantity as bigint)",
    "processed_count": "cast(floor(l_quantity * (1 - l_discount) + 1e-9) as bigint)",
    "error_count": "cast(l_quantity as bigint) % 3",
    "started_at": ("cast(l_shipdate as timestamp_ntz)", "cast(l_shipdate as timestamp)"),
}
VIEWS = {"images": ("documents", IMAGES, ""), "shots": ("events", SHOTS, ""), "tags": ("part", TAGS, ""), "image_tags": ("lineitem", IMAGE_TAGS, " group by l_orderkey, l_partkey"), "jobs": ("orders", JOBS, ""), "batches": ("lineitem", BATCHES, "")}

DUCK = {
    "groups": "select checksum, min(id) as primary_image_id, min(id) as group_id, 'exact' as similarity_type, 100 as confidence, min(id) % 2 = 0 as reviewed from images group by checksum having count(*) > 1",
    "members": "select g.group_id, i.id as image_id, 100 - (i.id % 7) as similarity_score from groups g join images i using (checksum)",
    "bursts": "select burst_id, count(*) as image_count, min(selected_date) as start_time, max(selected_date) as end_time, epoch(max(selected_date)) - epoch(min(selected_date)) as duration_seconds, min(camera_make) as camera_make, min(camera_model) as camera_model, min(id) as best_image_id from images where burst_id is not null group by burst_id",
    "variants": "select vec_id * 4 + v as image_id, vec_id, list_transform(range(1, 65), lambda k: embedding[k]::double * case when ((k - 1) * 7 + vec_id) % 64 < 2 * v then -1 else 1 end) as px from embeddings, (values (0), (1), (2), (3)) t(v)",
    "hashes": """select image_id, vec_id,
  list_sum(list_transform(range(1, 65), lambda k: case when px[k] > list_sum(px) / 64 then (1::hugeint << (64 - k)) else 0::hugeint end))::ubigint as ahash,
  list_sum(list_transform(range(1, 65), lambda k: case when px[k] < (case when k % 8 = 0 then px[k - 7] else px[k + 1] end) then (1::hugeint << (64 - k)) else 0::hugeint end))::ubigint as dhash from variants""",
    "pairs": "select a.image_id as image_1, b.image_id as image_2, bit_count(xor(a.ahash, b.ahash))::int as a_distance, bit_count(xor(a.dhash, b.dhash))::int as d_distance from hashes a join hashes b on a.image_id < b.image_id and (bit_count(xor(a.ahash, b.ahash)) <= 5 or bit_count(xor(a.dhash, b.dhash)) <= 5)",
}


def with_views(sql: str) -> str:
    """``sql`` after the definitions of the views that it names."""
    every = {name: f"select {', '.join(f'{e if isinstance(e, str) else e[1]} as {c}' for c, e in cols.items())} from {table}{tail}" for name, (table, cols, tail) in VIEWS.items()} | DUCK
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in every.items():
            if name not in need and re.search(rf"\b{name}\b", text) and body != text:
                visit(body)
                if name not in need:
                    need.append(name)

    visit(sql)
    head = ", ".join(f"{n} as ({every[n]})" for n in need)
    body = sql.strip()
    if not head:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {head}, {body[14:]}"
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"


class Views:
    """The views of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        table, cols, tail = VIEWS[name]
        exprs = {c: e if isinstance(e, str) else e[0] for c, e in cols.items()}
        df = self.table(table)
        if not tail:
            return df.selectExpr(*[f"{e} as {c}" for c, e in exprs.items()])
        keys = tail.split("group by ")[1].split(", ")
        made = df.groupBy(*keys).agg(*[F.expr(e).alias(c) for c, e in exprs.items() if e not in keys])
        return made.select(*[F.col(e).alias(c) if e in keys else c for c, e in exprs.items()])

    @cached_property
    def images(self) -> DataFrame:
        return self._view("images")

    @cached_property
    def shots(self) -> DataFrame:
        return self._view("shots")

    @cached_property
    def tags(self) -> DataFrame:
        return self._view("tags")

    @cached_property
    def image_tags(self) -> DataFrame:
        return self._view("image_tags")

    @cached_property
    def jobs(self) -> DataFrame:
        return self._view("jobs")

    @cached_property
    def batches(self) -> DataFrame:
        return self._view("batches")

    @cached_property
    def groups(self) -> DataFrame:
        g = self.images.groupBy("checksum").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
        return g.select("checksum", F.col("group_id").alias("primary_image_id"), "group_id", F.lit("exact").alias("similarity_type"), F.lit(100).alias("confidence"), (F.col("group_id") % 2 == 0).alias("reviewed"))

    @cached_property
    def members(self) -> DataFrame:
        return self.groups.select("group_id", "checksum").join(self.images, "checksum").select("group_id", F.col("id").alias("image_id"), (100 - F.col("id") % 7).alias("similarity_score"))

    @cached_property
    def bursts(self) -> DataFrame:
        from ..functions.dates import seconds

        b = self.images.where("burst_id is not null").groupBy("burst_id")
        return b.agg(F.count("*").alias("image_count"), F.min("selected_date").alias("start_time"), F.max("selected_date").alias("end_time"), (seconds(F.max("selected_date")) - seconds(F.min("selected_date"))).alias("duration_seconds"), F.min("camera_make").alias("camera_make"), F.min("camera_model").alias("camera_model"), F.min("id").alias("best_image_id"))

    @cached_property
    def variants(self) -> DataFrame:
        e = self.table("embeddings").withColumn("v", F.explode(F.array(*map(F.lit, range(4)))))
        px = F.transform("embedding", lambda x, k: x.cast("double") * F.when((k * 7 + F.col("vec_id")) % 64 < 2 * F.col("v"), -1).otherwise(1))
        return e.select((F.col("vec_id") * 4 + F.col("v")).alias("image_id"), "vec_id", px.alias("px"))

    @cached_property
    def hashes(self) -> DataFrame:
        from ..functions import hashing as h

        return self.variants.select("image_id", "vec_id", h.average_hash("px").alias("ahash"), h.difference_hash("px").alias("dhash"))

    @cached_property
    def pairs(self) -> DataFrame:
        from ..operators import duplicates

        return duplicates.similar_pairs(self.hashes, 5)
