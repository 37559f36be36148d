"""Discovery, upserts, exports and other reads and writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


_LOCAL: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table below ``spark.checkpoint.dir`` and read back, which cuts its lineage.

    Unlike ``checkpoint()`` this computes the plan once.
    """
    path = shared_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; in local mode, where none is set, in a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="pictorium-"))
    return f"{base.rstrip('/')}/pictorium/{name}-{uuid.uuid4().hex}"


def discover(paths: DataFrame) -> DataFrame:
    """``path, reason``: why a path is skipped (system folder, hidden, unsupported), null where it is media."""
    name = F.element_at(F.split("path", "/"), -1)
    reason = F.when(F.col("path").contains("/@eaDir"), "synology").when(name.startswith("@SynoResource"), "synology").when(name.startswith("."), "hidden").when(X.file_type(F.col("path")) == "unknown", "unsupported")
    return paths.select("path", reason.alias("reason"))


def media_files(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """Media files under a directory with content, type and checksum."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    return files.withColumn("file_type", X.file_type(F.col("path"))).where("file_type <> 'unknown'").withColumn("checksum", F.sha2("content", 256))


def image_id(catalog_id, checksum):
    return F.sha2(F.concat_ws(":", catalog_id, checksum), 256)


def scan_actions(found: DataFrame, existing: DataFrame) -> DataFrame:
    """``checksum, id, action`` of scanned files: the first path of each content is inserted, updated if its row lacks parts, or skipped."""
    first = found.withColumn("r", F.row_number().over(W.partitionBy("checksum").orderBy("id"))).where("r = 1").drop("r")
    e = existing.select("checksum", F.lit(True).alias("known"), "incomplete")
    action = F.when(F.col("known").isNull(), "insert").when(F.col("incomplete"), "update").otherwise("skip")
    return first.join(e, "checksum", "left").select("checksum", "id", action.alias("action"))


def latest(rows: DataFrame, keys: list[str], by: list[str], place: list[str] | None = None) -> DataFrame:
    """The last row of each key; of rows that tie, the first by ``place``, such as where they are stored."""
    order = [*[F.desc(b) for b in by], *[F.asc(p) for p in place or []]]
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti"))


def canonical_pairs(pairs: DataFrame, by: str) -> DataFrame:
    """Pairs with the smaller image first, the last writer's distance each."""
    p = pairs.withColumn("a", F.least("image_1", "image_2")).withColumn("b", F.greatest("image_1", "image_2"))
    return latest(p, ["a", "b"], [by]).select(F.col("a").alias("image_1"), F.col("b").alias("image_2"), "distance")


def orientation(rotation, flip_h):
    """EXIF orientation of a rotation in degrees and a horizontal flip."""
    out = None
    for (r, f), value in {(0, False): 1, (0, True): 2, (180, False): 3, (180, True): 4, (270, True): 5, (90, False): 6, (90, True): 7, (270, False): 8}.items():
        c = (rotation == r) & (flip_h == F.lit(f))
        out = F.when(c, value) if out is None else out.when(c, value)
    return out.otherwise(1)


def merge_incomplete(existing: DataFrame, found: DataFrame, parts: list[str], flags: list[str]) -> DataFrame:
    """Existing rows with only their missing parts taken from what was found, and flags set by either."""
    e, f = existing.alias("e"), found.alias("f")
    j = e.join(f, "checksum", "left")
    merged = [F.coalesce(f"e.{p}", f"f.{p}").alias(p) for p in parts]
    either = [(F.coalesce(F.col(f"e.{x}"), F.lit(False)) | F.coalesce(F.col(f"f.{x}"), F.lit(False))).alias(x) for x in flags]
    return j.select("checksum", *merged, *either)


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns of ``changes`` where it has the key."""
    r, c = rows.alias("r"), changes.withColumn("_hit", F.lit(True)).alias("c")
    j = r.join(c, F.col(f"r.{key}") == F.col(f"c.{key}"), "left")
    return j.select(*[F.when(F.col("c._hit"), F.col(f"c.{x}")).otherwise(F.col(f"r.{x}")).alias(x) if x in columns else F.col(f"r.{x}").alias(x) for x in rows.columns])


def run_sql(spark: SparkSession, sql: str, *params) -> DataFrame:
    """SQL with positional ``?`` markers."""
    return spark.sql(sql, args=list(params))


def save_index(hashes: DataFrame, path: str) -> None:
    hashes.select("image_id", "ahash", "dhash").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exported(df: DataFrame, path: str, form: str) -> None:
    """JSON lines or CSV with a header."""
    w = df.write.mode("overwrite")
    w.json(path) if form == "json" else w.option("header", True).csv(path)


def save_log(operations: DataFrame, path: str) -> None:
    """A transaction log as JSON lines: one for each transaction, its operations in order of ``position``.

    ``operations``: ``transaction_id, position, source, target, status``. A transaction is
    ``completed`` if all its operations are, ``failed`` if any failed, else ``pending``.
    """
    rows = F.array_sort(F.collect_list(F.struct("position", "source", "target", "status"))).alias("operations")
    state = F.when(F.bool_and(F.col("status") == "completed"), "completed").when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("pending")
    operations.groupBy("transaction_id").agg(state.alias("status"), rows).write.mode("overwrite").json(path)


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """``transaction_id, transaction_status, position, source, target, status`` of a saved log."""
    ddl = "transaction_id string, status string, operations array<struct<position: long, source: string, target: string, status: string>>"
    log = spark.read.schema(ddl).json(path)
    return log.select("transaction_id", F.col("status").alias("transaction_status"), F.explode("operations").alias("o")).select("transaction_id", "transaction_status", "o.*")


def create_schema(spark: SparkSession, database: str, tables: dict[str, str]) -> None:
    """Parquet tables by name and DDL, where they are absent."""
    spark.sql(f"create database if not exists {database}")
    for name, ddl in tables.items():
        spark.sql(f"create table if not exists {database}.{name} ({ddl}) using parquet")


def schema_exists(spark: SparkSession, database: str, tables: list[str]) -> bool:
    return spark.catalog.databaseExists(database) and all(spark.catalog.tableExists(f"{database}.{t}") for t in tables)


def checksum(content, algorithm: str = "sha256"):
    """Hexadecimal digest of a column, ``sha256``, ``sha1`` or ``md5``."""
    return {"sha256": lambda c: F.sha2(c, 256), "sha1": F.sha1, "md5": F.md5}[algorithm](content)


def verified(content, expected, algorithm: str = "sha256"):
    """Whether a column has the expected digest, in any case."""
    return F.lower(checksum(content, algorithm)) == F.lower(expected)


def without_catalog(rows: DataFrame, images: DataFrame, catalog_id) -> DataFrame:
    """Rows (``image_id``) that stay when a catalog and its images are deleted."""
    gone = images.where(F.col("catalog_id") == catalog_id).select(F.col("id").alias("image_id"))
    return rows.join(gone, "image_id", "left_anti")


def catalogs(images: DataFrame) -> DataFrame:
    """``catalog_id, n``."""
    return images.groupBy("catalog_id").agg(F.count("*").alias("n"))


def serialised(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, json``: the columns as one JSON text, nulls left out."""
    return rows.select(key, F.to_json(F.struct(*columns)).alias("json"))


def deserialised(rows: DataFrame, key: str, ddl: str) -> DataFrame:
    """Back from :func:`serialised`; ``ddl`` names the columns and their types."""
    return rows.select(key, F.from_json("json", ddl).alias("_r")).select(key, "_r.*")


#: The edits of an image that has none.
NO_EDITS = '{"version":1}'


def edits(stored):
    """An image's edits as JSON; null stands for none."""
    return F.coalesce(stored, F.lit(NO_EDITS))


def edited(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``id, edit`` after ``changes`` (``id, edit``); a change to null resets."""
    return updated(rows, changes, "id", ["edit"])


def merged_json(old, new):
    """Two JSON objects of texts as one; ``new`` wins."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(read(old), lambda k, v: ~F.map_contains_key(read(new), k)), read(new)))


def json_field(text, path: str, kind: str):
    """A field of a JSON text as ``kind``, null where it is missing or of another kind."""
    return F.get_json_object(text, path).try_cast(kind)


def first_directory(organised, sources):
    """Where an imported file belongs: its own directory, else the first of its sources (an array), else ``-``."""
    return F.coalesce(organised, F.get(sources, F.lit(0)), F.lit("-"))


def thumbnail_path(directory: str, image_id, size: str = "medium"):
    """Where an image's thumbnail is stored."""
    return F.concat(F.lit(f"{directory.rstrip('/')}/{size}/"), image_id.cast("string"), F.lit(".jpg"))
