"""Helpers shared by the training-data operators.

Nothing here depends on the size of the input: intermediate tables go to the
folder that the cluster names in ``spark.checkpoint.dir`` and are read back,
which cuts lineage and survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A word: a longest run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
ARROW_BYTES = 4 << 20
ARROW_ROWS = 2000


def bound_arrow(spark: SparkSession) -> None:
    """Bound each Arrow batch by bytes, so that very long texts cannot pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="pictorium-"))
    return base.rstrip("/")


_LOCAL: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pictorium/{name}-{uuid.uuid4().hex}"


NO_MARKER = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of it.

    What the write shuffled is deleted at its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        # no _SUCCESS marker, which nothing reads: a local file system starts two processes to set its permissions
        df.write.mode("overwrite").option("compression", "zstd").option(NO_MARKER, "false").parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the tables that :func:`durable` returned; nothing may read them any more."""
    for df in tables:
        if getattr(df, "durable_path", None):
            remove(df.sparkSession, df.durable_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`durable` wrote and nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Up to EDGES_A_TASK edges are one task's. Beyond, large-star and small-star rounds
    alternate until the edges no longer change: each is a dozen stages, which the driver
    plans whether edges are few or many. Minima are combined before the shuffle and every
    round is written to the shared folder. Edges may repeat or be loops; nulls are ignored.
    """
    spark = edges.sparkSession
    e = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    path = new_path(spark, "edges")
    e = durable(e, "edges", path)
    state = _digest(e)
    if state[0] <= EDGES_A_TASK and all(isinstance(f.dataType, IntegralType) for f in e.schema):
        return e.coalesce(1).mapInArrow(_merged, f"node {e.schema['u'].dataType.simpleString()}, component {e.schema['u'].dataType.simpleString()}")
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(e.where("u = v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low2.withColumnRenamed("m", "v")).distinct()
        after = new_path(spark, "edges")
        nxt = durable(small.coalesce(state[0] // EDGES_A_FILE + 1), "edges", after)  # there are no more than before
        new_state = _digest(nxt)
        remove(spark, path)
        e, path = nxt, after
        if new_state == state:
            break
        state = new_state
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


EDGES_A_FILE = 500_000
EDGES_A_TASK = 100_000


def _merged(batches):
    """``node, component`` of all edges ``u, v`` of the batches, by merging sets."""
    import pyarrow as pa

    above: dict[int, int] = {}

    def least(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    kind = pa.int64()
    for b in batches:
        kind = b["u"].type
        for x, y in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
            x, y = least(x), least(y)
            above[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(above), kind), pa.array([least(x) for x in list(above)], kind)], names=["node", "component"])


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


BROADCAST_ROWS = 50_000
MOST_BITS = 1 << 28
SALTS = 64


def small(keys: DataFrame) -> DataFrame:
    """``keys``, a narrow table, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _screened(rows: DataFrame, keys: DataFrame, n: int, key: list[str], of: list[str], salt: int = 0) -> DataFrame:
    """``rows`` with ``_found``: whether the hash of ``key`` is in a broadcast bitmap of those of the ``n`` rows of ``keys``."""
    bits = min(MOST_BITS, 1 << (n * 16 - 1).bit_length())
    place = lambda cols: F.xxhash64(*[F.lit(salt)] * bool(salt), *cols).bitwiseAND(F.lit(bits - 1).cast("long"))
    at, bit = F.shiftright("_at", 15), F.col("_at").bitwiseAND(F.lit((1 << 15) - 1).cast("long"))
    bitmap = keys.select(place(of).alias("_at")).groupBy(at.alias("_chunk")).agg(F.bitmap_construct_agg(bit).alias("_bitmap"))
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1, F.lit(False))
    return rows.withColumn("_at", place(key)).withColumn("_chunk", at).join(F.broadcast(bitmap), "_chunk", "left").withColumn("_found", found).drop("_chunk", "_bitmap", "_at")


def keyed_join(rows: DataFrame, keys: DataFrame, same: Column, how: str, key: list[str], of: list[str]) -> DataFrame:
    """``rows`` joined with a durable narrow table on ``same``, ``how``: ``inner``, ``left_semi`` or ``left_anti``.

    Columns ``key`` of ``rows`` and ``of`` of ``keys`` are equal, nulls too, where ``same`` holds. Up
    to BROADCAST_ROWS keys are broadcast. Beyond, a broadcast bitmap of their hashes screens the rows,
    and only those that may have a key are shuffled: about the share that has one, and one in 16 at most
    of the others up to MOST_BITS / 16 keys. More keys screen less, and the join stays exact.
    """
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), same, how)
    screened = _screened(rows, keys, n, key, of)
    met = screened.where("_found").drop("_found").join(keys, same, how)
    return screened.where("not _found").drop("_found").unionByName(met) if how == "left_anti" else met


def without(rows: DataFrame, every: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` whose ``key`` is not in durable ``gone``, none of them shuffled; ``every`` has the keys of all ``rows``, nulls equal.

    Up to BROADCAST_ROWS keys that go are broadcast. Beyond, a broadcast bitmap holds them; one of the
    keys that stay but hit it tells these from them; one of those that go and hit that, and so on: each
    table is a sixteenth of the one two before it, and the first of BROADCAST_ROWS at most is broadcast itself. As every key
    of ``rows`` took part, the outcome is exact. Only keys are shuffled.
    """
    key_of = [f"_of_{c}" for c in key]
    same = lambda left: reduce(and_, [left[c].eqNullSafe(F.col(o)) for c, o in zip(key, key_of, strict=True)])
    named = lambda t: t.select(*[F.col(c).alias(o) for c, o in zip(key, key_of, strict=True)])
    if (n := gone.count()) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(named(gone)), same(rows), "left_anti")
    inside, outside, hits = gone.select(*key), every.select(*key).join(named(gone), same(every), "left_anti"), 0
    rows = rows.withColumn("_hits", F.lit(0))
    while True:
        # only rows that hit all before can count: _hits is how many they hit in a row
        rows = _screened(rows, inside, n, key, key, hits + 1).withColumn("_hits", F.col("_hits") + (F.col("_found") & (F.col("_hits") == hits)).cast("int")).drop("_found")
        unsure = durable(_screened(outside, inside, n, key, key, hits + 1).where("_found").select(*key).distinct(), "unsure")
        hits += 1
        if (n := unsure.count()) <= BROADCAST_ROWS:
            break
        inside, outside = unsure, inside
    last = F.broadcast(named(unsure).withColumn("_last", F.lit(True)))
    rows = rows.join(last, same(rows), "left").withColumn("_hits", F.col("_hits") + (F.coalesce("_last", F.lit(False)) & (F.col("_hits") == hits)).cast("int"))
    return rows.where("_hits % 2 = 0").drop("_hits", "_last", *key_of)


def lookup_join(rows: DataFrame, small: DataFrame, keys: list[str], salt_by: str) -> DataFrame:
    """Inner join of ``rows`` with a durable table that has one row for each key, safe for hot keys.

    ``small`` is counted: up to BROADCAST_ROWS rows it is broadcast; beyond, both
    sides are salted, so that a key with a third of all rows meets in SALTS tasks.
    """
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")
