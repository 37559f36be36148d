"""Job status, batch progress, recovery and timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import checkpointed


def effective_status(status: Column, result: Column) -> Column:
    """queued, running, completed, failed or killed; the order of the rules matters."""
    return (
        F.when(status == "PENDING", "queued")
        .when(status.isin("STARTED", "PROGRESS"), "running")
        .when((status == "SUCCESS") & F.coalesce(result.isin("dispatched", "processing"), F.lit(False)), "running")
        .when(status.isin("FAILURE", "STALE"), "failed")
        .when(status.isin("REVOKED", "TERMINATED"), "killed")
        .when(status == "SUCCESS", "completed")
        .otherwise("running")
    )


def progress(batches: DataFrame) -> DataFrame:
    """Per job: batch counts by state, item sums, percent (truncated) and whether all are settled."""
    state = lambda s: F.count_if(F.col("status") == s)
    g = batches.groupBy("parent_job_id").agg(
        F.count("*").alias("total"), state("COMPLETED").alias("completed"), state("FAILED").alias("failed"), state("RUNNING").alias("running"), state("PENDING").alias("pending"), state("CANCELLED").alias("cancelled"),
        F.sum("items_count").alias("items"), F.sum("processed_count").alias("processed"), F.sum("error_count").alias("errors"),
    )
    percent = F.when(F.col("items") > 0, F.floor(F.col("processed") * 100 / F.col("items"))).otherwise(0).cast("int")
    overall = F.when(F.col("cancelled") > 0, "CANCELLED").when(F.col("completed") == F.col("total"), "SUCCESS").when((F.col("failed") > 0) & (F.col("completed") + F.col("failed") == F.col("total")), "FAILURE").when(F.col("running") + F.col("completed") > 0, "PROGRESS").otherwise("UNKNOWN")
    return g.withColumn("percent", percent).withColumn("is_complete", F.col("completed") + F.col("failed") + F.col("cancelled") == F.col("total")).withColumn("overall", overall)


def stale_batches(batches: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    return batches.where((F.col("status") == "RUNNING") & (F.col("started_at") < F.timestamp_add("MINUTE", F.lit(-minutes), as_of)))


def to_dispatch(batches: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Pending batches and stale running ones, each once."""
    cols = ["parent_job_id", "batch_number"]
    return stale_batches(batches, as_of, minutes).select(*cols).union(batches.where("status = 'PENDING'").select(*cols)).distinct()


def batch_plan(total: Column, seconds_per_item: Column, target: float = 30.0, low: int = 10, high: int = 5000) -> Column:
    """Batch size: what fits in ``target`` seconds within bounds; all in one if that is enough."""
    size = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.lit(target) / seconds_per_item)))
    return F.when(total <= size, total).otherwise(size)


def smoothed_timing(observations: DataFrame, keys: list[str], at: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average of ``value`` in order of ``at``, per key; it starts at the first value.

    Observations are dealt by ranges of key and time. What a range does to an average is a factor
    and an addend, so of a range two numbers are left, however many observations a key has.
    """
    o = observations.select(*keys, F.col(at).alias("at"), F.col(value).cast("double").alias("v"))
    o = checkpointed(o.repartitionByRange(*keys, "at").withColumn("part", F.spark_partition_id()))
    order = W.partitionBy(*keys, "part").orderBy("at", "v")
    n = F.count("*").over(W.partitionBy(*keys, "part"))
    o = o.withColumn("age", n - F.row_number().over(order))
    share = F.pow(F.lit(1 - alpha), F.col("age"))
    first = F.min(F.struct("at", "v"))
    ranges = o.groupBy(*keys, "part").agg(first.alias("first"), F.pow(F.lit(1 - alpha), F.count("*")).alias("factor"), F.sum(alpha * F.col("v") * share).alias("addend"))
    g = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "first", "factor", "addend"))).alias("o"))  # a row for each range at most
    ema = F.aggregate("o", F.element_at("o", 1)["first"]["v"], lambda acc, x: acc * x["factor"] + x["addend"])
    return g.select(*keys, ema.alias("ema"))


def cancelled(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Batches that must stop: cancelled themselves or of a job that is revoked or cancelled."""
    j = batches.join(jobs.select(F.col("job_id").alias("parent_job_id"), F.col("status").alias("job_status")), "parent_job_id", "left")
    return j.where((F.col("status") == "CANCELLED") | F.coalesce(F.col("job_status").isin("REVOKED", "CANCELLED"), F.lit(False))).select("parent_job_id", "batch_number")


def claimed(batches: DataFrame, worker: str) -> DataFrame:
    """The first pending batch of each job as running under ``worker``; settled and running ones stay."""
    first = F.row_number().over(W.partitionBy("parent_job_id", "status").orderBy("batch_number")) == 1
    b = batches.withColumn("take", (F.col("status") == "PENDING") & first)
    return b.select("parent_job_id", "batch_number", F.when(F.col("take"), "RUNNING").otherwise(F.col("status")).alias("status"), F.when(F.col("take"), worker).alias("worker_id"))


def recovery(batches: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """What a job needs: ``finalize`` if all settled, ``dispatch`` if batches are pending or stale, else ``wait``."""
    stale = (F.col("status") == "RUNNING") & (F.col("started_at") < F.timestamp_add("MINUTE", F.lit(-minutes), as_of))
    open_ = F.col("status").isin("PENDING", "RUNNING")
    g = batches.groupBy("parent_job_id").agg(F.count_if(open_).alias("open"), F.count_if(stale | (F.col("status") == "PENDING")).alias("ready"))
    return g.select("parent_job_id", F.when(F.col("open") == 0, "finalize").when(F.col("ready") > 0, "dispatch").otherwise("wait").alias("action"))


def requeue(batches: DataFrame, threshold: int) -> DataFrame:
    """Jobs with at least ``threshold`` failed batches."""
    return batches.where("status = 'FAILED'").groupBy("parent_job_id").agg(F.count("*").alias("failures")).where(F.col("failures") >= threshold)


#: Registered transforms by job type.
PROCESSORS: dict = {}


def processor(job_type: str):
    """Register a function of a DataFrame as the work of a job type."""

    def put(f):
        PROCESSORS[job_type] = f
        return f

    return put


def run_job(job_type: str, df: DataFrame) -> DataFrame:
    """What the processor of ``job_type`` makes of ``df``."""
    if job_type not in PROCESSORS:
        raise ValueError(f"no processor for {job_type}")
    return PROCESSORS[job_type](df)


#: What a job's status may be for each effective status.
STATUSES = {"queued": ("PENDING",), "running": ("STARTED", "PROGRESS"), "completed": ("SUCCESS",), "failed": ("FAILURE", "STALE"), "killed": ("REVOKED", "TERMINATED")}


def stale_jobs(jobs: DataFrame, as_of: Column, statuses: tuple = ("PROGRESS", "PENDING")) -> DataFrame:
    """Jobs of ``statuses`` last updated before ``as_of``."""
    return jobs.where(F.col("status").isin(*statuses) & (F.col("updated_at") < as_of))


def with_effective(jobs: DataFrame, keep: tuple = ()) -> DataFrame:
    """Jobs with their ``effective`` status, of ``keep`` only where that names any."""
    j = jobs.withColumn("effective", effective_status(F.col("status"), F.col("result_status")))
    return j.where(F.col("effective").isin(*keep)) if keep else j


def without(jobs: DataFrame, effective: tuple) -> DataFrame:
    """Jobs after a bulk deletion of all that have a status of the named effective ones."""
    gone = [s for e in effective for s in STATUSES[e]]
    return jobs.where(~F.coalesce(F.col("status").isin(*gone), F.lit(False)))


def recent(jobs: DataFrame, k: int) -> DataFrame:
    return jobs.orderBy(F.desc("updated_at"), F.desc("job_id")).limit(k)


def monitor(jobs: DataFrame, since: Column, expected: int | None = None) -> DataFrame:
    """``ok, failed, remaining, percent`` of the jobs updated from ``since`` on; ``expected``: how many there will be."""
    j = jobs.where(F.col("updated_at") >= since).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "SUCCESS").alias("ok"), F.count_if(F.col("status") == "FAILURE").alias("failed"))
    total = F.col("n") if expected is None else F.lit(expected)
    percent = F.when(total > 0, F.floor(F.col("ok") * 100 / total)).otherwise(0).cast("int")
    return j.select("ok", "failed", (total - F.col("ok") - F.col("failed")).alias("remaining"), percent.alias("percent"))


def transaction_states(operations: DataFrame, key: str) -> DataFrame:
    """Per transaction: operations, how many are completed and failed, whether all are and any is."""
    done, failed = F.col("status") == "COMPLETED", F.col("status") == "FAILED"
    return operations.groupBy(key).agg(F.count("*").alias("operations"), F.count_if(done).alias("completed"), F.count_if(failed).alias("failed"), F.bool_and(done).alias("is_complete"), F.bool_or(failed).alias("has_failures"))


def rolled_up(results: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Sums of the workers' ``counts`` by ``key``."""
    return results.groupBy(key).agg(*[F.sum(c).alias(c) for c in counts])


def first_errors(errors: DataFrame, worker: str, at: list[str], k: int = 10) -> DataFrame:
    """The first ``k`` errors of each worker in order of ``at``."""
    return errors.withColumn("_r", F.row_number().over(W.partitionBy(worker).orderBy(*at))).where(F.col("_r") <= k).drop("_r")


def operation_statistics(observations: DataFrame, operation: str, value: str, items: str) -> DataFrame:
    """Per operation: runs, total, least, most, mean for an item, and percent of the total of all operations."""
    g = observations.groupBy(operation).agg(F.count("*").alias("runs"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), (F.sum(value) / F.sum(items)).alias("mean"))
    return g.withColumn("share", 100 * F.col("total") / F.sum("total").over(W.partitionBy()))  # a row for each operation


def slowest(statistics: DataFrame, operation: str, n: int = 5) -> DataFrame:
    return statistics.orderBy(F.desc("total"), operation).limit(n)


def bottlenecks(statistics: DataFrame, percent: float = 10.0) -> DataFrame:
    """Operations that take at least ``percent`` of the total."""
    return statistics.where(F.col("share") >= percent)


def settings(config: DataFrame, prefix: str) -> DataFrame:
    """Entries whose key starts with ``prefix``, taken literally."""
    return config.where(F.col("key").startswith(prefix))
