"""Vector search, exact or by an inverted file of lists, and zero-shot tagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_LABELS = 10_000
FITTED_ON = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def resized(v: Column, n: int) -> Column:
    """Cut or padded with zeros to ``n``."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def search(vectors: DataFrame, query: list[float], threshold: float, limit: int) -> DataFrame:
    """``vec_id, similarity`` of the most similar vectors; the query travels as a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("vec_id", cosine(F.col("embedding"), q).alias("similarity")).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "vec_id").limit(limit)


def similar_to(vectors: DataFrame, vec_id: int, threshold: float, limit: int) -> DataFrame:
    """Like :func:`search` for a stored vector, itself left out; without it, no rows."""
    one = vectors.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q")).limit(1)
    met = vectors.where(F.col("vec_id") != vec_id).join(F.broadcast(one))  # one row
    return met.select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("similarity")).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "vec_id").limit(limit)


def zero_shot(vectors: DataFrame, labels: DataFrame, threshold: float, k: int) -> DataFrame:
    """``vec_id, tag, similarity``: each vector's best ``k`` of a fixed list of tag vectors (``tag, center``)."""
    if labels.count() > MOST_LABELS:
        raise ValueError(f"a vocabulary has {MOST_LABELS} tags at most")
    met = vectors.join(F.broadcast(labels))  # MOST_LABELS rows at most
    s = met.select("vec_id", "tag", F.round(cosine(F.col("embedding"), F.col("center")), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    return s.withColumn("r", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("similarity"), "tag"))).where(F.col("r") <= k).drop("r")


def list_centers(vectors: DataFrame, lists: int, rounds: int = 10) -> list[list[float]]:
    """Centers of an inverted file, fitted on FITTED_ON vectors at most, taken by hash."""
    import numpy as np

    x = np.array([r["embedding"] for r in vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FITTED_ON).select("embedding").collect()], float)
    if not len(x):
        return []
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = x[:lists].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for k in range(len(c)):
            if (near == k).any():
                mean = x[near == k].mean(axis=0)
                c[k] = mean / max(float(np.linalg.norm(mean)), 1e-300)
    return c.tolist()


def in_lists(vectors: DataFrame, centers: list[list[float]], probes: int = 1) -> DataFrame:
    """``vec_id, embedding, list``: each vector in the ``probes`` lists whose centers are most similar to it."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(centers)
        for b in batches:
            if not b.num_rows:
                continue
            x = b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            best = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
            t = b.take(pa.array(np.repeat(np.arange(b.num_rows), best.shape[1])))
            yield pa.RecordBatch.from_arrays([t["vec_id"], t["embedding"], pa.array(best.reshape(-1).astype(np.int32))], names=["vec_id", "embedding", "list"])

    return vectors.where("embedding is not null").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, f"vec_id long, embedding array<{element}>, list int")


def list_search(index: DataFrame, queries: DataFrame, centers: list[list[float]], probes: int, k: int) -> DataFrame:
    """``query, vec_id, similarity, r``: the ``k`` most similar vectors of each query's ``probes`` lists, itself left out.

    With as many probes as lists the answer is exact; fewer read less. ``index`` is what :func:`in_lists` gives, written.
    """
    q = in_lists(queries, centers, probes).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), "list")
    met = index.join(q, "list").where("vec_id <> query").select("query", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return met.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "vec_id"))).where(F.col("r") <= k)
