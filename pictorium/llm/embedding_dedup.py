"""Near-duplicate vectors by a random-projection tree forest with spill.

1. Equal vectors of a label are one class; one of them stands for it, with their number.
2. The forest is fitted on at most SAMPLE vectors of each length, taken by hash. Every level of
   a tree projects on a random direction of its own and each node splits at its sample's
   median; nodes without a sample split at their level's median. Trees are deep enough for
   leaves of about LEAF vectors of the most frequent label. A node that a split would mostly
   send both ways, such as one full of near copies of a vector, stays a leaf.
3. Every vector goes down every tree; within ``spill`` of a split it goes both ways. Vectors
   of one label, in one leaf, are compared, all with all, in double precision; a leaf with
   more than BLOCK vectors of a label is cut into blocks and each pair of blocks is a task.
4. A pair is counted in the first leaf that holds both, so counts need no list of pairs:
   a leaf gives each member its number of new links and one tie to its part of the leaf.
5. Ties give the components.

With spill, a pair at the threshold is separated by a split in about three of a hundred cases,
and all trees must separate it to miss it; tests measure recall against brute force.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component,
and rows without label, link with nothing; vectors of different lengths never link; rows that
repeat a ``vec_id`` are vectors of their own with one component; a row without ``vec_id`` takes
its component's, null where there is none; an empty table gives no rows. Columns other than
the three named are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable

SAMPLE = 32_768
LEAF = 512
DEEPEST = 22
BOTH_WAYS = 0.5
BLOCK = 1500


class Forest:
    """For each vector length and tree: directions by level and split points by node (root 1, children 2n and 2n + 1; NaN: a leaf)."""

    def __init__(self, trees: int, spill_factor: float, cosine: float, seed: int):
        self.trees, self.seed = trees, seed
        self.reach = spill_factor * float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        self.made: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def spill(self, dim: int) -> float:
        """A share of how far a pair at the threshold differs on a random direction."""
        return self.reach / dim**0.5

    def fit(self, x: np.ndarray, depth: int) -> None:
        dim = x.shape[1]
        self.made[dim] = []
        for t in range(self.trees):
            r = np.random.default_rng([self.seed, t, dim]).normal(size=(dim, depth))
            r /= np.linalg.norm(r, axis=0)
            splits = np.full(1 << depth, np.nan)
            node = np.ones(len(x), np.int64)
            for level, p in enumerate((x @ r).T):
                first = 1 << level
                splits[first : 2 * first] = np.median(p)
                order = np.lexsort((p, node))
                at, starts, sizes = np.unique(node[order], return_index=True, return_counts=True)
                splits[at] = p[order][starts + sizes // 2]
                near = np.bincount(node - first, np.abs(p - splits[node]) < self.spill(dim), first)[at - first]
                splits[at[(near > BOTH_WAYS * sizes) & (sizes > 1)]] = np.nan
                stopped = np.isnan(splits[first : 2 * first])
                if level:  # below a leaf there is nothing
                    stopped |= np.repeat(np.isnan(splits[first // 2 : first]), 2)
                splits[first : 2 * first][stopped] = np.nan
                live = ~stopped[node - first]
                node = np.where(live, 2 * node + (p >= splits[node]), 2 * node)
            self.made[dim].append((r, splits))

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of row and leaf code for rows of one length; codes tell trees apart."""
        spill = self.spill(x.shape[1])
        rows, codes = [], []
        for t, (r, splits) in enumerate(self.made.get(x.shape[1], [(np.zeros((x.shape[1], 0)), np.full(1, np.nan))])):
            own, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for p in (x @ r).T:
                away = p[own] - splits[node]
                done = np.isnan(away)
                rows.append(own[done])
                codes.append((t << 40) | node[done])
                left, right = away < spill, away >= -spill
                own, node = np.concatenate((own[left], own[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            rows.append(own)
            codes.append((t << 40) | node)
        return np.concatenate(rows), np.concatenate(codes)


def unit_rows(array) -> np.ndarray:
    """An Arrow list array of equally long vectors as unit rows in double precision."""
    x = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(x: np.ndarray, weights: np.ndarray, codes: list[list[int]], code: int, blocks: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links first met in leaf ``code``, each as many as its other end weighs, and for each member the first one of its part of the leaf."""
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if len(set(blocks.tolist())) > 1:
        near &= blocks[:, None] != blocks[None, :]
    n, some = len(x), np.flatnonzero(near.any(axis=1))
    links, part = np.zeros(n, np.int64), np.arange(n)
    if not len(some):
        return links, part
    near = near[np.ix_(some, some)]
    before = sorted({c for i in some for c in codes[i] if c < code})
    place = {c: k for k, c in enumerate(before)}
    member = np.zeros((len(some), len(before)), np.float32)
    for k, i in enumerate(some):
        member[k, [place[c] for c in codes[i] if c < code]] = 1
    links[some] = (near & ~(member @ member.T > 0) if before else near) @ weights[some]
    low = np.arange(len(some))
    while True:
        new = np.minimum(low, np.where(near, low[None, :], len(some)).min(axis=1))
        new = new[new]
        if (new == low).all():
            break
        low = new
    part[some] = some[low]
    return links, part


def links(vectors: DataFrame, cosine: float = 0.93, trees: int = 4, spill_factor: float = 0.4, seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    element = element if element == "float" else "double"  # floats travel as such
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast(f"array<{element}>").alias("embedding")).withColumn("row", F.monotonically_increasing_id())
    fine = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("embedding", lambda e: e != 0)
    v = durable(v.withColumns({"fine": F.coalesce(fine, F.lit(False)), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("second"), "embedding")}), "vectors")
    good = v.where("fine").withColumn("dim", F.size("embedding"))
    classes = durable(good.groupBy("label", "dim", "h1", "h2").agg(F.min("row").alias("rep"), F.count("*").alias("weight")), "classes")
    copies = classes.where("weight > 1")
    alone = copies.isEmpty()
    by_dim = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n"), F.sum("n").alias("all")).where(F.col("n") > LEAF)
    forest = Forest(trees, spill_factor, cosine, seed)
    for r in by_dim.orderBy("dim").toLocalIterator():  # other lengths have one leaf each
        rate = min(1.0, SAMPLE / r["all"])
        sample = good.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(rate * (1 << 30)))).select("embedding").limit(2 * SAMPLE).toArrow()["embedding"].combine_chunks()
        if len(sample):
            forest.fit(unit_rows(sample), min(DEEPEST, int(np.ceil(np.log2(r["n"] / LEAF)))))
    shared = spark.sparkContext.broadcast(forest)  # at most 2**DEEPEST split points a tree

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                at, codes = shared.value.leaves(unit_rows(b["embedding"].take(pa.array(own))))
                order = np.lexsort((codes, at))
                ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(own)))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes[order], pa.int64()))
                t = b.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([t["row"], t["label"], t["dim"], t["weight"], t["embedding"], lists], names=["row", "label", "dim", "weight", "embedding", "codes"])

    label = v.schema["label"].dataType.simpleString()
    one = good.withColumn("weight", F.lit(1).cast("long")) if alone else good.join(classes.select(F.col("rep").alias("row"), "weight"), "row")
    placed = durable(one.select("row", "label", "dim", "weight", "embedding").mapInArrow(assign, f"row long, label {label}, dim int, weight long, embedding array<{element}>, codes array<long>"), "placed")
    each = placed.withColumn("code", F.explode("codes"))
    large = each.groupBy("label", "dim", "code").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("label", "dim", "code", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    each = each.join(large, ["label", "dim", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    dealt = each.withColumn("b", F.explode(pair)).select("label", "dim", "code", "b.i", "b.j", "block", "row", "weight", "embedding", "codes")
    keys = ["label", "dim", "code", "i", "j"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        import pyarrow as pa

        def flush(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            n, part = compare(unit_rows(t["embedding"].combine_chunks()), t["weight"].to_numpy(), t["codes"].to_pylist(), t["code"][0].as_py(), t["block"].to_numpy(), cosine)
            row = t["row"].combine_chunks()
            met = np.flatnonzero((n > 0) | (part != np.arange(len(part))))
            return pa.RecordBatch.from_arrays([pa.array(n[met]), row.take(pa.array(met)), row.take(pa.array(part[met]))], names=["n", "u", "v"])

        last, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            k = list(zip(*(b[c].to_pylist() for c in keys), strict=True))
            edges = [0, *(x for x in range(1, len(k)) if k[x] != k[x - 1]), len(k)]
            for s, e in zip(edges, edges[1:], strict=False):
                if k[s] != last and parts:
                    yield flush(parts)
                    parts = []
                last = k[s]
                parts.append(b.slice(s, e - s))
        if parts:
            yield flush(parts)

    found = durable(dealt.mapInArrow(run, "n long, u long, v long"), "links")
    counted = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    rows = v.select("row", "vec_id", "label", "fine", F.size("embedding").alias("dim"), "h1", "h2")
    if alone:
        rows = rows.select("row", "vec_id", F.col("row").alias("rep"), F.lit(1).alias("weight"))
    else:
        known = rows.where("fine").join(classes, ["label", "dim", "h1", "h2"]).select("row", "vec_id", "rep", "weight")
        rows = durable(known.unionByName(rows.where("not fine").select("row", "vec_id", F.col("row").alias("rep"), F.lit(1).cast("long").alias("weight"))), "rows")
    again = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v <> last").select("vec_id", "v")
    ties = found.where("u <> v").select("u", "v").unionByName(rows.join(again, "vec_id").select(F.col("rep").alias("u"), "v"))
    parts = connected_components(ties)
    out = rows.join(counted, "rep", "left").join(parts, F.col("rep") == parts["node"], "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("part"))
    out = durable(out, "parts")
    least = out.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    return out.join(least, "part").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
