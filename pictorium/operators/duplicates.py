"""Exact and perceptual duplicates: pairs, segments, components, constrained groups, keepers."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing
from ..sources.storage import checkpointed


def exact_groups(images: DataFrame) -> DataFrame:
    """``checksum, ids``: files that share content, ids sorted."""
    g = images.where(F.col("checksum").isNotNull()).groupBy("checksum").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return g.where(F.size("ids") > 1)


def similar_pairs(hashes: DataFrame, threshold: int, mode: str = "any") -> DataFrame:
    """``image_1 < image_2`` within ``threshold`` bits by either hash (``any``) or both (``all``).

    Images with equal hashes are one key, and only keys meet; pairs of images are made at the end.
    Hashes within the threshold share two of ``threshold + 2`` bands, so an equi-join on pairs of
    bands finds every pair without comparing all. Hashes are written once, as their plan may be long.
    Joins are merge joins: Spark sizes exploded rows as if each key had one, and keys and images by
    their compressed files, and would broadcast them.
    """
    h = checkpointed(hashes.select("image_id", "ahash", "dhash"))
    keys = checkpointed(h.groupBy("ahash", "dhash").agg(F.min("image_id").alias("key"), F.count("*").alias("n")))
    out = None
    for name in ("ahash", "dhash"):
        met = keys.select("key", "ahash", "dhash", F.explode(hashing.band_pairs(F.col(name), threshold)).alias("b")).select("key", "ahash", "dhash", "b.band", "b.bits")
        a, b = met.alias("a"), met.alias("b")
        near = hashing.hamming(F.col(f"a.{name}"), F.col(f"b.{name}")) <= threshold
        j = a.hint("merge").join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.key") < F.col("b.key")) & near)
        found = j.select(F.col("a.key").alias("key_1"), F.col("b.key").alias("key_2"), hashing.hamming(F.col("a.ahash"), F.col("b.ahash")).alias("a_distance"), hashing.hamming(F.col("a.dhash"), F.col("b.dhash")).alias("d_distance"))
        out = found if out is None else out.unionByName(found)
        if mode == "all":
            break
    out = out.distinct()
    if keys.where("n > 1").isEmpty():
        out = out.select(F.col("key_1").alias("image_1"), F.col("key_2").alias("image_2"), "a_distance", "d_distance")
    else:
        of = checkpointed(h.hint("merge").join(keys, h["ahash"].eqNullSafe(keys["ahash"]) & h["dhash"].eqNullSafe(keys["dhash"])).select("key", "n", "image_id", h["ahash"], h["dhash"]))
        one, two = of.select(F.col("key").alias("key_1"), F.col("image_id").alias("a")), of.select(F.col("key").alias("key_2"), F.col("image_id").alias("b"))
        apart = out.hint("merge").join(one, "key_1").hint("merge").join(two, "key_2").select("a", "b", "a_distance", "d_distance")
        same = of.where("n > 1 and (ahash is not null or dhash is not null)")
        zero = lambda c: hashing.hamming(F.col(c), F.col(c)).alias(f"{c[0]}_distance")
        equal = same.select(F.col("key").alias("key_1"), F.col("image_id").alias("a"), zero("ahash"), zero("dhash")).hint("merge").join(two, F.col("key_1") == F.col("key_2")).where("a < b").select("a", "b", "a_distance", "d_distance")
        out = apart.unionByName(equal).select(F.least("a", "b").alias("image_1"), F.greatest("a", "b").alias("image_2"), "a_distance", "d_distance")
    return out.where((F.col("a_distance") <= threshold) & (F.col("d_distance") <= threshold)) if mode == "all" else out


def consensus(pairs: DataFrame, threshold: int = 5) -> DataFrame:
    return pairs.where((F.col("a_distance") <= threshold) & (F.col("d_distance") <= threshold))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """Each image's ``k`` nearest partners by average hash."""
    both = pairs.select(F.col("image_1").alias("query"), F.col("image_2").alias("other"), "a_distance").unionByName(pairs.select(F.col("image_2").alias("query"), F.col("image_1").alias("other"), "a_distance"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("a_distance", "other"))).where(F.col("rank") <= k)


def components(edges: DataFrame, u: str = "image_1", v: str = "image_2") -> DataFrame:
    """``node, component``: smallest node reachable, by label propagation with pointer jumping until nothing changes.

    Joins are merge joins: labels are as many as nodes, and Spark would broadcast them while their files are small.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
    both = checkpointed(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).select(F.col("u").alias("node"), "c"))
    while True:
        low = both.hint("merge").join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("c").alias("m"))
        new = label.hint("merge").join(low, label["node"] == low["u"]).select("node", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        jump = new.select(F.col("node").alias("at"), F.col("c").alias("to"))
        new = checkpointed(new.hint("merge").join(jump, new["c"] == jump["at"]).select("node", F.least("c", "to").alias("c"), "old"))
        label = new.select("node", "c")
        if new.where("c <> old").isEmpty():
            return label.select("node", F.col("c").alias("component"))


def segments(pairs: DataFrame, gap: int = 2) -> DataFrame:
    """Pairs with the segment of their distance: a new one where the sorted distances jump by more than ``gap``.

    Distances are a handful of values, so the scan runs over those and not over pairs.
    """
    d = pairs.select(F.col("distance").alias("d")).distinct()
    order = W.orderBy("d")
    jump = F.when(F.col("d") - F.lag("d").over(order) > gap, 1).otherwise(0)
    numbered = d.withColumn("jump", jump).withColumn("segment", F.sum("jump").over(order)).select("d", "segment")
    return pairs.join(F.broadcast(numbered), pairs["distance"] == numbered["d"]).drop("d")  # one row for each of at most 65 distances


def _links(one, two, distance):
    """``nodes, start, near, apart``: of node number ``i``, the neighbours' numbers, sorted, and their distances at ``start[i]:start[i + 1]``.

    Numbers follow the ids; of pairs that repeat, the smallest distance counts.
    """
    import numpy as np

    nodes, at = np.unique(np.concatenate([one, two]), return_inverse=True)
    i, j = at[: len(one)].astype(np.int32), at[len(one) :].astype(np.int32)
    src, near, apart = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([distance, distance])
    order = np.lexsort((apart, near, src))
    src, near, apart = src[order], near[order], apart[order]
    first = src != near
    first[1:] &= (src[1:] != src[:-1]) | (near[1:] != near[:-1])
    src, near, apart = src[first], near[first], apart[first]
    return nodes, np.searchsorted(src, np.arange(len(nodes) + 1)), near, apart


def _stars(start, near, apart) -> list:
    import numpy as np

    taken, out = np.zeros(len(start) - 1, bool), []
    for n in range(len(taken)):
        if taken[n]:
            continue
        others = near[start[n] : start[n + 1]]
        others = others[(others > n) & ~taken[others]]
        if len(others):
            taken[others] = True
            out.append(np.append(n, others))
    return out


def _constrained(start, near, apart, limit: int, diameter: int, window: int) -> list:
    import numpy as np

    n = len(start) - 1
    degree, left, met, out = np.diff(start), np.ones(n, bool), np.zeros(n, np.int32), []
    heap = [(-k, i) for i, k in enumerate(degree.tolist())]
    heapify(heap)
    while heap:
        k, seed = heappop(heap)
        if not left[seed]:
            continue
        if degree[seed] != -k:  # neighbours were taken since: its place is further back
            heappush(heap, (-int(degree[seed]), seed))
            continue
        others, d = near[start[seed] : start[seed + 1]], apart[start[seed] : start[seed + 1]]
        pick = left[others] & (d <= window)
        others = others[pick][np.argsort(d[pick], kind="stable")]
        group, new = [], seed
        while True:
            rows = slice(start[new], start[new + 1])
            group.append(int(new))
            left[new] = False
            degree[near[rows]] -= 1
            met[near[rows][apart[rows] <= diameter]] += 1
            others = others[met[others] == len(group)]  # near to all members
            if len(group) >= limit or not len(others):
                break
            new, others = others[0], others[1:]
        for m in group:
            met[near[start[m] : start[m + 1]]] = 0
        if len(group) > 1:
            out.append(np.array(group))
    return out


class _Bits:
    """Which groups a node fits, as a row of bits; ``first`` is the first that two nodes fit, or -1."""

    def __init__(self, nodes: int):
        import numpy as np

        self.np, self.rows, self.words = np, np.zeros((nodes, 1), np.uint64), 0

    def add(self, g: int, nodes) -> None:
        self.words = g // 64 + 1
        if self.words > self.rows.shape[1]:
            self.rows = self.np.hstack([self.rows, self.np.zeros_like(self.rows)])
        self.rows[nodes, g // 64] |= self.np.uint64(1 << g % 64)

    def drop(self, g: int, nodes) -> None:
        self.rows[nodes, g // 64] &= ~self.np.uint64(1 << g % 64)

    def first(self, a: int, b: int) -> int:
        low = 0
        while low < self.words:
            high = min(4 * low + 64, self.words)
            both = self.rows[a, low:high] & self.rows[b, low:high]
            k = int((both != 0).argmax())
            if word := int(both[k]):
                return 64 * (low + k) + (word & -word).bit_length() - 1
            low = high
        return -1


class _Sets:
    """As :class:`_Bits`, for components of many nodes, each of which fits few of the groups."""

    def __init__(self, nodes: int):
        self.rows: list[set] = [set() for _ in range(nodes)]

    def add(self, g: int, nodes) -> None:
        for n in nodes.tolist():
            self.rows[n].add(g)

    def drop(self, g: int, nodes) -> None:
        for n in nodes.tolist():
            self.rows[n].discard(g)

    def first(self, a: int, b: int) -> int:
        return min(self.rows[a] & self.rows[b], default=-1)


#: Components of up to so many nodes take a bit for each node and group.
BITS_BELOW = 1 << 14


def _cliques(start, near, apart) -> list:
    """A group keeps the nodes that are linked to all its members, which are all that it can still take."""
    import numpy as np

    n = len(start) - 1
    src = np.repeat(np.arange(n, dtype=np.int32), np.diff(start))
    up = src < near
    order = np.argsort(apart[up], kind="stable")
    linked, fitting = np.zeros(n, bool), (_Bits if n <= BITS_BELOW else _Sets)(n)
    groups, fits = [], []
    for a, b in zip(src[up][order].tolist(), near[up][order].tolist(), strict=True):
        g = fitting.first(a, b)
        if g < 0:
            one, two = near[start[a] : start[a + 1]], near[start[b] : start[b + 1]]
            linked[one] = True
            fits.append(np.append(two[linked[two]], (a, b)))
            linked[one] = False
            fitting.add(len(groups), fits[-1])
            groups.append({a, b})
            continue
        for x in (a, b):
            if x not in groups[g]:
                groups[g].add(x)
                mine = np.append(near[start[x] : start[x + 1]], x)
                linked[mine] = True
                stay = linked[fits[g]]
                linked[mine] = False
                fitting.drop(g, fits[g][~stay])
                fits[g] = fits[g][stay]
    return [np.array(sorted(g)) for g in groups]


STRATEGIES = {"constrained": _constrained, "clique": _cliques, "star": _stars}

#: Components share a task up to about so many pairs.
PAIRS_A_TASK = 100_000


def grouped(pairs: DataFrame, strategy: str = "constrained", limit: int = 20, diameter: int = 8, window: int = 3) -> DataFrame:
    """``group_id, image_id`` for order-defined grouping inside each component of ``image_1, image_2, distance``.

    ``constrained``: seeds of highest degree take near images that are near to all members.
    ``clique``: pairs by distance join the first group they are complete with; groups may overlap.
    ``star``: images in order of id absorb their neighbours. ``transitive`` and ``pair`` need no
    Python: :func:`components` and the pairs themselves. Components are dealt to tasks that hold the
    links of theirs as arrays; one component is one task's. Pairs are written once, as their plan may be long.
    """
    if strategy == "transitive":
        return components(pairs).select(F.col("component").alias("group_id"), F.col("node").alias("image_id"))
    if strategy == "pair":
        return pairs.select(F.monotonically_increasing_id().alias("group_id"), F.explode(F.array("image_1", "image_2")).alias("image_id"))
    pairs = checkpointed(pairs.select(F.col("image_1").cast("long").alias("image_1"), F.col("image_2").cast("long").alias("image_2"), "distance"))
    tasks = pairs.count() // PAIRS_A_TASK + 1
    task = F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task")
    tagged = pairs.join(components(pairs), F.col("image_1") == F.col("node")).select(task, "component", "image_1", "image_2", "distance")

    def run(pdf):
        import numpy as np
        import pandas as pd

        args = (limit, diameter, window) if strategy == "constrained" else ()
        parts = [pdf] if strategy in ("star", "constrained") else [p for _, p in pdf.groupby("component")]
        found = []
        for p in parts:
            nodes, *links = _links(p["image_1"].to_numpy(), p["image_2"].to_numpy(), p["distance"].to_numpy())
            found += [nodes[g] for g in STRATEGIES[strategy](*links, *args)]
        if not found:
            return pd.DataFrame({"group_id": [], "position": [], "image_id": []}, dtype="int64")
        n = [len(g) for g in found]
        return pd.DataFrame({"group_id": np.repeat([g[0] for g in found], n), "position": np.concatenate([np.arange(k) for k in n]), "image_id": np.concatenate(found)})

    return tagged.groupBy("task").applyInPandas(run, "group_id long, position long, image_id long")


def complete_cliques(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``group_id, complete``: whether a group has all its n (n - 1) / 2 pairs. Members may be many: joins are merge joins."""
    a, b = members.alias("a"), members.alias("b")
    inside = pairs.hint("merge").join(a, F.col("image_1") == F.col("a.image_id")).hint("merge").join(b, (F.col("image_2") == F.col("b.image_id")) & (F.col("a.group_id") == F.col("b.group_id"))).groupBy(F.col("a.group_id").alias("group_id")).agg(F.count("*").alias("edges"))
    n = members.groupBy("group_id").agg(F.count("*").alias("n"))
    return n.hint("merge").join(inside, "group_id", "left").select("group_id", (F.coalesce("edges", F.lit(0)) == F.col("n") * (F.col("n") - 1) / 2).alias("complete"))


def as_percent(confidence: Column) -> Column:
    """Whole percent of a confidence that may be given as a share of 1."""
    return F.when(confidence <= 1, confidence * 100).otherwise(confidence).cast("int")


def confidence(distance: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 10 * distance)


def primaries(members: DataFrame, images: DataFrame) -> DataFrame:
    """Each group's member of highest quality, smallest id among equals."""
    m = members.join(images, members["image_id"] == images["id"]).select("group_id", "image_id", "quality_score")
    r = F.row_number().over(W.partitionBy("group_id").orderBy(F.desc_nulls_last("quality_score"), "image_id"))
    return m.withColumn("r", r).where("r = 1").drop("r")


def keeper_scores(members: DataFrame, images: DataFrame) -> DataFrame:
    """Half quality (missing or 0: 50), age up to 30 (oldest of the group most), resolution up to 20 of the group's largest."""
    m = members.join(images, members["image_id"] == images["id"])
    g = W.partitionBy("group_id")
    days = F.floor(F.timestamp_diff("SECOND", F.min("selected_date").over(g), F.col("selected_date")) / 86400)
    age = F.when(F.col("selected_date").isNull(), 15.0).otherwise(30 * (1 - F.least(days / 365, F.lit(0.5))))
    px = F.col("width") * F.col("height")
    res = F.when(px.isNull(), 10.0).otherwise(20.0 * px / F.max(px).over(g))
    quality = F.when(F.coalesce("quality_score", F.lit(0)) == 0, 50).otherwise(F.col("quality_score"))
    return m.select("group_id", "image_id", F.round(0.5 * quality + age + res, 6).alias("score"), "selected_date", "size_bytes")


def keepers(members: DataFrame, images: DataFrame) -> DataFrame:
    """The recommended image of each group: best score, then oldest, then largest."""
    r = F.row_number().over(W.partitionBy("group_id").orderBy(F.desc("score"), F.asc_nulls_last("selected_date"), F.desc("size_bytes"), "image_id"))
    return keeper_scores(members, images).withColumn("r", r).where("r = 1").select("group_id", "image_id", "score")


def date_conflicts(members: DataFrame, images: DataFrame) -> DataFrame:
    m = members.join(images, members["image_id"] == images["id"])
    return m.groupBy("group_id").agg((F.count_distinct(F.to_date("selected_date")) > 1).alias("needs_review"))


def merge_groups(members: DataFrame) -> DataFrame:
    """Groups that overlap become one: ``image_id, component``."""
    first = members.groupBy("group_id").agg(F.min("image_id").alias("image_1"))
    e = members.join(first, "group_id").select("image_1", F.col("image_id").alias("image_2"))
    return components(e).withColumnRenamed("node", "image_id")


def group_listing(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with ``member_count``; without members that is 0."""
    n = members.groupBy("group_id").agg(F.count("*").alias("member_count"))
    return groups.join(n, "group_id", "left").withColumn("member_count", F.coalesce("member_count", F.lit(0)))


def largest_groups(listed: DataFrame, k: int) -> DataFrame:
    return listed.orderBy(F.desc("member_count"), "group_id").limit(k)


def filtered_groups(groups: DataFrame, reviewed: bool | None = None, similarity_type: str | None = None) -> DataFrame:
    g = groups if reviewed is None else groups.where(F.col("reviewed") == reviewed)
    return g.where(F.col("similarity_type") == similarity_type) if similarity_type else g


def group_details(members: DataFrame, images: DataFrame) -> DataFrame:
    """Members with the columns of their images."""
    return members.join(images, members["image_id"] == images["id"])


def redundant(groups: DataFrame, members: DataFrame, images: DataFrame) -> DataFrame:
    """Every group's members, with ``size_bytes`` of those that are not its primary; groups without members stay."""
    i = images.select(F.col("id").alias("_image"), "size_bytes")
    m = groups.join(members, "group_id", "left")
    return m.join(i, (F.col("image_id") == F.col("_image")) & (F.col("_image") != F.col("primary_image_id")), "left").drop("_image")


def group_statistics(groups: DataFrame, members: DataFrame, images: DataFrame) -> DataFrame:
    """``total, reviewed, savings``: groups, reviewed ones, bytes of what is not primary."""
    reviewed = F.count_distinct(F.when(F.col("reviewed"), F.col("group_id"))).alias("reviewed")
    return redundant(groups, members, images).agg(F.count_distinct("group_id").alias("total"), reviewed, F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("savings"))


def group_overview(groups: DataFrame, members: DataFrame, images: DataFrame) -> DataFrame:
    """``group_id, types, n, primary_path``: file types of the members, how many they are, the path of the primary."""
    m = group_details(members, images).groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("file_type")), ",").alias("types"), F.count("*").alias("n"))
    path = images.select(F.col("id").alias("primary_image_id"), F.col("source_path").alias("primary_path"))
    return groups.select("group_id", "primary_image_id").join(m, "group_id").join(path, "primary_image_id", "left").select("group_id", "types", "n", "primary_path")


def detector_statistics(members: DataFrame) -> DataFrame:
    """``groups, duplicates, redundant``: groups, their members, members beyond one for each group."""
    return members.agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("duplicates")).withColumn("redundant", F.col("duplicates") - F.col("groups"))


def group_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.round(F.avg("n"), 6).alias("mean"))


def burst_contamination(members: DataFrame, images: DataFrame) -> DataFrame:
    """``groups, with_bursts``: groups, and those that hold an image of a burst."""
    hit = F.when(F.col("burst_id").isNotNull(), F.col("group_id"))
    return group_details(members, images).agg(F.count_distinct("group_id").alias("groups"), F.count_distinct(hit).alias("with_bursts"))


def without_bursts(members: DataFrame, images: DataFrame) -> DataFrame:
    """Members that are in no burst, of groups that keep two or more of them."""
    in_burst = images.where("burst_id is not null").select(F.col("id").alias("image_id"))
    left = members.join(in_burst, "image_id", "left_anti")
    return left.join(left.groupBy("group_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("group_id"), "group_id", "left_semi")


def absent(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``known`` lacks."""
    return rows.join(known.select(key), key, "left_anti")


def index_difference(current: DataFrame, indexed: DataFrame, key: str, tolerance: float = 0.1) -> DataFrame:
    """``missing, extra, ratio, needs_rebuild`` of an index against the current keys; an empty catalog counts any extra key as 1."""
    j = current.select(key).distinct().withColumn("_c", F.lit(True)).join(indexed.select(key).distinct().withColumn("_i", F.lit(True)), key, "full")
    n = j.agg(F.count_if(F.col("_i").isNull()).alias("missing"), F.count_if(F.col("_c").isNull()).alias("extra"), F.count("_c").alias("_n"))
    apart = F.col("missing") + F.col("extra")
    ratio = F.when(F.col("_n") > 0, apart / F.col("_n")).otherwise(F.when(apart > 0, 1.0).otherwise(0.0))
    return n.select("missing", "extra", ratio.alias("ratio"), (ratio > tolerance).alias("needs_rebuild"))


def group_tags(members: DataFrame, images: DataFrame, known: DataFrame) -> DataFrame:
    """``image_id, tag`` of members, named by the first 8 digits of their hash, that ``known`` (``image_id, tag``) lacks; shorter hashes give none."""
    t = group_details(members, images).where(F.length("dhash") >= 8).select("image_id", F.concat(F.lit("dup-"), F.substring("dhash", 1, 8)).alias("tag")).distinct()
    return t.join(known, ["image_id", "tag"], "left_anti")


def group_confidence(members: DataFrame) -> DataFrame:
    """Mean similarity of each group's members."""
    return members.groupBy("group_id").agg(F.round(F.avg("similarity_score"), 6).alias("confidence"))


def group_features(members: DataFrame, images: DataFrame) -> DataFrame:
    """``group_id, oldest, pixels``: earliest date and largest resolution of the members."""
    return group_details(members, images).groupBy("group_id").agg(F.min("selected_date").alias("oldest"), F.max(F.col("width") * F.col("height")).alias("pixels"))


def with_members(groups: DataFrame, members: DataFrame) -> DataFrame:
    """``group_id, ids, confidence``: members' ids, sorted, and the confidence as a share of 1."""
    ids = members.groupBy("group_id").agg(F.array_sort(F.collect_list("image_id")).alias("ids"))
    return ids.join(groups.select("group_id", (F.col("confidence") / 100).alias("confidence")), "group_id")


def recommendations(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Every member with ``action``: keep the primary, delete others."""
    g = groups.select("group_id", "primary_image_id")
    return members.join(g, "group_id").withColumn("action", F.when(F.col("image_id") == F.col("primary_image_id"), "keep").otherwise("delete")).drop("primary_image_id")


def enriched(pairs: DataFrame, hashes: DataFrame, column: str, missing: int = 999) -> DataFrame:
    """Pairs with ``distance``, that of the two images' ``column``; ``missing`` where a hash is null."""
    h = lambda i: hashes.select(F.col("image_id").alias(f"image_{i}"), F.col(column).alias(f"_h{i}"))
    j = pairs.join(h(1), "image_1").join(h(2), "image_2")
    return j.withColumn("distance", F.coalesce(hashing.hamming(F.col("_h1"), F.col("_h2")), F.lit(missing))).drop("_h1", "_h2")


def inside(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs both images of which are in ``ids`` (``image_id``)."""
    one = lambda i: ids.select(F.col("image_id").alias(f"image_{i}"))
    return pairs.join(one(1), "image_1", "left_semi").join(one(2), "image_2", "left_semi")


def uncompared(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Images of no pair."""
    return images.join(pairs.select(F.explode(F.array("image_1", "image_2")).alias("image_id")), "image_id", "left_anti")


def replaced(old: DataFrame, new: DataFrame, catalog_id) -> DataFrame:
    """All groups after a catalog's were replaced by ``new`` (``group_id, confidence`` as percent or share of 1)."""
    n = new.withColumn("confidence", as_percent(F.col("confidence"))).withColumn("catalog_id", F.lit(catalog_id))
    return old.where(F.col("catalog_id") != catalog_id).unionByName(n.select(*old.columns))
