"""N-gram Jaccard self join by grouped prefixes.

1. Counters over all documents, more of them where there are more documents, hold how many
   documents a shingle has in common with others of its task. They give the global order:
   rare first, then by hash. Any order is exact; this one keeps common passages out of prefixes.
2. Two sets whose Jaccard similarity reaches ``num / den`` share a shingle among the first
   ``n - ceil(n * num / den) + 1`` of each. Equal sets are one class; classes with the same
   prefix and size are one group, and only groups meet on prefix shingles.
3. A pair of groups that meet is filtered by size and by a lower bound of the difference of
   their members: the gap between the ranges of their members' counts over BINS hash bins.
   What is left ties groups together, with fewer ties than groups for each shingle. What
   hangs together is a candidate set.
4. Groups expand to their classes. A task holds a candidate set and verifies, on whole sets,
   every pair of classes that shares a prefix shingle there, that its sizes allow and that is
   not connected yet. What it gives is each class's component, not its links.
5. Shingles with more than MEETING groups and candidate sets beyond BLOCK_CLASSES classes or
   BLOCK_SHINGLES shingles are dealt in blocks, each row once, and what that connects gets a
   label. Then rows of different labels meet, block by block; those of the largest label
   never meet each other. So a large group of near copies costs little more than its size.
6. What the tasks connected gives the components.

A text is known by two 64-bit hashes, a set by its size and two.

Defined results: null and blank texts have an empty set and link with nothing; a text with
fewer than ``k`` words is one shingle; equal texts are one class; rows that repeat a
``doc_id``, with one text or with several, keep a row each; a row whose ``doc_id`` is null takes
the component of its class, null where no row of that has an id; an empty table gives no
rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable, keyed_join, release, without
from .shingles import mix, shingle_sets

SLOTS_A_DOCUMENT = 64
MOST_SLOTS = 1 << 24
CHUNK = 1 << 14
BLOCK_CLASSES = 1500
BLOCK_SHINGLES = 1_000_000
BINS = 64
MEETING = 2000
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def count_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counters of shingles by hash, over all documents: a byte each, in steps of a quarter of a doubling.

    A task leaves out what it sees once. There are SLOTS_A_DOCUMENT counters a document, MOST_SLOTS at most.
    """
    slots = max(CHUNK, min(MOST_SLOTS, 1 << (docs.count() * SLOTS_A_DOCUMENT).bit_length()))

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(slots, np.uint32)
        for b in batches:
            h, _ = shingle_sets(b["text"], k)
            at, n = np.unique((h & np.uint64(slots - 1)).astype(np.uint32), return_counts=True)
            counts[at] += n.astype(np.uint32)
        at = np.flatnonzero(counts > 1)
        edges = np.searchsorted(at, np.arange(0, slots + 1, CHUNK))
        for c in np.flatnonzero(np.diff(edges)).tolist():
            own = at[edges[c] : edges[c + 1]]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "places": [(own % CHUNK).astype(np.uint16).tobytes()], "counts": [counts[own].tobytes()]})

    def total(key, table):
        import pyarrow as pa

        out = np.zeros(CHUNK, np.uint64)
        for places, counts in zip(table["places"], table["counts"], strict=True):
            out[np.frombuffer(places.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint32)
        code = np.minimum(255, np.round(4 * np.log2(1.0 + out))).astype(np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([code.tobytes()], pa.binary())})

    partial = docs.select("text").mapInArrow(run, "chunk int, places binary, counts binary")
    # a byte for each counter reaches the driver
    rows = partial.groupBy("chunk").applyInArrow(total, "chunk int, counts binary").collect()
    out = np.zeros((slots // CHUNK, CHUNK), np.uint8)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, text`` of every row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.alias("text"))


def _set_hashes(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [_sums(mix(h ^ np.uint64(seed)), at).view(np.int64) for seed in SEEDS]


def prefixes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, t1, t2, n, s1, s2, p, prefix, bins``: set size, two hashes of the set, one of the prefix, the prefix and counts by bin."""
    order = docs.sparkSession.sparkContext.broadcast(count_sketch(docs, k))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            h, at = shingle_sets(b["text"], k)
            n = np.diff(at)
            doc = np.repeat(np.arange(len(n)), n)
            slots = np.uint64(len(order.value) - 1)
            ranked = np.lexsort((h, order.value[(h & slots).astype(np.int64)], doc))
            keep = kept(n, num, den)
            rank = np.arange(len(h)) - np.repeat(at[:-1], n)
            chosen = h[ranked[rank < np.repeat(keep, n)]]
            ends = np.concatenate(([0], np.cumsum(keep)))
            bins = np.bincount(doc * BINS + (h >> np.uint64(58)).astype(np.int64), minlength=len(n) * BINS).reshape(-1, BINS)
            bins = np.minimum(bins, 255).astype(np.uint8)
            long = lambda x: pa.array(x.view(np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), long(chosen))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["t1"], b["t2"], pa.array(n, pa.int64()), *map(pa.array, _set_hashes(h, at)), long(_sums(mix(chosen), ends)), lists, pa.array([x.tobytes() for x in bins], pa.binary())], names=["doc_id", "t1", "t2", "n", "s1", "s2", "p", "prefix", "bins"])

    return docs.mapInArrow(run, "doc_id long, t1 long, t2 long, n long, s1 long, s2 long, p long, prefix array<long>, bins binary")


def kept(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Lengths of prefixes of sets of size ``n``."""
    return n - (n * num + den - 1) // den + (n > 0)


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    return total[at[1:]] - total[at[:-1]]


def stars(ids: np.ndarray, before: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """One edge for each part of ``before`` that became part of a larger one: from its least id to that one's."""
    order = np.lexsort((ids, before))
    first = order[np.concatenate(([True], before[order][1:] != before[order][:-1]))]
    by_part = first[np.lexsort((ids[first], part[first]))]
    heads = np.concatenate(([True], part[by_part][1:] != part[by_part][:-1]))
    least = ids[by_part][np.maximum.accumulate(np.where(heads, np.arange(len(by_part)), 0))]
    return list(zip(ids[by_part][~heads].tolist(), least[~heads].tolist(), strict=True))


def linked(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Edges, as :func:`stars` has them, that connect what is similar among ``sets``; equal ``labels`` are connected already.

    Compared is every pair that meets on a shingle of its prefixes (in an order of the given
    sets' own, rare first), whose sizes allow it and that is not connected.
    """
    by_size = np.argsort([len(s) for s in sets], kind="stable")
    sets, ids = [sets[i] for i in by_size], ids[by_size]
    before = np.unique(labels[by_size], return_inverse=True)[1]
    part = before.copy()
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    terms, flat, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), sizes)
    ranked = np.lexsort((flat, counts[flat], doc))
    keep = kept(sizes, num, den)
    chosen = ranked[np.arange(len(flat)) - np.repeat(starts, sizes) < np.repeat(keep, sizes)]
    chosen = chosen[counts[flat[chosen]] > 1]
    term, owner = flat[chosen], doc[chosen]
    by_term = np.lexsort((owner, term))
    posted, posted_term = owner[by_term], term[by_term]
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    lo, hi = np.searchsorted(posted_term, term, "left"), np.searchsorted(posted_term, term, "right")
    mark = np.zeros(len(terms), np.uint8)
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * den // num, "right"))
        met = [posted[lo[x] : hi[x]] for x in range(first[i], first[i + 1])]
        if not met:
            continue
        others = np.concatenate(met)
        others = others[(others > i) & (others < end)]
        others = np.unique(others[part[others] != part[i]])
        if not len(others):
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j] + sizes[j]]]) for j in others])
        mark[own] = 0
        for j in others[den * both >= num * (sizes[i] + sizes[others] - both)]:
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
    return stars(ids, before, part)


def ties_of(gids: np.ndarray, labels: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Edges, as :func:`stars` has them, that connect the groups of a prefix shingle which the filters cannot tell apart; equal ``labels`` are tied already."""
    order = np.argsort(n, kind="stable")
    gids, n, low, high = gids[order], n[order], low[order].astype(np.int16), high[order].astype(np.int16)
    before = np.unique(labels[order], return_inverse=True)[1]
    part = before.copy()
    for i in range(len(n) - 1):
        end = int(np.searchsorted(n, n[i] * den // num, "right"))
        others = i + 1 + np.flatnonzero(part[i + 1 : end] != part[i])
        if not len(others):
            continue
        both = n[i] + n[others]
        most = both - 2 * -(-num * both // (num + den))
        gap = np.maximum(0, np.maximum(low[others] - high[i], low[i] - high[others])).sum(axis=1)
        for j in others[gap <= most]:
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
    return stars(gids, before, part)


def once(rows: DataFrame, blocks: Column, id_: str, salt: int = 0) -> DataFrame:
    """Each row in one of its key's ``blocks``: columns ``i, j`` (0) and ``label``, the row's own id."""
    return rows.withColumns({"i": F.pmod(F.xxhash64(F.lit(salt), id_), blocks).cast("int"), "j": F.lit(0), "label": F.col(id_)})


def across(rows: DataFrame, key: str, id_: str, labels: DataFrame, most: Column, cols: list[str]) -> DataFrame:
    """Rows dealt to tasks ``key, i, j`` so that any two of a key with different labels meet; ``most``: of a key's rows, those of a block.

    The rows of a key's largest label never meet each other, and keys with one label are left out.
    """
    rows = rows.join(labels, rows[id_] == labels["node"], "left").withColumn("label", F.coalesce("component", id_))
    n = rows.groupBy(key, "label").agg(F.count("*").alias("m"), most.alias("most"))
    per = n.groupBy(key).agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("in_main"), F.sum("m").alias("all"), F.min("most").alias("most"))
    per = per.where("all > in_main").select(key, "main", F.ceil((F.col("all") - F.col("in_main")) / F.col("most")).cast("int").alias("rb"), F.ceil(F.col("in_main") / F.col("most")).cast("int").alias("mb"))
    rows = rows.join(per, key)
    own = F.when(F.col("label") == F.col("main"), F.col("rb") + F.pmod(F.xxhash64(id_), F.col("mb"))).otherwise(F.pmod(F.xxhash64(id_), F.col("rb"))).cast("int")
    rows = rows.withColumn("own", own)
    others = F.sequence(F.lit(0), F.when(F.col("label") == F.col("main"), F.col("rb")).otherwise(F.col("rb") + F.col("mb")) - 1)
    pair = F.transform(others, lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    return rows.withColumn("b", F.explode(pair)).select(key, "b.i", "b.j", "label", *cols)


def boxes(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``n, p, gid, prefix, low, high`` of every group of ``classes``: the least and the largest count of its members in each bin. Then the tables that hold them."""
    plain = classes.groupBy("n", "p").agg(F.min("cid").alias("gid"), F.min(F.struct("cid", "prefix"))["prefix"].alias("prefix"), F.min("bins").alias("low"), F.max("bins").alias("high"))
    plain = durable(plain, "groups")
    mixed = plain.where("low <> high").select("n", "p")
    if mixed.isEmpty():
        return plain, [plain]

    def fold(batches):
        import pyarrow as pa

        box: dict[tuple, list] = {}

        def out():
            n, p = zip(*box, strict=True) if box else ((), ())
            batch = pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(p, pa.int64()), *(pa.array([x[i].tobytes() for x in box.values()], pa.binary()) for i in (0, 1))], names=["n", "p", "low", "high"])
            box.clear()
            return batch

        for b in batches:
            for n, p, low, high in zip(*(b[c].to_pylist() for c in ("n", "p", "low", "high")), strict=True):
                low, high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
                old = box.get((n, p))
                box[n, p] = [low, high] if old is None else [np.minimum(low, old[0]), np.maximum(high, old[1])]
            if len(box) > 20_000:
                last = (n, p)
                keep = box.pop(last)
                yield out()
                box[last] = keep
        yield out()

    ddl = "n long, p long, low binary, high binary"
    members = classes.select("n", "p", F.col("bins").alias("low"), F.col("bins").alias("high")).join(mixed, ["n", "p"])
    # folded in each task first, so that a group which holds a third of the classes is a few rows
    both = members.mapInArrow(fold, ddl).repartition("n", "p").sortWithinPartitions("n", "p").mapInArrow(fold, ddl)
    both = both.select("n", "p", F.struct("low", "high").alias("box"))
    wide = plain.where("low <> high").drop("low", "high").join(both, ["n", "p"]).select("n", "p", "gid", "prefix", "box.low", "box.high")
    wide = durable(wide, "boxes")
    return plain.where("low = high").unionByName(wide), [plain, wide]


def _keyed(batches, cols: list[str], keys: int):
    """The rows of sorted batches, a list of columns for each run of equal first ``keys`` columns."""
    key, group = None, None
    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in cols), strict=True):
            if row[:keys] != key:
                if group:
                    yield key, group
                key, group = row[:keys], [[] for _ in cols[keys:]]
            for to, x in zip(group, row[keys:], strict=True):
                to.append(x)
    if group:
        yield key, group


def _pairs_batch(pairs):
    import pyarrow as pa

    u, v = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def tied(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Ties ``u, v`` between groups (``gid, n, prefix, low, high``) that share a prefix shingle and pass the filters."""
    postings = groups.select("gid", F.explode("prefix").alias("shingle"))
    shared = durable(postings.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    met = lambda some: postings.join(some, "shingle").join(groups.select("gid", "n", "low", "high"), "gid")
    cols = ["gid", "n", "low", "high"]

    def run(batches):
        seen: set[tuple] = set()
        found: set[tuple[int, int]] = set()
        for _, (label, gids, n, low, high) in _keyed(batches, ["shingle", "i", "j", "label", *cols], 3):
            if len(gids) < 2 or (key := tuple(gids)) in seen:
                continue
            if len(gids) < 50:  # near copies share many shingles, and the same groups meet again and again
                if len(seen) > 50_000:
                    seen.clear()
                seen.add(key)
            found.update(ties_of(np.array(gids), np.array(label), np.array(n), *(np.frombuffer(b"".join(x), np.uint8).reshape(-1, BINS) for x in (low, high)), num, den))
            if len(found) > 50_000:
                yield _pairs_batch(found)
                found.clear()
        yield _pairs_batch(found)

    def ties(dealt):
        keys = ["shingle", "i", "j"]
        return dealt.select(*keys, "label", *cols).repartition(*keys).sortWithinPartitions(*keys, "gid").mapInArrow(run, "u long, v long")

    found = durable(ties(once(met(shared), F.ceil(F.col("m") / MEETING), "gid")), "ties")
    large = shared.where(F.col("m") > MEETING)
    if large.isEmpty():
        return found
    rows = durable(met(large).select("shingle", *cols), "met")
    more = durable(ties(across(rows, "shingle", "gid", durable(connected_components(found), "tied"), F.lit(MEETING), cols)), "ties")
    release(rows)
    return found.unionByName(more)


def verify(docs: DataFrame, candidates: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``node, component`` of linked classes; ``candidates``: ``cid, doc_id, t1, t2, n, comp`` with one text of each class."""
    size = candidates.groupBy("comp").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles")).where("classes > 1")
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    cand = durable(candidates.join(size.select("comp", blocks.alias("blocks"), F.ceil(F.col("classes") / blocks).alias("most")), "comp"), "candidates")

    r = cand.withColumnsRenamed({c: f"rep_{c}" for c in ("doc_id", "t1", "t2")})
    same = (docs["t1"] == r["rep_t1"]) & (docs["t2"] == r["rep_t2"]) & docs["doc_id"].eqNullSafe(r["rep_doc_id"])
    met = keyed_join(docs, r, same, "inner", ["doc_id", "t1"], ["rep_doc_id", "rep_t1"])
    every = durable(met.select("cid", "comp", "blocks", "most", "text"), "texts")  # smaller than their sets
    release(cand)

    def with_sets(batches):
        import pyarrow as pa

        for b in batches:
            h, at = shingle_sets(b["text"], k)
            hashes = pa.array([h[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), hashes], names=[*names, "hashes"])

    def run(batches):
        for _, (label, cids, hashes) in _keyed(batches, ["comp", "i", "j", "label", "cid", "hashes"], 3):
            at = list(dict(zip(cids, range(len(cids)), strict=True)).values())  # rows may repeat
            if len(at) > 1:
                yield _pairs_batch(linked(np.array([cids[x] for x in at]), np.array([label[x] for x in at]), [np.frombuffer(hashes[x], np.uint64) for x in at], num, den))

    def links(dealt: DataFrame, content: str = "hashes") -> DataFrame:
        keys = ["comp", "i", "j"]
        dealt = dealt.select(*keys, "label", "cid", content).repartition(*keys).sortWithinPartitions(*keys)
        return dealt.mapInArrow(run if content == "hashes" else lambda batches: run(with_sets(batches)), "u long, v long")

    found = durable(links(once(every, F.col("blocks"), "cid"), "text"), "links")
    sets = every.where("blocks > 1")
    if sets.isEmpty():
        release(every)
        return found.select(F.col("u").alias("node"), F.col("v").alias("component"))  # each set was one task's, so its edges are whole components
    sets = durable(sets.mapInArrow(with_sets, "cid long, comp long, blocks int, most long, hashes binary"), "sets")  # for they meet more than once
    release(every)
    found = found.unionByName(durable(links(once(sets, F.col("blocks"), "cid", salt=1)), "links"))  # dealt anew, to connect most of what other blocks hold
    labels = durable(connected_components(found), "labels")
    out = connected_components(found.unionByName(links(across(sets, "comp", "cid", labels, F.min("most"), ["cid", "hashes"]))))
    release(sets)  # the components are read from their edges, which are written
    return out


def classified(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Every row as ``doc_id, t1, t2, n, s1, s2``; every set as ``n, s1, s2, comp, component``: its component and that one's smallest ``doc_id``."""
    docs = identified(docs)
    wide = durable(prefixes(docs, k, num, den), "prefixes")
    rows = durable(wide.select("doc_id", "t1", "t2", "n", "s1", "s2"), "rows")
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    whole = wide.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(rep).alias("rep"), F.min("p").alias("p"), F.min("prefix").alias("prefix"), F.min("bins").alias("bins"))
    whole = durable(whole.withColumn("cid", F.monotonically_increasing_id()), "classes")
    release(wide)
    groups, tables = boxes(whole)
    classes = durable(whole.select("n", "s1", "s2", "cid", "p", "rep"), "reps")
    release(whole)
    grouped = durable(classes.select("cid", "n", "p", "rep").join(groups.select("n", "p", "gid"), ["n", "p"]), "grouped")
    sets = connected_components(tied(groups, num, den))
    release(*tables)  # the components are read from their edges, which are written
    candidates = grouped.join(sets, grouped["gid"] == sets["node"], "left").select("cid", "rep.doc_id", "rep.t1", "rep.t2", "n", F.coalesce("component", "gid").alias("comp"))
    found = verify(docs, candidates, k, num, den)
    named = classes.select("n", "s1", "s2", "cid", "rep").join(found, classes["cid"] == found["node"], "left").select("n", "s1", "s2", "rep", F.coalesce("component", "cid").alias("comp"))
    named = durable(named, "named")
    least = named.groupBy("comp").agg(F.min("rep.doc_id").alias("component"))
    return rows, named.select("n", "s1", "s2", "comp").join(least, "comp")


def components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    rows, named = classified(docs, k, num, den)
    member = rows.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return member.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row, all columns kept; rows without words stay.

    The row is that of the smallest ``doc_id`` (a null one only where there is no other), then of the
    least text hash; where whole rows of it repeat, one of them.
    """
    rows, named = classified(docs, k, num, den)
    member = rows.where("n > 0").select("doc_id", "t1", "t2", "n", "s1", "s2").join(named, ["n", "s1", "s2"])
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2"))
    one = member.groupBy("comp").agg(chosen.alias("one")).select(F.col("one.doc_id").alias("one_id"), F.col("one.t1").alias("one_t1"), F.col("one.t2").alias("one_t2"))
    same = lambda r: r["doc_id"].eqNullSafe(F.col("one_id")) & (r["t1"] == F.col("one_t1")) & (r["t2"] == F.col("one_t2"))
    marked = durable(member.join(one, same(member), "left").select("doc_id", "t1", "t2", "one_id", "one_t1", "one_t2"), "marked")
    key = ["doc_id", "t1", "t2"]
    dropped = durable(marked.where("one_t1 is null").select(*key).distinct(), "dropped")
    more = durable(marked.where("one_t1 is not null").groupBy(*key).agg(F.count("*").alias("times")).where("times > 1").drop("times"), "repeated")
    text = F.col("text").cast("string")
    all_ = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"))
    if more.isEmpty():
        return without(all_, rows, dropped, key).select("row.*")
    named_ = more.select(*[F.col(c).alias(f"one_{c.removeprefix('doc_')}") for c in key])
    once_ = keyed_join(all_, named_, same(all_), "left_semi", ["doc_id", "t1"], ["one_id", "one_t1"]).dropDuplicates(key)
    return without(all_, rows, durable(dropped.unionByName(more), "gone"), key).unionByName(once_).select("row.*")
