"""Removal of every byte that a repeated 200-byte string covers, in texts as UTF-8, across the corpus.

1. Each window of 200 bytes names the least hash among its 64-byte strings. Equal windows
   name the same one, and neighbours mostly agree, so a text falls into segments: runs of
   window starts with one name. A segment has a hash of the bytes its windows span.
2. Names that occur once are dropped. Segments with the same name and bytes repeat each
   other: all their windows do, so one of each content is enough from here on.
3. The different contents of a name, with those of the other names of a batch, are
   suffix-sorted in two stages, and windows whose suffixes have 200 bytes in common with a
   neighbour's are repeated.
4. A name whose contents exceed HOT_BYTES is split before it is sorted: each window's name
   grows by half of the bytes it still lacks, after the 64-byte string or before it, on
   the side that has them. Equal windows grow alike, so they stay together; at the latest
   when a name spans the whole window its contents are all equal. No task grows with a name.
5. Covered ranges meet their text, which is cut.

A text is known by two 64-bit hashes, a content by its name and a 64-bit hash; equal texts
are copies of each other.

Defined results: a null or empty text has no bytes; texts shorter than the window lose nothing;
repeated rows lose all they have where they are long enough; an empty table gives no rows.
Columns other than ``doc_id`` and ``text`` are ignored. ``window`` is any number from 1 on.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, release
from .shingles import mix
from .suffix_sort import repeated_windows

LONGEST_RUN = 2048
TILE = 1 << 16
SORT_BYTES = 1 << 19
HOT_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
ID = ["t1", "t2"]


def gram_of(window: int) -> int:
    """Bytes of a name: a power of two, half the window and 64 at most."""
    return 1 << max(0, min(6, (window // 2).bit_length() - 1))


def grams(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place."""
    h, m, base = mix(np.arange(256, dtype=np.uint64))[text], 1, BASE
    while m < gram:
        h = h[:-m] * np.uint64(base) + h[m:]
        m, base = 2 * m, base * base % (1 << 64)
    return mix(h)


def names(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The name of each window, and hashes of strings that some window names, in order."""
    width = window - gram_of(window) + 1
    h = grams(text, gram_of(window))
    low = _slide(h, width, np.minimum)
    padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    return low, h[_slide(padded, width, np.maximum) == h]


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    m = 1
    total = len(x) - width + 1
    while 2 * m <= width:
        x = f(x[:-m], x[m:])
        m *= 2
    return f(x[:total], x[width - m : width - m + total])


def _contents(data, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(data[a : a + c + window - 1]) for a, c in zip(starts.tolist(), counts.tolist(), strict=True)], np.uint64)


def segments_of(data, window: int):
    """Segments of one text's bytes: names, content hashes, starts, numbers of windows, and whether a name recurs inside."""
    n = len(data) - window + 1
    for t in range(0, n, TILE):
        tile = data[t : min(n, t + TILE) + window - 1]
        low, picked = names(np.frombuffer(tile, np.uint8), window)
        edges = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1, [len(low)]))
        if np.diff(edges).max() > LONGEST_RUN:
            edges = np.unique(np.concatenate((edges, np.arange(0, len(low), LONGEST_RUN))))
        starts, counts = edges[:-1], np.diff(edges)
        again = np.isin(low[starts], picked[1:][picked[1:] == picked[:-1]])
        yield low[starts], _contents(tile, starts, counts, window), starts + t, counts, again


def levels(window: int) -> list[int]:
    """Lengths of names: level 0 is the string a window names, the last is the window."""
    out = [gram_of(window)]
    while out[-1] < window:
        out.append(out[-1] + (window - out[-1] + 1) // 2)
    return out


def finer_segments(piece, window: int, level: int):
    """Segments of a piece whose windows all have one name, by names of ``level``; as :func:`segments_of` gives them."""
    text = np.frombuffer(piece, np.uint8)
    n, lengths = len(text) - window + 1, levels(window)
    places = np.flatnonzero(grams(text, lengths[0]) == names(text[:window], window)[0][0])
    at = np.arange(n)
    g = places[np.searchsorted(places, at)]
    for a, b in zip(lengths[:level], lengths[1 : level + 1], strict=True):
        g = np.where(at + window - (g + a) >= b - a, g, g - (b - a))
    powers = np.full(len(text) + 1, pow(BASE, -1, 1 << 64), np.uint64)
    powers[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(text.astype(np.uint64)) * np.cumprod(powers, dtype=np.uint64)[:-1], dtype=np.uint64)))
    ahead = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(text), BASE, np.uint64))), dtype=np.uint64)
    own = mix((sums[g + lengths[level]] - sums[g]) * ahead[g] + np.uint64(level))
    edges = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [n]))
    starts, counts = edges[:-1], np.diff(edges)
    return own[starts], _contents(piece, starts, counts, window), starts, counts, g[starts] != g[edges[1:] - 1]


SEGMENT = {"t1": "long", "t2": "long", "name": "long", "content": "long", "a": "long", "n": "int", "again": "boolean"}
SEGMENT_DDL = ", ".join(f"{k} {v}" for k, v in SEGMENT.items())


def _batch(rows):
    """Rows of ``(t1, t2, names, contents, starts, counts, again)`` as a record batch of SEGMENT."""
    import pyarrow as pa

    t1, t2, name, content, a, n, again = zip(*rows, strict=True)
    sizes = [len(x) for x in a]
    cols = [np.repeat(np.array(t, np.int64), sizes) for t in (t1, t2)] + [np.concatenate(x).view(np.int64) for x in (name, content)]
    cols += [np.concatenate(a).astype(np.int64), np.concatenate(n).astype(np.int32), np.concatenate(again)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list(SEGMENT))


def segments(docs: DataFrame, window: int) -> DataFrame:
    """SEGMENT rows of every row of ``t1, t2, text``."""

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for t1, t2, text in zip(b["t1"].to_pylist(), b["t2"].to_pylist(), b["text"], strict=True):
                for found in segments_of(memoryview(text.as_buffer()), window):
                    rows.append((t1, t2, *found))
                    size += len(found[2])
                    if size > 50_000:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select("t1", "t2", "text").mapInArrow(run, SEGMENT_DDL)


RANGES = "array<struct<s:bigint,e:bigint>>"
NEEDS = "array<struct<name:bigint,a:bigint,n:int,hot:boolean>>"


def repeats(s: DataFrame, window: int, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """From SEGMENT rows, ranges that are covered for certain (``t1, t2, s, e``) and, per text, segments to look into (``t1, t2, needs``)."""
    again = s.groupBy("name").agg(F.count("*").alias("k"), F.max("again").alias("again")).where("k > 1 or again").select("name")
    # written before it is grouped, so that a name which a third of the texts hold is split among tasks
    d = durable(s.join(again, "name", "left_semi"), "repeated")
    release(s)
    c = durable(d.groupBy("name", "content").agg(F.count("*").alias("k"), F.min(F.struct(*ID, "a", "n")).alias("one"), F.max("again").alias("again")), "contents")
    sure = d.join(c.where("k > 1").select("name", "content"), ["name", "content"]).select(*ID, F.col("a").alias("s"), (F.col("a") + F.col("n") + window - 1).alias("e")).distinct()
    per_name = c.groupBy("name").agg(F.count("*").alias("contents"), F.sum(F.col("one.n") + window - 1).alias("size"))
    look = c.join(per_name, "name").where("contents > 1 or (again and k = 1)")
    hot = F.lit(False) if last else (F.col("contents") > 1) & (F.col("size") > HOT_BYTES)
    needs = look.groupBy("one.t1", "one.t2").agg(F.collect_list(F.struct("name", F.col("one.a").alias("a"), F.col("one.n").alias("n"), hot.alias("hot"))).alias("needs"))
    return sure, needs


def merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def cut(data: bytes, ranges) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed runs and the remaining bytes."""
    spans = merged(ranges)
    kept, at = [], 0
    for s, e in spans:
        kept.append(data[at:s])
        at = e
    kept.append(data[at:])
    return spans, b"".join(kept)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return list(zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True))


def _lists(column, *fields):
    """Offsets and, as numpy arrays, the fields of an Arrow list of structs; null lists are empty."""
    values = column.flatten()
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    return ends, *(values.field(f).to_numpy(zero_copy_only=False) for f in fields)


def sorted_windows(pending: DataFrame, window: int) -> DataFrame:
    """``t1, t2, s, e``: covered ranges found by sorting the segments that ``pending`` (``t1, t2, text, needs``) asks for and that are not hot."""
    of = {"t1": "long", "t2": "long", "name": "long", "a": "long", "n": "int", "bytes": "binary"}

    def contents(batches):
        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=list(of))

        for b in batches:
            ends, name, a, n, hot = _lists(b["needs"], "name", "a", "n", "hot")
            rows, size = [], 0
            for i, (t1, t2, text) in enumerate(zip(b["t1"].to_pylist(), b["t2"].to_pylist(), b["text"], strict=True)):
                data = memoryview(text.as_buffer())
                for k in (ends[i] + np.flatnonzero(~hot[ends[i] : ends[i + 1]].astype(bool))).tolist():
                    s, w = int(a[k]), int(n[k])
                    rows.append((t1, t2, int(name[k]), s, w, bytes(data[s : s + w + window - 1])))
                    size += w + window
                    if size > 1 << 20:
                        yield out(rows)
                        rows, size = [], 0
            if rows:
                yield out(rows)

    def sort(batches):
        import pyarrow as pa

        def flush(group):
            found = [(t1, t2, a + s, a + e - 1 + window) for (t1, t2, a), flags in zip(group, repeated_windows([c for _, c in group.values()], [n for n, _ in group.values()], window), strict=True) for s, e in _runs(flags)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ((),) * 4)], names=["t1", "t2", "s", "e"])

        group, size, last = {}, 0, None
        for b in batches:
            cols = [b[c].to_pylist() for c in ("t1", "t2", "name", "a", "n")]
            for i, (t1, t2, name, a, n) in enumerate(zip(*cols, strict=True)):
                if name != last and size > SORT_BYTES:
                    yield flush(group)
                    group, size = {}, 0
                last = name
                content = b["bytes"][i].as_buffer().to_pybytes()
                group[(t1, t2, a)] = (n, content)
                size += len(content)
        if group:
            yield flush(group)

    rows = pending.select(*ID, "text", "needs").mapInArrow(contents, ", ".join(f"{k} {v}" for k, v in of.items()))
    return rows.repartition("name").sortWithinPartitions("name").mapInArrow(sort, "t1 long, t2 long, s long, e long")


def finer(pending: DataFrame, window: int, level: int) -> DataFrame:
    """SEGMENT rows, by names of ``level``, of the hot segments that ``pending`` asks for."""

    def run(batches):
        for b in batches:
            ends, a, n, hot = _lists(b["needs"], "a", "n", "hot")
            rows, size = [], 0
            for i, (t1, t2, text) in enumerate(zip(b["t1"].to_pylist(), b["t2"].to_pylist(), b["text"], strict=True)):
                data = memoryview(text.as_buffer())
                for k in (ends[i] + np.flatnonzero(hot[ends[i] : ends[i + 1]].astype(bool))).tolist():
                    s = int(a[k])
                    own, content, starts, counts, again = finer_segments(data[s : s + int(n[k]) + window - 1], window, level)
                    rows.append((t1, t2, own, content, starts + s, counts, again))
                    size += len(starts)
                    if size > 50_000:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    return pending.select(*ID, "text", "needs").mapInArrow(run, SEGMENT_DDL)


def looked_into(pending: DataFrame, window: int) -> DataFrame:
    """``t1, t2, s, e``: covered ranges of what durable ``pending`` (``t1, t2, text, needs``) asks for."""
    found = sorted_windows(pending, window)
    hot = pending.where(F.exists("needs", lambda x: x["hot"])).select(*ID, "text", "needs").dropDuplicates(ID)
    most = len(levels(window)) - 1
    texts = None
    for level in range(1, most + 1):
        if hot.isEmpty():
            break
        texts = texts or durable(hot.select(*ID, "text"), "hot_texts")
        rows = durable(finer(hot, window, level), "finer")
        sure, needs = repeats(rows, window, level == most)
        hot = durable(texts.join(needs, ID), "hot")
        found = found.unionByName(sure).unionByName(sorted_windows(hot, window))
        hot = hot.where(F.exists("needs", lambda x: x["hot"]))
    return found


CUT = f"doc_id long, t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, ranges {RANGES}, needs {NEEDS}, text string"


def remove_repeats(docs: DataFrame, window: int = 200, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    With ``with_text`` also the remaining bytes as ``kept`` and the row's columns other than the
    text as the struct ``row``. Where a cut falls inside a character, what is left of it stays in ``kept``.
    """
    if window < 1:
        raise ValueError("a window has one byte at least")
    carried = F.struct(*[docs[c] for c in docs.columns if c != "text"]) if with_text else F.lit(None).cast("int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), carried.alias("row"))
    docs = docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})
    schema = T._parse_datatype_string(CUT).add("row", docs.schema["row"].dataType)
    sure, needs = repeats(durable(segments(docs.where(F.octet_length("text") >= window), window), "segments"), window)
    ranges = sure.groupBy(*ID).agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    owners = docs.where(F.octet_length("text") >= window).groupBy(*ID).agg(F.min("doc_id").alias("owner"))
    per_text = durable(ranges.join(needs.join(owners, ID), ID, "full").select(*ID, "ranges", "needs", "owner"), "per_text")

    def settle(batches):
        import pyarrow as pa

        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "kept_sha256": pa.string()}
        for b in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            ends, first, end = _lists(b["ranges"], "s", "e")
            waits = b["needs"].is_valid()
            for i, (text, wait) in enumerate(zip(b["text"], waits.to_pylist(), strict=True)):
                data = text.as_buffer().to_pybytes()
                own = slice(ends[i], ends[i + 1])
                spans, kept = cut(data, zip(first[own].tolist(), end[own].tolist(), strict=True))
                found = (len(data), sum(e - s for s, e in spans), len(spans), kept if with_text and not wait else None, None if wait else hashlib.sha256(kept).hexdigest())
                for k, v in zip(out, found, strict=True):
                    out[k].append(v)
            made = {k: pa.array(v, kinds[k]) for k, v in out.items()} | {k: b[k] for k in ("doc_id", *ID, "needs", "row")}
            at = pa.array(np.where(waits.to_numpy(zero_copy_only=False), np.arange(b.num_rows), -1), mask=~waits.to_numpy(zero_copy_only=False))
            made |= {k: b[k].take(at) for k in ("ranges", "text")}  # only what waits keeps them
            yield pa.RecordBatch.from_arrays([made[k] for k in schema.names], names=schema.names)

    # a text that is one of several copies is covered already; only its owner lends it to the search
    met = docs.join(per_text, ID, "left")
    mine = F.col("needs").isNotNull() & F.col("owner").eqNullSafe(F.col("doc_id"))
    first = durable(met.select("doc_id", *ID, "text", "ranges", F.when(mine, F.col("needs")).alias("needs"), "row").mapInArrow(settle, schema), "settled")
    pending = first.where("needs is not null")
    found = looked_into(pending, window).groupBy(*ID).agg(F.collect_list(F.struct("s", "e")).alias("more"))
    none = F.expr(f"cast(array() as {RANGES})")
    rest = pending.select("doc_id", *ID, "text", "ranges", "row").join(found, ID, "left").select("doc_id", *ID, "text", F.concat(F.coalesce("ranges", none), F.coalesce("more", none)).alias("ranges"), F.expr(f"cast(null as {NEEDS})").alias("needs"), "row")
    out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "row"] * with_text
    return first.where("needs is null").select(*out).unionByName(rest.mapInArrow(settle, schema).select(*out))


def without_repeats(docs: DataFrame, window: int = 200) -> DataFrame:
    """The rows of ``docs`` with what :func:`remove_repeats` leaves as ``text`` (split characters dropped) and ``n_chars`` to match."""
    cut_ = remove_repeats(docs, window, with_text=True).withColumn("kept_text", F.try_validate_utf8(F.col("kept").cast("string")))
    text = F.coalesce("kept_text", F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    return cut_.select(*[text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])
