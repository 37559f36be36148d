"""Best-fit packing planned on a histogram of lengths.

1. Every document becomes pieces of at most ``capacity`` ids (only longer ones are cut).
2. The histogram of piece lengths, ``capacity`` rows at most, goes to the driver, which
   runs best-fit decreasing over counts: bins that look alike are one entry with a count.
3. Pieces get a rank within their length (a rank within a hash bucket plus the counts of
   the buckets before it, so that a length which a third of the corpus shares is spread)
   and take the planned slot of that rank.

The plan depends on ``capacity`` alone in size, never on the number of documents.

Defined results: a null or empty text is one piece that holds the end id; repeated rows
are pieces of their own; a null ``doc_id`` packs like any other; an empty table gives no
rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable
from .tokenizing import WordCodec

ROWS_A_BUCKET = 200_000


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids and end id, cut at ``capacity``."""

    def run(batches):
        import pyarrow as pa

        codec = WordCodec(tokenizer_path)
        for b in batches:
            ids, at = codec.encode(b["text"])
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            out: list[tuple] = []
            for doc, lo, hi in zip(b["doc_id"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for k, s in enumerate(range(lo, hi, capacity)):
                    e = min(hi, s + capacity)
                    out.append((doc, k, s - lo, e - s, zlib.crc32(ids[s:e])))
            d, p, s, n, c = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "piece": pa.array(p, pa.int32()), "start": pa.array(s, pa.int64()), "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(c, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns slot ranges ``(length, first_rank, n, first_sequence, per_sequence, offset)``:
    rank ``first_rank + i`` (i < n) sits in sequence ``first_sequence + i // per_sequence``
    at ``offset + i % per_sequence * length``.
    """
    open_bins: list[tuple[int, int, int]] = []  # (room, first sequence, sequences), by room
    slots, next_sequence = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(open_bins, (length, -1, -1))
            if i < len(open_bins):
                room, first, n = open_bins.pop(i)
            else:
                room, first, n = capacity, next_sequence, -(-left // (capacity // length))
                next_sequence += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                if room - each * length:
                    insort(open_bins, (room - each * length, first, full))
            if full < n:
                if left and left < each:
                    slots.append((length, rank, left, first + full, left, capacity - room))
                    if room - left * length:
                        insort(open_bins, (room - left * length, first + full, 1))
                    full, left = full + 1, 0
                if full < n:
                    insort(open_bins, (room, first + full, n - full))
    return slots


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to durable pieces (a positive ``length``, at most ``capacity``, each)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = plan(histogram, capacity)
    buckets = max(1, -(-max(histogram.values(), default=0) // ROWS_A_BUCKET))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(bases, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    by_length: dict[int, list] = {}
    for length, *rest in slots:
        by_length.setdefault(length, []).append(rest)
    table = spark.createDataFrame([(k, v) for k, v in by_length.items()], "length long, slots array<struct<first_rank:long,n:long,first_sequence:long,each:long,at:long>>")
    # F.broadcast: a row for each length at most, and slot ranges whose number capacity bounds
    slot = F.filter("slots", lambda s: (s["first_rank"] <= F.col("rank")) & (F.col("rank") < s["first_rank"] + s["n"]))[0]
    placed = ranked.join(F.broadcast(table), "length").withColumn("slot", slot)
    i = F.col("rank") - F.col("slot.first_rank")
    return placed.select(*pieces.columns, (F.col("slot.first_sequence") + F.floor(i / F.col("slot.each"))).cast("long").alias("sequence_id"), (F.col("slot.at") + i % F.col("slot.each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return place(durable(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
