"""Token-id files of patched frame-of-reference blocks.

Documents are dealt by ranges of ``doc_id`` and each partition writes one shard::

    magic, counts | block table | document table | packed words | exceptions

A block holds 1024 ids. Its minimum is subtracted, a width is chosen among
percentiles of what is left (whichever gives the smallest block), every value
keeps that many low bits, and values that need more leave their high bits in
the block's exception list. The block table gives where each block starts, so
any document decodes without reading the blocks before it.

A shard is written under a name of its attempt and renamed when whole; content
and final name depend on the rows alone, so a task that runs again leaves the
same file. Shards go to the shared folder through the Arrow file systems.

Defined results: a null text is empty and still gets the end id; rows sort by
``doc_id`` (null first), then by the text's hash, so repeated ids and repeated
rows have a place each; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, new_path
from .tokenizing import WordCodec

BLOCK = 1024
MAGIC = b"PFOR0001"
PERCENTILES = (75, 90, 95, 99, 100)
BATCH_BLOCKS = 512


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """[blocks, BLOCK] values below 2**width to [blocks, BLOCK * width // 64] words."""
    lanes = values.reshape(-1, 64).astype(np.uint64)
    out = np.zeros((len(lanes), max(width, 1)), np.uint64)
    for j in range(64 if width else 0):
        word, bit = divmod(j * width, 64)
        out[:, word] |= lanes[:, j] << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - bit)
    return out[:, :width].reshape(len(values), BLOCK * width // 64)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of :func:`pack`; words: [blocks, BLOCK * width // 64]."""
    if not width:
        return np.zeros((len(words), BLOCK), np.uint64)
    rows = words.reshape(-1, width)
    out = np.empty((len(rows), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, bit = divmod(j * width, 64)
        v = rows[:, word] >> np.uint64(bit)
        if bit + width > 64:
            v = v | (rows[:, word + 1] << np.uint64(64 - bit))
        out[:, j] = v & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Whole blocks of ids to (table rows of minimum, width, exceptions, bytes) and each block's bytes."""
    x = ids.reshape(-1, BLOCK).astype(np.uint64)
    low = x.min(axis=1)
    rest = x - low[:, None]
    ranked = np.sort(rest, axis=1)
    best_width = np.zeros(len(x), np.int64)
    best_size = np.full(len(x), 1 << 40)
    for p in PERCENTILES:
        top = ranked[:, max(0, BLOCK * p // 100 - 1)]
        width = np.zeros(len(x), np.int64)
        for b in range(33):
            width += (top >> np.uint64(b)) > 0
        over = (rest >> width[:, None].astype(np.uint64) > 0).sum(axis=1)
        size = BLOCK * width // 8 + 6 * over
        better = size < best_size
        best_width, best_size = np.where(better, width, best_width), np.where(better, size, best_size)
    table = np.zeros((len(x), 4), np.int64)
    bodies: list[bytes] = [b""] * len(x)
    for width in np.unique(best_width):
        at = np.flatnonzero(best_width == width)
        mask = np.uint64((1 << int(width)) - 1)
        packed = pack(rest[at] & mask, int(width))
        high = rest[at] >> np.uint64(width)
        for k, i in enumerate(at):
            where = np.flatnonzero(high[k])
            bodies[i] = packed[k].astype("<u8").tobytes() + where.astype("<u2").tobytes() + high[k][where].astype("<u4").tobytes()
            table[i] = low[i], width, len(where), len(bodies[i])
    return table, bodies


def decode_blocks(table: np.ndarray, body: bytes, starts: np.ndarray) -> np.ndarray:
    """Blocks of a shard back to ids; ``starts``: where each begins in ``body``."""
    out = np.empty((len(table), BLOCK), np.uint64)
    for width in np.unique(table[:, 1]):
        at = np.flatnonzero(table[:, 1] == width)
        size = BLOCK * int(width) // 8
        words = np.frombuffer(b"".join([body[starts[i] : starts[i] + size] for i in at]), "<u8").reshape(len(at), -1)
        values = unpack(words, int(width))
        for k, i in enumerate(at):
            n = int(table[i, 2])
            if n:
                p = int(starts[i]) + size
                where = np.frombuffer(body, "<u2", n, p)
                values[k, where] |= np.frombuffer(body, "<u4", n, p + 2 * n).astype(np.uint64) << np.uint64(width)
        out[at] = values + table[at, 0].astype(np.uint64)[:, None]
    return out.reshape(-1).astype("<u4")


class ShardWriter:
    """Builds one shard; holds its packed bytes, never its ids."""

    def __init__(self):
        self.tables, self.bodies, self.pending, self.pending_n = [], [], [], 0
        self.docs: list[tuple[int | None, int]] = []
        self.n_ids = 0

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.pending_n += len(ids)
        self.n_ids += len(ids)
        if self.pending_n >= BLOCK * BATCH_BLOCKS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        whole = len(ids) // BLOCK * BLOCK
        if last and whole < len(ids):
            ids = np.concatenate((ids, np.full(-len(ids) % BLOCK, ids[-1], ids.dtype)))
            whole = len(ids)
        for k in range(0, whole, BLOCK * BATCH_BLOCKS):
            table, bodies = encode_blocks(ids[k : min(whole, k + BLOCK * BATCH_BLOCKS)])
            self.tables.append(table)
            self.bodies.append(b"".join(bodies))
        self.pending, self.pending_n = [ids[whole:]], len(ids) - whole

    def parts(self):
        self._flush(True)
        table = np.concatenate(self.tables) if self.tables else np.zeros((0, 4), np.int64)
        ids = np.array([(d is not None, d or 0, n) for d, n in self.docs], "<i8").reshape(-1, 3)
        yield MAGIC + struct.pack("<4q", BLOCK, len(table), len(ids), self.n_ids)
        yield table.astype("<i8").tobytes()
        yield ids.tobytes()
        yield from self.bodies


class ShardReader:
    """Reads a shard: ``documents()`` in batches, without decoding more than a batch of blocks at a time."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        _, n_blocks, n_docs, self.n_ids = struct.unpack_from("<4q", data, 8)
        at = 40
        self.table = np.frombuffer(data, "<i8", 4 * n_blocks, at).reshape(-1, 4)
        at += 32 * n_blocks
        self.docs = np.frombuffer(data, "<i8", 3 * n_docs, at).reshape(-1, 3)
        self.starts = at + 24 * n_docs + np.cumsum(self.table[:, 3]) - self.table[:, 3]
        self.data = data

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the shard; only the blocks that hold them are decoded."""
        if start >= end:
            return np.zeros(0, "<u4")
        a, b = start // BLOCK, -(-end // BLOCK)
        return decode_blocks(self.table[a:b], self.data, self.starts[a:b])[start - a * BLOCK : end - a * BLOCK]

    def documents(self):
        ends = np.cumsum(self.docs[:, 2])
        at = 0
        while at < len(self.docs):
            first = int(ends[at] - self.docs[at, 2])
            to = max(at + 1, int(np.searchsorted(ends, first + BLOCK * BATCH_BLOCKS, "right")))
            ids = self.ids(first, int(ends[to - 1]))
            for i in range(at, to):
                known, doc, n = self.docs[i]
                s = int(ends[i] - n) - first
                yield (int(doc) if known else None), int(ends[i] - n), ids[s : s + int(n)]
            at = to


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, shard_mb: int = 64) -> DataFrame:
    """Encode every text, append ``end_id`` and write the shards; returns the manifest: ``shard, path, n_docs, n_ids``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // (shard_mb << 20)))
    ordered = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("shard", F.spark_partition_id())

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        codec, writer, shard = None, ShardWriter(), None
        for b in batches:
            if not b.num_rows:
                continue
            codec = codec or WordCodec(tokenizer_path)
            shard = b["shard"][0].as_py()
            ids, at = codec.encode(b["text"])
            with_end = np.insert(ids, at[1:], end_id).astype("<u4")
            writer.add(with_end)
            writer.docs += zip(b["doc_id"].to_pylist(), (np.diff(at) + 1).tolist(), strict=True)
        if shard is None:
            return
        to, top = fs.FileSystem.from_uri(folder)
        name, attempt = f"{top}/shard-{shard:06d}.pfor", f"{top}/.{uuid.uuid4().hex}"
        with to.open_output_stream(attempt) as f:
            for part in writer.parts():
                f.write(part)
        to.move(attempt, name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    _mkdirs(spark, folder)
    return durable(ordered.mapInArrow(run, "shard int, path string, n_docs long, n_ids long"), "manifest", folder + "/manifest")


def _mkdirs(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the shards."""
    starts = manifest.withColumn("base", F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)))
    # a number of partitions is named, since rows this small would else be read by one task
    tasks = starts.select("path", F.coalesce("base", F.lit(0)).alias("base")).repartition(max(1, manifest.count()), "path")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        to, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, base in zip(b["path"].to_pylist(), b["base"].to_pylist(), strict=True):
                with to.open_input_file(path) as f:
                    shard = ShardReader(f.read())
                out: list[tuple] = []
                for doc, start, ids in shard.documents():
                    out.append((doc, base + start, len(ids), zlib.crc32(ids)))
                d, s, n, c = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(c, pa.int64())})

    return tasks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the corpus as token shards and return what reading them back gives, per document."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, tokenizer_path, end_id, folder), folder)
