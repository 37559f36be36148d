"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every expression here is a DataFrame or SQL function.

1. Targets: sources, in code-point order with null last, weigh 1, 2, 3 and repeat; they
   share all words, no target passes ``most`` times its source's words, and what is above
   is shared again by weight. With sources sorted by cap over weight this has a closed
   form in running sums.
2. Blocks: a keyed hash deals each source's documents into blocks. A source takes whole
   epochs of its blocks and, of one more epoch in permuted order, the blocks that its target
   still holds; the rest comes from single documents of all other blocks, in rounds: of what
   fits by itself, blocks in order as far as the target goes, then documents of the next block
   in hash order. Rounds end when no document fits.
3. The tree: the block draws of all sources are split between the two halves of the output
   shards with a multivariate-hypergeometric draw (source by source, from what is left of the
   places and of the draws), then each half again, down to single shards. Shards get
   the exact number of draws, and sources fall into them as a random deal would.
4. Each shard takes its disjoint run of every source's permuted draws; ``shuffle_key``
   orders the documents within the shard. What a document gives is the sum of what the
   written shards hold of it.

Randomness comes from hashes of the seed and ids, so reruns agree.

Defined results: a null or empty text has size 0 and is in the mix with no words; a null
source is a source of its own; repeated rows are mixed each by itself; an empty table gives
no rows. Sources are rows of one table of the plan; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, durable, lookup_join, small

DOCS_A_BLOCK = 50_000
LEAST_BLOCKS = 512
PASSES = 3
LEAST_SHARDS = 32
WORDS_A_SHARD = 50_000_000
LEVELS_A_TABLE = 5


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized_rows(docs: DataFrame, seed: int) -> DataFrame:
    """``row, doc_id, source, skey, size, h`` of every row, written to the shared folder."""
    rows = docs.select(*_identity(seed), word_count(F.col("text").cast("string")).alias("size"))
    return durable(rows.withColumn("skey", _source_key()).withColumn("row", F.monotonically_increasing_id()), "sized")


def _identity(seed: int) -> list[Column]:
    """``doc_id, source, h``; rows that agree in these and the text are alike."""
    doc = F.col("doc_id").cast("long")
    return [doc.alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.lit(seed), doc, F.xxhash64("text")).alias("h")]


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))


def targets(sized: DataFrame, most: float = 3.0) -> DataFrame:
    """``skey, source, place, source_size, target`` of every source."""
    by_source = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    s = by_source.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", (F.col("place") % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = W.orderBy("ratio", "place")
    every = W.orderBy("ratio", "place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(every))
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
    s = s.withColumn("open_level", F.first(F.when(F.col("ratio") >= F.col("level"), F.col("level")), ignorenulls=True).over(every))
    return s.select("skey", "source", "place", "source_size", F.when(F.col("ratio") < F.col("level"), F.col("cap")).otherwise(F.least("cap", F.col("open_level") * F.col("weight"))).alias("target"))


def _split(seed: int) -> str:
    """SQL that draws, from the quotas of a node (``lo, hi, quotas, n, k``), those of the ``k`` places of its left half.

    For each source, a hypergeometric draw of q among n for k places: weights relative to the
    mode's follow from their ratios, up to 12 standard deviations and 30 steps either way,
    beyond which doubles hold nothing, and one uniform number picks among them.
    """
    up = "(q - x) * (k - x) / ((x + 1) * greatest(n - q - k + x + 1, 1D))"
    down = "x * (n - q - k + x) / ((q - x + 1) * (k - x + 1))"
    total = lambda xs, ratio: f"aggregate({xs}, named_struct('w', 1D, 's', 0D), (b, x) -> named_struct('w', b.w * {ratio}, 's', b.s + b.w), b -> b.s)"
    walk = lambda xs, ratio, left: f"aggregate({xs}, named_struct('w', 1D, 'left', {left}, 'x', m), (b, x) -> if(b.left < 0, b, named_struct('w', b.w * {ratio}, 'left', b.left - b.w, 'x', x)), b -> b.x)"
    ups, downs = "sequence(m, least(q, k, m + r))", "sequence(m, greatest(0L, k + q - n, m - r), -1L)"
    uniform = f"(pmod(xxhash64({seed}L, lo, hi, a.j), 9007199254740992L) + 0.5D) / 9007199254740992D"
    # names are bound by one-element transforms; the mode counts in both sums, so one of them is left out
    pick = f"transform(array({uniform} * (su + sd - 1)), t -> if(t < su, {walk(ups, up, 't')}, {walk(downs, down, 't - su + 1')}))[0]"
    sums = f"transform(array({total(ups, up)}), su -> transform(array({total(downs, down)}), sd -> {pick})[0])[0]"
    radius = f"transform(array(cast(12 * sqrt(k * (q / n) * (1 - q / n) * (n - k) / greatest(n - 1, 1)) + 30 as bigint)), r -> {sums})[0]"
    mode = f"transform(array(least(q, k, greatest(0L, k + q - n, (q + 1) * (k + 1) div (n + 2)))), m -> {radius})[0]"
    one = f"if(q = 0 or a.k = 0, 0L, transform(array(a.n), n -> transform(array(a.k), k -> {mode})[0])[0])"
    step = f"(a, q) -> transform(array({one}), y -> named_struct('k', a.k - y, 'n', a.n - q, 'j', a.j + 1, 'out', concat(a.out, array(y))))[0]"
    return f"aggregate(quotas, named_struct('k', k, 'n', n, 'j', 0L, 'out', cast(array() as array<bigint>)), {step}, a -> a.out)"


def shard_quotas(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``place, shard, quota`` from ``place, n``: exact draws of each source in each shard."""
    node = counts.agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("c"))
    node = node.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.expr("transform(c, x -> x.place)").alias("places"), F.expr("transform(c, x -> cast(x.n as bigint))").alias("quotas"))
    node = node.withColumn("draws", F.expr("aggregate(quotas, 0L, (s, q) -> s + q)")).withColumn("n", F.col("draws"))
    leaf, level = 1, 0
    while leaf < shards:
        if level and level % LEVELS_A_TABLE == 0:
            node = durable(node.repartition("lo"), "nodes")
        node = node.withColumn("k", F.expr(f"(lo + hi) div 2 * draws div {shards} - lo * draws div {shards}"))
        left = node.withColumn("left", F.expr(_split(seed)))
        halves = F.array(
            F.struct(F.col("lo"), F.expr("(lo + hi) div 2").alias("hi"), F.col("left").alias("quotas")),
            F.struct(F.expr("(lo + hi) div 2").alias("lo"), F.col("hi"), F.expr("zip_with(quotas, left, (q, l) -> q - l)").alias("quotas")),
        )
        whole = F.array(F.struct(F.col("lo"), F.col("hi"), F.col("quotas")))
        node = left.select("places", "draws", F.explode(F.when(F.expr("hi - lo > 1"), halves).otherwise(whole)).alias("h")).select("places", "draws", "h.*")
        node = node.withColumn("n", F.expr("aggregate(quotas, 0L, (s, q) -> s + q)"))
        leaf, level = 2 * leaf, level + 1
    return node.select(F.col("lo").cast("int").alias("shard"), F.explode(F.arrays_zip("places", "quotas")).alias("z")).select(F.col("z.places").alias("place"), "shard", F.col("z.quotas").alias("quota"))


def fill(rows: DataFrame) -> DataFrame:
    """``skey, block, row`` of the documents that fill what is left of each source's target, until no other fits.

    ``rows``: ``row, doc_id, skey, size, h, block, rank, left``. In each round a source takes one
    document at least, and only documents of one block of a source meet in a task.
    """
    order = W.partitionBy("skey").orderBy("h", "doc_id", "size", "row")
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cols = ["row", "doc_id", "skey", "size", "h", "block", "rank", "left"]
    fitting = rows.where("left > 0 and size <= left").select(*cols)
    found = rows.limit(0).select("skey", "block", "row")
    while not fitting.isEmpty():
        by = fitting.groupBy("skey", "block").agg(F.first("rank").alias("rank"), F.first("left").alias("left"), F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(W.partitionBy("skey").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        by = by.withColumn("room", F.col("left") - before).select("skey", "block", "room", (F.col("words") <= F.col("room")).alias("whole"))
        met = lookup_join(fitting, durable(by, "rooms"), ["skey", "block"], "row")
        edge = F.expr("not whole and room >= 0")
        some = met.where(edge).withColumn("taken", F.lit(False))
        for _ in range(PASSES):
            fits = ~F.col("taken") & (F.col("size") <= F.col("room"))
            some = some.withColumn("run", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(order)).withColumn("now", fits & (F.col("run") <= F.col("room")))
            some = some.withColumn("room", F.col("room") - F.sum(F.when(F.col("now"), F.col("size")).otherwise(0)).over(every)).withColumn("taken", F.col("taken") | F.col("now"))
        marked = durable(met.where(~edge).select(*cols, F.col("whole").alias("taken")).unionByName(some.select(*cols, "taken")), "filled")
        found = found.unionByName(marked.where("taken").select("skey", "block", "row"))
        used = durable(marked.where("taken").groupBy("skey").agg(F.sum("size").alias("used")), "used")
        fitting = lookup_join(marked.where("not taken"), used, ["skey"], "row").withColumn("left", F.col("left") - F.col("used")).where("left > 0 and size <= left").select(*cols)
    return found


def plan(sized: DataFrame, shards: int | None, seed: int, most: float) -> tuple[DataFrame, DataFrame, int]:
    """``skey, block, source_size, target, draws``: for each block its draws, an array of ``epoch, shard, part``.

    ``part`` is true where not the whole block is drawn, but rows of the second table,
    ``skey, block, row``. Also the number of blocks a source has at most.
    """
    n_blocks = max(LEAST_BLOCKS, -(-sized.count() // DOCS_A_BLOCK))
    sources = durable(targets(sized, most), "sources")
    blocks = sized.groupBy("skey", _block(n_blocks)).agg(F.sum("size").alias("words"))
    s = lookup_join(blocks, sources, ["skey"], "block")
    s = s.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0))
    s = s.withColumn("need", F.col("target") - F.col("full") * F.col("source_size"))
    d = s.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    permuted = W.partitionBy("skey", "epoch").orderBy(F.xxhash64(F.lit(seed), "skey", "epoch", "block"), "block")
    d = d.withColumn("rank", F.row_number().over(permuted) - 1).withColumn("before", F.coalesce(F.sum("words").over(permuted.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("n_blocks", F.count("*").over(W.partitionBy("skey", "epoch")))
    last = F.col("epoch") == F.col("full")
    whole = ~last | (F.col("before") + F.col("words") <= F.col("need"))
    d = d.withColumn("whole", whole).withColumn("kept", F.sum(F.when(F.col("whole"), F.col("words")).otherwise(0)).over(permuted.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rest = durable(d.where("not whole and need > kept").select("skey", "block", "rank", (F.col("need") - F.col("kept")).alias("left")), "rest")
    rows = lookup_join(sized.select("row", "doc_id", "skey", "size", "h", _block(n_blocks)), rest, ["skey", "block"], "row")
    taken = fill(rows)
    parts = taken.select("skey", "block", F.lit(False).alias("whole"), F.lit(True).alias("part")).distinct()
    d = d.join(parts, ["skey", "block", "whole"], "left").withColumn("part", F.coalesce("part", F.lit(False))).withColumn("drawn", F.col("whole") | F.col("part"))
    d = durable(d.withColumn("draw", F.col("epoch") * F.col("n_blocks") + F.col("rank")), "draws")
    if shards is None:
        words = sources.agg(F.sum("target")).first()[0] or 0  # one number
        shards = max(LEAST_SHARDS, 1 << (int(words) // WORDS_A_SHARD).bit_length())
    quotas = shard_quotas(d.where("drawn").groupBy("place").agg(F.count("*").alias("n")), shards, seed).where("quota > 0")
    starts = quotas.withColumn("draw", F.sum("quota").over(W.partitionBy("place").orderBy("shard")) - F.col("quota"))
    order = F.row_number().over(W.partitionBy("place").orderBy("draw")) - 1
    draws = d.where("drawn").withColumn("draw", order).select("place", "draw", F.lit(None).cast("int").alias("shard"), F.struct("skey", "block", "epoch", "part").alias("d"))
    both = draws.unionByName(starts.select("place", "draw", "shard", F.lit(None).cast(draws.schema["d"].dataType).alias("d")))
    # a shard's run begins at its start, and each draw belongs to the last start before it
    run = F.last("shard", ignorenulls=True).over(W.partitionBy("place").orderBy("draw", F.col("shard").asc_nulls_last()))
    drawn = both.withColumn("shard", run).where("d is not null").select("d.*", "shard")
    per_block = drawn.groupBy("skey", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "part"))).alias("draws"))
    every = d.where("epoch = 0").select("skey", "block", "source_size", "target")
    return every.join(per_block, ["skey", "block"], "left").withColumn("draws", F.coalesce("draws", F.expr("cast(array() as array<struct<epoch:bigint,shard:int,part:boolean>>)"))), taken, n_blocks


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), "h"), F.lit(n_blocks)).cast("int").alias("block")


def decide(docs: DataFrame, shards: int | None = None, seed: int = 17, most: float = 3.0) -> DataFrame:
    """Every row of ``docs`` with its draws, in a durable table: ``row, doc_id, source, size, source_size, target, h, draws``."""
    sized = sized_rows(docs, seed)
    per_block, taken, n_blocks = plan(sized, shards, seed, most)
    base = sized.withColumn("block", _block(n_blocks)).join(per_block, ["skey", "block"])
    part = F.exists("draws", lambda d: d["part"])
    opened = base.where(part).join(taken.select("row", F.lit(True).alias("taken")), "row", "left")
    draws = F.when(F.col("taken"), F.col("draws")).otherwise(F.filter("draws", lambda d: ~d["part"]))
    out = ["row", "doc_id", "source", "size", "source_size", "target", "h"]
    return durable(base.where(~part).select(*out, "draws").unionByName(opened.select(*out, draws.alias("draws"))), "decided")


def _shuffle_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "shard", "epoch", "h").alias("shuffle_key")


def _in_shards(rows: DataFrame) -> DataFrame:
    """``rows`` with a shard in one task each, in the order of their ``shuffle_key``."""
    return rows.repartition("shard").sortWithinPartitions("shard", "shuffle_key")


def mix(docs: DataFrame, shards: int | None = None, seed: int = 17, most: float = 3.0) -> DataFrame:
    """The shards, a row for each document drawn, in order: ``row, doc_id, source, size, epoch, shard, shuffle_key``."""
    return shards_of(decide(docs, shards, seed, most), seed)


def shards_of(decided: DataFrame, seed: int) -> DataFrame:
    d = decided.select("row", "doc_id", "source", "size", "h", F.explode("draws").alias("d")).select("*", "d.epoch", "d.shard")
    return _in_shards(d.select("row", "doc_id", "source", "size", "epoch", "shard", _shuffle_key(seed)))


def taken_words(docs: DataFrame, shards: int | None = None, seed: int = 17, most: float = 3.0) -> DataFrame:
    """``doc_id, size, source_size, target, taken, shards`` of every row: what the written shards hold of it, and which they are."""
    decided = decide(docs, shards, seed, most)
    written = durable(shards_of(decided, seed), "shards")
    held = written.groupBy("row").agg(F.sum("size").alias("taken"), F.array_sort(F.collect_list("shard")).alias("shards"))
    none = F.expr("cast(array() as array<int>)")
    return decided.join(held, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def mixed_documents(docs: DataFrame, shards: int | None = None, seed: int = 17, most: float = 3.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns kept, by shard and in each shard's order.

    Texts are shuffled once, to their shards: a row's draws are its block's, and only of blocks that
    are drawn in part must single rows be known.
    """
    sized = sized_rows(docs, seed)
    per_block, taken, n_blocks = plan(sized, shards, seed, most)
    per_block = durable(per_block.where(F.size("draws") > 0).select("skey", "block", "draws"), "per_block")
    key = ["doc_id", "h", "skey"]
    chosen = taken.select("row").join(sized.select("row", *key), "row").groupBy(*key).agg(F.count("*").alias("times"))
    chosen = durable(chosen.select(*[F.col(c).alias(f"taken_{c}") for c in key], "times"), "chosen")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_identity(seed)).withColumn("skey", _source_key()).withColumn("block", _block(n_blocks).alias("block"))
    met = lookup_join(rows, per_block, ["skey", "block"], "h")
    whole = met.withColumn("draws", F.filter("draws", lambda d: ~d["part"]))
    same = F.col("doc_id").eqNullSafe(F.col("taken_doc_id")) & (F.col("h") == F.col("taken_h")) & (F.col("skey") == F.col("taken_skey"))
    part = met.withColumn("draws", F.filter("draws", lambda d: d["part"])).where(F.size("draws") > 0).join(small(chosen), same)
    nth = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))  # of rows that repeat, as many as were taken
    part = part.withColumn("nth", nth).where("nth <= times").select(*whole.columns)
    drawn = whole.unionByName(part).select("row", "h", F.explode("draws").alias("d")).select("row", "h", "d.epoch", "d.shard")
    return _in_shards(drawn.select("row", "shard", _shuffle_key(seed))).select("row.*")
