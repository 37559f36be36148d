"""Quality rules whose thresholds come from the corpus: mergeable quantile sketches by language and source.

Every expression here is a DataFrame or SQL function.

A sketch is a table of counts by bucket. Values below 64 have a bucket each and
larger ones keep six leading bits, so any quantile is within 1/32 of its value;
sketches merge by adding counts, in any order, and have a few hundred rows at most
whatever they summarise. Zeros are left out: of rates that most documents lack they
would say nothing. A measure's fence is its 90th percentile and ``SPREAD`` times the
distance from there to the median (the 10th percentile downwards), where distances
below what a sketch resolves count as that. It comes from the sketch of the document's
language and source; under ``least_rows`` values, from the merged sketch of the
language, then that of the corpus. A document beyond any fence is rejected, one on it
is not. Only documents that pass the base rules are sketched.

Defined results: a null or empty text has no words and fails the base rules; a null
language or source is a value of its own; repeated rows are judged alike, each with
its row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, durable, keyed_join, lookup_join

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: measure: whether low values are fenced too; rates in thousandths, mean word length in hundredths
MEASURES = {"symbol_rate": False, "word_length": True, "repeat_rate": False, "line_rate": False}
SPREAD = 3
RESOLUTION = 32
LEAST_ROWS = 100


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, key`` and the features of every row; ``key`` is a hash of all that decides."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("key", F.xxhash64("text", F.lit("lang"), "lang", F.lit("source"), "source"))
    t = t.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    t = t.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    t = t.select(
        "doc_id", "lang", "source", "key", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    hashes = "if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))"
    t = t.withColumn("windows", F.expr(hashes)).drop("words")
    t = t.withColumn("ranked", F.expr("if(size(array_distinct(windows)) < size(windows), sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))), cast(array() as array<struct<h:bigint,i:int>>))")).drop("windows")
    again = "(k > 0 and ranked[k].h = ranked[greatest(k - 1, 0)].h) or (k + 1 < size(ranked) and ranked[k].h = ranked[least(k + 1, size(ranked) - 1)].h)"
    t = t.withColumn("at", F.expr(f"if(size(ranked) = 0, cast(array() as array<int>), sort_array(transform(filter(sequence(0, size(ranked) - 1), k -> {again}), k -> ranked[k].i)))")).drop("ranked")
    covered = "if(size(at) = 0, 0, 3 + if(size(at) = 1, 0, aggregate(sequence(1, size(at) - 1), 0, (n, k) -> n + least(3, at[k] - at[k - 1]))))"
    t = t.withColumn("n_repeat_words", F.expr(covered).cast("long")).drop("at")
    t = t.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    n, lines = "greatest(n_words, 1)", "greatest(n_lines, 1)"
    return t.withColumns(
        {
            "symbol_rate": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
            "word_length": F.expr(f"100 * word_chars div {n}"),
            "repeat_rate": F.expr(f"1000 * n_repeat_words div {n}"),
            "line_rate": F.expr(f"1000 * n_dup_lines div {lines}"),
        }
    )


def bucket(v: str) -> Column:
    """The least value of the bucket of ``v``."""
    shift = f"greatest(length(bin({v})) - 6, 0)"
    return F.expr(f"shiftleft(shiftright({v}, {shift}), {shift})")


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, bucket, n``."""
    each = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(m).alias("bucket")) for m in MEASURES])).alias("s")).select(*keys, "s.*")
    return each.where("bucket > 0").groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of the union: ``keys`` are those that stay."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: ``rows_m, low_m, high_m`` of every measure; null where a measure has no values."""
    order = W.partitionBy(*keys, "measure").orderBy("bucket")
    q = sketches.withColumn("upto", F.sum("n").over(order)).withColumn("rows", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    q = q.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), *[F.min(F.when(F.col("upto") * 100 >= F.col("rows") * k, F.col("bucket"))).alias(f"q{k}") for k in (10, 50, 90)])
    q = q.withColumn("high", F.expr(f"q90 + {SPREAD} * greatest(q90 - q50, q90 div {RESOLUTION})")).withColumn("low", F.expr(f"q10 - {SPREAD} * greatest(q50 - q10, q10 div {RESOLUTION})"))
    out = []
    for m, two_sided in MEASURES.items():
        own = F.col("measure") == m
        out += [F.max(F.when(own, F.col("rows"))).alias(f"rows_{m}"), F.max(F.when(own, F.col("high"))).alias(f"high_{m}"), F.max(F.when(own, F.col("low") if two_sided else F.lit(0))).alias(f"low_{m}")]
    return q.groupBy(*keys).agg(*out)


def thresholds(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Fences for every language and source: for each measure their own, their language's or the corpus's."""
    rows = rows.where("not base_failed").withColumns(_keys())
    by_source = durable(sketch(rows, ["lang_key", "source_key"]), "sketch")
    by_lang = merge(by_source, ["lang_key"])
    names = [f"{side}_{m}" for m in MEASURES for side in ("rows", "high", "low")]
    own = fences(by_source, ["lang_key", "source_key"])
    lang = fences(by_lang, ["lang_key"]).select("lang_key", *[F.col(c).alias(f"lang_{c}") for c in names])
    every = fences(merge(by_lang.withColumn("all", F.lit(1)), ["all"]), ["all"]).select("all", *[F.col(c).alias(f"all_{c}") for c in names])
    t = own.join(lang, "lang_key").withColumn("all", F.lit(1)).join(every, "all")
    pick = lambda side, m: F.when(F.col(f"rows_{m}") >= least_rows, F.col(f"{side}_{m}")).when(F.col(f"lang_rows_{m}") >= least_rows, F.col(f"lang_{side}_{m}")).otherwise(F.col(f"all_{side}_{m}")).alias(f"{side}_{m}")
    return durable(t.select("lang_key", "source_key", *[pick(side, m) for m in MEASURES for side in ("high", "low")]), "fences")


def _keys() -> dict[str, Column]:
    return {"lang_key": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("~")), "source_key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))}


def judge(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Every row with its features, ``base_failed`` and ``kept``."""
    rows = durable(measured(docs), "measured")
    passed = rows.where("not base_failed").withColumns(_keys())
    judged = lookup_join(passed, thresholds(rows, least_rows), ["lang_key", "source_key"], "doc_id")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(True))
    cols = [*rows.columns]
    return judged.select(*cols, inside.alias("kept")).unionByName(rows.where("base_failed").withColumn("kept", F.lit(False)))


def kept_documents(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns kept; what is not rejected is hardly ever shuffled, and nothing where few are."""
    bad = durable(judge(docs, least_rows).where("not kept").select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct(), "rejected")
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("lang"), F.col("lang").cast("string"), F.lit("source"), F.col("source").cast("string"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), key.alias("key"))
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key"))
    return keyed_join(rows, bad, same, "left_anti", ["id", "key"], ["bad_id", "bad_key"]).select("row.*")
