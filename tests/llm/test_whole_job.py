"""What the operators must do on all of their input, whatever its size or mix."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.llm import chat, common, jaccard_join, mixing, quality, toxicity


def test_toxicity_is_calibrated_whatever_the_sample(spark):
    rng = random.Random(4)
    rows = []
    for d in range(4000):
        toxic = d % 10 == 0
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(40)}word" for _ in range(30)]
        if rng.random() < (0.7 if toxic else 0.1):
            words[9:12] = ["vile", "nasty", "rotten"]
        rows.append((d, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    weights = {r["toxic"]: r["w"] for r in toxicity.training_rows(docs, labels, 400).groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
    kept = {r["toxic"]: r["n"] for r in labels.where(~toxicity.held_out()).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert all(abs(weights[t] - kept[t]) < 1e-6 for t in (0, 1))
    for max_docs in (400, 20_000):
        assert abs(toxicity.classify(docs, labels, max_docs).agg(F.avg("score")).first()[0] - 0.1) < 0.03, max_docs


def test_toxicity_scores_by_brute_force(spark):
    """Every score from counts, segments and calibration worked out anew, with all segments of a text tried."""
    rng = random.Random(8)
    rows = []
    for d in range(600):
        toxic = d % 5 == 0
        words = [f"{rng.choice('abcd')}{rng.choice('efgh')}{rng.randrange(30)}tail" for _ in range(rng.randrange(5, 40))]
        if toxic and rng.random() < 0.8:
            words[2:2] = [rng.choice(["vile!", "nasty", "rotten,"]) for _ in range(3)]
        rows.append((d, " ".join(words), int(toxic)))
    rows += [(600, "x " * 100_000 + "vile nasty rotten vile", 1), (601, "", 0), (602, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    got = {r["doc_id"]: r for r in toxicity.classify(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    train = [(r["text"] or "", r["toxic"], r["half"]) for r in toxicity.training_rows(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()]
    assert {d: r["held_out"] for d, r in got.items()} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in rows}
    assert sorted(t for t, *_ in train) == sorted(t or "" for d, t, _ in rows if zlib.crc32(str(d).encode()) % 4 != 2)
    bare = lambda w: re.sub(r"^\W+|\W+$", "", w.lower())
    seen = [(set(map(bare, t.split())) - {""}, y) for t, y, half in train if half == 0]
    n_toxic, n_clean = sum(y for _, y in seen), sum(1 - y for _, y in seen)

    def odds(holds, prior):
        t, c = sum(y for w, y in seen if holds(w)), sum(1 - y for w, y in seen if holds(w))
        share = n_toxic * math.exp(prior) / (n_toxic * math.exp(prior) + n_clean)
        t, c = t + 2 * share, c + 2 * (1 - share)
        away = math.log(t / n_toxic) - math.log(c / n_clean) - prior
        return prior + math.copysign(max(0.0, abs(away) - 2 * math.sqrt(1 / t + 1 / c)), away)

    vocabulary = set().union(*(w for w, _ in seen))
    groups = {g: odds(lambda ws, g=g: any(w[:5] == g for w in ws), 0.0) for g in {w[:5] for w in vocabulary}}
    words = {x: odds(lambda ws, x=x: x in ws, groups[x[:5]]) for x in vocabulary}
    scores = lambda t: [words.get(bare(w), groups.get(bare(w)[:5], 0.0)) - 0.5 for w in t.split()]

    def maximal(s, lo, hi):
        sums = [0.0]
        for x in s[lo:hi]:
            sums.append(sums[-1] + x)
        best = max(((sums[j] - sums[i], -(j - i), lo + i, lo + j) for i in range(hi - lo) for j in range(i + 1, hi - lo + 1)), default=(0,))
        return maximal(s, lo, best[2]) + [best[0]] + maximal(s, best[3], hi) if best[0] > 0 else []

    half = [(scores(t), y) for t, y, h in train if h == 1]
    clean = [s for s, y in half if not y and s]
    flat = np.concatenate(clean)
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        lam = (lo + hi) / 2
        lo, hi = (lo, lam) if np.exp(lam * flat).mean() > 1 else (lam, hi)
    k = len(clean) / sum(len(s) * math.exp(-lo * max(maximal(s, 0, len(s)), default=0.0)) for s in clean if len(s) < 1000)

    def of(text):
        s = scores(text)
        n, s = len(s), s[-60:]
        e = [k * n * math.exp(-lo * x) for x in maximal(s, 0, len(s))]
        return math.log1p(sum(-math.log(max(x, 1e-300)) for x in e if x < 0.05))

    told = [(of(t), y) for t, y, h in train if h == 1]
    a = b = 0.0
    for _ in range(200):  # Newton's steps on the penalised likelihood, written out
        p = [1 / (1 + math.exp(-(a * x + b))) for x, _ in told]
        ga = sum((y - q) * x for (x, y), q in zip(told, p, strict=True)) - 1e-2 * a
        gb = sum(y - q for (_, y), q in zip(told, p, strict=True)) - 1e-3 * b
        haa = sum(q * (1 - q) * x * x for (x, _), q in zip(told, p, strict=True)) + 1e-2
        hab = sum(q * (1 - q) * x for (x, _), q in zip(told, p, strict=True))
        hbb = sum(q * (1 - q) for q in p) + 1e-3
        det = haa * hbb - hab * hab
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    for d, text, _ in rows:
        assert abs(got[d]["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, a * of(text or "") + b))))) < 1e-6, d
        assert got[d]["predicted"] == (got[d]["score"] >= 0.3)


def test_chat_texts_of_every_mark(spark):
    """Texts that begin with, end in or consist of marks, under every role, on both sides of the loss mask, and a very long one."""
    marks = ["### ", "###", "### User: ", ": ", "</turn>", "</turn>\n", "\n", "\\", "\\\\", "\\</turn>\n", "@", "### Assistant: </turn>\n### User: "]
    texts = [x for m in marks for x in (m, m + "a", "a" + m, m + m)] + ["foo</turn>\n", "</turn>\n</turn>\n", "a\\\\</turn>\n", "", "long </turn>\n " * 300_000]
    roles = ["system", "user", "assistant", "tool: x</turn>\n", "user"]
    rows = [(c, t, role, text) for c, text in enumerate(texts) for t, role in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    r = {x["conv_id"]: x for x in chat.read_back(chat.write_chat(df).repartition(5)).collect()}
    for c, text in enumerate(texts):
        assert r[c]["n_turns"] == len(roles) and not r[c]["valid"]
        assert r[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for role in roles).encode()).hexdigest(), text[:50]
        assert r[c]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r[c]["loss_chars"] == len(text)


def test_mixing_fills_targets_past_a_long_document(spark):
    rows = [(i, "w " * 40, "a") for i in range(500)] + [(500, "w " * 15_000, "a")] + [(1000 + i, "w " * 175, "b") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (3, 6):
        got = {r["source"]: r for r in mixing.taken_words(d, seed=seed).join(d, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("goal")).collect()}
        assert 0 <= got["a"]["goal"] - got["a"]["t"] < 40 and got["b"]["goal"] == got["b"]["t"]


def test_mixed_rows_that_repeat(spark):
    """Whole rows that repeat are taken each by itself, also where a block is drawn in part."""
    rows = [(i // 4, f"t{i // 4} " * (3 + i // 4 % 5), "a") for i in range(800)] + [(None, "x y", "b")] * 50 + [(1000 + i, "w " * 90, "b") for i in range(40)] + [(5, None, None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2):
        want = {(r["doc_id"], r["size"]): r["t"] for r in mixing.taken_words(d, seed=seed).groupBy("doc_id", "size").agg(F.sum("taken").alias("t")).collect() if r["t"]}
        got: dict = {}
        for r in mixing.mixed_documents(d, seed=seed).collect():
            n = len((r["text"] or "").split())
            got[r["doc_id"], n] = got.get((r["doc_id"], n), 0) + n
        assert {k: v for k, v in got.items() if v} == want


def written(spark):
    """Rows that all shuffles of the session have written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_kept_rows_are_not_shuffled_however_many_are_dropped(spark, monkeypatch):
    rows = spark.range(40_000).select(F.when(F.col("id") % 1000 != 3, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("t1")).repartition(4)
    rows = common.durable(rows, "rows")
    keys = common.durable(rows.where("doc_id % 40 = 0 or doc_id is null").select(F.col("doc_id").alias("one_id"), F.col("t1").alias("one_t1")), "keys")
    same = rows["doc_id"].eqNullSafe(F.col("one_id")) & (rows["t1"] == F.col("one_t1"))
    at = lambda how: sorted(map(str, common.keyed_join(rows, keys, same, how, ["doc_id", "t1"], ["one_id", "one_t1"]).collect()))
    want = {how: at(how) for how in ("inner", "left_semi", "left_anti")}
    assert [len(x) for x in want.values()] == [1040, 1040, 38_960]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how, rows_ in want.items():
            began = written(spark)
            assert at(how) == rows_, how
            assert written(spark) - began < 12_000, how  # all of them are 40,000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_few_or_many_dropped_give_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    steps = {"quality": lambda: quality.kept_documents(docs), "jaccard": lambda: jaccard_join.one_of_each(docs, 5, 80, 100)}
    few = {k: sorted(r["doc_id"] for r in f().collect()) for k, f in steps.items()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    joined = []
    monkeypatch.setattr(F, "bitmap_construct_agg", lambda c, f=F.bitmap_construct_agg: joined.append(1) or f(c))
    assert {k: sorted(r["doc_id"] for r in f().collect()) for k, f in steps.items()} == few
    assert len(joined) >= 3  # rejected documents, candidates and near copies


def test_texts_that_are_dropped_are_not_shuffled(spark, monkeypatch):
    """Only keys are, however many rows are dropped."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(99)), lambda w: F.concat_ws("-", w, F.col("id") % 500)))
    docs = spark.range(2000).select(F.when(F.col("id") != 3, F.col("id")).alias("doc_id"), F.when(F.col("id") < 1990, words).alias("text"))
    docs = common.durable(docs.repartition(4), "docs")
    want = sorted([i for i in range(500) if i != 3] + [503] + list(range(1990, 2000)))  # of a text, a row with an id; rows without text
    monkeypatch.setattr(common, "BROADCAST_ROWS", 40)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard_join.one_of_each(docs, 5, 80, 100).select("doc_id")
        began = written(spark)
        assert sorted(r["doc_id"] for r in out.collect()) == want
        assert written(spark) - began < 100  # of 2,000 rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [0, 50])
def test_without_is_exact(spark, monkeypatch, most):
    every = common.durable(spark.range(30_000).select(F.when(F.col("id") % 1000 != 3, F.col("id")).alias("doc_id"), F.when(F.col("id") % 7 > 0, F.xxhash64("id")).alias("t1")), "every")
    gone = common.durable(every.where("doc_id % 3 = 0 or doc_id is null").distinct(), "gone")
    left = lambda: sorted(map(str, common.without(every.withColumn("x", F.lit(1)), every, gone, ["doc_id", "t1"]).collect()))
    want = left()
    assert len(want) == every.where("doc_id % 3 > 0").count()
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    assert left() == want


def test_what_a_write_shuffled_is_deleted(spark):
    import time

    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    began = files()
    common.durable(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    for _ in range(40):
        if not (left := files() - began):
            break
        time.sleep(0.1)
    assert not left
