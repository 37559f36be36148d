"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.llm import chat, common, embedding_dedup, jaccard_join, mixing, packing, quality, suffix_dedup, token_binary, token_counts, toxicity
from pictorium.llm.common import connected_components
from pictorium.llm.entry import tokenizer_file
from pictorium.llm.suffix_sort import repeated_windows, suffix_array, words_at
from pictorium.llm.tokenizing import WordCodec

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en", "a"), (2, "", None, None), (3, "be " * 400, "en", "a"), (4, "one two", "en", "a"), (4, "one two", "en", "a"), (5, "é" * 300 + " x", "fr", "b"), (6, "w" * 5000, "fr", "b"), (None, "one two", "en", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, size int, h string")


def test_codec_is_the_library():
    c = WordCodec(tokenizer_file())
    texts = ["Ça vá l'été ’s don't 12", " \n", None, "ΑΣ. İ ß H̱ É", "x" * 5000 + " y", "Ab.. it's. x'S! q!'s a\x0bb", "<|endoftext|>!! ﬁ 漢字"]
    ids, at = c.encode(texts)
    assert [ids[at[i] : at[i + 1]].tobytes() for i in range(len(texts))] == [c.whole(t) for t in texts]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4)], "u long, v long")
    assert {(r["node"], r["component"]) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (9, 8), (8, 8), (5, 5)}


def test_components_of_few_edges_are_one_task(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, None), (2000, 2000), (-3, 5)]
    e = spark.createDataFrame(edges, "u long, v long")
    few = connected_components(e)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(common, "EDGES_A_TASK", 0)
    many = connected_components(e)
    assert "Exchange" in many._jdf.queryExecution().executedPlan().toString()
    assert few.dtypes == many.dtypes
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert connected_components(e.limit(0)).count() == 0


def test_segments_are_maximal():
    def brute(s, lo, hi):
        best = None
        for i in range(lo, hi):
            t = 0
            for j in range(i, hi):
                t += s[j]
                if t > 0 and (best is None or t > best[2] + 1e-12):
                    best = (i, j + 1, t)
        return brute(s, lo, best[0]) + [best] + brute(s, best[1], hi) if best else []

    rng = random.Random(0)
    for _ in range(100):
        s = np.array([rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 10 for _ in range(rng.randint(0, 14))])
        assert [x[:2] for x in toxicity.segments(s)] == [x[:2] for x in brute(s, 0, len(s))]


def test_toxicity(spark, odd):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    all_docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = toxicity.classify(all_docs, labels).where("held_out").join(labels, "doc_id").groupBy("predicted", "toxic").count().collect()
    n = {(x["predicted"], x["toxic"]): x["count"] for x in r}
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.85 and n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8
    scores = toxicity.classify(odd, labels.limit(0))
    assert scores.count() == len(ODD) and scores.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.classify(odd.limit(0), labels.limit(0)).count() == 0


def test_quality(odd):
    r = {x["doc_id"]: x for x in quality.judge(odd).collect()}
    assert quality.judge(odd).count() == len(ODD)
    assert r[1]["n_words"] == 0 and r[3]["n_repeat_words"] == 400 and not r[3]["kept"]
    assert quality.judge(odd.limit(0)).count() == 0
    clashing = odd.withColumns({c: F.lit(1) for c in ("row", "id", "key", "kept_id", "n_words")})
    assert quality.kept_documents(clashing).columns == clashing.columns


def test_fences_follow_the_source(spark):
    """Each source has cutoffs of its own, a null one too; what lies on a fence is kept; order and partitions do not matter."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        source = ("short", "long", None)[i % 3]
        n = {"short": 4, "long": 12, None: 7}[source]
        words = ["".join(rng.choice("abcdefgh") for _ in range(max(1, n + rng.choice([-1, 0, 0, 1])))) for _ in range(120)]
        rows.append((i, " ".join(words), "en", source))
    rows += [(1000, " ".join(w * 3 for w in rows[0][1].split()), "en", "short"), (1001, rows[1][1], "en", "short"), (1002, rows[1][1], "xx", "lone"), (1003, rows[0][1], "en", "lone")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = quality.judge(d).collect()
    kept = {r["doc_id"]: r["kept"] for r in judged}
    assert all(kept[i] for i in range(900)) and not kept[1000] and not kept[1001] and kept[1002] and kept[1003]
    assert kept == {r["doc_id"]: r["kept"] for r in quality.judge(d.repartition(13)).collect()}
    t = {(r["lang_key"], r["source_key"]): r for r in quality.thresholds(quality.measured(d)).collect()}
    assert t["=en", "=short"]["high_word_length"] < t["=en", "~"]["low_word_length"] < t["=en", "~"]["high_word_length"] < t["=en", "=long"]["low_word_length"]
    assert t["=en", "=lone"]["high_word_length"] > t["=en", "=long"]["high_word_length"] - 200
    at = t["=en", "=short"]["high_word_length"]
    lengths = lambda i: [at // 100] * (100 - (at + i) % 100) + [at // 100 + 1] * ((at + i) % 100)
    edge = [(2000 + i, " ".join("".join(rng.choice("abcdefgh") for _ in range(n)) for n in lengths(i)), "en", "short") for i in (0, 1)]
    both = quality.judge(d.unionByName(spark.createDataFrame(edge, d.schema))).where("doc_id >= 2000").orderBy("doc_id").collect()
    assert [r["kept"] for r in both] == [True, False]
    assert [r["word_length"] - at for r in both] == [0, 1]


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    rows = [(i * 4 + k, [float(x) for x in b + rng.normal(size=16) * 0.15 * k], i % 3) for i, b in enumerate(base) for k in range(4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None])
    np.fill_diagonal(near, False)
    monkeypatch.setattr(embedding_dedup, "LEAF", 32)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    found = {r["vec_id"]: r for r in embedding_dedup.links(v.withColumns({"row": F.lit(1), "codes": F.lit(2)})).collect()}
    got = {k: r["n_links"] for k, r in found.items()}
    want = dict(zip([r[0] for r in rows], near.sum(axis=1).tolist(), strict=True))
    assert sum(got.values()) >= 0.95 * sum(want.values()) and all(got[k] <= want[k] for k in want)
    if got == want:
        part = np.arange(len(rows))
        for _ in rows:
            part = np.minimum(part, np.where(near, part[None, :], len(rows)).min(axis=1))
        assert [found[r[0]]["component_id"] for r in rows] == [rows[p][0] for p in part]
    bad = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, 2.0], None), (6, [2.0, 4.0], 1), (7, [], 1)], "vec_id long, embedding array<float>, label int")
    assert {r["vec_id"]: r["n_links"] for r in embedding_dedup.links(bad).collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0}
    assert embedding_dedup.links(bad.limit(0)).count() == 0


def test_copies_ties_and_lengths_of_vectors(spark, monkeypatch):
    """Copies count each other, a pair at the threshold links, lengths keep apart, however many there are; ids may repeat or be null."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 4)
    rows = [(i, [1.0, 0.0], 0) for i in range(30)] + [(30, [0.93, (1 - 0.93**2) ** 0.5 - 1e-9], 0), (31, [0.92, (1 - 0.92**2) ** 0.5], 0)]
    rows += [(100 + n, [1.0] * n, 0) for n in range(3, 40)] + [(200 + n, [1.0] * n, 0) for n in range(3, 40)]
    rows += [(300, [0.0, -1.0], 0), (300, [-1.0, 0.0], 0), (301, [0.0, -2.0], 0), (None, [-2.0, 0.0], 0)]
    got = sorted(map(tuple, embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    want = [(i, 30, 0, i == 0) for i in range(30)] + [(30, 31, 0, False), (31, 1, 0, False)]
    want += [(100 + n, 1, 100 + n, True) for n in range(3, 40)] + [(200 + n, 1, 100 + n, False) for n in range(3, 40)]
    want += [(300, 1, 300, True), (300, 1, 300, True), (301, 1, 300, False), (None, 1, 300, False)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_forest_recall_and_leaf_sizes(n):
    """Pairs near the threshold meet in some leaf, leaves stay small as vectors grow in number, and near copies stop splitting."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x[: n // 5] = x[0] + rng.normal(size=(n // 5, 64)) * 0.001  # a group of near copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = x[n // 2 : n // 2 + 2000]
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    pairs = 0.93 * base + (1 - 0.93**2) ** 0.5 * other
    f = embedding_dedup.Forest(4, 0.4, 0.93, 5)
    f.fit(x[rng.permutation(n)[: embedding_dedup.SAMPLE]], int(np.ceil(np.log2(n / embedding_dedup.LEAF))))
    sets = []
    for y in (base, pairs):
        rows, codes = f.leaves(y)
        sets.append([set() for _ in y])
        for r, c in zip(rows.tolist(), codes.tolist(), strict=True):
            sets[-1][r].add(c)
    assert np.mean([bool(a & b) for a, b in zip(*sets, strict=True)]) > 0.95
    rows, codes = f.leaves(x[n // 5 :])
    assert np.median(np.unique(codes, return_counts=True)[1]) < 6 * embedding_dedup.LEAF and len(rows) < 16 * n
    assert len(f.leaves(x[: n // 5])[0]) < 32 * n // 5


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_of(rows, k, num, den):
    """``doc_id, n_shingles, component_id`` of ``(doc_id, text)`` rows by brute force."""
    sets = [shingles(t, k) for _, t in rows]
    part = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and den * len(s & sets[j]) >= num * len(s | sets[j]) and part[i] != part[j]:
                old = part[i]
                part = [part[j] if x == old else x for x in part]
    ids = [d for d, _ in rows]
    least = {p: min((d for d, q in zip(ids, part, strict=True) if q == p and d is not None), default=None) for p in part}
    return sorted(((d, len(s), least[p] if s else d) for d, s, p in zip(ids, sets, part, strict=True)), key=str)


@pytest.mark.parametrize(("blocks", "meeting"), [(1500, 2000), (3, 2)])
def test_jaccard(docs, odd, blocks, meeting, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", blocks)
    monkeypatch.setattr(jaccard_join, "MEETING", meeting)
    for df in (docs, odd):
        got = sorted(map(tuple, jaccard_join.components(df, 3, 90, 100).collect()), key=str)
        assert got == components_of([(r["doc_id"], r["text"]) for r in df.collect()], 3, 90, 100)
    assert jaccard_join.components(odd.limit(0), 3, 90, 100).count() == 0


@pytest.mark.parametrize(("blocks", "meeting"), [(1500, 2000), (7, 5)])
def test_jaccard_of_chains_groups_and_repeated_ids(spark, blocks, meeting, monkeypatch):
    """A chain of near copies, sets that share prefix and size but not the rest, and texts that share a doc_id."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", blocks)
    monkeypatch.setattr(jaccard_join, "MEETING", meeting)
    w = [f"w{i}" for i in range(400)]
    rows = [(10 + i, " ".join(w[i : i + 60])) for i in range(60)]
    rows += [(200 + i, " ".join([*w[200:240], *(f"v{i}x{j}" for j in range(i % 4)), *w[240:300]])) for i in range(40)]
    rows += [(1, "a b c d e f g h i j k"), (1, "q r s t u v w x y z"), (2, "a b c d e f g h i j k l"), (3, "q r s t u v w x y z k"), (1, "q r s t u v w x y z"), (None, "nobody has this text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.components(df, 2, 80, 100).collect()), key=str)
    assert got == components_of(rows, 2, 80, 100)
    extra = df.withColumns({"row": F.lit(1), "t1": F.lit("x"), "one_id": F.lit(2)})
    kept = jaccard_join.one_of_each(extra, 2, 80, 100)
    assert kept.columns == extra.columns
    want = {c for _, _, c in got}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*want, 1], key=str)


def test_jaccard_groups_share_prefix_and_size():
    rng = random.Random(2)
    for _ in range(30):
        sets = [np.sort(np.array(rng.sample(range(60), rng.randint(1, 30)), np.uint64)) for _ in range(40)]
        for i in range(0, 40, 3):
            sets[i] = np.unique(np.append(sets[i - 1], np.uint64(100 + i)))
        near = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        for labels in (np.arange(40), np.arange(40) // 2):
            want, got = labels.copy(), labels.copy()
            for i, j in near:
                want[want == want[i]] = want[j]
            for u, v in jaccard_join.linked(np.arange(40), labels, sets, 80, 100):
                got[got == got[u]] = got[v]
            assert ((want[:, None] == want) == (got[:, None] == got)).all()


def targets_of(sizes, most=3.0):
    """Target by source, by sharing again and again what stands above a cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=order.index):
            target[s] += share * weight[s]
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mixing(docs, odd):
    rows = mixing.taken_words(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken_words(docs).collect()))
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["shards"]) for r in rows)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect() for d in [r["doc_id"]]}
    sums = {s: sum(n for d, n in size.items() if source[d] == s) for s in set(source.values())}
    want = targets_of(sums)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[source[r["doc_id"]]]
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 * max(1, r["target"])
    for s, goal in want.items():
        own = [r for r in rows if source[r["doc_id"]] == s]
        open_ = [r["size"] for r in own if r["size"] and len(r["shards"]) <= goal // sums[s]]  # not yet drawn in the last epoch
        assert 0 <= goal - sum(r["taken"] for r in own) < max(1, min(open_, default=0) if goal < 3 * sums[s] else 0)
    assert mixing.taken_words(odd).count() == len(ODD) and mixing.taken_words(odd.limit(0)).count() == 0
    clashing = odd.withColumns({c: F.lit(1) for c in ("row", "shard", "_times", "_h", "nth", "draws")})
    assert mixing.mixed_documents(clashing).columns == clashing.columns


def test_targets_reach_their_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 5, None: 400, "e": 0, "f": 7}
    d = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    want = targets_of(sizes)
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.sized_rows(d, 1)).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_splitting_tree(spark):
    """Quotas are exact at every level; halves are drawn as a random deal would."""
    counts = {0: 700, 1: 3, 2: 0, 3: 297, 4: 77}
    df = spark.createDataFrame(list(counts.items()), "place long, n long")
    for shards in (1, 2, 6, 64):
        q = mixing.shard_quotas(df, shards, 5).collect()
        assert len(q) == shards * len(counts) and min(r["quota"] for r in q) >= 0
        total = sum(counts.values())
        assert {p: sum(r["quota"] for r in q if r["place"] == p) for p in counts} == counts
        for s in range(shards):
            assert sum(r["quota"] for r in q if r["shard"] == s) == (s + 1) * total // shards - s * total // shards
    quotas, k, n = [30, 50, 5], 40, 85
    rows = spark.range(4000).select((F.col("id") * 2).alias("lo"), (F.col("id") * 2 + 2).alias("hi"), F.array(*map(F.lit, quotas)).cast("array<bigint>").alias("quotas"), F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k"))
    x = np.array([r["y"] for r in rows.select(F.expr(mixing._split(3)).alias("y")).collect()])
    assert (x.sum(axis=1) == k).all() and (x <= quotas).all() and (x >= 0).all()
    for j, q in enumerate(quotas):
        mean, var = k * q / n, k * q / n * (1 - q / n) * (n - k) / (n - 1)
        assert abs(x[:, j].mean() - mean) < 5 * (var / 4000) ** 0.5 and abs(x[:, j].var() / var - 1) < 0.15


def test_shards_are_disjoint_runs_of_permuted_blocks(docs):
    rows = mixing.mix(docs, shards=8).collect()
    assert len({(r["row"], r["epoch"]) for r in rows}) == len(rows)
    taken = {}
    for r in rows:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["size"]
    assert all(r["taken"] == taken.get(r["doc_id"], 0) for r in mixing.taken_words(docs, shards=8).collect())
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["shuffle_key"])
    assert all(keys == sorted(keys) for keys in by.values())
    again = mixing.mixed_documents(docs, shards=8).groupBy("doc_id").count().collect()
    size = {r["doc_id"]: r["size"] for r in rows}
    assert {r["doc_id"]: r["count"] * size[r["doc_id"]] for r in again} == taken


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for top in (1, 2, 300, 50_000, 1 << 32):
        ids = rng.integers(0, top, 3 * token_binary.BLOCK).astype(np.uint64)
        ids[::97] = top - 1
        table, bodies = token_binary.encode_blocks(ids)
        starts = np.cumsum(table[:, 3]) - table[:, 3]
        assert (token_binary.decode_blocks(table, b"".join(bodies), starts) == ids).all()


def test_token_files(docs, odd):
    c = WordCodec(tokenizer_file())
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = c.whole(r["text"]) + (2).to_bytes(4, "little")
        want.append((r["doc_id"], at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, token_binary.token_files(docs, tokenizer_file()).collect())) == want
    assert token_binary.token_files(odd, tokenizer_file()).count() == len(ODD)
    assert token_binary.token_files(odd.limit(0), tokenizer_file()).count() == 0


def test_edits_keep_counts():
    c = token_counts.Counter(tokenizer_file("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    parts = ["a", "b", "'", "s", "'re", " ", "  ", "\n", "1", "22", "é", "!", " the", "\x1c", "\x85"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 30, 400])))
        x = token_counts.CountedText(t, c)
        for _ in range(4):
            s = rng.randint(0, len(x.text))
            x.edit(s, s + rng.choice([0, 1, 5, 100]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 20]))))
            assert x.n_tokens == len(c.encoding.encode_ordinary(x.text))
            assert x.tree.totals[:2] == [len(x.text), len(c.split(x.text))] and [len(b) for b in x.blocks] == (x.tree.leaves[0] or [0])


def test_many_edits_of_a_long_text():
    """Edits of a text of millions of characters neither copy nor encode it."""
    c = token_counts.Counter(tokenizer_file("byte_bpe_50k.tiktoken"))
    rng = random.Random(4)
    t = " ".join(rng.choice(["the", "of", "x12", "naïve", "\n", "..."]) for _ in range(500_000))
    x = token_counts.CountedText(t, c)
    began, encoded = time.process_time(), 0
    for _ in range(3000):
        s = rng.randrange(len(t))
        new = rng.choice(["", "new words", " ", "12", "'s"])
        encoded += x.edit(s, s + 3, new)
        if rng.random() < 0.01:
            t = x.text
    assert encoded < 3000 * 8 * token_counts.BLOCK and time.process_time() - began < 20
    assert x.n_tokens == len(c.encoding.encode_ordinary(x.text)) and x.tree.totals[1] == len(c.split(x.text))


def test_token_counts(docs, odd):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    c = token_counts.Counter(path)
    got = {r["doc_id"]: (r["n_tokens"], r["n_tokens_edited"]) for r in token_counts.redacted_counts(docs, path).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == (len(c.encoding.encode_ordinary(r["text"])), len(c.encoding.encode_ordinary(token_counts.REDACTED.sub(token_counts.MARK, r["text"]))))
    stored = token_counts.build_trees(odd, path).withColumn("edits", F.expr("array(named_struct('start', 0, 'end', 1, 'text', 'zz '))"))
    edited = token_counts.apply_edits(stored, path, keep_trees=True)
    for r in edited.collect():
        want = token_counts.CountedText(r["text"], c)
        assert r["text"].startswith("zz ") and r["n_tokens_edited"] == want.n_tokens == sum(r["tokens"]) and sum(r["chars"]) == len(r["text"]) == r["n_chars_edited"]
    again = token_counts.apply_edits(edited.withColumn("edits", F.expr("array(named_struct('start', 0, 'end', 3, 'text', cast(null as string)))")), path)
    assert {r["doc_id"]: r["n_tokens_edited"] for r in again.where("doc_id = 5").collect()} == {5: len(c.encoding.encode_ordinary("é" * 299 + " x"))}
    assert token_counts.redacted_counts(odd.limit(0), path).count() == 0


def pieces_of(rows, end_id=1, capacity=4096):
    """``doc_id, piece, start, length, ids_crc32`` by the library on whole texts."""
    c, out = WordCodec(tokenizer_file()), []
    for d, text in rows:
        ids = c.whole(text) + end_id.to_bytes(4, "little")
        for k, s in enumerate(range(0, len(ids), 4 * capacity)):
            own = ids[s : s + 4 * capacity]
            out.append((d, k, s // 4, len(own) // 4, zlib.crc32(own)))
    return sorted(out, key=str)


def sequences_of(rows, capacity=4096):
    """How many sequences there are; each must be gapless from 0 and within the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("bucket", [200_000, 3])
def test_packing(docs, odd, bucket, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_A_BUCKET", bucket)
    for df in (docs, odd.unionByName(odd)):
        rows = packing.pack_documents(df, tokenizer_file()).collect()
        want = pieces_of([(r["doc_id"], r["text"]) for r in df.collect()])
        assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == want
        assert sequences_of(rows) <= -(-sum(r["length"] for r in rows) // 4096) + 2
    assert packing.pack_documents(odd.limit(0), tokenizer_file()).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 120))]
        bins = []
        for n in sorted(lengths, reverse=True):
            fit = min((b for b in bins if b >= n), default=None)
            if fit is not None:
                bins.remove(fit)
            bins.append((20 if fit is None else fit) - n)
        slots = packing.plan({n: lengths.count(n) for n in set(lengths)}, 20)
        assert len({s + i // each for _, _, n, s, each, _ in slots for i in range(n)}) == len(bins)


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(40):
        t = np.array([rng.randrange(rng.choice([1, 2, 250])) + 1 for _ in range(rng.randint(1, 300))] + [0] * 40, np.uint8)
        order = suffix_array(t, words_at(t), 16).tolist()
        keys = [t.tobytes()[i : i + 16] for i in order]
        assert sorted(order) == list(range(len(t))) and keys == sorted(keys)
    assert [f.tolist() for f in repeated_windows([b"abcabcabX", b"cabY"], [2, 1], 8)] == [[False, False], [False]]
    assert [f.tolist() for f in repeated_windows([b"abcdefghijX", b"abcdefghijY"], [2, 2], 10)] == [[True, False], [True, False]]


def without_repeated(texts, window):
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` by brute force."""
    seen = {}
    for _, t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) > 0).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "hot"), [(200, 1 << 20), (200, 300), (50, 60), (101, 1 << 20), (3, 1 << 20)])
def test_repeats(docs, odd, window, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    for df in (docs.where("length(text) < 2000"), odd):
        texts = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
        assert sorted(map(tuple, suffix_dedup.remove_repeats(df, window).collect()), key=str) == without_repeated(texts, window)
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0
    assert suffix_dedup.without_repeats(odd.withColumn("_", F.lit(1)).withColumn("t1", F.lit("x"))).columns == [*odd.columns, "_", "t1"]


def test_a_passage_in_many_contexts_is_split(spark, monkeypatch):
    """A common string with different bytes around it: names grow until each has few contents."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common = word(150)
    texts = [(i, (word(rng.randrange(300)) + common + rng.choice(["", common]) + word(rng.randrange(300)) + rng.choice(["x", "y"]) * 250)) for i in range(120)]
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 1000)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == without_repeated([(d, t.encode()) for d, t in texts], 200)


def test_chat(spark):
    rows = [(1, 1, "assistant", "b \\ ### c </turn> ####"), (1, 0, "user", "a"), (2, 0, "assistant", None), (None, 0, "odd:role\n", "x"), (3, 0, None, ""), (3, 0, None, "")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    r = {x["conv_id"]: x for x in chat.read_back(chat.format_chat(c)).collect()}
    assert r[1]["valid"] and not r[2]["valid"] and r[3]["n_turns"] == 2
    assert r[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb \\ ### c </turn> ####\n").hexdigest()
    assert r[1]["loss_sha256"] == hashlib.sha256(b"b \\ ### c </turn> ####").hexdigest()
    assert r[None]["turns_sha256"] == hashlib.sha256(b"odd:role\n\nx\n").hexdigest()
    assert chat.read_back(chat.format_chat(c.limit(0))).count() == 0
