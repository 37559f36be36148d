"""Facts that hold for single operators: grouping, bursts, dates, scores."""

import hashlib
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from pictorium import plans
from pictorium.functions import dates, quality, text
from pictorium.operators import bursts, duplicates, images, jobs, ordered, tags, vectors
from pictorium.sources import storage


def pairs(spark, *edges):
    return spark.createDataFrame([(a, b, d) for a, b, d in edges], "image_1 long, image_2 long, distance int")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["group_id"], set()).add(r["image_id"])
    return sorted(map(sorted, out.values()))


def test_triangle_is_one_clique(spark):
    assert groups(duplicates.grouped(pairs(spark, (1, 2, 1), (1, 3, 1), (2, 3, 1)), "clique")) == [[1, 2, 3]]


def test_path_is_no_clique(spark):
    found = duplicates.grouped(pairs(spark, (1, 2, 1), (2, 3, 1)), "clique").collect()
    assert {1, 2, 3} not in [{r["image_id"] for r in found if r["group_id"] == g} for g in {r["group_id"] for r in found}]


def test_chain_makes_no_large_group(spark):
    e = [(1, 2, 0), (1, 3, 0), (2, 3, 0), (11, 12, 0), (11, 13, 0), (12, 13, 0), (21, 22, 0), (3, 11, 3), (13, 21, 4)]
    found = groups(duplicates.grouped(pairs(spark, *e)))
    assert max(map(len, found)) <= 5
    assert not any({1, 21} <= set(g) or {2, 22} <= set(g) for g in found)


def test_no_pairs_no_groups(spark):
    assert duplicates.grouped(pairs(spark).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("image_1"), (F.col("id") + 1).alias("image_2"))
    assert {r["component"] for r in duplicates.components(e).collect()} == {0}


def shots(spark, seconds, make="Canon"):
    return spark.createDataFrame([(i, float(s), make, "R5", float(i), f"/a/IMG_{i:04d}.jpg", None, None) for i, s in enumerate(seconds)], "image_id long, s double, camera_make string, camera_model string, quality_score double, source_path string, latitude double, longitude double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")


def test_bursts_of_three_and_four(spark):
    b = bursts.detect(shots(spark, [0, 1, 2, 60, 61, 62, 63, 500]), 2.0).orderBy("start_time").collect()
    assert [(r["image_count"], r["best_image_id"]) for r in b] == [(3, 2), (4, 6)]


def test_camera_bounds_a_burst(spark):
    both = shots(spark, [0, 1, 2]).unionByName(shots(spark, [3, 4, 5], "Sony").withColumn("image_id", F.col("image_id") + 10))
    assert bursts.detect(both, 2.0).count() == 2


def test_two_shots_are_no_burst(spark):
    assert bursts.detect(shots(spark, [0, 1]), 2.0).count() == 0


def test_dates_from_names_and_folders(spark):
    d = spark.createDataFrame([("/x/IMG_2023-01-15.jpg",), ("/x/photo_2023-06-20_120000.jpg",), ("/x/20221225_family.jpg",), ("/x/01-02-2021.jpg",), ("/2023-13/a.jpg",), ("/2023-07/b.jpg",)], "p string")
    r = d.select(dates.name_date(F.col("p")).cast("string").alias("n"), dates.directory_date(F.col("p")).alias("d")).collect()
    assert [x["n"] for x in r] == ["2023-01-15 00:00:00", "2023-06-20 12:00:00", "2022-12-25 00:00:00", "2021-01-02 00:00:00", None, None]
    assert [x["d"] for x in r] == ["2023-01", "2023-06", "2022", "2021", "2023", "2023-07"]
    d = spark.createDataFrame([("/p/Trip 2023-06/a.jpg",), ("/Summer2019/b.jpg",), ("/2023-13/1234/x.jpg",), ("/a/1850-02/b.jpg",)], "p string")
    assert [x["d"] for x in d.select(dates.directory_date(F.col("p")).alias("d")).collect()] == ["2023-06", "2019", "2023", None]


def test_best_date(spark):
    d = spark.createDataFrame([({"EXIF:DateTimeOriginal": "2020:02:03 04:05:06+02:00"}, "/2019-01/x.jpg"), ({"XMP:ModifyDate": "2020-02-04"}, "/x.jpg"), ({}, "/2019-01/x.jpg")], "e map<string,string>, p string")
    r = d.select(dates.best_date(F.col("e"), F.col("p"), F.lit(None).cast("timestamp_ntz")).alias("b")).select(F.col("b.ts").cast("string").alias("ts"), "b.confidence").collect()
    assert [tuple(x) for x in r] == [("2020-02-03 04:05:06", 95), ("2020-02-04 00:00:00", 85), ("2019-01-01 00:00:00", 50)]


def test_scores(spark):
    d = spark.createDataFrame([(7680, 4320, "cr2"), (0, 5, ""), (1000, 1000, "xyz")], "w int, h int, f string")
    r = d.select(quality.resolution_score(F.col("w"), F.col("h")).alias("r"), quality.format_score(F.col("f")).alias("f")).collect()
    assert [(round(x["r"], 3), x["f"]) for x in r] == [(100.0, 100), (0.0, 50), (40.0, 50)]


def test_texts(spark):
    d = spark.createDataFrame([(b"\xff\xd8\xff\xe0aaaa", "file is truncated"), (b"abc", "broken data stream"), (None, "x")], "c binary, m string")
    r = d.select(text.magic_kind(F.col("c")).alias("k"), text.corruption_severity(F.col("m")).alias("s")).collect()
    assert [tuple(x) for x in r] == [("jpeg", "minor"), (None, "moderate"), (None, "severe")]


def test_constrained_groups_by_brute_force(spark):
    rng = random.Random(6)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))): rng.randrange(7) for _ in range(150)}.items())
    near = {n: {} for n in range(40)}
    for (a, b), d in edges:
        near[a][b] = near[b][a] = d
    left, want = set(range(40)), []
    while left:
        seed = min(left, key=lambda n: (-len(left & set(near[n])), n))
        left.discard(seed)
        group = [seed]
        for d, n in sorted((d, n) for n, d in near[seed].items() if n in left and d <= 3):
            if len(group) < 20 and all(near[n].get(m, 999) <= 8 for m in group):
                group.append(n)
                left.discard(n)
        want += [sorted(group)] * (len(group) > 1)
    assert groups(duplicates.grouped(pairs(spark, *((a, b, d) for (a, b), d in edges)))) == sorted(want)


def test_constrained_groups_of_many_links(spark, monkeypatch):
    """400 images, all linked: within seconds, as no step passes over the links of those not taken in Python."""
    import numpy as np

    one, two = np.triu_indices(400, 1)
    _, *links = duplicates._links(one, two, (one + two) % 4)
    found = duplicates._constrained(*links, 20, 8, 3)
    assert [len(g) for g in found] == [20] * 20 and found[0][0] == 0 and sorted(int(x) for g in found for x in g) == list(range(400))
    assert found[0].tolist()[1:] == sorted(range(1, 400), key=lambda n: (n % 4, n))[:19]


def test_stars_absorb_in_order(spark):
    assert groups(duplicates.grouped(pairs(spark, (1, 2, 1), (2, 3, 1), (3, 4, 1), (5, 6, 1)), "star")) == [[1, 2], [3, 4], [5, 6]]


def test_small_components_share_tasks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "PAIRS_A_TASK", 100)
    e = [(9 * k + i, 9 * k + i + 1, 1) for k in range(200) for i in range(3)]
    df = duplicates.grouped(pairs(spark, *e), "star")
    assert groups(df) == sorted([9 * k + i, 9 * k + i + 1] for k in range(200) for i in (0, 2))
    joined = pairs(spark, *e, *[(b, a, d) for a, b, d in e])
    assert groups(duplicates.grouped(joined, "star")) == groups(df)
    node = df._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandas [task" in node


def test_dense_stars_by_brute_force(spark):
    rng = random.Random(8)
    e = [(a, b, rng.randrange(6)) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.3]
    near = {n: {b for a, b, _ in e if a == n} for n in range(60)}
    taken, want = set(), []
    for n in range(60):
        if n not in taken and near[n] - taken:
            want.append(sorted({n} | near[n] - taken))
            taken |= near[n]
    assert groups(duplicates.grouped(pairs(spark, *e), "star")) == want


@pytest.mark.parametrize("mode", ["any", "all"])
def test_bands_are_never_broadcast(spark, mode):
    h = spark.range(500).select(F.col("id").alias("image_id"), F.xxhash64("id").alias("ahash"), F.xxhash64("id", F.lit(1)).alias("dhash"))
    plan = duplicates.similar_pairs(h, 5, mode)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "bits" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


#: Queries that failed at 1 GB as bands were broadcast.
BAND_QUERIES = [
    "j11_pairs_all",
    "j12_nearest",
    "j16_inside_groups",
    "j17_enrich",
    "d11_metrics",
    "d14_compared",
    "d15_job",
    "s35_migrate_pairs",
    "s19_replace_groups",
    "w07_segments",
    "x07_any_all",
    "x08_best",
    "x42_pair_key",
    "x43_confidence",
    "d01_components",
    "d02_segment_components",
    "d07_complete",
    "d08_transitive",
    "d13_consensus",
]


@pytest.mark.parametrize("name", BAND_QUERIES)
def test_query_broadcasts_no_bands(spark, monkeypatch, name):
    made, plans_of = duplicates.similar_pairs, []

    def spied(*args):
        df = made(*args)
        plans_of.append(df._jdf.queryExecution().executedPlan().toString())
        raise InterruptedError  # the plan is all that is asked

    monkeypatch.setattr(duplicates, "similar_pairs", spied)
    with pytest.raises(InterruptedError):
        plans.queries()[name](spark, f"{DATA}/sf0.001")
    joins = [x for x in plans_of[0].splitlines() if "Join" in x and "bits" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def joins_of(monkeypatch, make) -> list[str]:
    """The joins of what a query writes on its way and of what it returns, as Spark first plans them."""
    written, found = duplicates.checkpointed, []

    def spied(df):
        found.extend(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
        return written(df)

    monkeypatch.setattr(duplicates, "checkpointed", spied)
    df = make()
    return found + [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]


#: Queries of components, whose labels and keys were broadcast; w07_segments still broadcasts its few distances.
@pytest.mark.parametrize("name", ["d15_job", "w07_segments", "d01_components", "d02_segment_components", "d08_transitive"])
def test_query_broadcasts_no_labels(spark, monkeypatch, name):
    joins = joins_of(monkeypatch, lambda: plans.queries()[name](spark, f"{DATA}/sf0.001"))
    assert len(joins) > 3 and all("SortMergeJoin" in x for x in joins if "distance" not in x.split("]")[0])


@pytest.mark.parametrize("name", ["s35_migrate_pairs", "d07_complete"])
def test_query_broadcasts_nothing(spark, monkeypatch, name):
    joins = joins_of(monkeypatch, lambda: plans.queries()[name](spark, f"{DATA}/sf0.001"))
    assert len(joins) > 3 and all("SortMergeJoin" in x for x in joins)


def test_equal_hashes_are_not_broadcast(spark, monkeypatch):
    h = spark.range(300).select(F.col("id").alias("image_id"), F.xxhash64(F.col("id") % 100).alias("ahash"), F.xxhash64(F.col("id") % 100, F.lit(1)).alias("dhash"))
    joins = joins_of(monkeypatch, lambda: duplicates.similar_pairs(h, 5))
    assert len(joins) == 6 and all("SortMergeJoin" in x for x in joins)


def test_similar_pairs_by_brute_force(spark):
    rng = random.Random(9)
    base = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(12)]
    rows = [(i, *(None if rng.random() < 0.05 else x ^ (sum(1 << rng.randrange(63) for _ in range(rng.randrange(6)))) for x in rng.choice(base))) for i in range(150)]
    rows += [(200 + i, *rows[i % 7][1:]) for i in range(30)]
    bits = lambda x, y: None if x is None or y is None else bin((x ^ y) & (1 << 64) - 1).count("1")
    every = [(i, j, bits(a, c), bits(b, d)) for n, (i, a, b) in enumerate(rows) for j, c, d in rows[n + 1 :]]
    low = lambda x: x is not None and x <= 5
    h = spark.createDataFrame(rows, "image_id long, ahash long, dhash long")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, duplicates.similar_pairs(h, 5).collect()), key=key) == sorted((r for r in every if low(r[2]) or low(r[3])), key=key)
    assert sorted(map(tuple, duplicates.similar_pairs(h, 5, "all").collect()), key=key) == sorted((r for r in every if low(r[2]) and low(r[3])), key=key)


def test_moving_average_and_slices(spark):
    rng = random.Random(2)
    rows = [(k, t, rng.random()) for k in "ab" for t in range(500)]
    want = {}
    for k, _, v in rows:
        want[k] = v if k not in want else want[k] * 0.7 + v * 0.3
    got = jobs.smoothed_timing(spark.createDataFrame(rows, "k string, t long, v double").repartition(7), ["k"], "t", "v").collect()
    assert {r["k"]: round(r["ema"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    batches = ordered.sliced(spark.range(1003).select((F.col("id") * 7 % 1003).alias("x")).repartition(5), "x", 100).collect()
    assert all(r["batch"] == r["x"] // 100 for r in batches) and len(batches) == 1003


def test_taxonomy_sync_inserts_once(spark):
    rows = [(f"root{i}", "c", None) for i in range(5)] + [(f"leaf{i}", "c", f"root{i % 5}") for i in range(35)]
    taxonomy = spark.createDataFrame(rows, "name string, category string, parent string")
    first = tags.sync_taxonomy(spark.createDataFrame([(3, "leaf0", "c"), (4, "own", "c")], "tag_id long, name string, category string"), taxonomy).cache()
    assert first.where("inserted").count() == 39 and first.where("name = 'leaf0' and tag_id = 3 and parent_id is not null").count() == 1
    again = tags.sync_taxonomy(first.select("tag_id", "name", "category"), taxonomy)
    assert again.where("inserted").count() == 0 and sorted(map(tuple, again.drop("inserted").collect()), key=str) == sorted(map(tuple, first.drop("inserted").collect()), key=str)


def test_list_index_finds_most_with_few_probes(spark):
    rng = random.Random(1)
    mids = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    v = spark.createDataFrame([(i, [x + rng.gauss(0, 0.2) for x in mids[i % 20]]) for i in range(600)], "vec_id long, embedding array<double>").cache()
    centers = vectors.list_centers(v, 10)
    index = vectors.in_lists(v, centers)
    q = v.where("vec_id < 20")
    found = [{(r["query"], r["vec_id"]) for r in vectors.list_search(index, q, centers, p, 5).collect()} for p in (2, 10)]
    assert len(found[1]) == 100 and len(found[0] & found[1]) >= 90


def test_files_schemas_and_exports(spark, tmp_path):
    (tmp_path / "in/b").mkdir(parents=True)
    for name in ("a.jpg", "b/c.CR2", "b/n.txt"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    found = {r["path"].rsplit("/", 1)[1]: (r["file_type"], r["checksum"]) for r in storage.media_files(spark, str(tmp_path / "in")).collect()}
    assert found == {n: ("image", hashlib.sha256(c).hexdigest()) for n, c in (("a.jpg", b"a.jpg"), ("c.CR2", b"b/c.CR2"))}
    assert storage.media_files(spark, str(tmp_path / "in"), False).count() == 1
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, s string")
    storage.exported(df, str(tmp_path / "j"), "json")
    storage.exported(df, str(tmp_path / "c"), "csv")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "j")).collect())) == [(1, "x"), (2, None)]
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    spark.sql(f"create database if not exists facts location '{tmp_path / 'db'}'")
    try:
        for _ in range(2):
            storage.create_schema(spark, "facts", {"statuses": "id string, name string"})
        assert spark.table("facts.statuses").columns == ["id", "name"]
    finally:
        spark.sql("drop database if exists facts cascade")
    with pytest.raises(ValueError):
        jobs.run_job("none such", df)


def test_eviction_starts_beyond_the_cap(spark):
    f = spark.createDataFrame([(i, 10, i % 7) for i in range(100)], "id long, size_bytes long, created_at long")
    assert images.evicted(f, 1000).count() == 0
    gone = {r["id"] for r in images.evicted(f, 900, 0.9).collect()}
    assert gone == {i for i, _ in sorted(((i, i % 7) for i in range(100)), key=lambda x: (x[1], x[0]))[:19]}
    assert images.evicted(f.limit(0), 1).count() == 0


def test_running_sums_over_ties_and_nothing(spark):
    f = spark.createDataFrame([(i // 5, i, i * i) for i in range(500)], "a long, b long, x long").repartition(7)
    got = {r["b"]: r["s"] for r in ordered.sum_before(f, ["a", "b"], F.col("x"), "s").collect()}
    assert got == {i: sum(k * k for k in range(i)) for i in range(500)}
    assert ordered.sum_before(f.limit(0), ["a", "b"], F.col("x"), "s").count() == 0


def test_index_of_an_empty_catalog(spark):
    some, none = spark.range(10), spark.range(0)
    row = lambda a, b: tuple(duplicates.index_difference(a, b, "id").first())
    assert row(none, none) == (0, 0, 0.0, False)
    assert row(none, some) == (0, 10, 1.0, True)
    assert row(some, none) == (10, 0, 1.0, True)
    assert row(some, spark.range(9)) == (1, 0, 0.1, False)


def test_search_takes_a_name_before_synonyms(spark):
    t = spark.createDataFrame([(1, "dogs"), (2, "wolves"), (3, "Puppy")], "tag_id long, name string")
    s = spark.createDataFrame([(1, "puppy"), (1, "PUPPY"), (3, "puppy"), (2, "canine")], "tag_id long, synonym string")
    assert sorted((r["tag_id"], r["hit"]) for r in tags.search(t, s, "pUPPY").collect()) == [(1, "synonym"), (3, "name")]
    assert tags.search(t, s, "nothing").count() == 0


def test_taxonomy_paths(spark):
    t = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", None)], "name string, parent string")
    assert {r["name"]: r["path"] for r in tags.paths(t).collect()} == {"a": "a", "b": "a/b", "c": "a/b/c", "d": "a/b/c/d", "e": "e"}
    with pytest.raises(Exception, match="deepest"):
        tags.paths(t, 3).collect()


def test_all_tags_means_all_known_ones(spark):
    t = spark.createDataFrame([(1, "x"), (2, "y")], "tag_id long, name string")
    it = spark.createDataFrame([(10, 1), (10, 2), (11, 1)], "image_id long, tag_id long")
    ids = lambda names: sorted(r["image_id"] for r in tags.images_with_all(it, t, names).collect())
    assert ids(["x", "y"]) == [10]
    assert ids(["x", "unheard of"]) == [10, 11]
    assert ids(["unheard of"]) == []


def test_stored_tags_keep_their_ids(spark):
    t = spark.createDataFrame([(7, "x", "c")], "tag_id long, name string, category string")
    n = spark.createDataFrame([("y", "d"), ("x", "d"), ("y", "d"), (None, "d"), ("a", None)], "name string, category string")
    assert sorted((r["tag_id"], r["name"]) for r in tags.stored(t, n).collect()) == [(7, "x"), (8, "a"), (9, "y")]
    assert [r["tag_id"] for r in tags.stored(t.limit(0), n.limit(1)).collect()] == [1]


def test_answers_that_are_no_json(spark):
    r = spark.createDataFrame([(1, "```json\n{\"cat\": 0.9, \"dog\": 0.2}\n```"), (2, "sorry"), (3, None), (4, "{}")], "id long, reply string")
    assert [tuple(x) for x in tags.answers(r, "id", "reply", ["cat", "dog"], 0.5).collect()] == [(1, "cat", 0.9)]


def test_videos_without_a_size(spark):
    v = spark.createDataFrame([(1, {"VideoWidth": "1920", "ImageHeight": "0", "VideoHeight": "1080 px", "VideoCodec": "none"}), (2, {"ImageWidth": "5"}), (3, {"ImageWidth": "x", "FileType": "MP4"})], "id long, exif map<string,string>")
    got = v.select("id", text.video_size(F.col("exif")).alias("s"), text.video_codec(F.col("exif"), F.lit("/a/b.MOV")).alias("c")).orderBy("id").collect()
    assert [(r["s"] and tuple(r["s"]), r["c"]) for r in got] == [((1920, 1080), "mov"), (None, "mov"), (None, "MP4")]


def test_groups_lose_burst_images(spark):
    i = spark.createDataFrame([(1, None), (2, 9), (3, None), (4, 9), (5, None)], "id long, burst_id long")
    m = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)], "group_id string, image_id long")
    assert sorted(r["image_id"] for r in duplicates.without_bursts(m, i).collect()) == [1, 3]
    assert tuple(duplicates.burst_contamination(m, i).first()) == (2, 2)


def test_cliques_by_brute_force(spark):
    rnd = random.Random(5)
    e = {(a, b): rnd.randrange(6) for a in range(14) for b in range(a + 1, 14) if rnd.random() < 0.45}
    joined = lambda a, b: (min(a, b), max(a, b)) in e
    found = duplicates.grouped(pairs(spark, *[(a, b, d) for (a, b), d in e.items()]), "clique").collect()
    assert {x for p in e for x in p} == {r["image_id"] for r in found}
    want = []
    for (a, b), _ in sorted(e.items(), key=lambda x: (x[1], x[0])):
        for g in want:
            if all(x == m or joined(x, m) for x in (a, b) for m in g):
                g.update((a, b))
                break
        else:
            want.append({a, b})
    assert sorted(r["image_id"] for r in found) == sorted(x for g in want for x in g)


@pytest.mark.parametrize("bits_below", [1 << 14, 0])
def test_cliques_of_many_groups(monkeypatch, bits_below):
    """Groups in the order of the old scan over all of them; a chain of 20,000 makes 20,000 groups within seconds."""
    import numpy as np

    monkeypatch.setattr(duplicates, "BITS_BELOW", bits_below)
    rnd = random.Random(7)
    e = {(a, b): rnd.randrange(3) for a in range(70) for b in range(a + 1, 70) if rnd.random() < 0.4}
    want = []
    for (a, b), _ in sorted(e.items(), key=lambda x: (x[1], x[0])):
        for g in want:
            if all(x == m or (min(x, m), max(x, m)) in e for x in (a, b) for m in g):
                g.update((a, b))
                break
        else:
            want.append({a, b})
    one, two, d = (np.array(x) for x in zip(*((a, b, d) for (a, b), d in e.items()), strict=True))
    found = duplicates._cliques(*duplicates._links(one, two, d)[1:])
    assert len(want) > 64 and [g.tolist() for g in found] == [sorted(g) for g in want]
    one = np.arange(20_000 if bits_below == 0 else 2_000)
    assert len(duplicates._cliques(*duplicates._links(one, one + 1, one % 3)[1:])) == len(one)


def test_monitor_of_expected_jobs(spark):
    j = spark.createDataFrame([("SUCCESS", 2), ("FAILURE", 2), ("SUCCESS", 1)], "status string, updated_at long")
    assert tuple(jobs.monitor(j, F.lit(2), 8).first()) == (1, 1, 6, 12)
    assert tuple(jobs.monitor(j, F.lit(9)).first()) == (0, 0, 0, 0)


def test_latest_of_rows_that_tie_is_the_first_stored(spark, tmp_path):
    """Batch numbers that repeat, over many tasks whose order a shuffle does not keep."""
    rows = [(k, b, 10 * k + i, i) for k in range(50) for i, b in enumerate((1, 2, 2, 2))]
    rng = random.Random(3)
    rng.shuffle(rows)
    first = {}
    for k, b, count, _ in rows:
        if b == 2:
            first.setdefault(k, count)
    df = spark.createDataFrame(rows, "parent_job_id long, batch_number int, processed_count long, i int")
    df.coalesce(1).write.parquet(f"{tmp_path}/b")
    stored = spark.read.parquet(f"{tmp_path}/b").select("parent_job_id", "batch_number", "processed_count", "_metadata.file_path", "_metadata.row_index")
    found = storage.latest(stored.orderBy(F.desc("row_index")), ["parent_job_id"], ["batch_number"], ["file_path", "row_index"])
    assert {r["parent_job_id"]: r["processed_count"] for r in found.collect()} == first
