"""Every stage of the pipeline against brute force on its own input."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SF, components_of, odd, pieces_of, sequences_of, targets_of  # noqa: F401

import corpus_pipeline
from pictorium.llm.entry import oracle_sql

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def steps(spark, odd):  # noqa: F811
    """Input and output rows of each stage, over small documents with odd rows among them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    extra = odd.select(*COLUMNS).where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 100_000)
    docs, out = docs.unionByName(extra).cache(), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_columns_and_names(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    assert all(after == COLUMNS for *_, after in steps[:-1])


def test_quality_rules(spark, steps, tmp_path):
    before, after, *_ = steps[0]
    spark.createDataFrame(before).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    kept = con.execute(f"select doc_id from ({oracle_sql()['op2_quality_rules']}) where kept").fetchall()
    assert sorted((r["doc_id"],) for r in after) == sorted(kept) and {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_ngram_jaccard_join(steps):
    before, after, *_ = steps[1]
    found = components_of([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in found}) and {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert len(after) < len(before)


def test_suffix_array_dedup(steps):
    before, after, *_ = steps[2]
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in before}
    seen = {}
    for t in texts.values():
        for i in range(len(t) - 199):
            h = hash(t[i : i + 200])
            seen[h] = seen.get(h, 0) + 1
    got, cuts = by_id(after), 0
    assert len(after) == len(before) == len(got)
    for r in before:
        t = texts[r["doc_id"]]
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[hash(t[i : i + 200])] > 1:
                gone[i : i + 200] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes().decode(errors="ignore")
        cuts += gone.any()
        g = got[r["doc_id"]]
        assert (g["text"], g["n_chars"], g["lang"], g["source"]) == (left, len(left), r["lang"], r["source"])
    assert cuts


def test_source_mixing(steps):
    before, after, *_ = steps[3]
    size = {r["doc_id"]: sum(1 for w in (r["text"] or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w) for r in before}
    sums, taken, times = {}, {}, {}
    for r in before:
        sums[r["source"]] = sums.get(r["source"], 0) + size[r["doc_id"]]
    for r in after:
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert {tuple(r) for r in after} <= {tuple(r) for r in before} and max(times.values()) <= 3
    for s, goal in targets_of(sums).items():
        open_ = [size[r["doc_id"]] for r in before if r["source"] == s and size[r["doc_id"]] and times.get(r["doc_id"], 0) <= goal // max(1, sums[s])]
        assert 0 <= goal + 1e-6 - taken.get(s, 0) < max(1, min(open_, default=0))


def test_best_fit_packing(steps):
    before, after, *_ = steps[4]
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after), key=str)
    assert got == pieces_of([(r["doc_id"], r["text"]) for r in before])
    assert sequences_of(after) <= -(-sum(r["length"] for r in after) // 4096) + 2


def test_empty_table(spark, steps):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if out.columns != COLUMNS else out


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))
    assert rows and sorted(map(key, rows)) == sorted(map(key, again))
    assert sequences_of(rows) <= -(-sum(r["length"] for r in rows) // 4096) + 2
