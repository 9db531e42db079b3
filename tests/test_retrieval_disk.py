"""Retrieval: what is shuffled, and what is left on disk."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from disputeflow.operators import retrieval


def corpus_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string")


def texts_of(seed, n):
    rng = random.Random(seed)
    return [" ".join(["common"] * (i % 3 == 0) + rng.choices([f"w{j}" for j in range(60)], k=8) + [f"rare{i // 2}"]) for i in range(n)]


def plain(spark, corpus):
    """norms and bounds by one join each."""
    n = corpus.count()
    counts = retrieval.term_counts(corpus, "chunk_id", "text")
    weights = counts.join(retrieval.inverse_frequencies(counts, n), "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weights.join(norms, "chunk_id").select("chunk_id", "term", "norm", (F.col("weight") / F.col("norm")).alias("most"))


@pytest.mark.parametrize("common, norms", [(1 << 18, 1 << 18), (5, 10), (0, 0)])
def test_lengths_and_bounds_beside_plain_joins(spark, monkeypatch, common, norms):
    monkeypatch.setattr(retrieval, "COMMON_TERMS", common)
    monkeypatch.setattr(retrieval, "BROADCAST_NORMS", norms)
    corpus = corpus_of(spark, texts_of(1, 90))
    index = retrieval.build_index(corpus, shard_size=7)
    shards = {r["chunk_id"]: r["shard"] for r in index.norms.collect()}
    want, lengths = {}, {}
    for r in plain(spark, corpus).collect():
        key = shards[r["chunk_id"]], r["term"]
        want[key] = max(want.get(key, 0.0), r["most"])
        lengths[r["chunk_id"]] = r["norm"]
    assert {r["chunk_id"]: r["norm"] for r in index.norms.collect()} == pytest.approx(lengths)
    assert {(r["shard"], r["term"]): r["most"] for r in index.bounds.collect()} == pytest.approx(want)
    assert index.bounds.count() == len(want)


def test_common_terms_are_bounded(spark, monkeypatch):
    frame = spark.createDataFrame([(f"t{i}", df) for i, df in enumerate([1, 1, 2, 3, 4, 9, 9])], "term string, df long")
    for most, least in [(0, 16), (1, 16), (2, 8), (3, 4), (5, 2), (6, 2), (7, 1)]:
        monkeypatch.setattr(retrieval, "COMMON_TERMS", most)
        assert retrieval.common_from(frame) == least
        assert frame.where(F.col("df") >= least).count() <= most
    assert retrieval.common_from(frame.where("df > 9")) == 1


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_shuffles_and_tables_go_when_used_up(spark, tmp_path, monkeypatch):
    before, left, write, made = shuffle_files(spark), [], retrieval._write, []

    def watched(frame, path):
        left.append((path, len({n.split("_")[1] for n in shuffle_files(spark) - before})))
        return write(frame, path)

    monkeypatch.setattr(retrieval, "_write", watched)
    monkeypatch.setattr(retrieval, "shared_folder", lambda s, purpose: made.append(str(tmp_path / purpose)) or made[-1])
    corpus, queries = corpus_of(spark, texts_of(2, 60)), spark.createDataFrame([(1, "w3 common rare7")], "query_id int, query string")
    hits = retrieval.retrieve(corpus, queries, pad=False)
    assert len(left) > 8 and max(n for _, n in left) <= 2  # single rows of counts
    assert sorted(os.path.basename(p) for p in made) == ["index", "retrieval"] and not any(map(os.path.exists, made))
    assert hits.count() == 3
    index = retrieval.build_index(corpus, folder=str(tmp_path / "own"))
    assert retrieval.retrieve(corpus, queries, pad=False, index=index).collect() == hits.collect()
    assert index.counts.count()  # an index that was given stays


def test_counts_are_not_shuffled(spark, monkeypatch, capsys):
    seen, write = {}, retrieval._write

    def watched(frame, path):
        frame.explain()
        seen[path.rsplit("/", 1)[-1]] = capsys.readouterr().out
        return write(frame, path)

    monkeypatch.setattr(retrieval, "_write", watched)
    retrieval.build_index(corpus_of(spark, texts_of(3, 40)), folder=retrieval.shared_folder(spark, "index"))
    assert seen["counts"].count("Exchange hashpartitioning") == 1 and "Generate" in seen["counts"]
    assert "BroadcastHashJoin" in seen["norms"] and "BroadcastHashJoin" in seen["bounds"]


def test_batches_and_index_are_compressed(spark, tmp_path):
    import pyarrow.parquet as pq

    from disputeflow.streaming import jobs

    jobs.write_batch(spark.range(9), str(tmp_path / "batches"), 3)
    retrieval.build_index(corpus_of(spark, ["alpha beta"]), folder=str(tmp_path / "index"))
    for folder in (tmp_path / "batches" / "batch_id=3", tmp_path / "index" / "counts"):
        file = max(folder.glob("*.parquet"), key=lambda f: f.stat().st_size)
        assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"
