from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from disputeflow.functions.stopwords import english_stop_words
from disputeflow.operators import retrieval

RULES = """
HANDBOOK OF DISPUTE RULES

POLICY 1: UNKNOWN PAYMENT

A cardholder says the payment is unknown. Check authentication, device and country.


POLICY 2: PARCEL

Delivery proof, courier name and delivery day are needed for a parcel dispute.

POLICY 10: MONEY BACK

A refund already paid closes the dispute. Refund day and refund sum are needed.
"""


def corpus_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")


def queries_of(spark, texts):
    return spark.createDataFrame(
        [(100 + i, t) for i, t in enumerate(texts)], "query_id long, query string"
    )


def words(text, stopped):
    return [w for w in re.findall(r"\w\w+", text.lower()) if w not in stopped]


def brute(chunks, query, stopped, k):
    """Cosine of smooth TF-IDF vectors, all pairs, plain Python."""
    counts = [Counter(words(c, stopped)) for c in chunks]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(chunks)) / (1 + d)) + 1 for t, d in df.items()}

    def vector(c):
        v = {t: n * idf[t] for t, n in c.items() if t in idf}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()} if length else {}

    asked = vector(Counter(words(query, stopped)))
    scores = []
    for i, c in enumerate(counts):
        v = vector(c)
        scores.append((round(sum(x * v.get(t, 0.0) for t, x in asked.items()), 9), i))
    return [(i, round(s, 4)) for s, i in sorted(scores, reverse=True)[:k]]


def test_chunks(spark):
    frame = spark.createDataFrame([(1, RULES), (2, "  \n "), (3, "no heading")], "id int, text string")
    got = rows(retrieval.split_chunks(frame, "id", "text").orderBy("id", "chunk_no"))
    first = [r for r in got if r["id"] == 1]
    assert [r["chunk"].split("\n")[0] for r in first] == [
        "HANDBOOK OF DISPUTE RULES", "POLICY 1: UNKNOWN PAYMENT", "POLICY 2: PARCEL",
        "POLICY 10: MONEY BACK",
    ]
    assert all(r["chunk"] == r["chunk"].strip() for r in got)
    assert [r["chunk"] for r in got if r["id"] != 1] == ["no heading"]


def test_stop_words(spark):
    stopped = english_stop_words()
    tokens = [w for w in stopped if len(w) > 1]
    assert len(stopped) - (len(stopped) - len(tokens)) == len(tokens)
    assert {"amount", "system", "the", "therein"} <= set(stopped)
    assert not {"did", "ought", "just"} & set(stopped)


def test_ranking_equals_brute_force(spark):
    stopped = set(english_stop_words())
    frame = spark.createDataFrame([(1, RULES)], "id int, text string")
    chunks = [r["chunk"] for r in rows(
        retrieval.split_chunks(frame, "id", "text").orderBy("chunk_no"))]
    asked = ["Was the parcel delivery refused?", "refund refund authentication", "zebra", ""]
    hits = retrieval.retrieve(corpus_of(spark, chunks), queries_of(spark, asked), k=3)
    got = {}
    for r in rows(hits.orderBy("query_id", "rank")):
        got.setdefault(r["query_id"] - 100, []).append((r["chunk_id"], r["score"]))
    for i, query in enumerate(asked):
        assert got[i] == brute(chunks, query, stopped, 3)
    assert got[2] == [(3, 0.0), (2, 0.0), (1, 0.0)]


@pytest.mark.parametrize("k", [1, 4, 9])
def test_padding_and_frequent_terms(spark, k):
    """One word in a third of all places, many copies, more hits asked than exist."""
    generator = __import__("random").Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    chunks = [
        " ".join(["common"] * (i % 3 == 0) + generator.choices(vocabulary, k=6)) for i in range(40)
    ] + ["common copy"] * 20
    asked = ["common", "w1 w2 w2 common", "w3 unheard"]
    index = retrieval.build_index(corpus_of(spark, chunks))
    assert "common" in [r[0] for r in index.frequent.collect()]
    hits = retrieval.retrieve(corpus_of(spark, chunks), queries_of(spark, asked), k=k, index=index)
    got = {}
    for r in rows(hits.orderBy("query_id", "rank")):
        got.setdefault(r["query_id"] - 100, []).append((r["chunk_id"], r["score"]))
    stopped = set(english_stop_words())
    assert got == {i: brute(chunks, q, stopped, k) for i, q in enumerate(asked)}


def test_padding_stops_at_the_corpus(spark):
    hits = retrieval.retrieve(
        corpus_of(spark, ["alpha", "beta"]), queries_of(spark, ["alpha"]), k=5
    )
    assert [(r["rank"], r["chunk_id"]) for r in rows(hits.orderBy("rank"))] == [(1, 0), (2, 1)]


def test_least_score_leaves_no_evidence(spark):
    corpus = corpus_of(spark, ["alpha beta", "gamma"])
    queries = queries_of(spark, ["alpha", "delta"])
    hits = retrieval.retrieve(corpus, queries, min_score=0.1)
    assert [r["query_id"] for r in rows(hits)] == [100]
    packed = rows(retrieval.pack_hits(hits, corpus))
    assert packed[0]["policy_evidence"] == [{"policy": "alpha beta", "score": 0.7071}]


def test_whole_texts_count(spark):
    """Terms at the far end of a long text are found."""
    long = " ".join(f"filler{i % 500}" for i in range(20_000)) + " needle"
    hits = retrieval.retrieve(
        corpus_of(spark, ["other words", long]), queries_of(spark, ["needle"]), k=1
    )
    assert rows(hits)[0]["chunk_id"] == 1


def test_index_is_reusable(spark, tmp_path):
    corpus = corpus_of(spark, ["alpha beta", "beta gamma"])
    retrieval.build_index(corpus, folder=str(tmp_path / "index"))
    index = retrieval.load_index(spark, str(tmp_path / "index"))
    assert index.vocabulary.where("term = 'beta'").first()["df"] == 2
    assert abs(index.vocabulary.where("term = 'beta'").first()["idf"] - 1.0) < 1e-12
    scores = retrieval.best_chunks(index, queries_of(spark, ["beta"]))
    assert scores.where(F.col("score").between(0, 1)).count() == 2


def test_counts_leave_the_row(spark, capsys):
    """Terms are counted without a shuffle, whatever texts hold."""
    texts = [None, "", "the of", "b a b b c a", "ONE one two", "x " * 5000 + "yy zz yy"]
    counts = retrieval.term_counts(corpus_of(spark, texts), "chunk_id", "text", ["the", "of"])
    got = {(r["chunk_id"], r["term"]): r["tf"] for r in counts.collect()}
    assert got == {(4, "one"): 2, (4, "two"): 1, (5, "yy"): 2, (5, "zz"): 1}
    words = retrieval.term_counts(corpus_of(spark, ["bb aa bb bb cc aa"]), "chunk_id", "text")
    assert {r["term"]: r["tf"] for r in words.collect()} == {"aa": 2, "bb": 3, "cc": 1}
    counts.explain()
    assert "Exchange" not in capsys.readouterr().out


@pytest.mark.parametrize("shard_size, k", [(3, 2), (5, 3), (1, 1), (1000, 4)])
def test_shards_change_no_ranking(spark, shard_size, k):
    """Exact top k with many ties, repeated chunks, frequent terms and shards that are skipped."""
    generator = __import__("random").Random(shard_size)
    vocabulary = [f"w{i}" for i in range(60)]
    chunks = [" ".join(generator.choices(vocabulary, k=generator.choice([1, 4, 12]))) for _ in range(80)]
    chunks = [c + " common" * (i % 3 == 0) for i, c in enumerate(chunks)] + chunks[:5]
    asked = [" ".join(generator.choices(vocabulary, k=5)) for _ in range(10)] + ["common", "unheard", chunks[7]]
    index = retrieval.build_index(corpus_of(spark, chunks), shard_size=shard_size)
    hits = retrieval.retrieve(corpus_of(spark, chunks), queries_of(spark, asked), k=k, index=index)
    got = {}
    for r in rows(hits.orderBy("query_id", "rank")):
        got.setdefault(r["query_id"] - 100, []).append((r["chunk_id"], r["score"]))
    stopped = set(english_stop_words())
    assert got == {i: brute(chunks, q, stopped, k) for i, q in enumerate(asked)}


def test_bounds_hold_and_skip_shards(spark):
    generator = __import__("random").Random(2)
    chunks = [" ".join(generator.choices([f"w{i}" for i in range(200)], k=8)) for _ in range(300)]
    index = retrieval.build_index(corpus_of(spark, chunks), shard_size=4)
    asked = retrieval.query_weights(index, queries_of(spark, [chunks[3], chunks[90]]))
    bounds = retrieval.shard_bounds(index, asked)
    scores = retrieval.shard_scores(index, index.counts, asked, bounds.select("query_id", "shard"))
    shards = index.norms.select("chunk_id", "shard")
    best = scores.join(shards, "chunk_id").groupBy("query_id", "shard").agg(F.max("score").alias("score"))
    joined = rows(bounds.join(best, ["query_id", "shard"], "full"))
    assert all(r["bound"] >= r["score"] - 1e-12 for r in joined)
    third = {q: sorted((r["score"] for r in rows(scores.where(F.col("query_id") == q))), reverse=True)[2] for q in (100, 101)}
    skipped = sum(r["bound"] < third[r["query_id"]] for r in joined)
    assert skipped > len(joined) / 3


def test_sums_need_no_shuffle_by_query_and_chunk(spark, capsys):
    chunks = [f"w{i % 7} w{i % 5} common" for i in range(50)]
    index = retrieval.build_index(corpus_of(spark, chunks), shard_size=5)
    asked = retrieval.query_weights(index, queries_of(spark, ["w1 common"]))
    pairs = retrieval.shard_bounds(index, asked).select("query_id", "shard")
    with retrieval.shared_partitioning(spark):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            retrieval.shard_scores(index, index.counts, asked, pairs).explain()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [x for x in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not any("chunk_id" in x.split("hashpartitioning")[1].split(")")[0] for x in exchanges)


def test_shuffles_have_more_partitions_for_more_shards(spark, monkeypatch):
    names = (retrieval.INITIAL_PARTITIONS, retrieval.ADVISORY_BYTES)
    before, seen, write = [spark.conf.get(n, None) for n in names], [], retrieval._write
    monkeypatch.setattr(retrieval, "SHARDS_PER_PARTITION", 1)
    monkeypatch.setattr(retrieval, "_write", lambda *given: seen.append([spark.conf.get(n) for n in names]) or write(*given))
    corpus = corpus_of(spark, [f"parcel number{i}" for i in range(20)])
    index = retrieval.build_index(corpus, shard_size=1)
    assert seen and all(s == ["20", str(retrieval.TASK_BYTES)] for s in seen)
    hits = rows(retrieval.retrieve(corpus, queries_of(spark, ["number7"]), k=1, pad=False, index=index))
    assert [h["chunk_id"] for h in hits] == [7]
    assert [spark.conf.get(n, None) for n in names] == before


def test_tasks_that_score_follow_the_shards_not_the_bytes(spark, monkeypatch):
    """All postings are a few kB, which one task would get by their bytes."""
    corpus = corpus_of(spark, [f"common word{i % 7} other{i}" for i in range(200)])
    index = retrieval.build_index(corpus, shard_size=2)
    n_shards = index.norms.agg(F.max("shard")).first()[0] + 1
    monkeypatch.setattr(retrieval, "SHARDS_PER_PARTITION", 4)
    n_tasks = retrieval.scoring_tasks(spark, n_shards)
    assert n_tasks >= n_shards / 4 and retrieval.scoring_tasks(spark, 0) == 1
    asked, seen = retrieval.query_weights(index, queries_of(spark, ["common word3", "other5 common"])), []
    pairs = retrieval.shard_bounds(index, asked).select("query_id", "shard")
    with retrieval.even_tasks(spark, n_shards), retrieval.shared_partitioning(spark):
        for given in (None, n_tasks):
            scored = retrieval.shard_scores(index, index.counts, asked, pairs, given)
            seen.append(rows(scored.withColumn("task", F.spark_partition_id())))
    scores = [{(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in found} for found in seen]
    assert scores[0] == scores[1] and len(scores[0]) == 400
    # some partitions stay empty, as shards are dealt by a hash
    tasks = [len({r["task"] for r in found}) for found in seen]
    assert tasks[1] > n_tasks / 2 and tasks[1] > tasks[0]

    made = []
    whole = retrieval.shard_scores
    monkeypatch.setattr(retrieval, "shard_scores", lambda *a: made.append(a[4:]) or whole(*a))
    retrieval.best_chunks(index, queries_of(spark, ["common word3"]), 3)
    assert made == [(n_tasks,), (n_tasks,)]
