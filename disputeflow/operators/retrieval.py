"""Policy retrieval: TF-IDF weights and cosine top-k as joins and groupings.

A corpus is (chunk_id, text), the questions are (query_id, query).
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from disputeflow import constants as C
from disputeflow.functions.stopwords import english_stop_words
from disputeflow.functions.texts import tokens, trim_space
from disputeflow.operators.skew import add_salt, copy_per_salt, keys_over_share
from disputeflow.session import deleted, shared_folder, stored

#: Chunks of a shard, and the shards of a query that are scored to find its threshold.
SHARD_SIZE, FIRST_SHARDS = 256, 2
#: Shards of a shuffle partition, and the bytes that a task gets: tasks grow in number with the corpus, not in size.
SHARDS_PER_PARTITION, TASK_BYTES = 8, 16 << 20
#: Different terms of all queries that are broadcast; more are not.
BROADCAST_TERMS = 1 << 20
#: Chunks that are hit whose ids are broadcast, likewise.
BROADCAST_CHUNKS = 1 << 20
#: Terms with the most chunks that are broadcast with their idf; the postings of all others are dealt by term.
COMMON_TERMS = 1 << 18
#: Chunks whose lengths are broadcast; those of more are dealt by shard.
BROADCAST_NORMS = 1 << 18
#: Scores are ranked by nine digits.
ROUNDING = 2e-9
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Shuffle files go as soon as the query that wrote them has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def split_chunks(
    documents: DataFrame, key: str, text: str, heading: str = C.POLICY_HEADING
) -> DataFrame:
    """(key, chunk_no, chunk): cut before each line that starts with ``heading``."""
    pieces = F.split(trim_space(F.col(text)), rf"\n(?={heading})", -1)
    return (
        documents.select(key, F.posexplode(F.transform(pieces, trim_space)))
        .where(F.col("col") != "")
        .select(key, F.col("pos").alias("chunk_no"), F.col("col").alias("chunk"))
    )


def term_counts(
    texts: DataFrame, key: str, text: str, stop_words: list[str] | None = None
) -> DataFrame:
    """(key, term, tf) without stop words; ``key`` is unique.

    Counted within the row: equal terms are neighbours once sorted, and the lengths of their
    runs are the counts. So (key, term, tf) leaves the row, and no text is shuffled. ``inline``
    holds the sorted terms as a column, which the lambdas would else sort again for each term.
    """
    stopped = english_stop_words() if stop_words is None else stop_words
    found = texts.select(key, F.inline(F.array(F.struct(F.array_sort(tokens(F.col(text))).alias("sorted")))))
    term = lambda i: F.get("sorted", i)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("sorted") - 1), lambda i: (i == 0) | (term(i) != term(i - 1))
    )
    found = found.where(F.size("sorted") > 0).select(key, "sorted", F.inline(F.array(F.struct(starts.alias("starts")))))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("sorted")))
    runs = F.zip_with("starts", ends, lambda start, end: F.struct(
        term(start).alias("term"), (end - start).cast("bigint").alias("tf")
    ))
    terms = found.select(key, F.inline(runs))
    return terms.where(~F.col("term").isin(stopped)) if stopped else terms


def inverse_frequencies(counts: DataFrame, n: int) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1 for a corpus of ``n`` chunks."""
    return (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1)
    )


@dataclass
class Index:
    """A fitted corpus as stored tables."""

    counts: DataFrame  # shard, chunk_id, term, tf
    vocabulary: DataFrame  # term, df, idf
    frequent: DataFrame  # term, copies; terms with a large share of all counts, so they are few
    norms: DataFrame  # shard, chunk_id, norm
    bounds: DataFrame  # shard, term, most; the largest weight of the term in the shard


def _write(rows: DataFrame, path: str) -> DataFrame:
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def build_index(
    corpus: DataFrame, stop_words: list[str] | None = None, folder: str | None = None, shard_size: int = SHARD_SIZE
) -> Index:
    """Term counts in shards of about ``shard_size`` chunks, idf, lengths and bounds, written to ``folder``.

    Texts are shuffled once, by shard; counts are not. They meet the idf of the ``COMMON_TERMS`` most common terms by a
    broadcast, so that only the postings of rare terms, a small share, are dealt by term.
    """
    folder = folder or shared_folder(corpus.sparkSession, "index")
    n = corpus.count()
    n_shards = max(1, -(-n // shard_size))
    shard = F.pmod(F.xxhash64("chunk_id"), F.lit(n_shards)).cast("int")
    with even_tasks(corpus.sparkSession, n_shards):
        return _built(corpus, shard, n, stop_words, folder)


def _built(corpus: DataFrame, shard: Column, n: int, stop_words: list[str] | None, folder: str) -> Index:
    # the texts are as uneven as their files, of which one may be a single task's
    dealt = corpus.select("chunk_id", "text").repartition(shard)
    counts = _write(term_counts(dealt, "chunk_id", "text", stop_words).withColumn("shard", shard), f"{folder}/counts")
    vocabulary = _write(inverse_frequencies(counts, n), f"{folder}/vocabulary")
    frequent = _write(keys_over_share(vocabulary, "term", "df"), f"{folder}/frequent")
    least = common_from(vocabulary)
    weight = F.col("tf") * F.col("idf")
    squares = _with_idf(counts, vocabulary, least).select("shard", "chunk_id", (weight * weight).alias("square"))
    length = F.sqrt(F.sum("square"))
    norms = _write(squares.groupBy("shard", "chunk_id").agg(length.alias("norm")), f"{folder}/norms")
    few = n <= BROADCAST_NORMS
    with shared_partitioning(corpus.sparkSession):
        known = F.broadcast(norms) if few else norms.repartition("shard")
        met = (counts if few else counts.repartition("shard")).join(known, ["shard", "chunk_id"])
        most = met.groupBy("shard", "term").agg(F.max(F.col("tf") / F.col("norm")).alias("share"))
        most = _with_idf(most, vocabulary, least).select("shard", "term", (F.col("share") * F.col("idf")).alias("most"))
        return Index(counts, vocabulary, frequent, norms, _write(most, f"{folder}/bounds"))


def common_from(vocabulary: DataFrame) -> int:
    """The least power of two such that at most ``COMMON_TERMS`` terms are in so many chunks."""
    bits = F.length(F.bin("df"))
    sizes = {r["bits"]: r["n"] for r in vocabulary.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, 1 << max(sizes, default=0)
    for size in sorted(sizes, reverse=True):
        total += sizes[size]
        if total > COMMON_TERMS:
            break
        least = 1 << (size - 1)
    return least


def _with_idf(rows: DataFrame, vocabulary: DataFrame, least: int) -> DataFrame:
    """``rows`` with the idf of their term. Of terms in fewer than ``least`` chunks no one has many rows."""
    idf = vocabulary.select("term", "idf")
    common, rare = (F.broadcast(idf.where(F.col("df") >= least)), idf.where(F.col("df") < least))
    others = rows.join(F.broadcast(idf.where(F.col("df") >= least).select("term")), "term", "left_anti")
    return rows.join(common, "term").unionByName(others.join(rare, "term"))


def load_index(spark: SparkSession, folder: str) -> Index:
    names = ("counts", "vocabulary", "frequent", "norms", "bounds")
    return Index(*[spark.read.parquet(f"{folder}/{name}") for name in names])


def query_weights(
    index: Index, queries: DataFrame, stop_words: list[str] | None = None
) -> DataFrame:
    """(query_id, term, idf, weight) of unit length over terms the corpus knows."""
    counts = term_counts(queries, "query_id", "query", stop_words)
    known = counts.join(index.vocabulary.select("term", "idf"), "term").select(
        "query_id", "term", "idf", (F.col("tf") * F.col("idf")).alias("weight")
    )
    length = F.sqrt(
        F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("query_id"))
    )
    return known.withColumn("weight", F.col("weight") / length)


def shard_bounds(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, shard, bound) for shards with a term of the query: no chunk there scores more."""
    salted = copy_per_salt(asked, "term", index.frequent)
    met = add_salt(index.bounds, "term", index.frequent, F.col("shard")).join(salted, ["term", "_salt"])
    return met.groupBy("query_id", "shard").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shared_partitioning(spark: SparkSession):
    """Joins on (shard, term) may use a partitioning by the shard alone, which the sums then keep."""
    return _set(spark, {CO_PARTITION: "false"})


def even_tasks(spark: SparkSession, n_shards: int):
    """Shuffles have as many partitions as the shards ask for, joined up to ``TASK_BYTES`` a task."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_shards // SHARDS_PER_PARTITION))
    return _set(spark, {INITIAL_PARTITIONS: str(parts), ADVISORY_BYTES: str(TASK_BYTES), SHUFFLES_GO: "true"})


def asked_postings(index: Index, asked: DataFrame) -> DataFrame:
    """The counts of terms that are asked for, where these are few enough to be sent to all tasks."""
    terms = asked.select("term").distinct()
    if terms.count() > BROADCAST_TERMS:
        return index.counts
    return index.counts.join(F.broadcast(terms), "term", "left_semi")


def scoring_tasks(spark: SparkSession, n_shards: int) -> int:
    """Tasks that score: no more than ``SHARDS_PER_PARTITION`` shards each, and as many as there are cores if shards allow."""
    return max(-(-n_shards // SHARDS_PER_PARTITION), min(n_shards, spark.sparkContext.defaultParallelism), 1)


def shard_scores(
    index: Index, postings: DataFrame, asked: DataFrame, pairs: DataFrame, n_tasks: int | None = None
) -> DataFrame:
    """(query_id, chunk_id, score) of the chunks in the given (query_id, shard) pairs.

    The terms of a query, which carry their idf, go to its shards, where the counts are: all
    sides are dealt by shard, and a chunk has all its terms there, so the sums by query and chunk
    need no further shuffle. A task has a sum for each chunk of its shards and query, many times
    its postings, so partitions are ``n_tasks`` as asked for and not joined by their bytes.
    """
    by_shard = [F.col("shard")] if n_tasks is None else [n_tasks, F.col("shard")]
    product = (F.col("weight") * F.col("idf")).alias("asked")
    dealt = pairs.join(asked.select("query_id", "term", product), "query_id").repartition(*by_shard)
    met = postings.repartition(*by_shard).join(dealt, ["shard", "term"])
    dots = met.groupBy("shard", "query_id", "chunk_id").agg(F.sum(F.col("tf") * F.col("asked")).alias("dot"))
    scored = dots.join(index.norms.repartition(*by_shard), ["shard", "chunk_id"])
    return scored.select("query_id", "chunk_id", (F.col("dot") / F.col("norm")).alias("score"))


def best_chunks(index: Index, queries: DataFrame, k: int = C.TOP_K, stop_words: list[str] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): exactly the best k of all chunks that share a term.

    Each query is first scored in the ``FIRST_SHARDS`` shards with its highest bounds. Its kth
    best score there is a threshold, and only shards whose bound reaches it are scored as well
    (max-score); a query with fewer than k hits so far has none. Bounds are sums of products like
    the scores, so a small allowance covers their rounding.
    """
    last = index.norms.agg(F.max("shard")).first()[0]
    n_shards = 0 if last is None else last + 1
    with even_tasks(index.counts.sparkSession, n_shards):
        return _best_chunks(index, queries, k, stop_words, n_shards)


def _best_chunks(index: Index, queries: DataFrame, k: int, stop_words: list[str] | None, n_shards: int) -> DataFrame:
    spark = index.counts.sparkSession
    n_tasks = scoring_tasks(spark, n_shards)
    folder = shared_folder(spark, "retrieval")
    asked = _write(query_weights(index, queries, stop_words), f"{folder}/query-weights")
    postings = asked_postings(index, asked)
    bounds = _write(shard_bounds(index, asked), f"{folder}/shard-bounds")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "shard")
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST_SHARDS)
    first = _write(first.select("query_id", "shard"), f"{folder}/first-shards")
    with shared_partitioning(spark):
        opening = top_k(shard_scores(index, _of_shards(postings, first), asked, first, n_tasks), k)
        opening = _write(opening, f"{folder}/first-hits")
        least = opening.where(F.col("rank") == k).select("query_id", (F.col("score") - ROUNDING).alias("least"))
        left = bounds.join(first, ["query_id", "shard"], "left_anti").join(least, "query_id", "left")
        reach = left.where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query_id", "shard")
        reach = _write(reach, f"{folder}/other-shards")
        rest = top_k(shard_scores(index, _of_shards(postings, reach), asked, reach, n_tasks), k)
        hits = stored(top_k(opening.unionByName(rest).drop("rank"), k), "hits")
    deleted(spark, folder)
    return hits


def _of_shards(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Postings of the shards in ``pairs``; a shard stands for hundreds of chunks, so that all may be broadcast."""
    return postings.join(F.broadcast(pairs.select("shard").distinct()), "shard", "left_semi")


def top_k(scores: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Best k chunks per query; the higher chunk_id on a tie.

    Spark keeps k rows per query and input partition before the shuffle
    (WindowGroupLimit), so one popular query cannot flood a task.
    """
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("score", 9)), F.desc("chunk_id")
    )
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pad_hits(
    hits: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = C.TOP_K
) -> DataFrame:
    """Fill up to k hits per query with zero-score chunks, highest chunk_id first.

    At most k chunks are taken already, so the 2k highest chunk_ids are enough: no
    pairing of queries with the whole corpus.
    """
    highest = corpus.select("chunk_id").orderBy(F.desc("chunk_id")).limit(2 * k)
    spare = highest.agg(F.sort_array(F.collect_list("chunk_id"), asc=False).alias("ids")).scalar()
    found = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("found")
    )
    kind = found.schema["found"].dataType.simpleString()
    listed = (
        queries.select("query_id")
        .join(found, "query_id", "left")
        .withColumns({"found": F.coalesce("found", F.array().cast(kind)), "spare": spare})
    )
    count = F.size("found")
    unused = F.array_except("spare", F.transform("found", lambda h: h["chunk_id"]))
    extra = F.transform(
        F.slice(unused, F.lit(1), F.lit(k) - count),
        lambda chunk, i: F.struct(
            (count + i + 1).cast("int").alias("rank"),
            chunk.alias("chunk_id"),
            F.lit(0.0).alias("score"),
        ),
    )
    return listed.select("query_id", F.inline(F.concat("found", extra)))


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = C.TOP_K,
    pad: bool = True,
    min_score: float | None = None,
    stop_words: list[str] | None = None,
    index: Index | None = None,
) -> DataFrame:
    """(query_id, rank, chunk_id, score) with the score rounded to 4 digits.

    pad=True always returns k hits, with score 0 where nothing matches;
    min_score drops weaker hits, so that missing evidence can be noticed.
    """
    folder = None if index else shared_folder(corpus.sparkSession, "index")
    hits = best_chunks(index or build_index(corpus, stop_words, folder), queries, k, stop_words)
    if folder:
        deleted(corpus.sparkSession, folder)
    if pad:
        hits = pad_hits(hits, queries, corpus, k)
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    return hits.select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"))


def pack_hits(hits: DataFrame, corpus: DataFrame, text: str = "text") -> DataFrame:
    """One row per query with its ranked list of {policy, score}; k is small.

    Only texts that are hit are shuffled: their ids, if few enough, go to the corpus first.
    """
    policies = corpus.select("chunk_id", F.col(text).alias("policy"))
    wanted = hits.select("chunk_id").distinct()
    if wanted.count() <= BROADCAST_CHUNKS:
        policies = policies.join(F.broadcast(wanted), "chunk_id", "left_semi")
    named = hits.join(policies, "chunk_id")
    listed = F.sort_array(F.collect_list(F.struct("rank", "policy", "score")))
    return named.groupBy("query_id").agg(
        F.transform(listed, lambda h: F.struct(h["policy"], h["score"])).alias("policy_evidence")
    )
