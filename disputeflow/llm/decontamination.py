"""Benchmark decontamination with an FM-index for each shard of documents.

Tasks number the words of their documents by the benchmark's vocabulary. A word that no
benchmark item has breaks every phrase, so a shard's index holds only the stretches between
such words that are as long as the shortest phrase; that loses no occurrence. All phrases are
searched backwards at once, their occurrences located, and their spans merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from disputeflow.llm import hashing
from disputeflow.llm.fm_index import LOCATED_AT_ONCE, FMIndex
from disputeflow.llm.frames import batches, raw, rows

WINDOW = 13
#: Words of a shard, and kept words of an index.
SHARD_WORDS = 2_000_000
#: Benchmark text that is broadcast at once; a larger benchmark is searched part by part.
BLOCK_BYTES = 16 << 20
#: A document is contaminated if at least 1 in SHARE of its words is hit.
SHARE = 20

_WORD = set(b"abcdefghijklmnopqrstuvwxyz0123456789")
LETTERS = bytes(b if b in _WORD or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int64()), ("n_words", pa.int64()),
     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]
)
DDL = "doc_id bigint, part bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class Vocabulary(dict):
    """Word to its number from 2; other words have 1, which ends every phrase."""

    def __missing__(self, word: bytes) -> int:
        return 1


@dataclass
class Phrases:
    """Distinct windows of benchmark items, as rows of word numbers, and the items of each."""

    vocabulary: Vocabulary
    numbers: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, benchmark: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases:
        vocabulary, found = Vocabulary(), {}
        for item, text in benchmark:
            numbers = tuple(vocabulary.setdefault(w, len(vocabulary) + 2) for w in words(text))
            width = min(window, len(numbers))
            for start in range(len(numbers) - width + 1 if numbers else 0):
                found.setdefault(numbers[start : start + width], set()).add(item)
        lengths = np.array([len(p) for p in found], np.int64)
        table = np.zeros((len(found), int(lengths.max(initial=0))), np.int64)
        for row, phrase in zip(table, found):
            row[: len(phrase)] = phrase
        return cls(vocabulary, table, lengths, [sorted(x) for x in found.values()])


def shard_hits(numbers: list[np.ndarray], phrases: Phrases) -> list[tuple[list, list]]:
    """For each document of a shard, its merged spans and its items."""
    out: list[tuple[list, list]] = [([], []) for _ in numbers]
    if not len(phrases.lengths):
        return out
    # documents one after another, each followed by a break
    text = np.concatenate([np.append(n, 1) for n in numbers])
    doc_start = np.concatenate(([0], np.cumsum([len(n) + 1 for n in numbers])))
    breaks = np.flatnonzero(text == 1)
    begin = np.concatenate(([0], breaks[:-1] + 1))
    long = breaks - begin >= phrases.lengths.min()
    begin, size = begin[long], (breaks - begin)[long] + 1  # with its break
    if not len(begin):
        return out
    new_begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    kept = np.arange(size.sum()) + np.repeat(begin - new_begin, size)
    index = FMIndex(text[kept], len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.numbers, phrases.lengths)
    count = high - low
    ends = np.cumsum(count)
    found: dict[int, tuple[list, set]] = {}
    first = 0
    while first < len(count):  # phrases by groups, so that few occurrences are held at once
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LOCATED_AT_ONCE, "right")))
        some = count[first:last]
        which = np.repeat(np.arange(first, last), some)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some)
        for start in range(0, len(which), LOCATED_AT_ONCE):
            cut = slice(start, start + LOCATED_AT_ONCE)
            place = kept[index.locate(low[which[cut]] + offset[cut])]
            doc = np.searchsorted(doc_start, place, "right") - 1
            order = np.lexsort((place, doc))
            doc, at, phrase = doc[order], (place - doc_start[doc])[order], which[cut][order]
            bounds = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
            for a, b in zip(bounds[:-1], bounds[1:]):
                spans, items = found.setdefault(int(doc[a]), ([], set()))
                spans += _union(at[a:b], at[a:b] + phrases.lengths[phrase[a:b]])
                for p in np.unique(phrase[a:b]):
                    items.update(phrases.items[p])
        first = last
    for doc, (spans, items) in found.items():
        pairs = np.array(sorted(spans), np.int64)
        out[doc] = ([{"start": s, "end": e} for s, e in _union(pairs[:, 0], pairs[:, 1])], sorted(items))
    return out


def _union(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans, sorted by start, as one."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:] - 1, len(start) - 1)
    return list(zip(start[firsts].tolist(), reach[lasts].tolist()))


def _block_hits(docs: DataFrame, phrases: Phrases) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def find(found):
        phrases = shared.value
        look = phrases.vocabulary.__getitem__

        def each():
            keys, numbers, size = [], [], 0
            for doc_id, part, text in rows(found):
                parts = [np.fromiter(map(look, w), np.int32, len(w)) for w in map(words, hashing.pieces(text))]
                numbers.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
                keys.append((doc_id, part))
                size += len(numbers[-1])
                if size >= SHARD_WORDS:
                    yield from finished(keys, numbers)
                    keys, numbers, size = [], [], 0
            if keys:
                yield from finished(keys, numbers)

        def finished(keys, numbers):
            for key, n, hit in zip(keys, numbers, shard_hits(numbers, phrases)):
                yield *key, len(n), *hit

        return batches(each(), SCHEMA)

    slim = docs.select(F.col("doc_id").cast("bigint"), F.crc32(raw("text")).alias("part"), raw("text").alias("text"))
    return slim.mapInArrow(find, DDL)


def _merged(spans: Column) -> Column:
    def add(done: Column, new: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], new["end"]).alias("end"))
        return F.when(
            F.coalesce(last["end"] >= new["start"], F.lit(False)),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer)),
        ).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, part, n_words, spans, items)``: merged removal spans (in words) and the items
    that occur, for each row of ``docs``.

    Null and empty texts have no words and no hits; items without words or without an id are
    left out. ``part`` (crc32 of the text) tells apart rows that share a doc_id. The benchmark
    goes to the tasks in parts of about ``block_bytes``, whatever its size; one part is the
    usual case, and of several the results are merged by document.
    """
    known = benchmark.select(F.col("item_id").cast("string").alias("item"), raw("text").alias("text")).where(
        "item is not null and octet_length(text) > 0"
    )
    size = known.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(n_blocks):
        own = known.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block)
        phrases = Phrases.of([(r["item"], bytes(r["text"])) for r in own.collect()], window)
        rows_ = _block_hits(docs, phrases)
        found = rows_ if found is None else found.unionByName(rows_)
    if n_blocks == 1:
        return found
    every = found.groupBy("doc_id", "part").agg(
        (F.count(F.lit(1)) / n_blocks).cast("int").alias("copies"), F.max("n_words").alias("n_words"),
        _merged(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of ``hits`` with the verdict, a row for each row of ``docs``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    counted = hits(docs, benchmark).select(
        "doc_id", "part", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "spans",
    )
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; the others stay as they are."""
    bad = judged(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("bad id"), F.col("part").alias("bad part")
    ).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("bad id")) & (F.crc32(raw(docs["text"])) == F.col("bad part"))
    return docs.join(bad, same, "left_anti")
