"""Repeated passages by a sparse suffix array.

Of all suffixes only those at content-selected positions are kept: the positions of the
smallest hash of SEED words in each window of WORDS words (minimisers). Equal windows select
equal positions, so every repeated window has its suffix in the array. Rows are sorted by
ranges and neighbours compared in three steps, each on what the step before has left:

1. suffixes by their first SEED words: those without an equal neighbour cannot be repeated;
2. suffixes extended left and right to all that their windows reach: equal neighbours make
   the whole reach a repeat, and only the first place of each reach is looked at further;
3. the rest window by window: each of the WORDS words around a suffix that select it.

What is sorted and compared are hashes of words (128 bits from step 2 on), not the words. The last
step looks at every window since the neighbour with the longest common extension to the right may
differ to the left, where another suffix of the same seed agrees: extending matches of
neighbours alone would lose repeats.

A word is removable if it lies in a window of WORDS words that occurs earlier, in the order
of doc_id and position. Words are runs of other than ASCII white space.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from disputeflow.llm import hashing
from disputeflow.llm.frames import kept, raw, rows, scratch, staged
from disputeflow.llm.runs import NO_ID, PLACE, runs

WORDS = 50
SEED = 10


def part(text: str = "text") -> Column:
    """Tells apart texts of rows that share a doc_id."""
    return (F.crc32(raw(text)) - (1 << 31)).cast("int")


def document(key: str = "doc_id") -> Column:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID))


def minimisers(seeds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are the (leftmost) smallest of some ``width`` neighbours, and for each
    the first of the windows that select it."""
    count = len(seeds) - width + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    best = np.arange(len(seeds))
    span = 1
    while span < width:  # the smallest of span neighbours becomes that of twice as many
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(seeds[right] < seeds[left], right, left)
        span += step
    starts = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    return best[starts], starts


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def suffixes(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """``(seed, reach_a, reach_b, doc, part, at, span)``: one row for each kept suffix.

    ``at`` is the first window that selects the suffix and ``span`` the number of words from
    there to the end of the last such window; the reach is hashed to 128 bits.
    """
    names = ["seed", "reach_a", "reach_b", "doc", "part", "at", "span"]
    types = [pa.int64()] * 4 + [pa.int32()] * 3
    schema = pa.schema(list(zip(names, types)))

    def find(found):
        for doc, part_, text in rows(found):
            hashes = hashing.word_hashes(text)
            if len(hashes) < words:
                continue
            seeds = hashing.window_hashes(hashes, seed)
            chosen, first = minimisers(seeds, words - seed + 1)
            ends = np.append(first[1:] - 1, len(hashes) - words) + words
            reach = [_signed(_ranges(hashes, first, ends, base)) for base in hashing.BASES]
            n = len(first)
            yield pa.record_batch(
                [pa.array(_signed(seeds[chosen])), pa.array(reach[0]), pa.array(reach[1]), pa.array(np.full(n, doc)),
                 pa.array(np.full(n, part_, np.int32)), pa.array(first.astype(np.int32)), pa.array((ends - first).astype(np.int32))],
                schema=schema,
            )

    def joined(found):
        held, n = [], 0
        for batch in find(found):
            held.append(batch)
            n += batch.num_rows
            if n > 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    slim = docs.select(document().alias("doc"), part().alias("part"), raw("text").alias("text"))
    return slim.mapInArrow(joined, "seed bigint, reach_a bigint, reach_b bigint, doc bigint, part int, at int, span int")


def _ranges(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the word ranges, as ``window_hashes`` would give for their widths."""
    power = hashing.powers(base, len(hashes))
    down = hashing.powers(pow(base, -1, 1 << 64), len(hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power, dtype=np.uint64)))
    return hashing.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(docs: DataFrame, reaches: DataFrame, words: int) -> DataFrame:
    """``(a, b, doc, part, at)``: the 128-bit hash of each window within ``reaches``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc", pa.int64()), ("part", pa.int32()), ("at", pa.int32())])

    def find(found):
        for doc, part_, spans, text in rows(found):
            hashes = hashing.word_hashes(text)
            keys = [_signed(hashing.window_hashes(hashes, words, base)) for base in hashing.BASES]
            at = np.unique(np.concatenate([np.arange(s["at"], s["at"] + s["span"] - words + 1) for s in spans]))
            n = len(at)
            yield pa.record_batch(
                [pa.array(keys[0][at]), pa.array(keys[1][at]), pa.array(np.full(n, doc)), pa.array(np.full(n, part_, np.int32)),
                 pa.array(at.astype(np.int32))],
                schema=schema,
            )

    of_text = reaches.groupBy("doc", "part").agg(F.collect_list(F.struct("at", "span")).alias("spans"))
    slim = docs.select(document().alias("doc"), part().alias("part"), raw("text").alias("text"))
    with_text = of_text.join(slim, ["doc", "part"]).select("doc", "part", "spans", "text")
    return with_text.mapInArrow(find, "a bigint, b bigint, doc bigint, part int, at int")


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans of one text as one: ``(doc, part, spans of (start, end, first_doc))``.

    ``first_doc`` is the document of the earliest place that a part of the span repeats.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct("start", "end", "first_doc")))
    empty = F.array().cast("array<struct<start:int,end:int,first_doc:bigint>>")

    def add(done: Column, new: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], new["end"]).alias("end"),
            F.least(last["first_doc"], new["first_doc"]).alias("first_doc"),
        )
        joins = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1)) >= new["start"])
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(new))
        )

    return spans.groupBy("doc", "part").agg(F.aggregate(sorted_, empty, add).alias("spans"))


def repeated_spans(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``(doc, part, spans)`` for each text with removable words.

    Null and empty texts, and texts of fewer than ``words`` words, have none. Rows repeated as
    they are count as one document. Only doc_id and text are read.
    """
    with scratch(docs.sparkSession):
        return kept(_repeated_spans(docs, words, seed), "repeated-spans")


def _repeated_spans(docs: DataFrame, words: int, seed: int) -> DataFrame:
    chosen = staged(suffixes(docs, words, seed), "suffixes")
    same_seed = runs(chosen, ["seed"], ["span"]).select("seed", *PLACE).distinct()
    reach = chosen.join(same_seed, ["seed", *PLACE], "left_semi")
    known = staged(runs(staged(reach, "reaches"), ["reach_a", "reach_b"], ["span"], singles=True, earliest=True), "reaches")
    whole = known.where("again").select(
        "doc", "part", F.col("at").alias("start"), (F.col("at") + F.col("span")).cast("int").alias("end"), "first_doc"
    )
    rest = staged(windows(docs, known.where("not again").select(*PLACE, "span").distinct(), words), "windows")
    single = runs(rest, ["a", "b"], earliest=True).where("again").select(
        "doc", "part", F.col("at").alias("start"), (F.col("at") + words).cast("int").alias("end"), "first_doc"
    )
    return merged(whole.unionByName(single))


def repeats(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, start, end, n_words, first_doc_id)``: a row for each removable span of words.

    ``start`` and ``end`` count the text's words from 0; ``first_doc_id`` holds the earliest
    place of what is repeated. An empty table gives no rows.
    """
    found = repeated_spans(docs, words, seed).select("doc", F.inline("spans"))
    number = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(
        number("doc").alias("doc_id"), "start", "end", (F.col("end") - F.col("start")).alias("n_words"),
        number("first_doc").alias("first_doc_id"),
    )


def cut(text: bytes, spans: list[dict]) -> bytes:
    """``text`` without the words of ``spans`` and the white space that follows each span."""
    out, done, count, inside, at = [], 0, 0, False, 0
    ends = iter(spans)
    span = next(ends, None)
    for word in re.finditer(rb"[^\x20\x09-\x0D]+", text):
        if span is not None and count == span["end"]:
            done, inside = word.start(), False
            span = next(ends, None)
        if span is not None and count == span["start"]:
            out.append(text[done : word.start()])
            inside = True
        count += 1
        at = word.end()
    if not inside:
        out.append(text[done:])
    else:
        out.append(text[at:])
    return b"".join(out)


def without_repeats(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` with each repeated passage cut from all but its first place.

    Texts without removable words stay as they are, nulls too; a text that is all repeat
    becomes empty. ``n_chars``, if there, follows the text. Rows repeated as they are stay.
    """
    found = repeated_spans(docs, words, seed).withColumnsRenamed({"doc": "repeat doc", "part": "repeat part", "spans": "repeat spans"})
    same = (document() == F.col("repeat doc")) & (part() == F.col("repeat part"))
    joined = docs.join(found, same, "left").select(
        *(docs[c] for c in docs.columns if c != "text"), docs["text"], F.col("repeat spans").alias("repeat spans")
    )
    names = [c for c in docs.columns if c != "text"]
    schema = joined.drop("repeat spans").schema

    def apply(parts):
        for batch in parts:
            texts, spans = batch.column(len(names)), batch.column(len(names) + 1)
            made = [
                t.as_py() if not s.is_valid else cut(t.as_py().encode(), s.as_py()).decode() for t, s in zip(texts, spans)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(made, pa.string())], [*names, "text"])

    cut_ = joined.mapInArrow(apply, schema)
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else None
    return cut_.select(*(length.alias(c) if c == "n_chars" else c for c in docs.columns))
