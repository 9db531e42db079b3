"""Fingerprints of documents from their improbable byte windows.

The entropy of every window of ``WINDOW`` bytes is found by sliding: the byte that leaves and the
one that enters change it by what their counts say. Windows are ranked by how rare their entropy
is among all windows of the corpus. In each run of ``RUN`` neighbouring windows the rarest
gets a point, and windows of ``POINTS`` points are the text's features. Their hashes go into
Bloom filters, a new one chained on when the last has ``FEATURES``. Two fingerprints are alike as
far as the filters of the smaller one have their set bits in some filter of the other, less
what chance gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from disputeflow.llm.frames import batches, kept, raw, rows
from disputeflow.llm.hashing import mix

WINDOW, RUN, POINTS = 16, 32, 8
#: Entropies are told apart in thousandths of the largest; windows below LEAST are no features.
BINS, LEAST = 1001, 100
NEVER = 1023
#: A filter's bits, the bits of a feature, and the features of a filter.
BITS, HASHES, FEATURES = 2048, 5, 160
#: Common bits count as chance up to so many standard deviations above their expected number.
NOISE = 2.0
#: Bytes whose windows are ranked at once; a longer text is taken in pieces.
PIECE = 1 << 18

_SCALE = 1 << 16
_LOGS = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int32)
_STEP = np.diff(_LOGS)


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy of each window of ``data``, in thousandths of the largest possible."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int32)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    sums = np.empty(n - WINDOW + 1, np.int32)
    sums[0] = _STEP[before[:WINDOW]].sum()
    sums[1:] = _STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]]
    np.cumsum(sums, out=sums)
    whole = int(_LOGS[WINDOW])
    return ((whole - sums.astype(np.int64)) * (BINS - 1) // whole).astype(np.int32)


def _pieces(texts: list[bytes], margin: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Buffers of about PIECE bytes with their parts: (text, start in the buffer, in the text, length).

    A text longer than that comes in parts that overlap by ``margin`` bytes.
    """
    held, parts, size = [], [], 0
    for number, text in enumerate(texts):
        for start in range(0, max(1, len(text) - margin), PIECE):
            part = text[start : start + PIECE + margin]
            if size and size + len(part) > PIECE + margin:
                yield np.frombuffer(b"".join(held), np.uint8), parts
                held, parts, size = [], [], 0
            held.append(part)
            parts.append((number, size, start, len(part)))
            size += len(part)
    if parts:
        yield np.frombuffer(b"".join(held), np.uint8), parts


def histogram(texts: list[bytes]) -> np.ndarray:
    """How many windows of ``texts`` have each entropy."""
    counts = np.zeros(BINS, np.int64)
    for data, parts in _pieces(texts, WINDOW - 1):
        found = entropies(data)
        inside = np.zeros(len(found), bool)
        for _, at, _, size in parts:
            inside[at : at + max(0, size - WINDOW + 1)] = True
        counts += np.bincount(found[inside], minlength=BINS)
    return counts


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy: the rarest first, of equally rare ones the lower."""
    ranks = np.empty(BINS, np.int32)
    ranks[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS)
    ranks[:LEAST] = NEVER
    return ranks


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].view("<u8")
    total = np.zeros(len(at), np.uint64)
    for column in words.T:
        total = mix((total ^ column) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return total


def _one(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "little")


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """For each text the hashes of its features in order, each once."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    margin = 2 * RUN + WINDOW - 3  # what points given left of a window, and right of it, rest on
    for data, parts in _pieces(texts, margin):
        order = ranks[entropies(data)]
        for _, at, _, size in parts:  # windows across two texts are never the rarest
            order[max(0, at + size - WINDOW + 1) : at + size] = NEVER
        best, width = (order << 20) | np.arange(len(order), dtype=np.int32), 1
        while width < RUN <= len(order):
            best = np.minimum(best[: len(best) - width], best[width:])
            width *= 2
        points = np.zeros(len(data), np.int32)
        spans = []
        for number, at, start, size in parts:
            windows = size - WINDOW + 1
            runs = windows - RUN + 1
            if runs > 0:
                spans.append(best[at : at + runs])
        if spans:
            winners = np.concatenate(spans)
            winners = winners[winners >> 20 < NEVER] & ((1 << 20) - 1)
            points[: len(order)] = np.bincount(winners, minlength=len(order))[: len(order)]
        for number, at, start, size in parts:
            runs = size - WINDOW + 1 - RUN + 1
            if runs <= 0:
                continue
            whole = len(texts[number]) - WINDOW + 1 - RUN + 1
            needed = max(1, min(POINTS, whole // 4))
            # a window's points are known where all runs with it are in this part
            first = 0 if not start else RUN - 1
            last = size - WINDOW + 1 if start + size == len(texts[number]) else runs
            chosen = np.flatnonzero(points[at + first : at + last] >= needed) + at + first
            if len(chosen):
                found[number].append(_hashes(data, chosen))
    out = []
    for text, hashes in zip(texts, found):
        if not hashes:
            out.append(np.array(_fallback(text, ranks), np.uint64))
            continue
        every = np.concatenate(hashes) if len(hashes) > 1 else hashes[0]
        _, first = np.unique(every, return_index=True)
        out.append(every[np.sort(first)])
    return out


def _fallback(text: bytes, ranks: np.ndarray) -> list[int]:
    """Of a text without features: the first of its rarest windows, or the whole of a short text."""
    if len(text) < WINDOW:
        return [_one(text)] if text else []
    best = None
    for data, parts in _pieces([text], WINDOW - 1):
        order = ranks[entropies(data)]
        at = int(order.argmin())
        if best is None or order[at] < best[0]:
            best = int(order[at]), int(_hashes(data, np.array([at]))[0])
    return [best[1]]


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chained Bloom filters of the features, ``(filter, bit)``."""
    bits = np.zeros((-(-len(hashes) // FEATURES), BITS), bool)
    number = np.arange(len(hashes)) // FEATURES
    for k in range(HASHES):
        bits[number, (hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = True
    return bits


def packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits, axis=1).tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the overlap of the smaller fingerprint's filters with their best ones in the other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if (len(a), int(a.sum()), a.tobytes()) > (len(b), int(b.sum()), b.tobytes()):
        a, b = b, a
    total = weight = 0.0
    theirs = b.astype(np.float32)
    sizes = b.sum(1)
    for start in range(0, len(a), 512):
        some = a[start : start + 512]
        mine = some.sum(1)
        best = np.zeros(len(some))
        for first in range(0, len(b), 512):
            common = some.astype(np.float32) @ theirs[first : first + 512].T
            chance = np.outer(mine, sizes[first : first + 512]) / BITS
            most = np.minimum(mine[:, None], sizes[None, first : first + 512])
            none = np.minimum(chance + NOISE * np.sqrt(chance), most - 1)
            best = np.maximum(best, ((common - none) / (most - none)).max(1))
        total += float(best @ mine)
        weight += float(mine.sum())
    return total / weight


def rarity(docs: DataFrame, text: str = "text") -> list[int]:
    """How many windows of all texts have each entropy: ``BINS`` numbers, whatever the data."""
    def count(found):
        def counted():
            total = np.zeros(BINS, np.int64)
            for batch in found:
                for part in _slices(batch):
                    total += histogram([value for (value,) in rows([part])])
            yield from ((b, int(n)) for b, n in enumerate(total) if n)

        return batches(counted(), pa.schema([("bin", pa.int32()), ("n", pa.int64())]))

    bins = docs.select(raw(text).alias("text")).mapInArrow(count, "bin int, n bigint")
    known = {r["bin"]: r["n"] for r in bins.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    return [known.get(b, 0) for b in range(BINS)]


def _slices(batch: pa.RecordBatch, size: int = 64) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, and of about a piece of text in their last column."""
    ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        begun = ends[start - 1] if start else 0
        end = min(start + size, max(start + 1, int(np.searchsorted(ends, begun + PIECE, "right"))), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def edited(text: str, following: str) -> str:
    """``text`` whose second half gives way to as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = [
    ("doc_id", pa.int64(), "bigint"), ("n_chars", pa.int64(), "bigint"), ("edited_sha256", pa.string(), "string"),
    ("fingerprint", pa.binary(), "binary"), ("edited_fingerprint", pa.binary(), "binary"),
    ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"),
]


def _rows(ids: list, texts: list[bytes], ranks: np.ndarray) -> Iterator[tuple]:
    """The result of each text but the last, which only follows the one before it."""
    plain = [t.decode() for t in texts]
    changed = [edited(a, b).encode() for a, b in zip(plain, plain[1:])]
    prints = [filters(h) for h in features([*texts, *changed], ranks)]
    for k, new in enumerate(changed):
        own, other = prints[k], prints[len(texts) + k]
        yield (
            ids[k], len(plain[k]), hashlib.sha256(new).hexdigest(), packed(own), packed(other),
            likeness(own, other), likeness(own, prints[k + 1]),
        )


DONE, FIRST, LAST = 0, 1, 2


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: list[int] | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they are.

    A document's edited text has its second half replaced by the beginning of the next document
    in order of id, then of a hash of the text; the last is followed by the first. Columns:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    ``counts`` are those of ``rarity``, by default of these documents; fingerprints made with the
    same counts can be compared.

    Null texts count as empty and have the empty fingerprint, which is like itself alone; a null
    id comes first and stays null. Repeated rows are documents of their own. Texts shorter than a
    window are one feature, and a text without any has its rarest window. A single document
    follows itself; an empty table gives no rows. Other columns are not read.
    """
    ranks = ranks_of(np.array(rarity(docs, text) if counts is None else counts, np.int64))
    edges = pa.schema([*((n, t) for n, t, _ in FIELDS), ("part", pa.int32()), ("kind", pa.int32()), ("text", pa.binary())])
    ddl = ", ".join(f"{n} {s}" for n, _, s in FIELDS)

    def pairs(found):
        def made():
            ids, texts, part, opened = [], [], None, False
            for batch in found:
                for piece in _slices(batch):
                    for number, doc, value in rows([piece]):
                        part = number
                        ids.append(doc)
                        texts.append(value)
                        if not opened:
                            opened = True
                            yield (*[None] * len(FIELDS), part, FIRST, value)
                    for row in _rows(ids, texts, ranks):
                        yield (*row, part, DONE, None)
                    ids, texts = ids[-1:], texts[-1:]
            if texts:
                yield (ids[0], *[None] * (len(FIELDS) - 1), part, LAST, texts[0])

        return batches(made(), edges, 256)

    def closing(found):
        def made():
            for batch in found:
                for doc, mine, following in rows([batch]):
                    yield from _rows([doc, None], [mine, following], ranks)

        return batches(made(), pa.schema([(n, t) for n, t, _ in FIELDS]), 16)

    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw(text).alias("text"))
    dealt = plain.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    found = kept(dealt.mapInArrow(pairs, f"{ddl}, part int, kind int, text binary"), "fingerprints")
    # a partition's last document is followed by the first of the next partition that has any:
    # two rows a partition
    first = found.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("following"))
    turn = Window.orderBy("next")
    link = first.select("next", F.lag("next").over(turn).alias("part"))
    link = link.select("next", F.coalesce("part", F.max("next").over(Window.partitionBy())).alias("part"))
    last = found.where(F.col("kind") == LAST).select("part", "doc_id", "text")
    open_ = last.join(link, "part").join(first, "next").select("doc_id", "text", "following")
    done = found.where(F.col("kind") == DONE).select(*(n for n, _, _ in FIELDS))
    every = done.unionByName(open_.mapInArrow(closing, ddl))
    return every.withColumns({name: F.base64(name) for name in ("fingerprint", "edited_fingerprint")})
