"""Aligns the tokens of two tokenizers, and counts over the corpus which ids go together.

Both encode the same bytes, so each gives an ascending list of byte offsets at which its tokens
end. The shorter list is driven through the longer: from where the last found end lies, steps
double until they pass the wanted offset, and a binary search settles the rest. Offsets in
both lists cut the tokens into groups; the differences of neighbouring ranks in each list say which
tokens of either side are in a group, that is overlap there.

The ids of a text do not change when it is encoded in parts that end before a space, if no
token has a space after something else. Parts are therefore encoded once and remembered, as many
as fit; offsets are compared over whole texts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from public_tokenizers import path
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from disputeflow.llm.frames import kept, raw, scratch, staged

#: Parts of texts remembered by a worker (twice as many at most), and the longest in characters.
REMEMBERED, REMEMBERED_CHARS = 1 << 18, 48
#: Rows and bytes of text aligned at once; one text is never cut.
ROWS, BYTES = 128, 1 << 18
#: Links expanded at once; the links of one id of the first tokenizer may be more.
LINKS = 1 << 21
#: Ends looked for at once by galloping steps.
DRIVERS = 1024
#: Pairs whose counts are broadcast; beyond that they are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
ID_BITS = 24

#: A space after a letter, digit or ASCII punctuation, which is never within a token.
CUT = re.compile(r"(?<=[\w!-/:-@\[-`{-~])(?= )")
BEFORE_CUT = re.compile(r"[\w!-/:-@\[-`{-~]\Z")


def _byte_of() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and remembered parts of texts."""

    def __init__(self, a_file: str, b_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_file)
        self.space = self.b.piece_to_id("▁")
        byte_of = _byte_of()
        special = set(self.a.get_added_tokens_decoder())
        size = self.a.get_vocab_size()
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [n.encode() if i in special else bytes(byte_of[c] for c in n) for i, n in enumerate(names)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.cut = CUT if not any(b" " in t.lstrip(b" ") for t in self.b_bytes) else re.compile("(?!)")
        self.a_lengths = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(t) for t in self.b_bytes], np.int64)
        self.shown = [b"%d%s" % (i, end) for i in range(size) for end in (b",", b"|")]
        self.shown += [b"%d%s" % (i, end) for i in range(len(pieces)) for end in (b",", b";")]
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.earlier: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.unlike: set[str] = set()  # parts whose tokens do not give back their bytes

    def learn(self, parts: list[str]) -> None:
        """Encodes ``parts``, each with its leading space; those that may stand together at once."""
        together = [part for part in parts if BEFORE_CUT.search(part)] if self.cut is CUT else []
        if together and not self.at_once(together):
            together = []
        alone = [part for part in parts if not together or part not in self.known[0]]
        a_found = [e.ids for e in self.a.encode_batch_fast(alone, add_special_tokens=False)]
        b_found = self.b.encode([part[1:] for part in alone], num_threads=1)
        for part, a, b in zip(alone, a_found, b_found):
            # the model adds no space to an empty text; a space alone is a part at the end of a text
            both = a, b or [self.space]
            for known, ids, data in zip(self.known, both, (self.a_bytes, self.b_bytes)):
                known[part] = np.array(ids, np.int32).tobytes()
                if b"".join(map(data.__getitem__, ids)) != part.encode():
                    self.unlike.add(part)

    def at_once(self, parts: list[str]) -> bool:
        """Encodes parts as one text, cut again where they end; false if bytes differ."""
        joined = "".join(parts)
        ends = np.cumsum([len(part.encode()) for part in parts])
        a = self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids
        b = self.b.encode(joined[1:], num_threads=1)
        found = []
        for ids, data, lengths in ((a, self.a_bytes, self.a_lengths), (b, self.b_bytes, self.b_lengths)):
            if b"".join(map(data.__getitem__, ids)) != joined.encode():
                return False
            ids = np.array(ids, np.int32)
            at = np.cumsum(lengths[ids])
            stops = np.searchsorted(at, ends) + 1
            if (at[stops - 1] != ends).any():
                return False
            packed, stops = ids.tobytes(), (4 * stops).tolist()
            found.append([packed[i:j] for i, j in zip([0, *stops], stops)])
        for known, each in zip(self.known, found):
            known.update(zip(parts, each))
        return True

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Packed ids of each text by both tokenizers; None where there are none."""
        if len(self.known[0]) > REMEMBERED:
            self.earlier, self.known = self.known, ({}, {})
        split = [self.cut.split(" " + text) if text else [] for text in texts]
        a_known, b_known = self.known
        missing = set(chain.from_iterable(split)).difference(a_known)
        again = missing.intersection(self.earlier[0])
        for known, earlier in zip(self.known, self.earlier):
            known.update((part, earlier[part]) for part in again)
        new = list(missing.difference(again))
        for start in range(0, len(new), 4096):
            self.learn(new[start : start + 4096])
        out = [
            (b"".join(map(a_known.__getitem__, parts)), b"".join(map(b_known.__getitem__, parts)))
            if parts and (not self.unlike or self.unlike.isdisjoint(parts)) else None
            for parts in split
        ]
        # what is too long or unlike is not remembered, so that nothing forgotten is taken for like
        for part in new:
            if len(part) > REMEMBERED_CHARS or part in self.unlike:
                del a_known[part], b_known[part]
        self.unlike.clear()
        return out


@lru_cache(maxsize=1)
def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    """Loaded once by a worker, whose later tasks find what it remembers."""
    return Tokenizers(a_file, b_file)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranks in ``a`` and in ``b``, both ascending, of the numbers that both have."""
    if len(b) < len(a):
        other, own = common_ends(b, a)
        return own, other
    start, last = 0, len(b) - 1
    mine, theirs = [], []
    for first in range(0, len(a), DRIVERS):
        wanted = a[first : first + DRIVERS]
        low, high = np.full(len(wanted), start), np.full(len(wanted), last)
        step, left = 1, 0  # the drivers before ``left`` know where to stop
        while left < len(wanted):
            probe = min(start + step - 1, last)
            passed = left + int(np.count_nonzero(wanted[left:] <= b[probe]))
            high[left:passed] = probe
            left = passed
            if probe == last:
                break
            low[left:] = probe + 1
            step *= 2
        while (low < high).any():
            middle = (low + high) >> 1
            less = b[middle] < wanted
            low = np.where(less, np.minimum(middle + 1, high), low)
            high = np.where(less, high, middle)
        same = b[low] == wanted
        mine.append(np.flatnonzero(same) + first)
        theirs.append(low[same])
        start = int(low[-1])
    return (np.concatenate(mine), np.concatenate(theirs)) if mine else (np.empty(0, np.int64),) * 2


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``starts[i] .. starts[i] + sizes[i]``, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def linked(a: np.ndarray, b: np.ndarray, group: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct id pairs of linked tokens of one text and how many links each has, in slices.

    ``group`` is the group of each token in ``a``; a group's tokens in ``b`` begin at ``b_start``.
    Each slice has other ids of the first tokenizer. One has at most ``LINKS`` links, or those of one
    id with each of its groups.
    """
    entry, times = np.unique(a.astype(np.int64) << 32 | group, return_counts=True)
    ids, where = entry >> 32, entry & ((1 << 32) - 1)
    ends = np.cumsum(b_size[where])
    start = 0
    while start < len(ids):
        base = ends[start - 1] if start else 0
        end = int(np.searchsorted(ends, base + LINKS, "right"))
        if end < len(ids):  # an id is not parted
            end = max(int(np.searchsorted(ids, ids[end], "left")), int(np.searchsorted(ids, ids[start], "right")))
        sizes = b_size[where[start:end]]
        pairs = np.repeat(ids[start:end], sizes) << ID_BITS | b[_spread(b_start[where[start:end]], sizes)]
        weights = np.repeat(times[start:end], sizes)
        order = np.argsort(pairs, kind="stable")
        pairs, weights = pairs[order], weights[order]
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        yield pairs[first], np.add.reduceat(weights, first)
        start = end


class Aligned:
    """Groups of the tokens of several texts, laid end to end."""

    def __init__(self, both: Tokenizers, found: list[tuple[bytes, bytes]]) -> None:
        self.a = np.frombuffer(b"".join(a for a, _ in found), np.int32)
        self.b = np.frombuffer(b"".join(b for _, b in found), np.int32)
        self.a_texts = np.cumsum([0, *(len(a) // 4 for a, _ in found)])
        self.b_texts = np.cumsum([0, *(len(b) // 4 for _, b in found)])
        at_a, at_b = common_ends(np.cumsum(both.a_lengths[self.a]), np.cumsum(both.b_lengths[self.b]))
        self.a_start, self.b_start = np.concatenate(([0], at_a + 1)), np.concatenate(([0], at_b + 1))
        self.a_size, self.b_size = np.diff(self.a_start), np.diff(self.b_start)
        self.group = np.repeat(np.arange(len(at_a)), self.a_size)
        # a text's last tokens end together, so that its groups end there too
        self.group_texts = np.searchsorted(self.a_start, self.a_texts)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        self.codes = np.empty(len(self.a) + len(self.b), np.int64)
        self.codes[np.arange(len(self.a)) + self.b_start[self.group]] = 2 * self.a + last_a
        b_group = np.repeat(np.arange(len(at_b)), self.b_size)
        self.codes[np.arange(len(self.b)) + self.a_start[b_group + 1]] = 2 * (len(both.a_bytes) + self.b) + last_b
        self.shown = both.shown.__getitem__

    def row(self, k: int) -> tuple[int, int, int, int, str]:
        """``n_a, n_b, n_groups, n_links, groups_sha256`` of text ``k``."""
        a0, a1, b0, b1 = *self.a_texts[k : k + 2], *self.b_texts[k : k + 2]
        g0, g1 = self.group_texts[k : k + 2]
        links = int(self.a_size[g0:g1] @ self.b_size[g0:g1])
        digest = hashlib.sha256()
        codes = self.codes[a0 + b0 : a1 + b1]
        for start in range(0, len(codes), 1 << 18):
            text = b"".join(map(self.shown, codes[start : start + (1 << 18)].tolist()))
            digest.update(text[:-1] if start + (1 << 18) >= len(codes) else text)
        return int(a1 - a0), int(b1 - b0), int(g1 - g0), links, digest.hexdigest()

    def pairs(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a0, a1 = self.a_texts[k : k + 2]
        g0, g1 = self.group_texts[k : k + 2]
        return linked(self.a[a0:a1], self.b, self.group[a0:a1] - g0, self.b_start[g0:g1], self.b_size[g0:g1])


SCHEMA = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))]
)
DDL = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
       "pairs array<bigint>, links array<bigint>")


def _batch(rows: list[tuple], lists: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)]
    ends = pa.array(np.cumsum([0, *(len(p) for p, _ in lists)]), pa.int32())
    for side in (0, 1):
        values = np.concatenate([np.empty(0, np.int64), *(x[side] for x in lists)])
        columns.append(pa.ListArray.from_arrays(ends, pa.array(values, pa.int64())))
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def _alike(both: Tokenizers, ids: list, texts: list[str], numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
    """Rows of texts with their pairs; a text of many pairs has further rows without counts."""
    found = both.encode(texts)
    aligned = Aligned(both, [x for x in found if x is not None])
    none = np.empty(0, np.int64)
    rows, lists, size, k = [], [], 0, 0
    for doc, pair in zip(ids, found):
        number = next(numbers)
        if pair is None:
            rows.append((number, doc, 0, 0, 0, 0, ""))
            lists.append((none, none))
            continue
        head = (number, doc, *aligned.row(k))
        for part in aligned.pairs(k):
            rows.append(head)
            lists.append(part)
            size += len(part[0])
            head = (number, *[None] * 6)
            if size > LINKS:
                yield _batch(rows, lists)
                rows, lists, size = [], [], 0
        k += 1
    if rows:
        yield _batch(rows, lists)


def aligned(
    docs: DataFrame,
    a_file: str = path("byte_bpe_50k.json"),
    b_file: str = path("piece_bpe_32k.model"),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of each document.

    ``a_file`` is a byte-level vocabulary, which encodes a space and the text, ``b_file`` a model
    that adds the space itself; strings of special tokens are plain text. Tokens of both sides in
    one group are linked. The count of an id pair is the number of documents in which it is linked;
    ``count_sum`` adds the counts of a document's links, and ``n_best`` is how many links have the
    highest count of their first id. ``groups_sha256`` is the digest of the groups, such as
    ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and those whose tokens do not give back a space and the text, have no
    tokens: zeros and an empty digest. Repeated rows are documents of their own; null ids stay
    null. Other columns are not read; an empty table gives no rows.
    """
    def align(found):
        both = tokenizers(a_file, b_file)
        task = TaskContext.get().partitionId() << 40
        numbers = iter(range(task, task + (1 << 40)))
        for batch in found:
            ids, texts, size = [], [], 0
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_buffer()
                if ids and (len(ids) >= ROWS or size + data.size > BYTES):
                    yield from _alike(both, ids, texts, numbers)
                    ids, texts, size = [], [], 0
                ids.append(batch.column(0)[k].as_py())
                texts.append(data.to_pybytes().decode())
                size += data.size
            if ids:
                yield from _alike(both, ids, texts, numbers)

    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw(text).alias("text"))
    with scratch(docs.sparkSession):
        found = staged(plain.mapInArrow(align, DDL), "aligned")
        counts = staged(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "counts")
        first = F.shiftright("pair", ID_BITS).alias("a")
        most = counts.groupBy(first).agg(F.max("n").alias("most"))
        marked = counts.select("pair", "n", first).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
        marked = staged(marked, "pairs")
        if marked.count() <= BROADCAST_PAIRS:
            marked = F.broadcast(marked)
        every = found.select("row", F.inline(F.arrays_zip("pairs", "links")).alias("pair", "times"))
        sums = every.join(marked, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        )
        heads = found.where("n_a is not null").drop("pairs", "links")
        whole = heads.join(sums, "row", "left")
        zero = F.lit(0).cast("bigint")
        return kept(
            whole.select(
                "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
            ),
            "alignment",
        )
