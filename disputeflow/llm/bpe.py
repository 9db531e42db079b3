"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, and decoding.

A pre-token is a linked list of byte ranges. For each merge rank a bucket holds the list
positions whose pair merges to that rank. Bits tell which buckets are filled, and bits above
them which words have a bit, so the next rank is found by two find-first-set steps however
many ranks there are. A position is not taken out of its bucket when its pair changes: it is
stale and skipped when it comes up. Positions of one rank come leftmost first. The work is
O(n log n) in the length of a pre-token, so a text without a break costs little more. The bucket
of a short pre-token is a set of positions in the bits of a number, taken out at once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from public_tokenizers import PATTERN, path

from disputeflow.llm.frames import raw

#: A vocabulary file above this size is refused, since every task holds its ranks.
VOCABULARY_BYTES = 64 << 20
#: Remembered pre-tokens of one task (twice as many at most), the longest in characters, and how
#: many of them a worker keeps for its next task.
REMEMBERED, REMEMBERED_CHARS, KEPT = 1 << 19, 64, 1 << 18
#: Characters of a text that are split into pre-tokens at once.
PIECE = 1 << 20
#: Ranks in a word of the lower bitmap, as a power of two; one word of the upper one has the rest.
WORD = 8
#: Bytes of a pre-token whose positions fit a number.
SHORT = 62
#: PATTERN as the standard library knows it, for texts of ASCII alone.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
BATCH_BYTES = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        data = file.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Encoder(dict):
    """Pre-token to its token ids, packed as little-endian unsigned 32-bit integers.

    As a dict it remembers short pre-tokens, ``remembered`` of them (twice as many at most). When full it
    forgets those not asked for since it was full before, which changes no id.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int | None = None) -> None:
        super().__init__()
        self.ranks = ranks
        self.remembered = remembered or REMEMBERED
        self.earlier: dict[str, bytes] = {}
        self.longest = max(map(len, ranks), default=0)
        self.buckets: dict[int, list[int]] = {}
        words = (max(ranks.values(), default=0) >> WORD) + 1
        self.low = [0] * words
        #: The positions of each rank in a short pre-token, the word of its bit, and the bits themselves.
        self.spots = [0] * (words << WORD)
        self.word = [w for w in range(words) for _ in range(1 << WORD)]
        self.bit = [1 << r for r in range(1 << WORD)] * words
        self.top = [1 << i for i in range(max(words, SHORT))]
        #: The rank of each pair of bytes, -1 where they do not merge.
        self.pairs = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.split = regex.compile(pattern)
        self.ascii = re.compile(ASCII_PATTERN, re.ASCII) if pattern == PATTERN else self.split
        # a cut before white space that follows something else parts no pre-token
        self.cut = regex.compile(r"\S(?=\s)")

    def __missing__(self, token: str) -> bytes:
        found = self.earlier.get(token) or self.merge(token.encode())
        if len(token) <= REMEMBERED_CHARS:
            if len(self) >= self.remembered:
                self.earlier = dict(self)
                self.clear()
            self[token] = found
        return found

    def merge(self, token: bytes) -> bytes:
        whole = self.packed.get(token)
        if whole is not None:
            return whole
        if len(token) <= SHORT:
            return self.merge_short(token)
        rank_of, longest, buckets, low, pairs = self.ranks.get, self.longest, self.buckets, self.low, self.pairs
        n, high, live = len(token), 0, 0
        after, before = list(range(1, n + 1)), list(range(-1, n))
        mask = (1 << WORD) - 1
        pair = [pairs[a << 8 | b] for a, b in zip(token, token[1:])]
        for position, rank in enumerate(pair):
            if rank >= 0:
                live += 1
                if rank in buckets:
                    buckets[rank].append(position)
                else:
                    buckets[rank] = [position]
                    low[rank >> WORD] |= 1 << (rank & mask)
                    high |= 1 << (rank >> WORD)
        pair.append(-1)
        while live:
            word = (high & -high).bit_length() - 1
            bits = low[word]
            first = bits & -bits
            rank = (word << WORD) + first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                position = heappop(bucket)
            else:
                position = bucket[0]
                del buckets[rank]
                low[word] = bits = bits ^ first
                if not bits:
                    high ^= 1 << word
            if pair[position] != rank:
                continue
            gone = after[position]
            after[position] = end = after[gone]
            before[end] = position
            live -= 1
            pair[position] = -1
            if pair[gone] >= 0:
                live -= 1
                pair[gone] = -1
            if end < n and after[end] - position <= longest:
                new = rank_of(token[position : after[end]])
                if new is not None:
                    live += 1
                    pair[position] = new
                    if new in buckets:
                        heappush(buckets[new], position)
                    else:
                        buckets[new] = [position]
                        low[new >> WORD] |= 1 << (new & mask)
                        high |= 1 << (new >> WORD)
            if position:
                place = before[position]
                new = rank_of(token[place:end]) if end - place <= longest else None
                old = pair[place]
                if new is None:
                    if old >= 0:
                        live -= 1
                        pair[place] = -1
                elif new != old:
                    live += old < 0
                    pair[place] = new
                    if new in buckets:
                        heappush(buckets[new], place)
                    else:
                        buckets[new] = [place]
                        low[new >> WORD] |= 1 << (new & mask)
                        high |= 1 << (new >> WORD)
        for rank in buckets:  # what is left is stale
            low[rank >> WORD] = 0
        buckets.clear()
        return self.parts(token, after)

    def merge_short(self, token: bytes) -> bytes:
        """As ``merge``; a changed pair leaves its bucket at once, so that bits are left for live pairs alone."""
        rank_of, low, pairs, spots, word, bit, top = self.ranks.get, self.low, self.pairs, self.spots, self.word, self.bit, self.top
        n, high = len(token), 0
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [pairs[a << 8 | b] for a, b in zip(token, token[1:])]
        for at, rank in zip(top, pair):
            if rank >= 0:
                held = spots[rank]
                if not held:
                    low[word[rank]] |= bit[rank]
                    high |= top[word[rank]]
                spots[rank] = held | at
        pair.append(-1)
        while high:
            w = (high & -high).bit_length() - 1
            bits = low[w]
            first = bits & -bits
            rank = (w << WORD) + first.bit_length() - 1
            held = spots[rank]
            at = held & -held
            spots[rank] = held = held ^ at
            if not held:
                low[w] = bits = bits ^ first
                if not bits:
                    high ^= top[w]
            position = at.bit_length() - 1
            gone = after[position]
            after[position] = end = after[gone]
            before[end] = position
            pair[position] = -1
            old = pair[gone]
            if old >= 0:
                spots[old] = held = spots[old] ^ top[gone]
                if not held:
                    w = word[old]
                    low[w] = bits = low[w] ^ bit[old]
                    if not bits:
                        high ^= top[w]
            if end < n:
                new = rank_of(token[position : after[end]])
                if new is not None:
                    pair[position] = new
                    held = spots[new]
                    if not held:
                        low[word[new]] |= bit[new]
                        high |= top[word[new]]
                    spots[new] = held | at
            if position:
                place = before[position]
                new = rank_of(token[place:end], -1)
                old = pair[place]
                if new != old:
                    pair[place] = new
                    at = top[place]
                    if old >= 0:
                        spots[old] = held = spots[old] ^ at
                        if not held:
                            w = word[old]
                            low[w] = bits = low[w] ^ bit[old]
                            if not bits:
                                high ^= top[w]
                    if new >= 0:
                        held = spots[new]
                        if not held:
                            low[word[new]] |= bit[new]
                            high |= top[word[new]]
                        spots[new] = held | at
        return self.parts(token, after)

    def parts(self, token: bytes, after: list[int]) -> bytes:
        out, position, packed = [], 0, self.packed
        while position < len(token):
            end = after[position]
            out.append(packed[token[position:end]])
            position = end
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        split = self.ascii if text.isascii() else self.split
        return b"".join([b"".join(map(self.__getitem__, split.findall(piece))) for piece in self.pieces(text)])

    def rest(self) -> None:
        """Forgets all but the first pre-tokens, among which the frequent ones are: the worker lives
        on after a task, and with it what its encoder holds."""
        first = dict(islice(self.items(), self.remembered * KEPT // REMEMBERED))
        self.clear()
        self.update(first)
        self.earlier = {}

    def pieces(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > PIECE:
            found = self.cut.search(text, start + PIECE)
            if not found:
                break
            yield text[start : found.end()]
            start = found.end()
        yield text[start:]


_HELD: dict[str, Encoder] = {}


def held_encoder(key: str, ranks: dict[bytes, int], pattern: str, remembered: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary, with what it remembers from earlier tasks."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(ranks, pattern, remembered)
    return _HELD[key]


class Decoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = {rank: token for token, rank in ranks.items()}

    def decode(self, ids: bytes) -> bytes:
        parts = []
        for start in range(0, len(ids), 4 * PIECE):
            numbers = memoryview(ids)[start : start + 4 * PIECE].cast("I")
            parts.append(b"".join(map(self.tokens.__getitem__, numbers.tolist())))
        return b"".join(parts)


def _extended(
    docs: DataFrame, source, fields: list[tuple[str, pa.DataType]], make, prepare
) -> DataFrame:
    """``docs`` with computed columns, which replace columns of the same names."""
    kept = [c for c in docs.columns if c not in {name for name, _ in fields}]
    inner = docs.select(*(docs[c] for c in kept), source.alias("input of the codec"))
    kinds = {pa.int64(): LongType(), pa.binary(): BinaryType()}
    schema = StructType(
        [docs.schema[c] for c in kept] + [StructField(name, kinds[kind]) for name, kind in fields]
    )

    def extend(found):
        work = prepare()
        for batch in found:
            start = 0
            while start < batch.num_rows:
                made, size, end = [], 0, start
                while end < batch.num_rows and size < BATCH_BYTES:
                    row = make(work, batch.column(len(kept))[end].as_buffer())
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                    made.append(row)
                    end += 1
                old = batch.slice(start, end - start)
                new = [pa.array(column, kind) for column, (_, kind) in zip(zip(*made), fields)]
                names = kept + [name for name, _ in fields]
                yield pa.RecordBatch.from_arrays([*old.columns[: len(kept)], *new], names)
                start = end
        if isinstance(work, Encoder):
            work.rest()

    return inner.mapInArrow(extend, schema)


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, text: str = "text", remembered: int | None = None
) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_ids`` (packed little-endian 32-bit integers).

    ``pattern`` splits a text into pre-tokens, each of which is merged by itself; special
    tokens are ordinary text. Null and empty texts have no tokens. Very long texts are split
    in pieces at white space. Rows stay as they are, with repeated ones; columns named like
    the new ones are replaced; an empty table stays empty. ``remembered`` pre-tokens (twice as many at
    most) take a worker's memory, a part of them between tasks too; fewer take more time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    listed = b"".join(len(t).to_bytes(4, "little") + t + r.to_bytes(4, "little") for t, r in sorted(ranks.items()))
    key = f"{hashlib.sha256(listed + pattern.encode()).hexdigest()}-{remembered}"

    def make(encoder: Encoder, value) -> tuple[int, bytes]:
        ids = encoder.encode(value.to_pybytes().decode())
        return len(ids) // 4, ids

    fields = [("n_tokens", pa.int64()), ("token_ids", pa.binary())]
    return _extended(docs, raw(text), fields, make, lambda: held_encoder(key, shared.value, pattern, remembered))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its token ids; null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    return _extended(
        encoded,
        F.coalesce(F.col(ids), F.lit(b"")),
        [("decoded", pa.binary())],
        lambda decoder, value: (decoder.decode(value.to_pybytes()),),
        lambda: Decoder(shared.value),
    )


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, int]:
    """The ranks of an installed public vocabulary."""
    return read_ranks(path(name))
