"""Aligned tokens beside whole texts encoded by the libraries and compared token by token."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path

from disputeflow.llm import tokenizer_alignment as ta

FILES = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
PARTS = [
    "the", "a", "quality", "été", "日本語", "Straße", "1234", "!", ",", ".", " ", "  ", "\n", "\t", " \n ", " ", "▁", "　",
    "é", "<|endoftext|>", "<s>", "'s", "=====", "\x1f", "\x85", "🙂", "naïve-", "_", "ﬁ", "᠎", "​",
]


def whole(text):
    """Groups of (ids of A, ids of B) of a whole text, or none."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    both = ta.tokenizers(*FILES)
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids if text else [], both.b.encode(text) if text else []
    data = (" " + text).encode()
    if not text or b"".join(both.a_bytes[i] for i in a) != data or b"".join(both.b_bytes[i] for i in b) != data:
        return []
    groups, mine, theirs, at_a, at_b, k = [], [], [], 0, 0, 0
    for i in a:
        at_a += len(both.a_bytes[i])
        mine.append(i)
        while at_b < at_a:
            at_b += len(both.b_bytes[b[k]])
            theirs.append(b[k])
            k += 1
        if at_a == at_b:
            groups.append((mine, theirs))
            mine, theirs = [], []
    return groups


def brute(rows):
    links = [Counter((x, y) for mine, theirs in whole(text or "") for x in mine for y in theirs) for _, text in rows]
    count = Counter(pair for found in links for pair in found)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (doc, text), found in zip(rows, links):
        groups = whole(text or "")
        shown = ";".join(",".join(map(str, m)) + "|" + ",".join(map(str, t)) for m, t in groups)
        out.append((
            doc, sum(len(m) for m, _ in groups), sum(len(t) for _, t in groups), len(groups), sum(found.values()),
            sum(n for pair, n in found.items() if count[pair] == most[pair[0]]), sum(n * count[pair] for pair, n in found.items()),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


def mixed(rng, n):
    return "".join(rng.choice(PARTS) + rng.choice(["", " ", " "]) for _ in range(n))


@pytest.mark.parametrize("drivers, links, at_once", [(1024, 1 << 21, 128), (3, 5, 2)])
def test_equals_brute_force(spark, monkeypatch, drivers, links, at_once):
    monkeypatch.setattr(ta, "LINKS", links)
    monkeypatch.setattr(ta, "ROWS", at_once)
    rng = random.Random(drivers)
    rows = [(k, mixed(rng, rng.choice([1, 2, 5, 30, 100]))) for k in range(150)]
    rows += [(None, "null id"), (200, None), (201, ""), (202, " "), (203, rows[3][1]), (203, rows[3][1]), (204, "x" * 3000), (205, "日" * 900 + " end")]
    frame = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id bigint, text string, row int, pairs string")
    found = ta.aligned(frame)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = brute(rows)
    assert got == want
    assert any(r[1] == 0 for r in want) and sum(r[1] > 0 for r in want) > 80
    assert ta.aligned(frame.limit(0)).count() == 0


def test_pairs_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(k, "the same words again " * (k + 1)) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(ta, "BROADCAST_PAIRS", 0)
    assert sorted((tuple(r) for r in ta.aligned(frame).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("drivers", [1, 7, 1024])
def test_common_ends(monkeypatch, drivers):
    monkeypatch.setattr(ta, "DRIVERS", drivers)
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
        b = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
        for x, y in ((a, b), (b, a)):
            mine, theirs = ta.common_ends(x, y)
            both = np.intersect1d(x, y, return_indices=True)
            assert (mine == both[1]).all() and (theirs == both[2]).all()


def test_parts_encode_as_the_whole():
    """Remembered parts give the ids of whole texts, also when parts are forgotten."""
    rng = random.Random(6)
    both = ta.Tokenizers(*FILES)
    texts = [mixed(rng, 40) for _ in range(300)]
    for text in texts + texts[:20]:
        (found,) = both.encode([text])
        groups = whole(text)
        if not groups:
            assert found is None
        else:
            a, b = (np.frombuffer(x, np.int32).tolist() for x in found)
            assert a == [i for m, _ in groups for i in m] and b == [i for _, t in groups for i in t]
        if len(both.known[0]) > 200:
            both.earlier, both.known = both.known, ({}, {})
