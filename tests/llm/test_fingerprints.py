"""Fingerprints of improbable windows beside a plain version, and the edited texts."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from disputeflow.llm import fingerprints as fp

WORDS = "alpha beta gamma delta of and the quality noise river stone 日本 été - , . 1234".split()


def prose(rng, n):
    return "".join(rng.choice(WORDS) + str(rng.randrange(300)) + rng.choice([" ", " ", "\n", "    "]) for _ in range(n))


def entropy(window):
    logs = sum(int(fp._LOGS[c]) for c in Counter(window).values())
    return (int(fp._LOGS[fp.WINDOW]) - logs) * (fp.BINS - 1) // int(fp._LOGS[fp.WINDOW])


def windows(text):
    return [text[i : i + fp.WINDOW] for i in range(len(text) - fp.WINDOW + 1)]


def plain_features(text, ranks):
    order = [int(ranks[entropy(w)]) for w in windows(text)]
    runs = [order[i : i + fp.RUN] for i in range(len(order) - fp.RUN + 1)]
    points = Counter(i + r.index(min(r)) for i, r in enumerate(runs) if min(r) < fp.NEVER)
    needed = max(1, min(fp.POINTS, len(runs) // 4))
    chosen = [windows(text)[i] for i in sorted(points) if points[i] >= needed]
    if not chosen:
        if len(text) < fp.WINDOW:
            return [hashlib.sha256(text).digest()[:8]] if text else []
        chosen = [windows(text)[order.index(min(order))]]
    return list(dict.fromkeys(chosen))


@pytest.mark.parametrize("piece", [1 << 18, 150, 40])
def test_features_equal_the_plain_version(monkeypatch, piece):
    monkeypatch.setattr(fp, "PIECE", piece)
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([0, 1, 2, 3, 5, 8, 30, 120])).encode() for _ in range(60)]
    texts += [b"a" * 500, b" " * 40 + b"word " * 100, bytes(range(256)) * 2, texts[7]]
    counts = Counter(entropy(w) for t in texts for w in windows(t))
    found = fp.histogram(texts)
    assert found.tolist() == [counts[b] for b in range(fp.BINS)]
    ranks = fp.ranks_of(found)
    for text, hashes in zip(texts, fp.features(texts, ranks)):
        want = plain_features(text, ranks)
        if len(text) >= fp.WINDOW:
            data = np.frombuffer(b"".join(want), np.uint8)
            assert hashes.tolist() == fp._hashes(data, np.arange(len(want)) * fp.WINDOW).tolist()
        else:
            assert [int(h).to_bytes(8, "little") for h in hashes] == want


def test_likeness():
    rng = np.random.default_rng(2)
    n = fp.FEATURES
    many = rng.integers(0, 1 << 63, 8 * n).astype(np.uint64)
    a, b = fp.filters(many[: 4 * n]), fp.filters(many[4 * n :])
    empty = fp.filters(many[:0])
    assert fp.likeness(a, a) == fp.likeness(empty, empty) == 1 and fp.likeness(a, empty) == fp.likeness(empty, a) == 0
    assert fp.likeness(a, b) < 0.1
    half = fp.filters(np.concatenate([many[: 2 * n], many[4 * n : 6 * n]]))
    assert fp.likeness(a, half) == fp.likeness(half, a) and 0.45 < fp.likeness(a, half) < 0.6
    contained = fp.filters(many[n : 2 * n])
    assert fp.likeness(contained, a) == fp.likeness(a, contained) == 1


def test_compared(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.choice([0, 1, 20, 200])) for _ in range(80)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    rows += [(None, "null id " * 9, "x", 1), (100, None, "x", 1), (101, texts[3], "x", 1), (101, texts[3], None, None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, part int").repartition(7)
    found = fp.compared(frame)
    assert found.columns == [n for n, _, _ in fp.FIELDS]
    got = found.collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    own = {}
    for row, following in zip(order, order[1:] + order[:1]):
        text, after = row[1] or "", following[1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        own[row[0]] = text, new, after
    ranks = fp.ranks_of(np.array(fp.rarity(frame)))
    def prints(text):
        return fp.filters(fp.features([text.encode()], ranks)[0])

    assert len(got) == len(rows)
    for r in got:
        text, new, after = own[r["doc_id"]]
        if r["doc_id"] != 101:
            assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            assert base64.b64decode(r["edited_fingerprint"]) == fp.packed(prints(new))
            assert r["near_edited"] == fp.likeness(prints(text), prints(new))
            assert r["near_next"] == fp.likeness(prints(text), prints(after))
        assert r["n_chars"] == len(text)
        assert base64.b64decode(r["fingerprint"]) == fp.packed(prints(text))
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[101]["fingerprint"] == by_id[3]["fingerprint"]


def test_few_documents(spark):
    frame = spark.createDataFrame([(1, "one short text"), (1, "two")], "doc_id bigint, text string")
    assert fp.compared(frame.limit(0)).count() == 0
    single = fp.compared(frame.where("text = 'two'")).collect()
    assert [(r["near_next"], r["edited_sha256"]) for r in single] == [(1.0, hashlib.sha256(b"twt").hexdigest())]
    two = {r["n_chars"]: r["edited_sha256"] for r in fp.compared(frame).collect()}
    assert two[3] == hashlib.sha256(b"two"[:2] + b"o").hexdigest()
