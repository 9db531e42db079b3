"""Near duplicates, repeated passages and fuzzy passages against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from disputeflow.llm import chaining, hashing, near_dedup, suffix_dedup
from disputeflow.llm.runs import runs

DOCS = "doc_id bigint, text string"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text, width):
    words = words_of(text)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[i:] for i in range(width))))


def brute_components(docs, width):
    sets = {i: shingle_set(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        common = len(x & y)
        if x and y and 100 * common >= 80 * (len(x) + len(y) - common):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    docs = []
    for base in range(12):
        words = [rng.choice(common) if rng.random() < 0.5 else f"b{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 9, 14, 40, 120, 300]))]
        docs.append(words)
        for _ in range(rng.randrange(8)):
            docs.append(edited(rng, words, rng.randrange(1 + len(words) // 10)))
        docs.append(list(words))
    rng.shuffle(docs)
    return [(i, (" " if i % 3 else "\n").join(w).upper() if i % 5 == 0 else " ".join(w)) for i, w in enumerate(docs)] + [
        (1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, "one two"),
    ]


@pytest.mark.parametrize("seed,width", [(1, 2), (2, 5)])
def test_components_equal_brute_force(spark, seed, width):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS), width).collect()}
    assert got == brute_components(docs, width)


def test_large_group_is_settled_in_blocks(spark, monkeypatch):
    """Copies that are alike in part only: the centre does not reach all of them."""
    rng = random.Random(3)
    words = [f"t{i}" for i in range(200)]
    docs = [(i, " ".join(edited(rng, words, rng.randrange(5, 22)))) for i in range(60)]
    monkeypatch.setattr(near_dedup, "BLOCK", 900)
    monkeypatch.setattr(near_dedup, "SKETCH_BLOCK", 300)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS), 2).collect()}
    assert got == {i: c for i, (_, c, _) in brute_components(docs, 2).items()}


def test_copies_that_meet_under_unlike_centres_only(spark):
    """Each list that two near copies share has another, heavier, unlike centre."""
    value = lambda word: int(hashing.shingles(hashing.word_hashes(word.encode()), 1)[0])
    fresh = sorted((f"w{i}" for i in range(40_000)), key=value)
    x, tail = fresh[:6_400:80], fresh[-67:]
    y = x[:12] + [fresh[961]] + x[13:30] + [fresh[2401]] + x[31:47] + [fresh[3761]] + x[48:]
    # the smallest values of the others are one run of x, and their tails make them heavier
    docs = [x, y] + [x[i : i + 3] + tail for i in range(len(x) - 2)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 1).collect()}
    assert got == {i: c for i, (_, c, _) in brute_components(rows, 1).items()}
    assert got[1] == 0


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words here now"), (None, "a b c d"), (None, None), (2, None)]
    frame = spark.createDataFrame([(*r, "x", 9) for r in rows], DOCS + ", node string, kept int")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"])
                 for r in near_dedup.near_duplicates(frame, 2).collect())
    assert got == [(0, 0, 0, True), (0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (1, 3, 1, True), (2, 0, 2, True)]
    empty = spark.createDataFrame([], DOCS)
    assert near_dedup.near_duplicates(empty, 2).count() == 0
    kept = near_dedup.one_of_each(frame, 2)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [
        (0, ""), (1, "a b c d"), (1, "other words here now"), (2, "")
    ]
    assert near_dedup.one_of_each(empty, 2).count() == 0


def repeated_words(docs, width):
    """Word places of every window that occurs earlier, in the order of id and place."""
    first, out = set(), {}
    for doc, text in sorted(docs):
        words = (text or "").split()
        for at in range(len(words) - width + 1):
            window = tuple(words[at : at + width])
            if window in first:
                out.setdefault(doc, set()).update(range(at, at + width))
            first.add(window)
    return out


def test_one_of_each_keeps_clashing_columns(spark):
    rows = [(1, "same words here", "x", "c"), (2, "same words here", "y", "d"), (3, "", "z", "e")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, chosen_text string, Text_key string")
    found = near_dedup.one_of_each(frame)
    assert found.columns == frame.columns
    assert sorted((r["doc_id"], r["chosen_text"], r["Text_key"]) for r in found.collect()) == [(1, "x", "c"), (3, "z", "e")]


def test_removable_spans_equal_brute_force(spark):
    rng = random.Random(7)
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(8, 30))] for k in range(5)]
    docs = []
    for doc in range(40):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(6))]
            words += rng.choice(passages)[rng.randrange(3):]
        if doc % 7 == 0:
            words += ["x"] * 30
        docs.append((doc, " ".join(words)))
    docs += [(100, docs[1][1]), (101, None), (102, "")]
    frame = spark.createDataFrame(docs, DOCS)
    got = {}
    for r in suffix_dedup.repeats(frame, words=8, seed=3).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
        assert r["first_doc_id"] <= r["doc_id"]
    want = repeated_words(docs, 8)
    assert got == want
    cut = suffix_dedup.without_repeats(frame.selectExpr("*", "length(text) AS n_chars"), words=8, seed=3)
    for r in cut.collect():
        text = dict(docs)[r["doc_id"]]
        kept = [w for i, w in enumerate((text or "").split()) if i not in want.get(r["doc_id"], ())]
        assert (r["text"] or "").split() == kept
        assert (r["text"] is None) == (text is None)
        assert r["n_chars"] == (None if text is None else len(r["text"]))


@pytest.mark.parametrize("partitions", [1, 8, 23])
def test_first_places_do_not_depend_on_partitions(spark, partitions):
    """A passage that most documents share fills several partitions; its first document is found."""
    passage = " ".join(f"w{i}" for i in range(15))
    docs = [(i, f"u{i} {passage} v{i}" if i % 4 else f"u{i} v{i}") for i in range(3, 400)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = suffix_dedup.repeats(spark.createDataFrame(docs, DOCS).repartition(5), words=8, seed=3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    first = min(i for i, text in docs if passage in text)
    assert {(r["doc_id"], r["start"], r["end"], r["first_doc_id"]) for r in found} == {
        (i, 1, 16, first) for i, text in docs if passage in text and i != first
    }


def test_repeats_of_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    rows = [(1, passage, "s"), (1, passage, "s"), (None, passage, "s"), (3, "x " + passage, None)]
    frame = spark.createDataFrame(rows, DOCS + ", spans string")
    got = sorted((r["doc_id"] or 0, r["start"], r["end"]) for r in suffix_dedup.repeats(frame, 8, 3).collect())
    # a null id sorts first and holds the first place; repeated rows are one document
    assert got == [(1, 0, 12), (3, 1, 13)]
    assert suffix_dedup.without_repeats(frame, 8, 3).columns == frame.columns
    assert suffix_dedup.repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_across_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k, doc, 0, at, 5) for k in (1, 1, 1, 2, 3) for doc in range(3) for at in range(30 if k == 1 else 2)]
        rows = sorted(set(rows)) + [(9, 0, 0, 0, 5)]
        frame = spark.createDataFrame(rows, "key bigint, doc bigint, part int, at int, span int")
        got = {(r["key"], r["doc"], r["at"]): r["again"] for r in runs(frame, ["key"], ["span"], singles=True).collect()}
        assert len(got) == len(rows)
        assert sorted(k for k, again in got.items() if not again) == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (9, 0, 0)]
        assert runs(frame, ["key"], ["span"]).count() == len(rows) - 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_know_the_earliest_place_across_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k, doc, 0, at) for k in (1, 2, 3) for doc in range(3) for at in range(300 if k == 2 else 2)]
        frame = spark.createDataFrame(rows, "key bigint, doc bigint, part int, at int")
        got = runs(frame, ["key"], earliest=True).collect()
        assert len(got) == len(rows)
        assert {(r["first_doc"], r["first_part"], r["first_at"]) for r in got} == {(0, 0, 0)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fenwick_chains():
    exact = [(i * 7, 100 + i * 7) for i in range(10)]
    noise = [(3, 900), (40, 2), (65, 500)]
    best = chaining.chains(exact + noise)[0]
    assert best == exact
    assert chaining.chains([]) == []
    tree = chaining.Fenwick(5)
    tree.raise_to(3, 2.0, 7)
    tree.raise_to(1, 1.0, 8)
    assert tree.upto(2) == (1.0, 8) and tree.upto(5) == (2.0, 7) and tree.upto(1)[1] == -1


@pytest.mark.parametrize("size,apart", [(60, 100), (60, 60), (150, 120)])
def test_exact_passages_with_unlike_text_between(size, apart):
    for trial in range(20):
        rng = random.Random(trial)
        fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
        first, second = fresh(size), fresh(size)
        texts = [fresh(10) + first + fresh(apart) + second + fresh(10) for _ in range(2)]
        x, y = (hashing.word_hashes(" ".join(t).encode()) for t in texts)
        kmers = [hashing.window_hashes(h, chaining.SEED) for h in (x, y)]
        at, of = (suffix_dedup.minimisers(k, chaining.SPACING)[0].tolist() for k in kmers)
        matches = [(i, j) for i in at for j in of if kmers[0][i] == kmers[1][j]]
        found = sorted(f[:2] for f in chaining.compare(x, y, matches))
        assert found == [(10, 10 + size), (10 + size + apart, 10 + 2 * size + apart)]


def test_parts_keep_edited_stretches_whole():
    # 40 equal words, 15 others, 40 equal words: each side alone is too short
    assert chaining._parts([[0, 40, 0, 40], [55, 95, 55, 95]], [0]) == [[0, 95, 0, 95, 80]]
    three = [[0, 100, 0, 100], [150, 250, 150, 250], [300, 400, 300, 400]]
    assert sorted(chaining._parts(three, [0, 0])) in (
        [[0, 100, 0, 100, 100], [150, 400, 150, 400, 200]], [[0, 250, 0, 250, 200], [300, 400, 300, 400, 100]])


def test_fuzzy_passages(spark):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(90)]
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    fuzzy = list(passage)
    for at in (20, 45, 70):
        fuzzy[at] = "changed"
    del fuzzy[33]
    docs = [
        (1, fresh(40) + passage + fresh(20)), (2, fresh(10) + fuzzy + fresh(30)), (3, fresh(200)),
        (4, fresh(5) + passage[:30] + fresh(50)), (5, fresh(60) + passage),
    ]
    rows = [(i, " ".join(w)) for i, w in docs] + [(6, None), (7, ""), (8, "few words")]
    got = {r["doc_id"]: r for r in chaining.passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got) == {2, 5}
    assert (got[5]["start"], got[5]["end"], got[5]["other_id"], got[5]["identity"]) == (60, 150, 1, 1.0)
    assert got[2]["start"] == 10 and got[2]["end"] == 99 and got[2]["n_equal"] == 86
    assert chaining.passages(spark.createDataFrame([], DOCS)).count() == 0


def test_passage_of_seeds_first_seen_in_different_texts(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(60)
    docs = [fresh(30) + passage[k : k + 8] + fresh(30) for k in range(0, 53) for _ in range(6)]
    docs += [fresh(40) + passage + fresh(40), fresh(70) + passage + fresh(10)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    got = [(r["doc_id"], r["start"], r["end"], r["other_id"]) for r in chaining.passages(spark.createDataFrame(rows, DOCS)).collect()]
    assert got == [(len(docs) - 1, 70, 130, len(docs) - 2)]


def test_recall_at_the_declared_identity(spark):
    """60 words of which 12 are others."""
    rng = random.Random(13)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    docs = []
    for _ in range(60):
        passage = fresh(60)
        copy = list(passage)
        for at in rng.sample(range(60), 12):
            copy[at] = fresh(1)[0]
        docs += [fresh(40) + passage + fresh(40), fresh(70) + copy + fresh(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    got = {(r["doc_id"], r["other_id"]) for r in chaining.passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got <= {(i + 1, i) for i in range(0, 120, 2)}
    assert len(got) >= 54


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_repeats_are_all_found(spark, seed):
    """Every window of 50 words that occurs earlier, in its own text or another, lies in a passage:
    also in texts of one word, of short periods, and of frequent lines."""
    rng = random.Random(seed)
    lines = [[f"l{k}_{i}" for i in range(rng.randrange(20, 60))] for k in range(4)]
    docs = []
    for doc in range(30):
        words = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(4)
            if kind == 0:
                words += [f"p{rng.randrange(3)}"] * rng.randrange(40, 130)
            elif kind == 1:
                period = [f"q{rng.randrange(9)}" for _ in range(rng.randrange(2, 9))]
                words += (period * 80)[: rng.randrange(60, 200)]
            elif kind == 2:
                words += rng.choice(lines) + rng.choice(lines)
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
        docs.append((doc, " ".join(words)))
    want = repeated_words(docs, chaining.WORDS)
    got = {}
    for r in chaining.passages(spark.createDataFrame(docs, DOCS)).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    missed = {doc: sorted(w - got.get(doc, set())) for doc, w in want.items() if w - got.get(doc, set())}
    assert sum(map(len, want.values())) > 1000
    assert not missed


def test_every_copy_within_a_text_is_found(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    footer, long = fresh(60), []
    for _ in range(10):
        long += fresh(300) + footer
    rows = [(1, " ".join(fresh(30) + footer + fresh(30))), (2, " ".join(long))]
    got = chaining.passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in got if r["other_id"] == 1} == {
        (2, 300 + 360 * i, 360 + 360 * i) for i in range(10)
    }


def test_fuzzy_passages_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    frame = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 0), (2, "a " * 500, 0)], DOCS + ", seed int")
    got = [(r["doc_id"], r["other_id"]) for r in chaining.passages(frame).collect()]
    assert (1, None) in got and (2, 2) not in [g for g in got if g[0] == 1]
