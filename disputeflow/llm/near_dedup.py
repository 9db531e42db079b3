"""Near-duplicate documents from bottom-k sketches.

One hash function orders all shingles; a sketch holds a document's ``k`` smallest. Inverted
lists of retained values generate overlaps, the sketch of a pair's union estimates its
similarity, and the full sets decide.

A list holds the documents that retain the same few values, one after another in the order of
the hash (``list_keys``): single values would list all documents with a common shingle, and
ever more of them as the corpus grows. Two sets that are 80 % alike have about half of their
62 runs of three values in common, and none with a probability of about 1e-10; lists of small
sets are made so that alike ones meet for certain, or but for about 1 in 10,000 of those that
are barely alike. Within a list all members meet one centre instead of each other, be they like
it or not. Pairs of members that are still in different components afterwards are settled in
blocks (``settle``), so no pair that shares a list is left out.

At k = 64 a pair of similarity 0.8 has an estimate below 0.5 with a probability of about
2e-7; sets of up to k shingles are compared in whole.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from disputeflow.llm import hashing
from disputeflow.llm.components import components
from disputeflow.llm.frames import ROWS, batches, kept, raw, rows, scratch, staged, unused

K = 64
LEAST = 0.5
PERCENT = 80
#: Retained values of a list's key.
RUN = 3
#: Sizes up to which sets are tiny and small, and from which they are large.
TINY, SMALL, LARGE = 10, 60, 48
#: Shingles, and values of sketches, on either side of a block in ``settle``.
BLOCK, SKETCH_BLOCK = 400_000, 100_000
#: Columns of an incidence matrix; similar sizes that one range of ``blocks`` spans.
COLUMNS, RANGES = 4096, 5


def text_key(text: str = "text") -> Column:
    """Tells apart rows that share a doc_id."""
    return F.unhex(F.md5(raw(text)))


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """``(doc_id, text_key, n_shingles, node, sketch)``; equal sets have the same ``node``.

    A text without words has no shingle, a null ``node`` and a null ``sketch``.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_shingles", pa.int64()),
         ("node", pa.binary()), ("sketch", pa.binary())]
    )

    def sketch(found):
        def each():
            for doc_id, key, text in rows(found):
                values = hashing.shingles(hashing.word_hashes(text.lower()), width)
                node = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                small = values[:k].tobytes()
                yield (doc_id, key, len(values), *((node, small) if len(values) else (None, None)))

        return batches(each(), schema)

    slim = docs.select(F.col("doc_id").cast("bigint"), text_key().alias("key"), raw("text").alias("text"))
    return slim.mapInArrow(sketch, "doc_id bigint, text_key binary, n_shingles bigint, node binary, sketch binary")


def _key(*parts: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b"".join(parts))


def list_keys(values: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Keys of the inverted lists of a sketch, and of those that prove an overlap by themselves.

    ``values``: retained hashes, ascending; ``n``: size of the full set. Larger sets are
    listed under each RUN values that follow one another. Small sets, whose sketch is complete,
    are listed under the values that fall in each of a number of hash ranges: more ranges than
    two sets of 80 % can differ in. Tiny ones are listed under themselves without any two, one
    or none of their values. Sizes near a border are listed both ways.
    """
    runs, sure = [], []
    if n >= LARGE:
        runs = hashing.window_hashes(values, RUN).view(np.int64).tolist()
    if TINY < n <= SMALL:
        step = np.log(100 / PERCENT)
        own = int(np.floor(np.log(n) / step))
        for label in (own, own + 1):
            ranges = 2 * int(np.exp(step * (label + 1)) * (100 - PERCENT) / PERCENT) + 2
            place = ((values >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cuts = np.searchsorted(place, np.arange(ranges + 1, dtype=np.uint64))
            for r in range(ranges):
                if cuts[r] < cuts[r + 1]:
                    sure.append(_key(b"%d:%d:" % (label, r), values[cuts[r] : cuts[r + 1]].tobytes()))
    if n <= TINY + 3:
        packed = [values[i : i + 1].tobytes() for i in range(n)]
        for gone in range(min(3, n)):
            sure += [_key(*kept) for kept in combinations(packed, n - gone)]
    return runs, [k - (1 << 64) if k >> 63 else k for k in sure]


def postings(reps: DataFrame) -> DataFrame:
    """``(key, node, sure, weight)``: the entries of all lists that have two or more.

    ``weight`` is how many entries the node's lists have together.
    """
    pack = pa.schema([("key", pa.int64()), ("node", pa.binary()), ("sure", pa.bool_())])

    def unpack(found):
        for batch in found:
            for start in range(0, batch.num_rows, ROWS):
                nodes, sizes, small = batch.slice(start, ROWS).columns
                keys, owner, sure = [], [], []
                for i, (n, packed) in enumerate(zip(sizes.to_pylist(), small.to_pylist())):
                    loose, firm = list_keys(np.frombuffer(packed, np.uint64), n)
                    keys += loose + firm
                    owner += [i] * (len(loose) + len(firm))
                    sure += [False] * len(loose) + [True] * len(firm)
                yield pa.record_batch(
                    [pa.array(keys, pa.int64()), nodes.take(pa.array(owner, pa.int32())), pa.array(sure, pa.bool_())], schema=pack
                )

    every = reps.select("node", "n_shingles", "sketch").mapInArrow(unpack, "key bigint, node binary, sure boolean")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    entries = staged(every.join(shared, "key"), "entries")
    weights = entries.groupBy("node").agg(F.sum("df").alias("weight"))
    return entries.drop("df").join(weights, "node")


def stars(listed: DataFrame) -> DataFrame:
    """``(a, b)``: the centre of a list, its heaviest member, and every other member, each once.

    A single common list is enough: two similar members may each meet an unlike centre only
    once, and come together in ``settle`` through that row alone.
    """
    centre = listed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top"))
    pairs = listed.join(centre.select("key", F.col("top.node").alias("a")), "key").where("node <> a")
    return pairs.select("a", F.col("node").alias("b")).distinct()


def union_estimate(a: bytes, b: bytes, k: int) -> float:
    """Similarity from two sketches: the share of the union's sketch that both hold."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    union = np.sort(np.concatenate((x, y)))
    double = union[1:] == union[:-1]
    firsts = np.concatenate(([True], ~double))
    positions = np.cumsum(firsts)
    size = min(k, int(positions[-1]))
    return float(np.count_nonzero(double & (positions[1:] <= size))) / size


def estimated(pairs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Pairs whose union sketch estimates at least LEAST."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def likely(found):
        return batches(((a, b) for a, b, x, y in rows(found) if union_estimate(x, y, k) >= LEAST), schema)

    small = reps.select("node", "sketch")
    both = pairs.join(small.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b").join(
        small.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a"
    )
    return both.select("a", "b", "x", "y").mapInArrow(likely, "a binary, b binary")


def alike(common: int, x: int, y: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (x + y - common)


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs whose full sets are at least 80 % alike. ``texts``: ``(node, text)``."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def check(found):
        def each():
            last, first = None, None
            for a, b, x, y in rows(found):
                if a != last:
                    last, first = a, hashing.shingles(hashing.word_hashes(x.lower()), width)
                second = hashing.shingles(hashing.word_hashes(y.lower()), width)
                common = len(np.intersect1d(first, second, assume_unique=True))
                if alike(common, len(first), len(second)):
                    yield a, b

        return batches(each(), schema)

    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def blocks(members: DataFrame, weight: Column, limit: int) -> DataFrame:
    """Members of one centre dealt to blocks that together hold every pair to be compared.

    ``members``: ``(centre, node, label, n, core)``; ``core`` marks the centre's component.
    What is outside the core asks all members of a similar size. Sizes fall in wide ranges;
    a member hears in each range that a similar size can fall in. Range by range the asking
    and the hearing members are cut in parts of about ``limit`` in ``weight``, and each pair of
    parts is a block, so the largest block does not grow with a list.
    """
    wide = float(np.log(100 / PERCENT)) * RANGES
    place = lambda size: F.floor(F.log(size) / wide).cast("int")
    size = F.col("n").cast("double")
    slack = 1e-9
    rows_ = members.select(
        "centre", "node", "label", "n", "core", weight.alias("weight"), place(size).alias("own"),
        F.explode(F.sequence(place(size * PERCENT / 100 * (1 - slack)), place(size * 100 / PERCENT * (1 + slack)))).alias("place"),
    ).withColumn("asks", ~F.col("core") & (F.col("own") == F.col("place")))
    sizes = rows_.groupBy("centre", "place").agg(
        F.ceil(F.sum(F.when(F.col("asks"), F.col("weight"))) / limit).cast("int").alias("n_i"),
        F.ceil(F.sum("weight") / limit).cast("int").alias("n_j"),
        F.count(F.lit(1)).alias("n_rows"),
    ).where("n_i > 0 and n_rows > 1").drop("n_rows")
    i, j = (F.pmod(F.xxhash64("node"), F.col(n)).cast("int") for n in ("n_i", "n_j"))
    cells = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    heard = cells("n_i", lambda x: F.struct(x.alias("i"), j.alias("j")))
    asked = cells("n_j", lambda x: F.struct(i.alias("i"), x.alias("j")))
    dealt = rows_.join(sizes, ["centre", "place"]).select(
        "centre", "place", "node", "label", "asks", i.alias("own_i"), j.alias("own_j"),
        F.explode(F.when(F.col("asks"), F.array_union(heard, asked)).otherwise(heard)).alias("cell"),
    )
    return dealt.select(
        "centre", "place", "cell.i", "cell.j", "node", "label",
        (F.col("asks") & (F.col("own_i") == F.col("cell.i"))).alias("asks"),
        (F.col("own_j") == F.col("cell.j")).alias("hears"),
    )


def _sides(table: pa.Table, read) -> tuple:
    columns = {c: table[c].to_pylist() for c in ("node", "label", "asks", "hears")}
    sets = [read(x) for x in table["payload"].to_pylist()]
    ask, hear = ([i for i, x in enumerate(columns[c]) if x] for c in ("asks", "hears"))
    number: dict[bytes, int] = {}
    label = np.array([number.setdefault(x, len(number)) for x in columns["label"]])
    common = _common([sets[i] for i in ask], [sets[i] for i in hear])
    sizes = np.array([len(s) for s in sets])
    other = label[ask][:, None] != label[hear][None, :]
    return columns, ask, hear, common, sizes[ask][:, None], sizes[hear][None, :], other


def promising(members: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """``(centre, node)`` of members whose sketch agrees with that of a member of another component."""
    schema = pa.schema([("centre", pa.binary()), ("node", pa.binary())])

    def compare(table: pa.Table) -> pa.Table:
        columns, ask, hear, common, x, y, other = _sides(table, lambda small: np.frombuffer(small, np.uint64))
        # both sketches complete: similarity itself; else the least overlap of an estimate
        whole = (x < k) & (y < k)
        agree = np.where(whole, 100 * common >= PERCENT * (x + y - common), common >= LEAST * np.minimum(k, np.minimum(x, y)))
        p, q = np.nonzero(agree & other)
        nodes = sorted({columns["node"][ask[i]] for i in p} | {columns["node"][hear[i]] for i in q})
        centre = table["centre"][0].as_py() if len(table) else None
        return pa.table([[centre] * len(nodes), nodes], schema=schema)

    dealt = blocks(members, F.least("n", F.lit(k)), SKETCH_BLOCK)
    payload = reps.select("node", F.col("sketch").alias("payload"))
    return (
        dealt.join(payload, "node").groupBy("centre", "place", "i", "j")
        .applyInArrow(compare, "centre binary, node binary").distinct()
    )


def settle(members: DataFrame, reps: DataFrame, texts: DataFrame, width: int, k: int) -> DataFrame:
    """Links between members of one centre that are in different components.

    Sketches tell which members can have such a link, and their full sets decide. A block
    reports one link for each member and component, not all pairs.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compare(table: pa.Table) -> pa.Table:
        columns, ask, hear, common, x, y, other = _sides(
            table, lambda text: hashing.shingles(hashing.word_hashes(text.lower()), width)
        )
        p, q = np.nonzero((100 * common >= PERCENT * (x + y - common)) & other)
        found = sorted({(columns["node"][ask[i]], columns["label"][hear[j]]) for i, j in zip(p, q)})
        return pa.table([[a for a, _ in found], [b for _, b in found]], schema=schema)

    chosen = staged(promising(members, reps, k), "promising")
    dealt = blocks(members.join(chosen, ["centre", "node"], "left_semi"), F.col("n"), BLOCK)
    payload = texts.select("node", F.col("text").alias("payload"))
    return (
        dealt.join(payload, "node").groupBy("centre", "place", "i", "j")
        .applyInArrow(compare, "a binary, b binary")
    )


def _common(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of incidence matrices, some columns at a time."""
    out = np.zeros((len(first), len(second)), np.int64)
    if not first or not second:
        return out
    flat = [np.concatenate(side) for side in (first, second)]
    owner = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (first, second)]
    values = np.intersect1d(*flat)
    where = [np.searchsorted(values, f) for f in flat]
    kept = [(w < len(values)) & (values[np.minimum(w, len(values) - 1)] == f) if len(values) else np.zeros(len(f), bool)
            for w, f in zip(where, flat)]
    for start in range(0, len(values), COLUMNS):
        width = min(COLUMNS, len(values) - start)
        sides = []
        for side, w, f, o in zip((first, second), where, kept, owner):
            own = f & (w >= start) & (w < start + width)
            matrix = np.zeros((len(side), width), np.float32)
            matrix[o[own], w[own] - start] = 1
            sides.append(matrix)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def near_duplicates(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """Components of documents whose ``width``-word shingle sets are at least 80 % alike.

    Returns ``(doc_id, text_key, n_shingles, component, component_id, kept)``, a row for each
    row of ``docs``. Words are runs of other than ASCII white space, A-Z lower-cased; a text
    with fewer words than ``width`` has one shingle. ``component`` is null for texts without
    words, which link with nothing: null and empty texts are their own component. Rows of
    equal sets share a component; rows that repeat a doc_id stay rows of their own.
    ``component_id`` is the smallest doc_id of the component (null doc_ids do not count) and
    ``kept`` tells whether it is the row's own. An empty table gives no rows; columns other
    than doc_id and text are not read.
    """
    with scratch(docs.sparkSession):
        return kept(_near_duplicates(docs, width, k), "near-duplicates")


def _near_duplicates(docs: DataFrame, width: int, k: int) -> DataFrame:
    marked = staged(sketches(docs, width, k), "sketches")
    words = marked.where("node is not null")
    reps = staged(
        words.groupBy("node").agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    pairs = staged(stars(staged(postings(reps), "postings")), "pairs")
    likely = staged(estimated(pairs, reps, k), "likely")
    member = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("node")), F.struct(F.col("b").alias("node"))))).distinct()
    wanted = reps.join(member, "node", "left_semi").select(
        "node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")
    )
    named = docs.select(F.col("doc_id").cast("bigint"), text_key().alias("text_key"), raw("text").alias("text"))
    texts = staged(
        named.join(wanted, named["doc_id"].eqNullSafe(wanted["doc_id"]) & (named["text_key"] == wanted["text_key"]))
        .select("node", "text").dropDuplicates(["node"]),
        "texts",
    )
    links = staged(verified(likely, texts, width), "links")
    labels = components(links)
    more = settle(_open_members(pairs, reps, labels), reps, texts, width, k)
    final = components(links.unionByName(staged(more, "links")))
    return _result(marked, final)


def _open_members(pairs: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of centres of which some are outside the centre's component."""
    known = reps.select("node", F.col("n_shingles").alias("n")).join(labels, "node", "left").select(
        "node", "n", F.coalesce("label", "node").alias("label")
    )
    of_centre = known.select(F.col("node").alias("a"), F.col("label").alias("home"))
    rest = pairs.select("a", F.col("b").alias("node")).join(known, "node").join(of_centre, "a").select(
        F.col("a").alias("centre"), "node", "label", "n", (F.col("label") == F.col("home")).alias("core")
    )
    open_ = rest.groupBy("centre").agg(
        F.count(F.lit(1)).alias("n_rows"), F.bool_and("core").alias("closed")
    ).where("n_rows > 1 and not closed")
    return staged(rest.join(open_.select("centre"), "centre", "left_semi"), "open")


def _result(marked: DataFrame, labels: DataFrame) -> DataFrame:
    rows_ = marked.join(labels, "node", "left").select(
        "doc_id", "text_key", "n_shingles", F.coalesce("label", "node").alias("component")
    )
    smallest = rows_.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    named = rows_.join(smallest, "component", "left")
    component_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return named.select(
        "doc_id", "text_key", "n_shingles", "component", component_id.alias("component_id"),
        F.col("doc_id").eqNullSafe(component_id).alias("kept"),
    )


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id.

    Texts without words all stay. Of rows that share that doc_id, the one with the smallest
    text digest stays; a row repeated as it is stays once. All columns stay, whatever their names.
    """
    found = near_duplicates(docs, width)
    winner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("winner")
    groups = found.where("component is not null").groupBy("component").agg(winner)
    chosen = groups.select("winner.doc_id", "winner.text_key").unionByName(
        found.where("component is null").select("doc_id", "text_key")
    ).distinct()
    digest = unused("chosen_text", docs.columns)
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("text_key").alias("chosen_key"))
    keyed = docs.withColumn(digest, text_key())
    match = keyed["doc_id"].cast("bigint").eqNullSafe(chosen["chosen_id"]) & (keyed[digest] == chosen["chosen_key"])
    return keyed.join(chosen, match, "left_semi").dropDuplicates(["doc_id", digest]).select(*docs.columns)
