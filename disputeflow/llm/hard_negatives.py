"""Hard negatives by exact integer inner products, scored with the Four-Russians method.

Components are scaled to integers. A candidate is held as bit planes: bit j of eight
neighbouring components makes one byte. For an anchor and each group of eight dimensions a
table has the sums of all 256 subsets of the anchor's components, so that a candidate's byte
looks up what its eight bits add to the score. Lookups of a plane are added, the total is
doubled from one plane to the next lower, and the highest plane, the sign, is subtracted: the
result is the full exact inner product.

Anchors are a stated query set, scored against all rows in cells: a block of at most
``BLOCK`` candidates and one of at most ``ANCHORS`` anchors. A cell keeps the best few for each
of its anchors, and these meet afterwards. No label, however common, makes a larger cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from disputeflow.llm.frames import batches, kept, scratch, staged

#: Rows and anchors of a cell, and anchors whose tables are in memory at once.
BLOCK, ANCHORS, AT_ONCE = 4096, 2048, 64
#: Cells are dealt to as many tasks, but to no more than this.
TASKS = 20_000
GROUP = 8


def tables(anchors: np.ndarray) -> np.ndarray:
    """For each group of eight dimensions and each subset of them, every anchor's sum."""
    n, dims = anchors.shape
    parts = anchors.T.reshape(dims // GROUP, GROUP, n)
    out = np.zeros((dims // GROUP, 1 << GROUP, n), anchors.dtype)
    for bit in range(GROUP):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + parts[:, bit, None]
    return out


def planes(vectors: np.ndarray, bits: int) -> np.ndarray:
    """Two's-complement bit planes, ``(plane, group, row)``, a byte for eight dimensions."""
    shifted = (vectors[None] >> np.arange(bits)[:, None, None]) & 1
    return np.ascontiguousarray(np.packbits(shifted.astype(np.uint8), axis=2, bitorder="little").transpose(0, 2, 1))


def scores(bit_planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Inner product of every row with every anchor, ``(row, anchor)``."""
    total = np.zeros((bit_planes.shape[2], sums.shape[2]), sums.dtype)
    found = np.empty_like(total)
    top = len(bit_planes) - 1
    for plane in range(top, -1, -1):
        total += total
        for group in range(len(sums)):
            np.take(sums[group], bit_planes[plane, group], axis=0, out=found, mode="clip")
            if plane == top:
                total -= found
            else:
                total += found
    return total


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of a list column, filled with zeros to ``dims``."""
    ends = column.offsets.to_numpy()
    lengths = np.diff(ends)
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _blocks(found, size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of at most ``size`` rows."""
    waiting, n = [], 0
    for batch in found:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            waiting.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _list(table: pa.Table, name: str) -> pa.ListArray:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else column.combine_chunks()


def _candidates(rows: DataFrame, parts: int, dims: int, bits: int) -> DataFrame:
    """Blocks of rows in order of label and id: ``(c, ids, labels, planes)``."""
    def pack(found):
        def packed():
            for table in _blocks(found, BLOCK):
                ids, labels = _column(table, "id"), _column(table, "label")
                order = np.lexsort((ids, labels))
                vectors = _matrix(_list(table, "vector"), dims)[order]
                part = int(table.column("part")[0].as_py())
                yield part, ids[order].tobytes(), labels[order].tobytes(), planes(vectors, bits).tobytes()

        schema = pa.schema([("c", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("planes", pa.binary())])
        return batches(packed(), schema, 16)

    dealt = rows.select("id", "label", "vector").repartition(parts)
    dealt = dealt.withColumn("part", F.spark_partition_id() % parts)
    return staged(dealt.mapInArrow(pack, "c int, ids binary, labels binary, planes binary"), "candidates")


def _anchors(rows: DataFrame, parts: int, dims: int) -> DataFrame:
    """Blocks of anchors, with their positives' ids and scores where there are any."""
    with_positives = "positives" in rows.columns
    fields = ["ids", "labels", "vectors", "sizes", "positives", "scores"]

    def pack(found):
        def packed():
            for table in _blocks(found, ANCHORS):
                ids, labels = _column(table, "id"), _column(table, "label")
                part = int(table.column("part")[0].as_py())
                row = [ids.tobytes(), labels.tobytes(), _matrix(_list(table, "vector"), dims).tobytes()]
                if with_positives:
                    lists = _list(table, "positives")
                    inner, ends = lists.values, lists.offsets.to_numpy()
                    inner = inner.slice(ends[0], ends[-1] - ends[0])
                    row += [np.diff(ends).astype(np.int64).tobytes()]
                    row += [inner.field(i).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for i in (0, 1)]
                else:
                    row += [b"", b"", b""]
                yield part, *row

        schema = pa.schema([("a", pa.int32()), *((name, pa.binary()) for name in fields)])
        return batches(packed(), schema, 16)

    dealt = rows.repartition(parts).withColumn("part", F.spark_partition_id() % parts)
    text = "a int, " + ", ".join(f"anchor_{name} binary" for name in fields)
    return staged(dealt.mapInArrow(lambda found: _renamed(pack(found)), text), "anchors")


def _renamed(found):
    for batch in found:
        yield batch.rename_columns(["a", *(f"anchor_{name}" for name in batch.schema.names[1:])])


def _cells(candidates: DataFrame, candidate_parts: int, anchors: DataFrame, anchor_parts: int) -> DataFrame:
    """Every block of candidates beside every block of anchors, one row a cell."""
    tasks = min(candidate_parts * anchor_parts, TASKS)
    left = candidates.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(anchor_parts - 1))))
    right = anchors.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(candidate_parts - 1))))
    return left.repartition(tasks, "a", "c").join(right.repartition(tasks, "a", "c"), ["a", "c"])


def _score_cells(cells: DataFrame, dims: int, bits: int, kind: str, choose, names: list[str]) -> DataFrame:
    """``choose`` over each cell; it gives tuples of integers with the given names."""
    schema = pa.schema([(name, pa.int64()) for name in names])

    def work(found):
        def chosen():
            for batch in found:
                for row in batch.to_pylist():
                    numbers = {k: np.frombuffer(v, np.int64) for k, v in row.items() if isinstance(v, bytes) and k != "planes"}
                    bit_planes = np.frombuffer(row["planes"], np.uint8).reshape(bits, dims // GROUP, -1)
                    vectors = numbers["anchor_vectors"].reshape(-1, dims).astype(kind)
                    yield from choose(numbers, bit_planes, vectors)

        return batches(chosen(), schema)

    return cells.mapInArrow(work, ", ".join(f"{name} bigint" for name in names))


def _ranks(ids: np.ndarray) -> np.ndarray:
    """For each row ``n - 1`` less the place of its id, so that smaller ids count more."""
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids) - 1, -1, -1)
    return place


def _nearest_alike(wanted: int):
    """Of each anchor the ``wanted`` best rows of its label: (anchor, other, score)."""
    def choose(numbers, bit_planes, vectors):
        labels, mine = numbers["labels"], numbers["anchor_labels"]
        for label in np.unique(mine):
            start, end = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
            if start == end:
                continue
            ids, n = numbers["ids"][start:end], end - start
            tie = _ranks(ids)
            here = np.ascontiguousarray(bit_planes[:, :, start:end])
            members = np.flatnonzero(mine == label)
            for first in range(0, len(members), AT_ONCE):
                some = members[first : first + AT_ONCE]
                order = scores(here, tables(vectors[some])).T.astype(np.int64) * n + tie
                own = numbers["anchor_ids"][some]
                order[ids[None] == own[:, None]] = np.iinfo(np.int64).min
                keep = min(wanted, n)
                best = np.argpartition(order, n - keep, axis=1)[:, n - keep :]
                for k, rows in enumerate(best):
                    for at in rows:
                        if order[k, at] != np.iinfo(np.int64).min:
                            yield int(own[k]), int(ids[at]), int(order[k, at] // n)

    return choose


def _within_band(wanted: int, low: int, high: int, base: int):
    """Of each anchor and positive the ``wanted`` best rows of other labels within the band."""
    def choose(numbers, bit_planes, vectors):
        ids, labels, n = numbers["ids"], numbers["labels"], len(numbers["ids"])
        tie = _ranks(ids)
        by_tie = np.empty(n, np.int64)
        by_tie[tie] = np.arange(n)
        ends = np.cumsum(numbers["anchor_sizes"])
        for first in range(0, len(vectors), AT_ONCE):
            found = np.ascontiguousarray(scores(bit_planes, tables(vectors[first : first + AT_ONCE])).T)
            for k, row in enumerate(found, first):
                start = ends[k] - numbers["anchor_sizes"][k]
                wanted_by = [
                    (int(p), int(s), -(-low * int(s) // base), high * int(s) // base)
                    for p, s in zip(numbers["anchor_positives"][start : ends[k]], numbers["anchor_scores"][start : ends[k]])
                ]
                wanted_by = [x for x in wanted_by if x[2] <= x[3]]
                if not wanted_by:
                    continue
                least, most = min(x[2] for x in wanted_by), max(x[3] for x in wanted_by)
                inside = np.flatnonzero((row >= least) & (row <= most) & (labels != numbers["anchor_labels"][k]))
                order = np.sort(-(row[inside].astype(np.int64) * n + tie[inside]))
                anchor = int(numbers["anchor_ids"][k])
                for positive, score, floor, ceiling in wanted_by:
                    at = np.searchsorted(order, -((ceiling + 1) * n - 1))
                    for value in order[at : at + wanted].tolist():
                        if -value < floor * n:
                            break
                        yield anchor, positive, score, int(ids[by_tie[-value % n]]), -value // n

    return choose


def _first(rows: DataFrame, group: list[str], score: str, other: str, wanted: int) -> DataFrame:
    best = Window.partitionBy(*group).orderBy(F.col(score).desc(), other)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted)


def mine(
    rows: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = 5,
    negatives: int = 10,
    band: tuple[int, int, int] = (30, 90, 100),
    scale: int = 256,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Rows that meet the condition ``anchor`` are anchors. A score is the inner product of
    ``floor(scale * x)``; higher ones come first, ties by smaller id. An anchor's positives are
    its first ``positives`` other rows of its label, and the negatives of a positive the first
    ``negatives`` rows of other labels with ``low * positive <= base * negative <= high * positive``
    for ``band = (low, high, base)``. Where there are fewer, all are given.

    Rows with a null id, label, vector or component, or a component that is not finite, take no
    part. Of several rows with one id the least in label and vector counts, once. Shorter vectors
    are filled with zeros. Components so large that scores might pass 64 bits raise a ValueError.
    Other columns are not read; an empty table and one without anchors give no rows.
    """
    spark = rows.sparkSession
    kind = label if isinstance(label, Column) else F.col(label)
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = rows.withColumn("chosen as anchor", F.coalesce(anchor, F.lit(False))).select(
        F.col(vec_id).cast("bigint").alias("id"), kind.cast("bigint").alias("label"), F.col(vector).alias("raw"),
        finite.alias("finite"), whole.alias("vector"), "chosen as anchor",
    )
    known = known.where("id is not null and label is not null and raw is not null and finite")
    with scratch(spark):
        one = known.groupBy("id").agg(F.min(F.struct("label", "vector", "chosen as anchor")).alias("row"))
        one = staged(one.select("id", "row.label", "row.vector", F.col("row.chosen as anchor").alias("is_anchor")), "vectors")
        size = one.agg(
            F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("vector")).alias("dims"),
            F.min(F.array_min("vector")).alias("low"), F.max(F.array_max("vector")).alias("high"),
        ).first()
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        if not size["anchors"]:
            return spark.createDataFrame([], ", ".join(f"{c} bigint" for c in names)).select(*_columns(F.lit(1)))
        low, high = size["low"] or 0, size["high"] or 0
        dims = max(1, -(-size["dims"] // GROUP)) * GROUP
        bits = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
        largest = dims << (2 * bits)
        if largest * BLOCK * max(band) >= 1 << 62:
            raise ValueError(f"components of {bits} bits in {dims} dimensions may pass 64 bits")
        kind = "int32" if largest < 1 << 31 else "int64"
        parts, anchor_parts = -(-size["n"] // BLOCK), -(-size["anchors"] // ANCHORS)
        candidates = _candidates(one, parts, dims, bits)
        chosen = one.where("is_anchor").select("id", "label", "vector")
        cells = _cells(candidates, parts, _anchors(chosen, anchor_parts, dims), anchor_parts)
        alike = _score_cells(cells, dims, bits, kind, _nearest_alike(positives), ["id", "positive_id", "score"])
        alike = _first(alike, ["id"], "score", "positive_id", positives)
        alike = alike.groupBy("id").agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
        cells = _cells(candidates, parts, _anchors(chosen.join(alike, "id"), anchor_parts, dims), anchor_parts)
        found = _score_cells(cells, dims, bits, kind, _within_band(negatives, *band), names)
        found = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
        return kept(found.select(*_columns(F.col("rank"))), "hard-negatives")


def _columns(rank: Column) -> list[Column | str]:
    return ["anchor_id", "positive_id", rank.cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"]
