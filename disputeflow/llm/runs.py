"""Sort rows by a key and compare neighbours, with hot keys cut into several partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from disputeflow.llm.frames import staged

#: Stands for a null document id, which sorts first.
NO_ID = -(1 << 63)
PLACE = ["doc", "part", "at"]
ROW, FIRST_RUN, LAST_RUN, LAST_ROW = 0, 1, 2, 3


def runs(rows: DataFrame, keys: list[str], extra: list[str] = (), singles: bool = False, earliest: bool = False) -> DataFrame:
    """Rows whose keys occur twice or more, with an earlier place of the key.

    ``rows`` has bigint ``keys``, ``doc`` bigint, ``part`` int, ``at`` int and int ``extra``
    columns. The result adds ``again``, true for all but the first place of a key, and
    ``first_doc``, ``first_part``, ``first_at``: the key's first place, or where a key's rows fill
    several partitions, for most of its rows the first in the same partition, unless
    ``earliest``. ``singles`` keeps rows of other keys too, not ``again``.

    Rows are dealt by ranges of key and place, so that a key with a third of all rows is cut
    into many partitions, and sorted there. One pass compares neighbours. Only a
    partition's first row may have an equal one in an earlier partition, and its last in a later:
    these wait for those of all partitions, two rows a partition at most and hence broadcast.
    """
    columns = [*keys, *PLACE, *extra]
    types = [pa.int64()] * (len(keys) + 1) + [pa.int32()] * (2 + len(extra))
    firsts = [("first_doc", pa.int64()), ("first_part", pa.int32()), ("first_at", pa.int32())]
    schema = pa.schema([*zip(columns, types), *firsts, ("size", pa.int32()), ("kind", pa.int32())])
    width = len(keys)

    def neighbours(batches):
        held = None  # the last row so far: its run's first place, its run's rows, whether first run
        for batch in batches:
            if not batch.num_rows:
                continue
            data = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            n = batch.num_rows
            new = np.ones(n, bool)
            same = np.ones(n - 1, bool)
            for key in data[:width]:
                same &= key[1:] == key[:-1]
            new[1:] = ~same
            if held is not None:
                new[0] = any(int(key[0]) != old for key, old in zip(data[:width], held["key"]))
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            place = [np.where(start < 0, held["first"][i] if held else 0, data[width + i][np.maximum(start, 0)]) for i in range(3)]
            follows = np.append(~new[1:], False)
            size = np.where(new & ~follows, 1, 2).astype(np.int32)
            if held is not None and held["alone"]:
                wait = held["opening"] and FIRST_RUN
                if not new[0] or wait or singles:
                    yield _one(held, schema, 1 if new[0] else 2, wait or ROW)
            kind = np.full(n, ROW, np.int32)
            kind[0] = FIRST_RUN if held is None else ROW
            wanted = (kind == FIRST_RUN) | (size > 1) | singles
            wanted[-1] &= not new[-1]  # a run that begins with the last row is not known yet
            if wanted.any():
                arrays = [pa.array(x[wanted], t.type) for x, t in zip([*data, *place, size, kind], schema)]
                yield pa.record_batch(arrays, schema=schema)
            last = [x[-1].item() for x in data]
            first_run = not new[1:].any() if held is None else held["first_run"] and not new.any()
            held = {
                "key": last[:width], "row": last, "first": [p[-1].item() for p in place], "alone": bool(new[-1]),
                "opening": held is None and n == 1, "first_run": bool(first_run),
            }
        if held is not None:
            if held["alone"]:
                yield _one(held, schema, 1, FIRST_RUN if held["opening"] else LAST_ROW)
            elif not held["first_run"]:
                mark = held | {"row": [*held["key"], *held["first"], *([0] * len(extra))]}
                yield _one(mark, schema, 2, LAST_RUN)

    kinds = {pa.int64(): "bigint", pa.int32(): "int"}
    text = ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)
    dealt = rows.select(*columns).repartitionByRange(*keys, *PLACE).sortWithinPartitions(*keys, *PLACE)
    found = staged(dealt.mapInArrow(neighbours, text), "runs")
    edges = found.where(F.col("kind") != ROW).groupBy(*keys).agg(
        F.min(F.struct(*PLACE)).alias("edge"), F.count(F.lit(1)).alias("n")
    )
    edges = edges.select(*keys, F.col("edge.doc").alias("e_doc"), F.col("edge.part").alias("e_part"),
                         F.col("edge.at").alias("e_at"), "n")
    sure = found.where(F.col("kind") == ROW)
    open_ = found.where(F.col("kind").isin(FIRST_RUN, LAST_ROW)).join(F.broadcast(edges), keys)
    settled = open_.select(
        *columns, F.col("e_doc").alias("first_doc"), F.col("e_part").alias("first_part"), F.col("e_at").alias("first_at"),
        F.greatest("size", F.least(F.col("n"), F.lit(2)).cast("int")).alias("size"),
    )
    if earliest:  # a key that fills several partitions has its first place among the edges
        true = sure.join(F.broadcast(edges.drop("n")), keys, "left")
        known, edge = F.struct("first_doc", "first_part", "first_at"), F.struct(
            F.col("e_doc").alias("first_doc"), F.col("e_part").alias("first_part"), F.col("e_at").alias("first_at")
        )
        place = F.when(F.col("e_doc").isNotNull() & (edge < known), edge).otherwise(known)
        sure = true.withColumn("place", place).select(
            *columns, *(F.col(f"place.{c}").alias(c) for c, _ in firsts), "size"
        )
    every = sure.select(*settled.columns).unionByName(settled)
    again = ~((F.col("doc") == F.col("first_doc")) & (F.col("part") == F.col("first_part")) & (F.col("at") == F.col("first_at")))
    result = every.select("*", ((F.col("size") > 1) & again).alias("again"))
    return result if singles else result.where("size > 1")


def _one(held: dict, schema: pa.Schema, size: int, kind: int) -> pa.RecordBatch:
    values = [*held["row"], *held["first"], size, kind]
    return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)
