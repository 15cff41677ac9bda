"""Prefix sums of a table in a stated order, in two levels.

The rows are dealt by ranges of the whole order, so no key is too hot: one that
holds a third of all rows takes a third of the partitions. Each partition runs its
own sums, and what stands before a partition comes from one row for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import cut

#: Where a row stands in its partition, which, whether the partition's first segment still runs, and that of the row.
PLACE = ["s_part", "s_at", "s_open"]


def started(keys: np.ndarray, before: int | None) -> np.ndarray:
    """For each row where the last segment began that is not after it; -1 where it began in an earlier batch."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[0] = before is None or keys[0] != before
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))


def scanned(df: DataFrame, by: list[str], sums: dict[str, str], xors: dict[str, str] | None = None, segment: str | None = None) -> DataFrame:
    """``df`` with, for each ``new: old`` of ``sums`` and ``xors``, the running sum (or exclusive or) of ``old`` up to the row, itself included.

    ``by`` is the order, nulls first; rows equal in all of it are in any one order.
    With a ``segment``, a column of longs without null that leads ``by``, sums begin
    anew with each of its values. ``old`` columns are longs without null. The
    result is checkpointed. An empty table stays empty.
    """
    xors = xors or {}
    sources, adds = [*sums.values(), *xors.values()], [np.add] * len(sums) + [np.bitwise_xor] * len(xors)
    back = [np.subtract] * len(sums) + [np.bitwise_xor] * len(xors)
    made = [*sums, *xors]
    schema = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in made), StructField(PLACE[0], LongType()), StructField(PLACE[1], LongType()), StructField(PLACE[2], BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        totals, last, at, whole = [np.int64(0)] * len(made), None, 0, True
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = np.zeros(n, np.int64) if segment is None else batch.column(batch.schema.get_field_index(segment)).to_numpy(zero_copy_only=False)
            begun = started(keys, last)
            out = []
            for k, (source, add, less) in enumerate(zip(sources, adds, back, strict=True)):
                values = batch.column(batch.schema.get_field_index(source)).to_numpy(zero_copy_only=False).astype(np.int64)
                run = add.accumulate(values)
                before = np.where(begun > 0, run[np.maximum(begun, 1) - 1], 0) if n > 1 else np.zeros(1, np.int64)
                here = np.where(begun >= 0, less(run, before), add(run, totals[k]))
                totals[k] = here[-1]
                out.append(pa.array(here))
            if last is None:
                last = int(keys[0])
                first = last
            open_ = (keys == first) & whole
            whole = bool(open_[-1])
            last = int(keys[-1])
            place = [pa.array(np.full(n, part)), pa.array(np.arange(at, at + n)), pa.array(open_)]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, *place], names=[*batch.schema.names, *made, *PLACE])

    here = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema))
    tail = F.max_by(F.struct(F.lit(0).cast("long").alias("key") if segment is None else F.col(segment).alias("key"), *made, "s_open"), "s_at")
    head = F.lit(0).cast("long") if segment is None else F.min_by(segment, "s_at")
    parts = here.groupBy("s_part").agg(tail.alias("tail"), head.alias("head")).orderBy("s_part").collect()
    carried, rows = None, []
    for p in parts:
        goes_on = carried is not None and carried[0] == p["head"]
        carry = carried[1] if goes_on else [0] * len(made)
        rows.append((p["s_part"], *carry))
        own = [p["tail"][c] for c in made]
        total = [int(add(np.int64(x), np.int64(y))) for add, x, y in zip(adds, own, carry, strict=True)] if p["tail"]["s_open"] else own
        carried = (p["tail"]["key"], total)
    offsets = df.sparkSession.createDataFrame(rows, StructType([StructField("s_part", LongType()), *(StructField(f"before_{c}", LongType()) for c in made)]))
    joined = here.join(F.broadcast(offsets), "s_part")  # a row for each partition
    whole = lambda c: F.col(c).bitwiseXOR(F.col(f"before_{c}")) if c in xors else F.col(c) + F.col(f"before_{c}")
    return joined.select(*df.columns, *(F.when(F.col("s_open"), whole(c)).otherwise(F.col(c)).alias(c) for c in made))
