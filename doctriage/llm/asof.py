"""As-of joins: the latest earlier state of a key, for every row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from doctriage.session import stage


def carry_forward(
    rows: DataFrame, key: str, order: list[str], is_state: Column, state: list[str]
) -> DataFrame:
    """``rows`` with ``carried``: the ``state`` columns of the last state row that precedes each row
    among the rows of its key, in ``order`` (ascending, nulls first); null if there is none.

    Rows are dealt out by ranges of (key, order), so a key of any size spreads over as many tasks
    as its rows need, and each task walks its sorted rows in batches.  What a task must know of the
    tasks before it is one state per range, handed on in a table of one row per range.
    The key must be a non-null string.  The result is a table in the shared folder.
    """
    marked = rows.withColumn("_is_state", F.coalesce(is_state, F.lit(False)))
    by = [key, *order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    fields = {f.name: f for f in rows.schema.fields}
    carried = StructType([fields[name] for name in state])
    schema = StructType(
        [StructField(f.name, f.dataType) for f in rows.schema.fields]
        + [
            StructField("_is_state", BooleanType()),
            StructField("carried", carried),
            StructField("_range", IntegerType()),
            StructField("_tail", BooleanType()),
        ]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        last: pa.Table | None = None  # the last row's key, and the state that follows from it
        known = False
        for batch in batches:
            if not batch.num_rows:
                continue
            # The state so far stands in front of the batch as one more row.
            table = pa.Table.from_batches([batch])
            if last is not None:
                table = pa.concat_tables([last, table])
            table = table.combine_chunks()
            count, extra = table.num_rows, 0 if last is None else 1
            codes = table[key].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            group = np.repeat(starts, np.diff(np.append(starts, count)))
            has = table["_is_state"].to_numpy(zero_copy_only=False).astype(bool).copy()
            if extra:
                has[0] = known
            upto = np.maximum.accumulate(np.where(has, np.arange(count), -1))
            before = np.concatenate([[-1], upto[:-1]])
            before = np.where(before >= group, before, -1)
            taken = pa.array(np.maximum(before, 0)[extra:])
            values = [table[name].combine_chunks().take(taken) for name in state]
            none = pa.array(before[extra:] < 0)
            found = pa.StructArray.from_arrays(values, names=state, mask=none)
            out = table.slice(extra)
            rows_out = out.num_rows
            out = out.append_column("carried", found)
            out = out.append_column("_range", pa.array(np.full(rows_out, own, np.int32)))
            out = out.append_column("_tail", pa.array(np.zeros(rows_out, bool)))
            yield from out.to_batches()
            known = bool(upto[-1] >= group[-1])
            # The key of the last row with the columns of its latest state.
            last = table.slice(int(upto[-1]) if known else count - 1, 1)
        if last is not None:
            values = [last[name].combine_chunks() for name in state]
            mask = pa.array([not known])
            tail = last.append_column("carried", pa.StructArray.from_arrays(values, names=state, mask=mask))
            tail = tail.append_column("_range", pa.array([own], pa.int32()))
            tail = tail.append_column("_tail", pa.array([True]))
            yield from tail.to_batches()

    walked = stage(dealt.mapInArrow(walk, schema), "walked")
    # One row per range: its last key and the state after it, which may stem from earlier ranges.
    tails = walked.filter("_tail").select("_range", F.col(key).alias("_key"), "carried")
    spanning = Window.partitionBy("_key").orderBy("_range")
    tails = tails.withColumn("_after", F.last("carried", ignorenulls=True).over(spanning))
    ranges = Window.orderBy("_range")
    handed = tails.select(
        F.col("_range"),
        F.lag("_key").over(ranges).alias("_from"),
        F.lag("_after").over(ranges).alias("_handed"),
    )
    # As many rows as ranges.
    handed = handed.filter("_handed IS NOT NULL").withColumnRenamed("_range", "_into")
    same = (F.col("_range") == F.col("_into")) & (F.col(key) == F.col("_from"))
    joined = walked.filter("NOT _tail").join(F.broadcast(handed), same, "left")
    return joined.select(*rows.columns, F.coalesce("carried", "_handed").alias("carried"))
