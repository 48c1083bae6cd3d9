"""Running totals and ranks over any number of rows without a one-task window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.session import materialise

#: Keys per window task. With two levels of blocks, the last window sees one row per FAN_OUT ** 2 keys.
FAN_OUT = 4096


def running_offset(
    df: DataFrame, order: str, amount: str, out: str, fan_out: int = FAN_OUT, levels: int = 2
) -> DataFrame:
    """``(order, out)``: sum of ``amount`` over all rows with a smaller ``order``, a unique integer.

    Keys are summed up in blocks of ``fan_out``, the blocks' own offsets are found the same way and added to the
    running sum inside each block, so no task sees more than ``fan_out`` keys until ``levels`` are used up.
    """
    frame = (Window.unboundedPreceding, -1)
    if levels == 0:
        before = F.sum(amount).over(Window.orderBy(order).rowsBetween(*frame))
        return df.select(order, F.coalesce(before, F.lit(0)).cast("long").alias(out))
    block, start = f"_block_{levels}", f"_start_{levels}"
    keyed = df.select(order, amount, F.expr(f"`{order}` div {fan_out}L").alias(block))
    totals = keyed.groupBy(block).agg(F.sum(amount).alias(amount))
    starts = running_offset(totals, block, amount, start, fan_out, levels - 1)
    inside = Window.partitionBy(block).orderBy(order).rowsBetween(*frame)
    within = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return (
        keyed.select(order, block, within.alias("_within"))
        .join(starts, block)
        .select(order, (F.col("_within") + F.col(start)).cast("long").alias(out))
    )


def ordered_offsets(df: DataFrame, order: str, amount: str, out: str, partitions: int | None = None) -> DataFrame:
    """``(order, out)``: sum of ``amount`` (null: 0) over all rows with a smaller ``order``, a unique value.

    One pass: rows are range-partitioned by ``order`` and sorted inside their partition, each task adds up its own
    rows, and the totals of the partitions (one number each) give every partition its offset, which is added by
    partition number. The input is read once, written, and only the written copy is sampled and partitioned; keys
    may be sparse, negative or very large, as only their order counts.
    """
    spark = df.sparkSession
    keyed = materialise(df.select(order, F.coalesce(F.col(amount), F.lit(0)).cast("long").alias("_amount")))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    key_type = keyed.schema[order].dataType.simpleString()

    def running(batches):
        total = 0
        for batch in batches:
            amounts = batch.column("_amount").to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(amounts) - amounts + total
            total += int(amounts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(order), batch.column("_part"), batch.column("_amount"), pa.array(before)],
                [order, "_part", "_amount", "_within"],
            )

    within = materialise(
        ranged.mapInArrow(running, f"`{order}` {key_type}, _part int, _amount long, _within long")
    )
    totals = sorted((r["_part"], r["_sum"]) for r in within.groupBy("_part").agg(F.sum("_amount").alias("_sum")).collect())
    offsets, start = [], 0
    for part, total in totals:
        offsets.append((part, start))
        start += total
    table = spark.createDataFrame(offsets, "_part int, _offset long")
    return within.join(F.broadcast(table), "_part").select(order, (F.col("_within") + F.col("_offset")).alias(out))


#: Up to this many rows a plain top-n is cheaper than ranking everything.
TOP_N_ROWS = 10_000


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest ``order``, a unique integer; large ``n`` is ranked block by block."""
    if n <= TOP_N_ROWS:
        return df.orderBy(order).limit(n)
    ranks = running_offset(df.select(order, F.lit(1).alias("_one")), order, "_one", "_rank")
    return df.join(ranks.where(F.col("_rank") < n).select(order), order, "left_semi")
