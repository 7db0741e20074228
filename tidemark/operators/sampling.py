"""Cutting streams of events into samples: ids, batches, triggers, gates, deltas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ranges


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str, large: bool = False) -> DataFrame:
    """rows with a contiguous number from 1 in each group. ``large`` groups are numbered in ranges of the
    order's first column, a number."""
    if not large:
        return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))
    parted = ranges.before(ranges.cut(rows, order[0]), by, {"_before": (F.count("*"), F.sum("_before"))})
    place = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order))
    return parted.withColumn(name, (place + F.coalesce("_before", F.lit(0))).cast("long")).drop("_range", "_before")


def batch_end(rows: DataFrame, by: list[str], time: str, order: list[str], gap_us: int = 100) -> DataFrame:
    """rows with ``batch_end``: the next row of the group is over gap_us later; false for the last."""
    ahead = F.lead(time).over(W.partitionBy(*by).orderBy(*order)) - F.col(time)
    return rows.withColumn("batch_end", F.coalesce(ahead > gap_us, F.lit(False)))


def triggers(rows: DataFrame, by: list[str], order: list[str], amount: Column, bucket_amount: int, bucket_us: int, level: str, time: str = "ts_us") -> DataFrame:
    """rows with amount, time and change triggers and the cut_index they add up to.

    The set form: a trigger fires where the running amount or the time enters a new bucket, or
    where the level differs from the row before. (The form that resets its window after each
    cut needs state: see streaming.)
    """
    w = W.partitionBy(*by).orderBy(*order)
    running = F.sum(amount).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_a", F.floor(running / bucket_amount)).withColumn("_t", F.floor(F.col(time) / bucket_us))
    moved = lambda c: F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(False))
    rows = rows.withColumn("amount_trigger", moved("_a")).withColumn("time_trigger", moved("_t")).withColumn("change_trigger", moved(level))
    cut = (F.col("amount_trigger") | F.col("time_trigger") | F.col("change_trigger")).cast("int")
    return rows.withColumn("cut_index", F.sum(cut).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_a", "_t")


def warmup(rows: DataFrame, number: str, n: int = 50) -> DataFrame:
    """rows with ``warming``: predict but do not trade for the first n of an instrument."""
    return rows.withColumn("warming", F.col(number) <= n)


def deltas(rows: DataFrame, by: list[str], order: list[str], columns: list[str], least: int | None = None) -> DataFrame:
    """rows with <column>_delta: cumulative values as steps; the first counts from 0."""
    w = W.partitionBy(*by).orderBy(*order)
    for c in columns:
        step = F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
        rows = rows.withColumn(f"{c}_delta", step if least is None else F.greatest(step, F.lit(least)))
    return rows


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def ended_once(updates: DataFrame, key: list[str], order: list[str], status: str, terminal: list[str]) -> DataFrame:
    """updates with ``applied``: false from the row after an order's first terminal state."""
    ended = F.max(F.col(status).isin(*terminal).cast("int")).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return updates.withColumn("applied", F.coalesce(ended, F.lit(0)) == 0)


def position_path(trades: DataFrame, by: list[str], order: list[str], sign: Column, volume: str = "volume") -> DataFrame:
    """trades with running bought and sold volumes and the position."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = trades.withColumn("bought", F.sum(F.when(sign > 0, F.col(volume)).otherwise(0)).over(w)).withColumn("sold", F.sum(F.when(sign < 0, F.col(volume)).otherwise(0)).over(w))
    return rows.withColumn("position", F.col("bought") - F.col("sold"))


def filled(rows: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """rows with the column's last known value."""
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def throttled(rows: DataFrame, by: list[str], time: str, order: list[str], min_gap: int, reject: str | None = None, block: int = 0) -> DataFrame:
    """rows with ``blocked``: less than min_gap after the last row of its key that was let through,
    or less than ``block`` after a reject.

    ``reject``: a boolean column; rows where it is true are answers, not requests. One that
    follows a row let through, and no other answer to it, blocks its key; any other is ignored.
    Answers are never blocked themselves.

    What a row meets depends on all decisions before it, so each key's rows are walked in order,
    batch by batch; what is kept between batches is one key, two times and whether an answer
    is still open. ``time`` is a long without nulls and the first column of ``order``.
    """
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = free = asked = None  # free: the time from which the key is open
        for batch in batches:
            at = batch.column(time).to_numpy()
            answers = np.zeros(len(at), bool) if reject is None else batch.column(reject).fill_null(False).to_numpy(zero_copy_only=False)
            keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            passed = answers.copy()
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if keys[a] != key:
                    key, free, asked = keys[a], None, False
                requests, rejects = a + np.flatnonzero(~answers[a:b]), a + np.flatnonzero(answers[a:b])
                i = a
                while i < b:  # from one row let through, or one answer to it, to the next
                    opens = i if free is None else max(i, a + int(np.searchsorted(at[a:b], free)))
                    k = int(np.searchsorted(requests, opens))
                    request = int(requests[k]) if k < len(requests) else b
                    k = int(np.searchsorted(rejects, i)) if asked else len(rejects)
                    if k < len(rejects) and rejects[k] < request:
                        i, asked = int(rejects[k]), False
                        free = max(free, int(at[i]) + block)
                    elif request < b:
                        i, asked, passed[request] = request, True, True
                        free = int(at[i]) + min_gap
                    else:
                        break
                    i += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(~passed)], [*batch.schema.names, "blocked"])

    return dealt.mapInArrow(walk, T.StructType([*rows.schema.fields, T.StructField("blocked", T.BooleanType())]))


def rolling_volume(rows: DataFrame, by: list[str], time: str, span: int, volume: str = "volume") -> DataFrame:
    """rows with the volume of the last ``span`` time units, their own included."""
    w = W.partitionBy(*by).orderBy(time).rangeBetween(-span, 0)
    return rows.withColumn("window_volume", F.sum(volume).over(w))


def sessions(rows: DataFrame, by: list[str], time: Column, gap: str) -> DataFrame:
    """(by, start, end, n): batches of rows whose gaps are at most ``gap``."""
    return rows.groupBy(*by, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
