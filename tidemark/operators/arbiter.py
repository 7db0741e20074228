"""Arbitration between two prediction sources, as windows over all updates of a symbol.

An update is accepted if it is valid, its day is not older than any accepted day before
it, and its time is not older than any accepted time of its source on that day. A newer
day forgets everything before it. Since an accepted time is the greatest so far, being
accepted is the same as reaching a running maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import valid_candidate

FULL, SNAPSHOT = 1, 2


def accepted(updates: DataFrame, order: str = "arrival") -> DataFrame:
    """updates with ``accepted``."""
    before = W.partitionBy("symbol").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ok = valid_candidate()
    rows = updates.withColumn("_ok", ok).withColumn("_day", F.max(F.when(F.col("_ok"), F.col("trading_day"))).over(before))
    rows = rows.withColumn("_ok", F.col("_ok") & (F.col("trading_day") == F.col("_day")))
    of_source = W.partitionBy("symbol", "trading_day", "source").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    newest = F.max(F.when(F.col("_ok"), F.col("exchange_time_us"))).over(of_source)
    return rows.withColumn("accepted", F.coalesce(F.col("_ok") & (F.col("exchange_time_us") == newest), F.lit(False))).drop("_ok")


def arbitrate(updates: DataFrame, order: str = "arrival", max_age_us: int = 4_000_000, epsilon: float = 0.01) -> DataFrame:
    """updates with ``accepted``, the ``selected`` source (null if none is ready) and its sequence.

    A source is fresh if its last accepted update is of the day and within max_age_us of the
    newest. The full book is chosen if it is usable and the snapshot is not fresh or has no
    greater turnover (by more than epsilon); else a fresh snapshot.
    """
    rows = accepted(updates, order)
    # _day is the newest accepted day; updates of older days change nothing and see its state.
    state = W.partitionBy("symbol", "_day").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    seen = lambda s: F.last(F.when(F.col("accepted") & (F.col("source") == s), F.struct("exchange_time_us", "turnover", "sequence")), ignorenulls=True).over(state)
    newest = F.max(F.when(F.col("accepted"), F.col("exchange_time_us"))).over(state)
    rows = rows.withColumn("full", seen(FULL)).withColumn("snap", seen(SNAPSHOT)).withColumn("newest", newest)
    fresh = lambda c: F.coalesce(F.col("newest") - F.col(f"{c}.exchange_time_us") <= max_age_us, F.lit(False))
    full_usable = F.col("full_runtime_valid") & fresh("full")
    wins = full_usable & (~fresh("snap") | F.coalesce(F.col("full.turnover") + epsilon >= F.col("snap.turnover"), F.lit(False)))
    selected = F.when(wins, FULL).when(fresh("snap"), SNAPSHOT)
    rows = rows.withColumn("selected", selected)
    sequence = F.when(F.col("selected") == FULL, F.col("full.sequence")).when(F.col("selected") == SNAPSHOT, F.col("snap.sequence"))
    return rows.withColumn("selected_sequence", sequence).drop("full", "snap", "newest")


def dispatch_once(rows: DataFrame, order: str = "arrival") -> DataFrame:
    """The ready rows whose (source, sequence) differs from that of the last dispatched one."""
    ready = rows.where("selected is not null").withColumn("_pick", F.struct("selected", "selected_sequence"))
    last = F.lag("_pick").over(W.partitionBy("symbol", "_day").orderBy(order))
    return ready.withColumn("_last", last).where("_last is null or _last <> _pick").drop("_last", "_pick")
