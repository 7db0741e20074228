"""Summaries: percentiles by index, latencies, counters, bars, audits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ranges
from tidemark.sources.shared import written

#: Index of a percentile among n sorted values, from 0: three rules are in use.
RULES = {"ceil": lambda n, p: F.ceil((n - 1) * p), "floor": lambda n, p: F.floor((n - 1) * p), "round": lambda n, p: F.bround((n - 1) * p).cast("long")}


#: Share of a group's rows on either side of a wanted place that are put in order to find it.
MARGIN = 0.002
#: Groups (their key and a few numbers each) up to which a table of them is broadcast.
BROADCAST_GROUPS = 10_000


def _beside(rows: DataFrame, facts: DataFrame, by: list[str], few: bool) -> DataFrame:
    """rows with the facts of their group; null keys meet null keys."""
    named = facts.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return rows.join(F.broadcast(named) if few else named, same).drop(*[f"_by_{c}" for c in by])


def at_places(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, Callable[[Column], Column]]], beside: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Per group its number ``_n`` of values that are not null, and those at exact places of their
    order: name -> (about which share of them is before, place from 0 as a function of ``_n``);
    ``beside``: further aggregates of the value, taken with the first pass.

    No group is ordered whole. Approximate percentiles, which are aggregated before the shuffle,
    part each group into ranges with two bounds about each place; counts by range tell which ones
    hold the places, and only their values are shuffled, counted by value and ordered. Bounds
    that are off cost time, not exactness. Ties are counted, so a frequent value is one row.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    if rows.limit(ranges.SMALL_ROWS + 1).count() <= ranges.SMALL_ROWS:  # one ordinary window
        group = W.partitionBy(*by)
        ranked = rows.select("*", F.row_number().over(group.orderBy("_v")).alias("_i"), F.count("*").over(group).alias("_n"))
        picks = [F.max(F.when(F.col("_i") == place(F.col("_n")) + 1, F.col("_v"))).alias(name) for name, (_, place) in wanted.items()]
        return ranked.groupBy(*by, "_n").agg(*picks, *[f(F.col("_v")).alias(n) for n, f in (beside or {}).items()])
    shares = sorted({min(max(p + m, 0.0), 1.0) for p, _ in wanted.values() for m in (-MARGIN, MARGIN)})
    more = beside or {}
    bounds = written(rows.groupBy(*by).agg(F.percentile_approx("_v", shares, 10_000).alias("_bounds"), *[f(F.col("_v")).alias(n) for n, f in more.items()]))
    few = bounds.count() <= BROADCAST_GROUPS
    cell = reduce(Column.__add__, [(F.col("_v") >= F.col("_bounds")[i]).cast("int") for i in range(len(shares))])
    celled = _beside(rows, bounds.select(*by, "_bounds"), by, few).select(*by, "_v", cell.alias("_cell"))

    group = W.partitionBy(*by)
    sizes = celled.groupBy(*by, "_cell").agg(F.count("*").alias("_size"))
    sizes = sizes.select(*by, "_cell", "_size", F.sum("_size").over(group).alias("_n"), (F.sum("_size").over(group.orderBy("_cell")) - F.col("_size")).alias("_before"))
    places = {name: place(F.col("_n")) for name, (_, place) in wanted.items()}
    holds = reduce(Column.__or__, [(x >= F.col("_before")) & (x < F.col("_before") + F.col("_size")) for x in places.values()])
    held = sizes.where(holds).select(*by, "_cell", "_n", "_before")

    inside = _beside(celled, held, [*by, "_cell"], few).groupBy(*by, "_cell", "_n", "_before", "_v").agg(F.count("*").alias("_k"))
    upto = F.col("_before") + F.sum("_k").over(W.partitionBy(*by, "_cell").orderBy("_v"))
    inside = inside.withColumn("_upto", upto)
    picks = [F.max(F.when((x >= F.col("_upto") - F.col("_k")) & (x < F.col("_upto")), F.col("_v"))).alias(name) for name, x in places.items()]
    found = inside.groupBy(*by, "_n").agg(*picks)
    return _beside(found, bounds.drop("_bounds"), by, few) if more else found


def rank_percentiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Per group exact percentiles: name -> (p, rule). Nulls do not count."""
    return at_places(rows, by, value, {name: (p, lambda n, p=p, rule=rule: RULES[rule](n, F.lit(p))) for name, (p, rule) in wanted.items()}).drop("_n")


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, p50 at (n-1)/2, p99 at (n-1)*99/100 (whole division), max; nulls do not count."""
    whole = lambda num, den: lambda n: F.floor((n - 1) * num / den)
    placed = at_places(rows, by, value, {"p50": (0.5, whole(1, 2)), "p99": (0.99, whole(99, 100))}, {"mean": F.avg, "max": F.max})
    return placed.select(*by, F.col("_n").alias("n"), "mean", "p50", "p99", "max")


def gaps(rows: DataFrame, by: list[str], time: str) -> DataFrame:
    """rows with ``gap`` to the time before in the group. A group may be large: it is read in ranges of
    time, and the last time of the ranges before is carried over."""
    parted = ranges.before(ranges.cut(rows, time), by, {"_earlier": (F.max(time), F.max("_earlier"))})
    inside = F.lag(time).over(W.partitionBy(*by, "_range").orderBy(time))
    return parted.withColumn("gap", F.col(time) - F.coalesce(inside, F.col("_earlier"))).drop("_range", "_earlier")


def gap_metrics(rows: DataFrame, by: list[str], time: str, limit: int) -> DataFrame:
    """Per group: rows, gaps of more than ``limit``, the greatest gap."""
    return gaps(rows, by, time).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("gap") > limit).alias("gaps"), F.max("gap").alias("longest"))


def channel_stats(rows: DataFrame, channel: str, time: str) -> DataFrame:
    """Per channel: rows, first and last time, median and p99 of the gaps (round rule)."""
    base = rows.groupBy(channel).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return base.join(rank_percentiles(gaps(rows, [channel], time), [channel], "gap", {"gap_median": (0.5, "round"), "gap_p99": (0.99, "round")}), channel, "left")


def bars(trades: DataFrame, interval_s: int, start_s: int, end_s: int, by: str = "symbol", time: str = "ts_us", price: str = "price", volume: str = "volume", tie: str = "sequence") -> DataFrame:
    """OHLC, volume and turnover per interval within a time of day."""
    of_day = F.col(time) % 86_400_000_000
    inside = trades.where((of_day >= start_s * 1_000_000) & (of_day < end_s * 1_000_000))
    step = interval_s * 1_000_000
    place = F.struct(time, tie)
    return inside.groupBy(by, (F.floor(F.col(time) / step) * step).alias("bar_us")).agg(
        F.min_by(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, place).alias("close"),
        F.sum(volume).alias("volume"), F.sum(F.col(price) * F.col(volume)).alias("turnover"))


def ticker_pnl(trades: DataFrame, fee: float, by: str = "symbol", sign: str = "sign", price: str = "price", volume: str = "volume", place: Column | None = None) -> DataFrame:
    """Cash flow plus position at the last price, less fees (our rule)."""
    place = place if place is not None else F.struct("ts_us", "sequence")
    amount = F.col(price) * F.col(volume)
    out = trades.groupBy(by).agg(F.sum(-F.col(sign) * amount).alias("cash"), F.sum(F.col(sign) * F.col(volume)).alias("position"), F.max_by(price, place).alias("last"), F.sum(amount).alias("turnover"))
    return out.select(by, "position", (F.col("cash") + F.col("position") * F.col("last") - fee * F.col("turnover")).alias("pnl"))


def sequence_audit(rows: DataFrame, by: list[str], seq: str, order: list[str]) -> DataFrame:
    """rows with the step from the greatest sequence before: ok (1), duplicate (0 or less) or
    gap (more), and the number of missing events. A group (a shard, say) may be large: it is read in
    ranges of the order's first column, a number."""
    parted = ranges.before(ranges.cut(rows, order[0]), by, {"_seen": (F.max(seq), F.max("_seen"))})
    inside = F.max(seq).over(W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    parted = parted.withColumn("_step", F.col(seq) - F.greatest(inside, F.col("_seen"))).drop("_range", "_seen")
    step = F.col("_step")
    state = F.when(step.isNull() | (step == 1), "ok").when(step <= 0, "duplicate").otherwise("gap")
    return parted.withColumn("state", state).withColumn("missing", F.when(step > 1, step - 1).otherwise(0)).drop("_step")
