"""Daily static data and positions: cleaning, universe, inheritance, health, routing, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import exclusion_reason, format_decimal


def clean_free_share(raw: DataFrame, code: str = "ts_code", value: str = "free_share") -> DataFrame:
    """(code, free_share, copies) of rows with a code of the six Shenzhen prefixes and a finite
    positive value; copies over 1 marks a duplicate, which is an error."""
    c = F.upper(F.trim(code))
    x = F.col(value).try_cast("double")
    rows = raw.select(c.alias("code"), x.alias("x")).where(F.col("code").rlike("^(000|001|002|003|300|301)[0-9]{3}\\.SZ$") & (F.col("x") > 0) & ~F.isnan("x") & (F.col("x") != float("inf")))
    return rows.select("code", format_decimal("x").alias("free_share"), F.count("*").over(W.partitionBy("code")).alias("copies"))


def universe_audit(candidates: DataFrame, name: str = "name") -> DataFrame:
    """One row: accepted, rejected, candidates and the rejected ones by reason."""
    rows = candidates.withColumn("reason", exclusion_reason(name))
    by = [F.count_if(F.col("reason") == r).alias(r) for r in ("delisting", "new_listing", "st")]
    return rows.agg(F.count_if(F.col("reason") == "keep").alias("accepted"), F.count_if(F.col("reason") != "keep").alias("rejected"), F.count("*").alias("candidates"), *by)


def inherit_positions(universe: DataFrame, prior: DataFrame, key: str = "symbol", column: str = "static_position") -> DataFrame:
    """The universe with prior positions, 0 where there is none."""
    held = prior.where(F.col(column) != 0).select(key, column)
    return universe.join(held, key, "left").withColumn(column, F.coalesce(column, F.lit(0)))


def orphan_positions(universe: DataFrame, prior: DataFrame, key: str = "symbol", column: str = "static_position") -> DataFrame:
    """Prior positions that the universe does not hold; must be empty."""
    return prior.where(F.col(column) != 0).select(key).join(universe, key, "left_anti").distinct()


def startup_sync(params: DataFrame, broker: DataFrame, now: Column, cutoff: int, key: str = "symbol") -> DataFrame:
    """params with broker positions; symbols without one are gated before the cutoff and 0 after."""
    rows = params.join(broker.select(key, F.col("total_position").alias("_total"), F.col("available_position").alias("_available")), key, "left")
    late, known = now >= cutoff, F.col("_total").isNotNull()
    zero = lambda c: F.when(known, F.col(c)).when(late, 0)
    return rows.withColumn("total", zero("_total")).withColumn("available", zero("_available")).withColumn("gated", ~known & ~late).drop("_total", "_available")


def can_trade(symbols: DataFrame, shards: DataFrame, feeds: DataFrame, td: DataFrame) -> DataFrame:
    """Per symbol new_risk, reduce_risk and the first reason that restricts it.

    shards and feeds (one row per shard) and td (one row) are small by nature: joined by key,
    and left to the optimizer, which broadcasts them by their size.
    """
    rows = symbols.join(shards, "shard", "left").join(feeds, "shard", "left").join(td, "td_id", "left")
    feed_bad = F.coalesce(F.col("feed_state"), F.lit("missing")) != "healthy"
    not_ready = ~F.coalesce(F.col("ready") & F.col("td_ready"), F.lit(False))
    degraded = F.coalesce(F.col("journal_state"), F.lit("missing")) != "healthy"
    reason = F.when(feed_bad, "feed").when(not_ready, "not_ready").when(degraded, "journal").otherwise("ok")
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("new_risk", F.col("reason") == "ok").withColumn("reduce_risk", F.col("reason").isin("ok", "journal"))


def route(events: DataFrame, assignments: DataFrame, key: str = "symbol") -> DataFrame:
    """events with their shard; null where no assignment exists."""
    return events.join(assignments.select(key, F.col("shard").alias("shard_id")), key, "left")


def shared_symbols(assignments: DataFrame, key: str = "symbol", shard: str = "shard") -> DataFrame:
    """Symbols that more than one shard owns; must be empty."""
    return assignments.groupBy(key).agg(F.countDistinct(shard).alias("shards")).where("shards > 1")


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """Message of the first rule that does not hold (null counts as not), else null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), message) for ok, message in rules])


def last_status(updates: DataFrame, key: str, status: str, order: Column, terminal: list[str]) -> DataFrame:
    """The last status of each order that has not ended."""
    return updates.groupBy(key).agg(F.max_by(status, order).alias("status")).where(~F.col("status").isin(*terminal))
