"""As-of joins by one union and window functions: no inequality join, one shuffle by key.

What comes next is read with the order turned round, as the last value so far: a frame
from the current row onwards would be computed anew for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ranges


def nearest(left: DataFrame, right: DataFrame, by: list[str], time: str = "ts_us") -> DataFrame:
    """left with ``delta``: the least absolute distance in time to the last row of right at or
    before it and to the next one after it; null where right has no row of the key. A key (a shard,
    say) may hold many rows: it is read in ranges of time."""
    both = left.withColumn("_other", F.lit(None).cast("long")).unionByName(right.select(*by, time, F.col(time).alias("_other")), allowMissingColumns=True)
    both = both.withColumn("_rank", F.col("_other").isNull().cast("int"))  # at equal times right comes first
    both = ranges.before(ranges.cut(both, time), by, {"_earlier": (F.max("_other"), F.max("_earlier"))})
    both = ranges.before(both, by, {"_later": (F.min("_other"), F.min("_later"))}, later=True)
    key = W.partitionBy(*by, "_range")
    last = F.last("_other", ignorenulls=True)
    before = F.coalesce(last.over(key.orderBy(time, "_rank").rowsBetween(W.unboundedPreceding, 0)), F.col("_earlier"))
    after = F.coalesce(last.over(key.orderBy(F.desc(time), F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)), F.col("_later"))
    delta = F.least(F.abs(F.col(time) - before), F.abs(F.col(time) - after))
    return both.withColumn("delta", delta).where("_rank = 1").drop("_other", "_rank", "_range", "_earlier", "_later")


def nearest_by_key(left: DataFrame, right: DataFrame, by: list[str], time: str = "ts_us") -> DataFrame:
    """As ``nearest`` with ``status``: ok for rows of keys that both sides have; a key that only one side
    has is a single row of its own with status insufficient and nothing else."""
    keys = left.groupBy(*by).agg(F.lit(True).alias("_l")).join(right.groupBy(*by).agg(F.lit(True).alias("_r")), by, "full_outer")
    alone = keys.where("_l is null or _r is null").select(*by, F.lit("insufficient").alias("status"))
    return nearest(left, right, by, time).where("delta is not null").withColumn("status", F.lit("ok")).unionByName(alone, allowMissingColumns=True)


def forward(left: DataFrame, right: DataFrame, by: list[str], value: str, horizons: dict[str, int], time: str = "ts_us", tie: str = "sequence") -> DataFrame:
    """left with a column per horizon: right's ``value`` at its first row at or after time + horizon,
    of equal times the row of the smallest ``tie``."""
    out = left
    for name, ahead in horizons.items():
        asks = out.withColumn("_at", F.col(time) + ahead).withColumn("_rank", F.lit(0)).withColumn("_tie", F.lit(None).cast("long")).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
        rows = right.select(*by, F.col(time).alias("_at"), F.lit(1).alias("_rank"), F.col(tie).cast("long").alias("_tie"), F.col(value).alias("_value"))
        order = W.partitionBy(*by).orderBy(F.desc("_at"), F.desc("_rank"), F.desc("_tie")).rowsBetween(W.unboundedPreceding, 0)
        both = asks.unionByName(rows, allowMissingColumns=True).withColumn(name, F.last("_value", ignorenulls=True).over(order))
        out = both.where("_rank = 0").drop("_at", "_rank", "_tie", "_value")
    return out


def previous_pair(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """rows with ``previous``: a struct of the columns of the row before it, null for the first."""
    return rows.withColumn("previous", F.lag(F.struct(*columns)).over(W.partitionBy(*by).orderBy(*order)))


def last_before(left: DataFrame, right: DataFrame, by: list[str], value: str, time: str = "ts_us") -> DataFrame:
    """left with right's last ``value`` at or before its time; of equal times the greatest value."""
    both = left.withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).withColumn("_rank", F.lit(1)).unionByName(
        right.select(*by, time, F.col(value).alias("_value"), F.lit(0).alias("_rank")), allowMissingColumns=True)
    order = W.partitionBy(*by).orderBy(time, "_rank", "_value").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(order)).where("_rank = 1").drop("_value", "_rank")
