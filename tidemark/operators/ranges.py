"""Groups that may hold a large share of all rows, cut into ranges of their order.

A window over such a group is one task. Here it runs inside (group, range), and what a row needs
of the ranges before or after its own is aggregated to one row per range and added by an
equi-join. Ranges are bounded by approximate quantiles over all rows, as many as there are
shuffle partitions: a range holds about that part of the rows at most, whatever the groups' sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows up to which one range holds all: a window over them is a small task, whatever the groups.
SMALL_ROWS = 500_000


def cut(rows: DataFrame, value: str, name: str = "_range") -> DataFrame:
    """rows with the number of the range of ``value``, a number; nulls come first, as in a sort.
    Equal values share a range. Of few rows all share one, which its metadata say."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.count("*").alias("n"), F.percentile_approx(value, [i / n for i in range(1, n)] or [0.5], 10 * n).alias("ends")).first()
    if found["n"] <= SMALL_ROWS or n == 1:
        return rows.withColumn(name, F.lit(0)).withMetadata(name, {"single": True})
    at = F.when(F.col(value).isNull(), -1)
    bounds = F.array(*[F.lit(x) for x in sorted(set(found["ends"] or []))])
    return rows.withColumn(name, at.otherwise(F.size(F.filter(bounds, lambda x: x < F.col(value)))))


def before(rows: DataFrame, by: list[str], facts: dict[str, tuple[Column, Column]], name: str = "_range", later: bool = False) -> DataFrame:
    """rows with, per fact (an aggregate of a range, an aggregate of ``facts`` by their name), its value
    over the ranges of the group before a row's own, or after it; null where there are none."""
    each = rows.groupBy(*by, name).agg(*[one.alias(n) for n, (one, _) in facts.items()])
    if rows.schema[name].metadata.get("single"):
        return rows.withColumns({n: F.lit(None).cast(each.schema[n].dataType) for n in facts})
    frame = W.partitionBy(*by).orderBy(F.desc(name) if later else name).rowsBetween(W.unboundedPreceding, -1)
    carried = each.select(*[F.col(c).alias(f"_by_{c}") for c in [*by, name]], *[over.over(frame).alias(n) for n, (_, over) in facts.items()])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in [*by, name]])
    return rows.join(carried, same).drop(*[f"_by_{c}" for c in [*by, name]])
