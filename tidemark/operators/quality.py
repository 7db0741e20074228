"""Comparison of two runs: row alignment, tolerances, first divergence, replay checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Within max(rtol * max(|a|, |b|), atol); NaN equals NaN, null equals null."""
    both_nan = F.isnan(a) & F.isnan(b)
    near = F.abs(a - b) <= F.greatest(rtol * F.greatest(F.abs(a), F.abs(b)), F.lit(atol))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(both_nan | near)


def align(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Both runs side by side as structs e and a, by key; a side is null where it has no row."""
    names = [c for c in expected.columns if c not in key]
    left, right = expected.select(*key, F.struct(*names).alias("e")), actual.select(*key, F.struct(*names).alias("a"))
    return left.join(right, key, "full_outer")


def field_errors(aligned: DataFrame, key: list[str], exact: list[str], prediction: str, numeric: list[str], rtol: float = 1e-5, prediction_tol: float = 1e-3, factor_tol: float = 1e-6) -> DataFrame:
    """Long form: (key, priority, field, category, equal, error) of every field of every row."""
    rows = [F.struct(F.lit(0).alias("priority"), F.lit("row").alias("field"), F.lit("ordering").alias("category"), (F.col("e").isNotNull() & F.col("a").isNotNull()).alias("equal"), F.lit(None).cast("double").alias("error"))]
    present = F.col("e").isNotNull() & F.col("a").isNotNull()
    for i, c in enumerate([*exact, prediction, *numeric], 1):
        e, a = F.col(f"e.{c}"), F.col(f"a.{c}")
        if c in exact:
            same, error, kind = e.eqNullSafe(a), F.lit(None).cast("double"), "exact"
        else:
            same, error, kind = close(e, a, 0.0 if c == prediction else rtol, prediction_tol if c == prediction else factor_tol), F.abs(e - a), "floating"
        rows.append(F.struct(F.lit(i).alias("priority"), F.lit(c).alias("field"), F.lit(kind).alias("category"), (~present | same).alias("equal"), F.when(present, error).alias("error")))
    return aligned.select(*key, F.explode(F.array(*rows)).alias("f")).select(*key, "f.*")


def divergence_stats(errors: DataFrame) -> DataFrame:
    """Per field: rows compared, rows that differ, greatest error."""
    return errors.groupBy("field", "category").agg(F.count("*").alias("n"), F.count_if(~F.col("equal")).alias("n_differ"), F.max("error").alias("max_error"))


def first_divergence(errors: DataFrame, key: list[str]) -> DataFrame:
    """The first field that differs, by row and then by priority."""
    return errors.where(~F.col("equal")).orderBy(*key, "priority").limit(1)


def verdict(errors: DataFrame) -> DataFrame:
    """One row: PASS or FAIL and the number of differences of each category."""
    bad = ~F.col("equal")
    counts = [F.count_if(bad & (F.col("category") == c)).alias(f"n_{c}") for c in ("exact", "floating", "ordering")]
    return errors.agg(F.when(F.count_if(bad) == 0, "PASS").otherwise("FAIL").alias("status"), *counts)


def live_vs_recovered(live: DataFrame, recovered: DataFrame, key: str) -> DataFrame:
    """Events decoded twice: key and whether status and content are equal, null-safely."""
    names = [c for c in live.columns if c != key]
    both = live.select(key, F.struct(*names).alias("l")).join(recovered.select(key, F.struct(*names).alias("r")), key)
    return both.select(key, F.col("l").eqNullSafe(F.col("r")).alias("equal"))


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same columns, and those that only one has."""
    only = lambda x, y: F.array_join(F.array(*[F.lit(c) for c in sorted(set(x.columns) - set(y.columns))]).cast("array<string>"), ",")
    return a.agg(F.lit(set(a.columns) == set(b.columns)).alias("same"), only(a, b).alias("only_first"), only(b, a).alias("only_second"))


def parity_digest(rows: DataFrame, key: str, content: list[str], arrival: list[str]) -> DataFrame:
    """Per key the number of rows and a hash of their contents and of the order in which they came."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*arrival))
    line = F.md5(F.concat_ws("|", place, *content))
    # Only the places need the key's rows in order; the sum of hashes of (place, content) is commutative.
    return rows.select(key, line.alias("line")).groupBy(key).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("line", 1, 8), 16, 10).cast("long")).alias("digest"))
