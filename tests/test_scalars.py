"""The literal cases of the domain's scalar rules."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_startup_position(spark):
    assert tuple(value(spark, S.startup_position(F.lit(1000), F.lit(1200), F.lit(900)))) == (1200, 900, 200)
    assert tuple(value(spark, S.startup_position(F.lit(1000), F.lit(-10), F.lit(500)))) == (0, 0, -1000)


@pytest.mark.parametrize("args, want", [((0, 300, 0, 0), 0), ((0, 300, -1000, 0), 1000), ((1000, 300, 0, 100), 200)])
def test_max_can_buy(spark, args, want):
    shortable, limit, delta, pending = args
    assert value(spark, S.max_can_buy(F.lit(shortable), F.lit(limit), F.lit(delta), F.lit(pending))) == want


@pytest.mark.parametrize("args, want", [((0, 300, 1000, 0, 0), 0), ((1000, 300, 1000, 0, 100), 200), ((1000, 300, 1000, -1000, 0), 0)])
def test_max_can_sell(spark, args, want):
    static, shortable, limit, delta, pending = args
    assert value(spark, S.max_can_sell(*map(F.lit, (static, shortable, limit, delta, pending)))) == want


def test_bias_cutoff_and_warmup(spark):
    assert value(spark, S.bias(F.lit(50000), F.lit(100000), F.lit(2))) == 1
    assert value(spark, S.bias(F.lit(50000), F.lit(0), F.lit(2))) == 0
    assert value(spark, S.unit_bias(F.lit(0.001), F.lit(2), F.lit(10), F.lit(100000))) == pytest.approx(2e-7)
    assert [value(spark, S.after_cutoff(F.lit(t), F.lit(93100))) for t in (93059, 93100, 130000)] == [False, True, True]


def test_target_and_hash(spark):
    got = value(spark, S.target_permille(F.lit(100.0), F.lit(100.1), F.lit(99.9), F.lit(100.2)))
    assert got == pytest.approx(0.6666666667)
    assert value(spark, S.target_permille(F.lit(0.0), F.lit(1.0))) is None
    assert value(spark, S.fnv1a32(F.lit("000001.SZ"))) == 1636776661


def test_text_and_codes(spark):
    assert [value(spark, S.normalize_symbol(F.lit(x))) for x in ("1.SZ", "000807", "600000.SH")] == ["000001", "000807", "600000"]
    assert [value(spark, S.classify_market(F.lit(x))) for x in ("600000", "000001", "301000", "920001", "510300")] == ["SH", "SZ", "SZ", "BJ", "NONE"]
    assert value(spark, S.format_decimal(F.lit(816048.1215))) == "816048.1215" and value(spark, S.format_decimal(F.lit(5.0))) == "5"
    assert [str(value(spark, S.parse_date(F.lit(x)))) for x in ("2026-07-31", "20260731", "31.07.2026", "20261331")] == ["2026-07-31", "2026-07-31", "None", "None"]
    assert value(spark, S.rjust(F.lit("abc"), 5, "0")) == "00abc" and value(spark, S.rjust(F.lit("abcdef"), 5)) == "abcdef"
    assert [value(spark, S.exclusion_reason(F.lit(x))) for x in ("某退", "N新", "*ST某", "某")] == ["delisting", "new_listing", "st", "keep"]
    assert tuple(value(spark, S.endpoint(F.lit("10.0.0.1:9000")))) == ("10.0.0.1", 9000)
    assert value(spark, S.hhmmss(F.lit(34_260_000_000))) == 93100
    assert [value(spark, S.is_finite(F.lit(x))) for x in (1.0, float("nan"), float("inf"), None)] == [True, False, False, False]
    assert value(spark, S.lot_round(F.lit(250), 100, 200, 1000)) == 200 and value(spark, S.lot_round(F.lit(150), 100, 200, 1000)) == 0
