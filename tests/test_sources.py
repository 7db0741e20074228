"""Readers and writers on small files."""

import datetime
import json

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources import readers, sinks


def test_datagrams_skip_blank_malformed_and_incomplete_lines(spark, tmp_path):
    good = {"ts_ns": 5, "monotonic_ns": 6, "channel": "tick_a", "source_ip": "10.0.0.1", "source_port": 1, "length": 9, "prefix_hex": "0a"}
    lines = [json.dumps(good), "", "   ", '{"ts_ns": 1, "chan', json.dumps({"ts_ns": 7}), json.dumps({"channel": "x"})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text(json.dumps(good | {"ts_ns": 8}))
    rows = readers.read_datagrams(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])
    assert sorted((r.ts_ns, r.channel, r.length) for r in rows.collect()) == [(5, "tick_a", 9), (8, "tick_a", 9)]


def test_absent_samples_are_an_empty_relation(spark, tmp_path):
    rows = readers.read_samples(spark, str(tmp_path / "none.csv"))
    assert rows.count() == 0 and rows.schema == schemas.SAMPLE


def test_static_map_becomes_rows(spark, tmp_path):
    doc = {"ins_params": {"000001": {"Close": 10.5, "FreeShare": 3.0, "static_position": 7}, "000002": {"Close": 1.0}}}
    (tmp_path / ".daily.json.crc").unlink(missing_ok=True)
    (tmp_path / "daily.json").write_text(json.dumps(doc, indent=1))
    got = {r.symbol: (r.Close, r.FreeShare, r.static_position) for r in readers.read_static(spark, str(tmp_path / "daily.json")).collect()}
    assert got == {"000001": (10.5, 3.0, 7), "000002": (1.0, None, None)}


def test_levels_are_packed(spark):
    wide = spark.range(1).select(F.lit("a").alias("instrument_id"), *[F.lit(float(i)).alias(f"{s}_price{i}") for s in ("bid", "ask") for i in range(1, 6)], *[F.lit(i * 100).alias(f"{s}_volume{i}") for s in ("bid", "ask") for i in range(1, 6)])
    row = readers.pack_levels(wide).first()
    assert [(x.price, x.volume) for x in row.bids] == [(float(i), i * 100) for i in range(1, 6)] and row.instrument_id == "a"


def test_retention_and_daily_document(spark):
    names = [("sim_journal_20260701",), ("sim_journal_20260731",), ("sim_journal_20261399",), ("other",)]
    old = sinks.retention(spark.createDataFrame(names, "name string"), F.lit(datetime.date(2026, 8, 5)), 10)
    assert [r.name for r in old.collect()] == ["sim_journal_20260701"]
    a = sinks.daily_document(spark.createDataFrame([("b", 2), ("a", 1)], "symbol string, x int")).first()
    b = sinks.daily_document(spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, x int")).first()
    assert a == b and json.loads(a.document) == [{"symbol": "a", "x": 1}, {"symbol": "b", "x": 2}]


def test_split_and_partitioned_write(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 20260801, 0), ("b", 2, 20260801, 1)], "symbol string, v int, trading_day int, shard int")
    full, compact = sinks.split_samples(rows, rows.where("symbol = 'a'"), ["symbol"])
    assert full.columns == rows.columns and compact.columns == ["symbol"] and compact.first().symbol == "b"
    sinks.write_by_shard(rows, str(tmp_path / "out"))
    assert (tmp_path / "out" / "trading_day=20260801" / "shard=1").is_dir()


def test_gbk(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        from tidemark.functions.scalars import gbk_to_utf8

        raw = spark.createDataFrame([(bytearray("平安银行".encode("gbk")),)], "b binary")
        assert raw.select(gbk_to_utf8("b").alias("t")).first().t == "平安银行"
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_daily_document_is_published_whole_or_not_at_all(spark, tmp_path):
    import pytest

    path = f"file://{tmp_path}/daily.json"
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "symbol string, x int")
    digest = sinks.publish_daily(rows, path)
    read = lambda: sinks.read_daily(spark, path).first()
    assert read().sha256 == digest and read().intact and json.loads(read().document) == [{"symbol": "a", "x": 1}, {"symbol": "b", "x": 2}]
    broken = rows.withColumn("x", F.when(F.col("symbol") == "b", F.raise_error(F.lit("a failed task"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="a failed task"):
        sinks.publish_daily(broken, path)
    assert read().sha256 == digest and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["daily.json"]
    assert sinks.publish_daily(rows.where("x = 1"), path) != digest and json.loads(read().document) == [{"symbol": "a", "x": 1}]
    (tmp_path / ".daily.json.crc").unlink(missing_ok=True)
    (tmp_path / "daily.json").write_text((tmp_path / "daily.json").read_text().replace("a", "b", 1))
    assert not read().intact


def test_a_daily_document_of_over_20_mb_is_published(spark, tmp_path):
    path = f"file://{tmp_path}/daily.json"
    rows = spark.range(25).select("id", F.repeat(F.lit("x"), 1_000_000).alias("text"))
    digest = sinks.publish_daily(rows, path, "id")
    got = sinks.read_daily(spark, path).select("sha256", "intact", F.length("document").alias("n")).first()
    assert got.sha256 == digest and got.intact and got.n > 25_000_000
