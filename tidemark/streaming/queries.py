"""Registered streaming queries: the given events replayed as a stream, to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.plans import adapters as A
from tidemark.plans.market import _ARBITER
from tidemark.plans.registry import query
from tidemark.plans.summaries import _features, network_sql
from tidemark.sources import sinks
from tidemark.sources.readers import read_parquet_stream
from tidemark.sources.shared import shared_dir
from tidemark.streaming import operators as T


#: Parts of its time in which a replay by key is written and read.
PARTS = 3


def replayed(spark: SparkSession, source: DataFrame, fn, key: list[str] | None = None, time: str | None = None, n_parts: int = PARTS, **options) -> DataFrame:
    """fn over ``source`` written to files and read back as a stream, until all is consumed.

    With key and time (a number) the parts of the time, dealt by key, come one after the other:
    the query ends after each part and a new one resumes from its checkpoint, as after a lost
    driver. State, watermark, timers and the sink's commit log are carried over. The stream runs
    in a session of its own with the given options.
    """
    home, own = shared_dir(spark), spark.newSession()
    for k, v in options.items():
        own.conf.set(k, v)
    parts, files = parts_of(source, key, time, n_parts)
    for rows in parts:
        rows.write.mode("append").parquet(f"{home}/in")
        stream = fn(read_parquet_stream(own, f"{home}/in", source.schema, files))
        sinks.stream_sink(stream, f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def parts_of(source: DataFrame, key: list[str] | None, time: str | None, n_parts: int = PARTS) -> tuple[list[DataFrame], int]:
    """The source in parts of its time, each dealt by key to as many files as is returned."""
    if key is None:
        return [source], 1000
    ends = sorted(set(source.approxQuantile(time, [i / n_parts for i in range(1, n_parts)], 0.01))) if n_parts > 1 else []
    part = sum(((F.col(time) > x).cast("int") for x in ends), F.lit(0))
    files = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [source.where(part == i).repartition(files, *key) for i in range(len(ends) + 1)], files


_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return A.feed(spark, d).withColumn("ts", F.timestamp_micros("ts_us")).withColumn("sequence", F.col("event_id"))


@query(A.with_ctes("""WITH w AS (SELECT ts_us // 86400000000 * 86400000000 AS start_us, shard, kind, volume FROM feed)
SELECT start_us, shard, kind, count(*) AS n, sum(volume)::BIGINT AS volume FROM w WHERE start_us + 86400000000 <= (SELECT max(ts_us) // 1000 * 1000 FROM feed) GROUP BY start_us, shard, kind""", "feed"))
def t1_capture_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The windows that the watermark has passed."""
    out = replayed(spark, _feed(spark, d), lambda s: T.capture_metrics(s, "1 day", "0 seconds"), ["shard", "kind"], "ts_us")
    return out.select(F.unix_micros("window.start").alias("start_us"), "shard", "kind", "n", "volume")


@query(A.with_ctes("""WITH rows_ AS (SELECT symbol, trading_day, event_id, exchange_time_us AS t, price * volume AS a, row_number() OVER (PARTITION BY symbol, trading_day ORDER BY exchange_time_us, event_id) AS k FROM feed),
walk(symbol, trading_day, k, sequence, cut_index, window_start_us, amount_trigger, time_trigger, start_, amount) AS (
  SELECT symbol, trading_day, k, event_id, (a >= 1000)::BIGINT, t, a >= 1000, false, t, CASE WHEN a >= 1000 THEN 0.0::DOUBLE ELSE 0.0::DOUBLE + a END FROM rows_ WHERE k = 1
  UNION ALL
  SELECT r.symbol, r.trading_day, r.k, r.event_id, w.cut_index + (w.amount + r.a >= 1000 OR r.t - w.start_ >= 3600000000)::BIGINT, w.start_, w.amount + r.a >= 1000, r.t - w.start_ >= 3600000000,
    CASE WHEN w.amount + r.a >= 1000 OR r.t - w.start_ >= 3600000000 THEN r.t ELSE w.start_ END, CASE WHEN w.amount + r.a >= 1000 OR r.t - w.start_ >= 3600000000 THEN 0.0::DOUBLE ELSE w.amount + r.a END
  FROM walk w JOIN rows_ r ON r.symbol = w.symbol AND r.trading_day = w.trading_day AND r.k = w.k + 1)
SELECT symbol, trading_day, sequence, cut_index, window_start_us, amount_trigger, time_trigger FROM walk WHERE amount_trigger OR time_trigger""", "feed").replace("WITH ", "WITH RECURSIVE ", 1))
def t3_sampler(spark: SparkSession, d: str) -> DataFrame:
    """T3, and T13: rows of an instrument are taken in the order of time and sequence."""
    return replayed(spark, _feed(spark, d), T.samples, ["symbol", "trading_day"], "ts_us", **_ROCKS)


@query(A.with_ctes("SELECT symbol, sequence, side, tick, (sum(qty) OVER (PARTITION BY symbol, side, tick ORDER BY ts_us, sequence ROWS UNBOUNDED PRECEDING))::BIGINT AS level_qty FROM book_changes", "book_changes"))
def t4_book_owner(spark: SparkSession, d: str) -> DataFrame:
    changes = A.book_changes(spark, d).withColumn("exchange_time_us", F.col("ts_us"))
    return replayed(spark, changes, T.book_levels, ["symbol"], "ts_us", **_ROCKS)


_SMALL = (50, [64], 32, [8])


@query(network_sql(*_SMALL, states=False))
def t5_stream_scoring(spark: SparkSession, d: str) -> DataFrame:
    weights = scoring.patterned_weights(*_SMALL)
    rows = replayed(spark, _features(spark, d, 50), lambda s: T.scored(s, weights), ["symbol", "trading_day"], "row_in_stock_day", **_ROCKS)
    return rows.withColumn("prediction", F.round("prediction", 6))


@query(A.with_ctes(_ARBITER + " SELECT symbol, arrival, accepted, selected, selected_sequence FROM rows_", "candidates"))
def t6_stream_arbiter(spark: SparkSession, d: str) -> DataFrame:
    return replayed(spark, A.candidates(spark, d), lambda s: T.arbitration(s, 14_400_000_000), ["symbol"], "arrival", **_ROCKS)


@query(A.with_ctes("SELECT DISTINCT event_id, symbol FROM feed", "feed"))
def t9_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    f = _feed(spark, d).select("event_id", "ts", "symbol", "ts_us")
    again = f.where("event_id % 5 = 0").withColumn("ts_us", F.col("ts_us") + 3 * A.DAY_US)  # the copies come in later parts
    return replayed(spark, f.union(again), lambda s: T.without_duplicates(s, ["event_id"], "40 days"), ["symbol"], "ts_us", **_ROCKS).select("event_id", "symbol")


_LIMIT_MS = 3_600_000


@query(A.with_ctes(f"""WITH beats AS (SELECT shard, ts_us // 1000 AS ms FROM feed), edge AS (SELECT (max(ts_us) - 1000000) // 1000 AS mark FROM feed),
last_ AS (SELECT shard, max(ms) AS last_ms FROM beats GROUP BY 1)
SELECT shard, last_ms, last_ms + {_LIMIT_MS} <= mark AS stale FROM last_, edge""", "feed"))
def t10_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """The last heartbeat of each shard, and whether the watermark has passed its limit since."""
    rows = replayed(spark, _feed(spark, d).select("shard", "ts", "ts_us"), lambda s: T.heartbeats(s, _LIMIT_MS), ["shard"], "ts_us", **_ROCKS)
    said = rows.groupBy("shard").agg(F.max("last_ms").alias("last_ms"), F.max(F.when(F.col("stale"), F.col("last_ms"))).alias("_stale_ms"))
    return said.select("shard", "last_ms", F.coalesce(F.col("_stale_ms") == F.col("last_ms"), F.lit(False)).alias("stale"))


_DELAY_US = 1_800_000_000


@query(A.with_ctes(f"""WITH last_ AS (SELECT max(ts_us) AS newest FROM feed),
o AS (SELECT *, lead(ts_us) OVER (PARTITION BY symbol ORDER BY ts_us, event_id) AS next_us FROM feed WHERE kind <> 'malformed'),
due AS (SELECT symbol, event_id, ts_us + {_DELAY_US} AS due_us, next_us FROM o WHERE kind IN ('buy', 'sell'))
SELECT symbol, event_id AS order_id, due_us FROM due, last_ WHERE CASE WHEN next_us IS NULL THEN due_us // 1000 <= (newest - 1000000) // 1000 ELSE next_us > due_us END""", "feed"))
def t8_delayed_cancels(spark: SparkSession, d: str) -> DataFrame:
    """Orders to be cancelled as nothing replaced, filled or cancelled them within half an hour."""
    return replayed(spark, _feed(spark, d), lambda s: T.delayed_cancels(s, _DELAY_US), ["symbol"], "ts_us", **_ROCKS)


@query(A.with_ctes("SELECT f.event_id, p_size * 1000.0::DOUBLE AS free_share FROM feed f LEFT JOIN part ON lpad(p_partkey::VARCHAR, 6, '0') = f.symbol", "feed"))
def t11_stream_enrich(spark: SparkSession, d: str) -> DataFrame:
    share = A.instruments(spark, d).select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("symbol"), "free_share")
    return replayed(spark, _feed(spark, d), lambda s: T.enriched(s, share), ["symbol"], "ts_us").select("event_id", "free_share")


@query(A.with_ctes("SELECT event_id, symbol, price FROM feed", "feed"))
def s7_replay(spark: SparkSession, d: str) -> DataFrame:
    """S7, S11 and T12: replay through the file sink's commit log, resumed twice from its checkpoint."""
    return replayed(spark, _feed(spark, d), lambda s: s.select("event_id", "symbol", "price"), ["shard"], "ts_us")


@query(A.with_ctes("SELECT event_id, price, trading_day, shard FROM feed", "feed"))
def s8_by_shard(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/by_shard"
    sinks.write_by_shard(A.feed(spark, d).select("event_id", "price", "trading_day", "shard"), path)
    return spark.read.parquet(path).select("event_id", "price", "trading_day", "shard")


#: Deadlines by kind of event: name, and microseconds from the event on (none: taken back).
_DEADLINES = {"buy": ("cancel", 1_800_000_000), "sell": ("cancel", 1_800_000_000), "trade": ("cancel", None), "cancel": ("throttle", 7_200_000_000), "malformed": ("callback", 86_400_000_000)}


def _deadline_rows(spark: SparkSession, d: str) -> DataFrame:
    f = _feed(spark, d).select("symbol", "ts", "ts_us", "event_id", "kind")
    pick = lambda i, t: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[i]).cast(t)) for k, v in _DEADLINES.items()])
    return f.withColumn("name", pick(0, "string")).withColumn("after_us", pick(1, "long")).drop("kind")


@query(A.with_ctes(f"""WITH rules(kind, name, after_us) AS (VALUES {', '.join(f"('{k}', '{n}', {'NULL' if a is None else a})" for k, (n, a) in _DEADLINES.items())}),
rows_ AS (SELECT f.symbol, f.event_id, f.ts_us, r.name, f.ts_us + r.after_us AS due_us FROM feed f JOIN rules r USING (kind)),
next_ AS (SELECT *, lead(ts_us) OVER (PARTITION BY symbol, name ORDER BY ts_us, event_id) AS next_us, max(ts_us) OVER (PARTITION BY symbol) AS last_us, (max(ts_us) OVER () - 1000000) // 1000 AS mark FROM rows_)
SELECT symbol, name, due_us, event_id AS set_by FROM next_ WHERE due_us IS NOT NULL AND CASE WHEN next_us IS NULL THEN last_us > due_us OR due_us // 1000 <= mark ELSE next_us > due_us END""", "feed"))
def t8_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Delayed cancels, throttle expiry and scheduled callbacks as named deadlines of a symbol."""
    return replayed(spark, _deadline_rows(spark, d), T.deadlines, ["symbol"], "ts_us", **_ROCKS)


@query(A.with_ctes("SELECT event_id, symbol, price FROM feed", "feed"))
def t12_follow(spark: SparkSession, d: str) -> DataFrame:
    """Backfill of what is there, then the same checkpoint followed while the rest arrives; the
    following query is stopped once on the way and started again."""
    home, own = shared_dir(spark), spark.newSession()
    source = _feed(spark, d)
    parts, files = parts_of(source, ["shard"], "ts_us", 4)
    start = lambda follow: T.recover(read_parquet_stream(own, f"{home}/in", source.schema, files).select("event_id", "symbol", "price"), f"{home}/out", f"{home}/checkpoint", follow)
    parts[0].write.mode("append").parquet(f"{home}/in")
    start(None).awaitTermination()
    running = start("500 milliseconds")
    for k, rows in enumerate(parts[1:]):
        rows.write.mode("append").parquet(f"{home}/in")
        if k == 1:
            running.stop()
            running = start("500 milliseconds")
    running.processAllAvailable()
    running.stop()
    return spark.read.schema("event_id long, symbol string, price double").parquet(f"{home}/out")


@query(A.with_ctes("""WITH f AS (SELECT *, symbol IN (SELECT symbol FROM feed WHERE shard = 3) AS detailed FROM feed)
SELECT CASE WHEN kind <> 'trade' THEN 'events' WHEN detailed THEN 'full' ELSE 'compact' END AS output, event_id, symbol, price, CASE WHEN detailed THEN volume END AS volume FROM f WHERE detailed OR kind = 'trade'""", "feed"))
def s9_split_stream(spark: SparkSession, d: str) -> DataFrame:
    """Trades are samples, the rest events: three outputs of each micro-batch."""
    home, own = shared_dir(spark), spark.newSession()
    source = _feed(spark, d).select("event_id", "symbol", "price", "volume", "kind", "shard", "ts_us")
    parts, files = parts_of(source, ["symbol"], "ts_us")
    detailed = source.where("shard = 3")
    for rows in parts:
        rows.write.mode("append").parquet(f"{home}/in")
        stream = read_parquet_stream(own, f"{home}/in", source.schema, files)
        sinks.split_stream(stream, detailed, ["event_id", "symbol", "price"], f"{home}/out", f"{home}/checkpoint", F.col("kind") != "trade").awaitTermination()
    columns = ["event_id", "symbol", "price", "volume"]
    read = lambda name: sinks.read_split(spark, f"{home}/out", name, source.select(*(columns[:3] if name == "compact" else columns)).schema).withColumn("output", F.lit(name))
    return read("full").unionByName(read("events")).unionByName(read("compact"), allowMissingColumns=True)


_FLUSH_ROWS = 300


@query(A.with_ctes(f"SELECT shard, count(*) AS n, true AS within_limit FROM feed GROUP BY 1", "feed"))
def s11_flush(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a sink with limits wrote, by shard, and whether all of their files kept the limit."""
    home, own = shared_dir(spark), spark.newSession()
    source = _feed(spark, d).select("event_id", "symbol", "price", "shard", "ts_us")
    source.repartition(8, "shard").write.parquet(f"{home}/in")
    stream = read_parquet_stream(own, f"{home}/in", source.schema, max_bytes=256_000)
    sinks.stream_sink(stream, f"{home}/out", f"{home}/checkpoint", flush_rows=_FLUSH_ROWS, writers=int(spark.conf.get("spark.sql.shuffle.partitions"))).awaitTermination()
    rows = spark.read.schema(source.schema).parquet(f"{home}/out").withColumn("file", F.input_file_name())
    of_file = rows.groupBy("file", "shard").agg(F.count("*").alias("n"))
    sizes = of_file.groupBy("file").agg((F.sum("n") <= _FLUSH_ROWS).alias("within"))
    return of_file.join(sizes, "file").groupBy("shard").agg(F.sum("n").alias("n"), F.every("within").alias("within_limit"))


@query(A.with_ctes("SELECT document, sha256(document) AS sha256, true AS intact FROM (SELECT '[' || string_agg('{\"code\":\"' || code || '\",\"p_partkey\":' || p_partkey || ',\"shard\":' || shard || '}', ',' ORDER BY p_partkey) || ']' AS document FROM instruments)", "instruments"))
def s10_published(spark: SparkSession, d: str) -> DataFrame:
    """The daily document as it is read back after its publication."""
    path = f"{shared_dir(spark)}/daily.json"
    sinks.publish_daily(A.instruments(spark, d).select("code", "p_partkey", "shard"), path, "p_partkey")
    return sinks.read_daily(spark, path)
