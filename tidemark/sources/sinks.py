"""Sinks: partitioned outputs, split and exported logs, daily documents, retention."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def write_by_shard(df: DataFrame, path: str) -> None:
    """Parquet under trading_day=/shard=; rows of a shard and day are brought together first."""
    df.repartition("trading_day", "shard").write.mode("overwrite").partitionBy("trading_day", "shard").parquet(path)


def split_samples(samples: DataFrame, detailed: DataFrame, compact: list[str], symbol: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """(all columns of detailed symbols, compact columns of the others)."""
    return samples.join(detailed.select(symbol).distinct(), symbol, "left_semi"), samples.join(detailed.select(symbol).distinct(), symbol, "left_anti").select(*compact)


def log_exports(log: DataFrame, kinds: list[str], kind: str = "record_type") -> dict[str, DataFrame]:
    """One relation per record type, and ``summary`` with their counts."""
    return {k: log.where(F.col(kind) == k) for k in kinds} | {"summary": log.groupBy(kind).count()}


def daily_document(static: DataFrame, key: str = "symbol") -> DataFrame:
    """One row: a JSON array of the rows in key order with sorted fields, and its SHA-256.

    For the daily static table (one row per instrument), which a single document holds by nature.
    """
    row = F.to_json(F.struct(*sorted(static.columns)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("j")))), lambda x: x["j"])
    out = static.agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("document"))
    return out.withColumn("sha256", F.sha2("document", 256))


def retention(partitions: DataFrame, today: Column, days: int, name: str = "name") -> DataFrame:
    """Partitions named like journal_YYYYMMDD whose day is older than today - days;
    nothing is deleted."""
    day = F.try_to_date(F.regexp_extract(name, "^[a-z_]+_([0-9]{8})$", 1), "yyyyMMdd")
    return partitions.withColumn("day", day).where(F.col("day") < F.date_sub(today, days))


def stream_sink(df: DataFrame, path: str, checkpoint: str, interval: str | None = None, flush_rows: int | None = None, writers: int | None = None) -> StreamingQuery:
    """Append micro-batches as Parquet files of at most ``flush_rows`` rows,
    by ``writers`` tasks if that is given (else those that read; many small files of one task are slow).

    With an interval the query follows its source and flushes what has come every so often;
    without one it writes what is there and ends. Bytes of a flush are bounded where the stream
    is read (``read_parquet_stream(.., max_bytes)``). The sink's commit log names the files of
    finished batches: an incomplete tail is not read, and is written anew on restart. Either
    form resumes where the other ended, from one checkpoint.
    """
    df = df.repartition(writers) if writers else df
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if flush_rows:
        writer = writer.option("maxRecordsPerFile", flush_rows)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def split_stream(stream: DataFrame, detailed: DataFrame, compact: list[str], path: str, checkpoint: str, is_event: Column, symbol: str = "symbol", interval: str | None = None, between: Callable[[int], None] = lambda batch: None) -> StreamingQuery:
    """Each micro-batch split into three tables under ``path``: ``full`` (samples of detailed symbols, all
    columns), ``compact`` (samples of the others) and ``events`` (events of detailed symbols only).

    A batch's rows go to folders of its number, which a repeated batch overwrites, and the batch
    is entered in a ledger once all are written: read_split leaves out what is not in it. So a
    batch that fails between two tables and runs again is in each of them once. ``between`` is
    called with the number after each table (tests fail there).
    """
    chosen = F.broadcast(detailed.select(symbol).distinct())  # the symbols that are watched in detail

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            samples, events = batch.where(~is_event), batch.where(is_event)
            tables = {"full": samples.join(chosen, symbol, "left_semi"), "compact": samples.join(chosen, symbol, "left_anti").select(*compact), "events": events.join(chosen, symbol, "left_semi")}
            for name, rows in tables.items():
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
                between(number)
            batch.sparkSession.range(number, number + 1).withColumnRenamed("id", "batch").write.mode("append").parquet(f"{path}/ledger")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def read_split(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """One of split_stream's tables, of the batches that the ledger has."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    done = spark.read.schema("batch long").parquet(f"{path}/ledger").distinct()
    return spark.read.schema(whole).parquet(f"{path}/{name}").join(F.broadcast(done), "batch", "left_semi").select(*schema.names)


def publish_daily(static: DataFrame, path: str, key: str = "symbol") -> str:
    """The daily document and its SHA-256 as one JSON file at ``path``; returns the hash.

    The file is written beside it, read back, and takes its place by one rename, which the file
    system does whole: a reader sees the old or the new document, and a failed task leaves the
    old one. What lies beside is removed in either case.
    """
    spark = static.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf, beside = spark.sparkContext._jsc.hadoopConfiguration(), f"{path}.{uuid.uuid4().hex}"
    target, folder = fs.Path(path), fs.Path(beside)
    files = target.getFileSystem(conf)
    try:
        daily_document(static, key).select(F.to_json(F.struct("sha256", "document"))).coalesce(1).write.text(beside)
        found = read_daily(spark, beside).select("sha256", "intact").first()  # the text stays with the executors
        if found is None or not found["intact"]:
            raise OSError(f"{beside} was not written whole")
        part = next(f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen())
        overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        overwrite[0] = getattr(fs.Options.Rename, "OVERWRITE")
        fs.FileContext.getFileContext(target.toUri(), conf).rename(part, target, overwrite)
        return found["sha256"]
    finally:
        files.delete(folder, True)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """(document, sha256, intact) of a published file; intact: its text has that hash."""
    row = F.from_json("value", "sha256 string, document string", {"maxStringLen": str(2**31 - 1)})  # 20 MB by default
    return spark.read.text(path).select(row.alias("d")).select("d.document", "d.sha256", (F.sha2("d.document", 256) == F.col("d.sha256")).alias("intact"))
