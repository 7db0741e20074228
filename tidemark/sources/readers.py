"""Sources: L2 tables, snapshots, datagrams, samples, static parameters."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas


def _scan(spark: SparkSession, path: str | list[str], schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(*([path] if isinstance(path, str) else path))


def read_orders(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, path, schemas.L2_ORDER, fmt)


def read_trades(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, path, schemas.L2_TRADE, fmt)


def pack_levels(wide: DataFrame, n: int = 5) -> DataFrame:
    """Wide snapshot columns as an array of (price, volume) per side."""
    side = lambda s: F.array(*[F.struct(F.col(f"{s}_price{i}").alias("price"), F.col(f"{s}_volume{i}").alias("volume")) for i in range(1, n + 1)]).alias(f"{s}s")
    packed = [c for c in wide.columns if not any(c.startswith(f"{s}_{k}") for s in ("bid", "ask") for k in ("price", "volume"))]
    return wide.select(*packed, side("bid"), side("ask"))


def read_snapshots(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    return pack_levels(_scan(spark, path, schemas.SNAPSHOT_WIDE, fmt))


def parse_datagrams(lines: DataFrame) -> DataFrame:
    """(good, report) of JSON lines in ``value``: blank lines are skipped; malformed ones, and
    those without ts_ns or channel, are not good."""
    full = T.StructType([*schemas.DATAGRAM.fields, T.StructField("_corrupt", T.StringType())])
    rows = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.col("r._corrupt").isNull() & F.col("r.ts_ns").isNotNull() & F.col("r.channel").isNotNull()
    return rows.select("value", *[F.col(f"r.{f.name}").alias(f.name) for f in schemas.DATAGRAM.fields], F.coalesce(good, F.lit(False)).alias("good"))


def read_datagrams(spark: SparkSession, paths: list[str]) -> DataFrame:
    return parse_datagrams(spark.read.text(paths)).where("good").drop("value", "good")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample CSV; an absent file is an empty relation."""
    try:
        return spark.read.schema(schemas.SAMPLE).option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.SAMPLE)


def parse_static(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row per symbol of JSON documents with an ``ins_params`` map."""
    spec = T.StructType([T.StructField("ins_params", T.MapType(T.StringType(), schemas.INSTRUMENT_STATIC))])
    rows = documents.select(F.from_json(column, spec).alias("d")).select(F.explode("d.ins_params").alias("symbol", "p"))
    return rows.select("symbol", "p.*")


def read_static(spark: SparkSession, path: str) -> DataFrame:
    return parse_static(spark.read.text(path, wholetext=True))


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1000, max_bytes: int | None = None) -> DataFrame:
    """A captured day replayed as a stream; run it with trigger(availableNow=True). A micro-batch takes
    ``max_bytes`` of files if that is given (a single larger file alone), else ``max_files``."""
    limit = ("maxFilesPerTrigger", max_files) if max_bytes is None else ("maxBytesPerTrigger", max_bytes)
    return spark.readStream.schema(schema).option(*limit).parquet(path)
