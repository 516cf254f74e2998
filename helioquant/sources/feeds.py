"""CSV telemetry feeds described by a specification record."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioquant.functions.timestamps import local_date, parse_ts, to_utc

CORRUPT = "_corrupt_record"
TIME_COLUMN = "DATE_TIME"

# Column order, types and working names of the two feed kinds.
GENERATION = (
    ("DATE_TIME", T.StringType(), "ts_text"),
    ("PLANT_ID", T.IntegerType(), "plant_id"),
    ("SOURCE_KEY", T.StringType(), "device"),
    ("DC_POWER", T.DoubleType(), "dc"),
    ("AC_POWER", T.DoubleType(), "ac"),
    ("DAILY_YIELD", T.DoubleType(), "daily"),
    ("TOTAL_YIELD", T.DoubleType(), "total"),
)
WEATHER = (
    ("DATE_TIME", T.StringType(), "ts_text"),
    ("PLANT_ID", T.IntegerType(), "plant_id"),
    ("SOURCE_KEY", T.StringType(), "device"),
    ("AMBIENT_TEMPERATURE", T.DoubleType(), "ambient"),
    ("MODULE_TEMPERATURE", T.DoubleType(), "module"),
    ("IRRADIATION", T.DoubleType(), "irradiation"),
)
KINDS = {"generation": GENERATION, "weather": WEATHER}


@dataclass(frozen=True)
class FeedSpec:
    """One feed: where it lies, how its clock is written, what kind of rows it has."""

    label: str
    path: str
    time_format: str
    kind: str = "generation"
    style: str = ""
    plant: str | None = None
    timezone: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    @property
    def columns(self):
        return KINDS[self.kind]


def text_schema(spec: FeedSpec) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name, _, _ in spec.columns])


def typed_schema(spec: FeedSpec) -> T.StructType:
    fields = [T.StructField(name, kind) for name, kind, _ in spec.columns]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def _csv_reader(reader, spec: FeedSpec):
    reader = reader.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    # A file whose header has other columns, or another order, is an error and not a mix-up.
    reader = reader.option("enforceSchema", False)
    return reader.options(**spec.options)


def _finish(df: DataFrame, spec: FeedSpec, strict: bool) -> DataFrame:
    ts = parse_ts(TIME_COLUMN, spec.time_format, strict)
    out = df.select(
        F.lit(spec.label).alias("feed"),
        F.lit(spec.plant or spec.label).alias("plant"),
        *[F.col(raw).alias(name) for raw, _, name in spec.columns],
        ts.alias("ts"),
        F.col(CORRUPT).alias("corrupt_record"),
    ).withColumn("local_date", local_date("ts"))
    # Daily rules need the plant's own date, so it is taken before the clock moves to UTC.
    return out.withColumn("ts_utc", to_utc("ts", spec.timezone)) if spec.timezone else out


def read_feed(
    spark: SparkSession, spec: FeedSpec, typed: bool = False, strict: bool = False
) -> DataFrame:
    """A feed as text columns, or typed with a parsed timestamp and a local date.

    Schemas are declared, so no pass is spent on inference. A row whose measures do not parse
    keeps its text in ``corrupt_record``. ``strict`` makes unreadable times an error.
    """
    reader = _csv_reader(spark.read, spec)
    if not typed:
        return reader.schema(text_schema(spec)).csv(spec.path).select(
            F.lit(spec.label).alias("feed"), "*"
        )
    return _finish(reader.schema(typed_schema(spec)).csv(spec.path), spec, strict)


def read_feeds(
    spark: SparkSession, specs: Iterable[FeedSpec], typed: bool = False, strict: bool = False
) -> DataFrame:
    """All feeds stacked, told apart by ``feed``; columns a kind lacks are null."""
    frames = [read_feed(spark, spec, typed, strict) for spec in specs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_feed_stream(
    spark: SparkSession, spec: FeedSpec, max_files_per_trigger: int = 64
) -> DataFrame:
    """The typed feed as a stream over a folder of CSV files."""
    reader = _csv_reader(spark.readStream, spec).option("maxFilesPerTrigger", max_files_per_trigger)
    return _finish(reader.schema(typed_schema(spec)).csv(spec.path), spec, strict=False)


def time_texts(spark: SparkSession, spec: FeedSpec) -> DataFrame:
    """Column-pruned scan: only the feed's time text is parsed out of the file."""
    return read_feed(spark, spec).select("feed", F.col(TIME_COLUMN).alias("ts_text"))


def raw_samples(frames: Mapping[str, DataFrame], text: str = "ts_text", n: int = 3) -> DataFrame:
    """The ``n`` smallest raw time texts of every feed, stacked (a top-n per feed)."""
    parts = [
        df.select(F.lit(label).alias("feed"), F.col(text).alias("raw_sample"))
        .orderBy("raw_sample")
        .limit(n)
        for label, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def verify_timestamps(
    frames: Mapping[str, DataFrame], formats: Mapping[str, tuple[str, str]], text: str = "ts_text"
) -> DataFrame:
    """Per feed: rows, rows parsed, rows failed or null, earliest and latest time.

    ``formats`` maps a feed to (format, style description).
    """
    parts = []
    for label, df in frames.items():
        fmt, style = formats[label]
        parts.append(
            df.select(
                F.lit(label).alias("feed"),
                F.lit(fmt).alias("format"),
                F.lit(style).alias("style"),
                parse_ts(text, fmt).alias("_ts"),
            )
        )
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("feed", "format", "style")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count("_ts").alias("parsed"),
            (F.count(F.lit(1)) - F.count("_ts")).alias("failed_or_null"),
            F.min("_ts").alias("earliest"),
            F.max("_ts").alias("latest"),
        )
    )


def verify_feeds(spark: SparkSession, specs: Iterable[FeedSpec]) -> DataFrame:
    specs = list(specs)
    return verify_timestamps(
        {s.label: time_texts(spark, s) for s in specs},
        {s.label: (s.time_format, s.style) for s in specs},
    )
