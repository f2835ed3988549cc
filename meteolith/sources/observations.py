"""Observations: the schema, canonical form, and the view of them over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteolith.config import DEFAULT, VARIABLES, Rules
from meteolith.sources import files

SCHEMA = "seq bigint, station_id string, timestamp timestamp_ntz, temp_c double, pressure_hpa double, rh_pct double"
STATIONS = "station_id string, name string, lat double, lon double, elevation_m double, terrain string"
#: The registry of the eight stations of the view (id, name, latitude, longitude, elevation, terrain): invented places.
REGISTRY = (
    ("S00", "Old Mill", 46.12, 7.05, 540.0, "valley"),
    ("S01", "Harbour Light", 45.61, 6.21, 22.0, "coastal"),
    ("S02", "North Field", 46.95, 7.62, 610.0, "plateau"),
    ("S03", "Brick Works", 46.33, 8.14, 655.0, "inland"),
    ("S04", "East Ridge", 45.18, 8.87, 470.0, "plateau"),
    ("S05", "Sheep Hill", 45.32, 7.41, 760.0, "hill"),
    ("S06", "Long Pier", 44.57, 6.68, 51.0, "coastal"),
    ("S07", "High Meadow", 45.47, 7.02, 1290.0, "hill"),
)


def canonical(df: DataFrame) -> DataFrame:
    """NaN is absent: null. Values are otherwise kept as they came."""
    return df.withColumns({v: F.when(F.isnan(v), None).otherwise(F.col(v)) for v in VARIABLES})


_TABLES: dict[tuple, DataFrame] = {}


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation for each event, as a table: the JSON of an event is parsed once for each state of its files and
    session, not in every branch of every plan. Arithmetic goes through integers, so that every engine gives equal values."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    status = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(folder)
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(events.inputFiles())), status.getLen(), status.getModificationTime())
    if key not in _TABLES:
        cores = spark.sparkContext.defaultParallelism
        # A small file is one split; dealt over the cores here, every later scan is too.
        _TABLES[key] = files.written(view(events if events.rdd.getNumPartitions() >= cores else events.repartition(cores)))
    return _TABLES[key]


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return view(spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir))


def view(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    v100 = F.round(F.col("value") * 100).cast("bigint")
    e = e.select("event_id", "user_id", "ts", "event_type", k.alias("k"), v100.alias("v100"))
    temp = F.when(F.col("k") == 13, -9999.0).when((F.col("event_type") == "error") & (F.col("k") < 20), None).otherwise((1500 + F.floor(F.col("v100") * 12 / 100.0)) / 100.0)
    pressure = F.when((F.col("event_type") == "signup") & (F.col("k") < 10), None).otherwise((9800 + 4 * F.col("k")) / 10.0)
    rh = F.when((F.col("event_type") == "view") & (F.col("k") < 10), None).otherwise((300 + 7 * F.col("k") + F.floor(F.col("v100") / 500.0)) / 10.0)
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("S0"), (F.col("user_id") % 8).cast("string")).alias("station_id"), F.col("ts").alias("timestamp"),
        temp.alias("temp_c"), pressure.alias("pressure_hpa"), rh.alias("rh_pct"), "event_type",
    )


def stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), STATIONS)


def trusted(obs: DataFrame, cfg: Rules = DEFAULT.rules) -> DataFrame:
    """obs with keep: complete, no sentinel, every value within its range."""
    from meteolith.operators.rules import is_sentinel, out_of_range

    bad = F.lit(False)
    for v in VARIABLES:
        bad = bad | F.col(v).isNull() | F.coalesce(is_sentinel(F.col(v), cfg) | out_of_range(v, cfg), F.lit(False))
    return obs.withColumn("keep", ~bad)
