"""File sources and sinks: CSV and PSV readings, station metadata, JSON messages, the audit table, model artifacts,
evidence bundles."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meteolith.config import VARIABLES
from meteolith.functions.physics import fahrenheit_to_celsius, rh_from_dewpoint, station_pressure
from meteolith.functions.text import parse_float, parse_timestamp

#: Names that a column may have, in order of preference.
CANDIDATES = {
    "station": ("station_id", "station", "stationid", "site", "id"),
    "time": ("timestamp", "datetime", "date_time", "time", "date"),
    "temp": ("temp_c", "temperature", "temp", "air_temperature", "tavg", "t"),
    "pressure": ("pressure_hpa", "station_level_pressure", "station_pressure", "pressure"),
    "slp": ("sea_level_pressure", "slp", "pres", "mslp"),
    "rh": ("rh_pct", "relative_humidity", "rhum", "humidity", "rh"),
    "dew": ("dew_point_temperature", "dew_point", "dewpoint", "dwpt", "td"),
}
STATION_CANDIDATES = {"station": ("station_id", "id", "station"), "name": ("name",), "lat": ("lat", "latitude"), "lon": ("lon", "longitude"), "elevation": ("elevation_m", "elevation", "elev", "alt"), "terrain": ("terrain",)}
DELIMITERS = ("|", ",", ";", "\t")


def sniff(spark: SparkSession, path: str) -> str:
    """The first delimiter in order of priority that the header line holds."""
    row = spark.read.text(path).first()
    if row is None:
        raise ValueError(f"{path} has no header")
    return next((d for d in DELIMITERS if d in row[0]), ",")


def resolve(columns: list[str], candidates: tuple, compat: bool = False) -> str | None:
    """Column for a meaning: equal names first, then names that hold a candidate as whole words (compat: anywhere)."""
    return resolve_all(columns, {"it": candidates}, compat)["it"]


def resolve_all(columns: list[str], meanings: dict[str, tuple], compat: bool = False) -> dict[str, str | None]:
    """Columns for several meanings; a column that has one meaning by name is no other's by its words (but in compat)."""
    lower = {c.strip().lower(): c for c in columns}
    found: dict[str, str | None] = {k: next((lower[c] for c in cs if c in lower), None) for k, cs in meanings.items()}
    taken = set() if compat else set(found.values())
    words = lambda c, name: c in name if compat else f"_{c}_" in f"_{name.replace(' ', '_').replace('-', '_')}_"
    for k, cs in meanings.items():
        if found[k] is None:
            found[k] = next((o for c in cs for name, o in lower.items() if o not in taken and words(c, name)), None)
    return found


def load_csv(spark: SparkSession, path: str, station_id: str | None = None, elevation_m: float = 0.0, column_map: dict | None = None, temperature_unit: str = "C", compat: bool = False) -> DataFrame:
    """station_id, timestamp and values of a delimited file; rows without a readable time drop; in station and time
    order. Units, sea-level pressure and dew point are converted."""
    df = spark.read.option("header", True).option("sep", sniff(spark, path)).csv(path)
    if not df.columns:
        raise ValueError(f"{path} has no header")
    col = resolve_all(df.columns, CANDIDATES, compat) | (column_map or {})
    parts = [resolve(df.columns, (p,), False) for p in ("year", "month", "day", "hour")]
    if col["time"] is None and not all(parts):
        raise ValueError(f"{path} has no time column")
    if col["station"] is None and station_id is None:
        raise ValueError(f"{path} has no station column, and no station was named")
    get = lambda k: F.col(f"`{col[k]}`") if col[k] else F.lit(None).cast("string")
    if all(parts):
        y, m, d, h = (F.trim(F.col(f"`{p}`")) for p in parts)
        stamp = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.concat(F.lpad(h, 2, "0"), F.lit(":00:00"))), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    else:
        stamp = parse_timestamp(get("time"))
    temp = parse_float(get("temp"))
    dew = parse_float(get("dew"))
    if temperature_unit.upper() == "F":
        temp, dew = fahrenheit_to_celsius(temp), fahrenheit_to_celsius(dew)
    pressure, slp, rh = parse_float(get("pressure")), parse_float(get("slp")), parse_float(get("rh"))
    name = F.coalesce(F.nullif(F.trim(get("station")), F.lit("")), F.lit(station_id), F.lit("UNKNOWN"))
    out = df.select(
        name.alias("station_id"), stamp.alias("timestamp"), temp.alias("temp_c"), F.coalesce(pressure, station_pressure(slp, F.lit(float(elevation_m)), temp)).alias("pressure_hpa"),
        F.coalesce(rh, F.when(temp.isNotNull(), rh_from_dewpoint(temp, dew))).alias("rh_pct"),
    )
    return out.where("timestamp is not null").orderBy("station_id", "timestamp")


def load_ghcnh(spark: SparkSession, path: str, elevation_m: float = 0.0) -> DataFrame:
    return load_csv(spark, path, elevation_m=elevation_m)


def load_meteostat(spark: SparkSession, path: str, station_id: str, elevation_m: float = 0.0) -> DataFrame:
    """`pres` is sea-level pressure there."""
    return load_csv(spark, path, station_id=station_id, elevation_m=elevation_m, column_map={"slp": "pres"} if has_column(spark, path, "pres") else None)


def has_column(spark: SparkSession, path: str, name: str) -> bool:
    return name.lower() in {c.strip().lower() for c in spark.read.option("header", True).option("sep", sniff(spark, path)).csv(path).columns}


def load_stations(spark: SparkSession, path: str) -> DataFrame:
    """Rows with an id and a position; elevation 0, terrain inland and the id as name by default."""
    df = spark.read.option("header", True).option("sep", sniff(spark, path)).csv(path)
    col = {k: resolve(df.columns, c) for k, c in STATION_CANDIDATES.items()}
    if not (col["station"] and col["lat"] and col["lon"]):
        raise ValueError(f"{path} needs id, latitude and longitude")
    get = lambda k: F.nullif(F.trim(F.col(f"`{col[k]}`")), F.lit("")) if col[k] else F.lit(None).cast("string")
    out = df.select(
        get("station").alias("station_id"), F.coalesce(get("name"), get("station")).alias("name"), parse_float(get("lat")).alias("lat"), parse_float(get("lon")).alias("lon"),
        F.coalesce(parse_float(get("elevation")), F.lit(0.0)).alias("elevation_m"), F.coalesce(F.lower(get("terrain")), F.lit("inland")).alias("terrain"),
    )
    return out.where("station_id is not null and lat is not null and lon is not null")


def load_network(spark: SparkSession, observations: str, stations: str, ids: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid, stations, genuine extremes) of an archive; no station left raises."""
    from meteolith.operators import grid

    registry = load_stations(spark, stations)
    if ids is not None:
        registry = registry.where(F.col("station_id").isin(ids))
    if registry.isEmpty():
        raise ValueError("no such stations")
    obs = load_csv(spark, observations).withColumn("seq", F.monotonically_increasing_id())
    minutes = grid.interval_minutes(obs)
    g = grid.build(obs, registry, minutes)
    return g, registry, grid.extremes(g, per_hour=max(1, round(60 / minutes)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; with a local master (tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="meteolith-")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: read by several parts of a plan, it is computed once."""
    path = f"{shared_dir(df.sparkSession)}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MESSAGE = "station_id string, timestamp string, temp_c string, pressure_hpa string, rh_pct string, neighbours string"


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages (batch or stream) as observations with error: null, or why the message is refused. Numbers may be
    strings; booleans, other words, NaN and infinities are refused; nulls are absent."""
    m = F.from_json(F.col(column), MESSAGE)
    df = raw.select(column, m.alias("m")).select(column, "m.*")
    stamp = parse_timestamp(F.col("timestamp"))
    number = {v: F.trim(v).try_cast("double") for v in VARIABLES}
    bad = F.lit(False)
    for v in VARIABLES:
        bad = bad | (F.col(v).isNotNull() & (number[v].isNull() | F.isnan(number[v]) | (F.abs(number[v]) == float("inf"))))
    error = (
        F.when(F.col("station_id").isNull() | (F.trim("station_id") == ""), "station_id is required").when(stamp.isNull(), "timestamp is required").when(F.coalesce(bad, F.lit(True)), "values must be finite numbers")
    )
    return df.select("station_id", stamp.alias("timestamp"), *[number[v].alias(v) for v in VARIABLES], "neighbours", error.alias("error"))


def archive_rows(raw: DataFrame, station_id: str, column: str = "value") -> DataFrame:
    """Rows of an hourly archive response (JSON with parallel arrays); nulls stay null. Fetching is left to the caller."""
    schema = "hourly struct<time:array<string>,temperature_2m:array<double>,surface_pressure:array<double>,relative_humidity_2m:array<double>>"
    h = raw.select(F.from_json(column, schema)["hourly"].alias("h"))
    z = h.select(F.explode(F.arrays_zip("h.time", "h.temperature_2m", "h.surface_pressure", "h.relative_humidity_2m")).alias("x"))
    return z.select(F.lit(station_id).alias("station_id"), parse_timestamp(F.col("x")["time"]).alias("timestamp"), F.col("x")["temperature_2m"].alias("temp_c"), F.col("x")["surface_pressure"].alias("pressure_hpa"), F.col("x")["relative_humidity_2m"].alias("rh_pct"))


class AuditStore:
    """Append-only table of records by (station_id, timestamp), partitioned by day; the first write of a key wins.

    A write leaves keys alone that are stored already. Two writers at once may both store a key: reads then take the
    row of the file written first (ties: smaller file name), so all readers get one and the same record of a key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self) -> DataFrame | None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
        return self.spark.read.parquet(self.path) if there else None

    def records(self, *which: Column) -> DataFrame:
        """One row for each key of the rows that fit `which` (conditions on station, time or day only)."""
        df = self._table()
        for condition in which:
            df = df.where(condition)
        names = df.columns
        w = Window.partitionBy("station_id", "timestamp", "day").orderBy("__at", "__file", "seq")
        df = df.select("*", F.col("_metadata.file_modification_time").alias("__at"), F.col("_metadata.file_name").alias("__file"))
        return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*names)

    def append(self, records: DataFrame) -> None:
        """Idempotent: keys that are stored already are left alone, so a repeated batch changes nothing."""
        w = Window.partitionBy("station_id", "timestamp").orderBy("seq")
        new = records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").withColumn("day", F.to_date("timestamp"))
        if (old := self._table()) is not None:
            new = new.join(old.select("station_id", "timestamp", "day"), ["station_id", "timestamp", "day"], "left_anti")
        new.repartition("day").sortWithinPartitions("station_id", "timestamp").write.mode("append").partitionBy("day").parquet(self.path)

    def station(self, station_id: str, start=None, end=None, limit: int | None = None, newest: bool = False) -> DataFrame:
        """Inclusive bounds; partitions of other days are not read."""
        which = [F.col("station_id") == station_id]
        if start is not None:
            which.append((F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")) & (F.col("day") >= F.to_date(F.lit(start).cast("timestamp_ntz"))))
        if end is not None:
            which.append((F.col("timestamp") <= F.lit(end).cast("timestamp_ntz")) & (F.col("day") <= F.to_date(F.lit(end).cast("timestamp_ntz"))))
        df = self.records(*which).orderBy(F.desc("timestamp") if newest else "timestamp")
        return df.limit(limit) if limit else df

    def anomalies(self, station_id: str | None = None, limit: int | None = None) -> DataFrame:
        """Newest first. A key's first record decides, so the verdict is asked of it alone."""
        which = [F.col("station_id") == station_id] if station_id else []
        df = self.records(*which).where("is_anomaly").orderBy(F.desc("timestamp"))
        return df.limit(limit) if limit else df

    def count(self, station_id: str | None = None) -> int:
        if self._table() is None:
            return 0
        return self.records(*([F.col("station_id") == station_id] if station_id else [])).count()


def bounded_limit(text: str | None, default: int = 200, most: int = 5000) -> int:
    """Row limit of a request."""
    if text in (None, ""):
        return default
    n = int(text)
    if n < 1:
        raise ValueError("limit must be at least 1")
    return min(n, most)


def write_bundle(payload: dict, path: str, name: str = "EVIDENCE") -> None:
    """Driver-side evidence for a page: one assignment of strict JSON."""
    with open(path, "w") as f:
        f.write(f"window.{name} = {json.dumps(payload, allow_nan=False)};\n")


def save_artifact(model, path: str) -> None:
    with open(path, "wb") as f:
        f.write(model.to_bytes())


def load_artifact(kind: type, path: str):
    with open(path, "rb") as f:
        return kind.from_bytes(f.read())
