"""Registered queries of the file formats, messages, stored records and rendered texts: readings are written in a
format, read back through its source, and given as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meteolith.config import VARIABLES
from meteolith.functions import physics, text
from meteolith.operators import fusion, metrics, rules, temporal
from meteolith.plans.queries import evidence, obs, query, r6, rounded
from meteolith.sources import files
from meteolith.sources import observations as source


def cases(by: int, *values: Column | str | None) -> Column:
    """The value of the place seq % by; the last for all others."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    out = lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.col("seq") % by == i, lit(v)).otherwise(out)
    return out


def stamp(pattern: str) -> Column:
    return F.date_format("timestamp", pattern)


def delimited(df: DataFrame, sep: str) -> str:
    """df as delimited files with a header in the shared folder."""
    path = f"{files.shared_dir(df.sparkSession)}/x-{uuid.uuid4().hex}"
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


def readings(df: DataFrame) -> DataFrame:
    return rounded(df, ["station_id", "timestamp"], list(VARIABLES))


@query
def parsed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and times in all accepted spellings, and in some that are none."""
    number = cases(9, F.concat(F.lit(" "), (F.col("seq") % 1000).cast("string"), F.lit(".5 ")), "NA", "", "-", "NaN", "abc", "-9999", "1e3", None)
    time = cases(
        11, stamp("yyyy-MM-dd HH:mm:ss"), stamp("yyyy/MM/dd HH:mm"), stamp("yyyy-MM-dd'T'HH:mm:ss"), stamp("yyyy-MM-dd'T'HH:mm"), stamp("yyyy-MM-dd HH"), stamp("yyyyMMddHHmm"), stamp("yyyyMMdd"), stamp("yyyy/MM/dd"),
        stamp("yyyy-MM-dd'T'HH:mm:ss'+02:00'"), stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"), "soon",
    )
    return obs(spark, d).select("seq", text.parse_float(number).alias("number"), text.parse_timestamp(time).alias("time"))


@query
def csv_source(spark: SparkSession, d: str) -> DataFrame:
    """Semicolons, Fahrenheit, sea-level pressure and dew point; every 13th time cannot be read."""
    f = F.col("temp_c") * 1.8 + 32.0
    x = obs(spark, d).select(F.col("station_id").alias("Station"), F.when(F.col("seq") % 13 == 0, "soon").otherwise(stamp("yyyy-MM-dd HH:mm:ss")).alias("Date_Time"), f.alias("Air_Temperature"), F.col("pressure_hpa").alias("MSLP"), (f - 9.0).alias("Dew_Point"))
    return readings(files.load_csv(spark, delimited(x, ";"), elevation_m=250.0, temperature_unit="F"))


@query
def ghcnh_source(spark: SparkSession, d: str) -> DataFrame:
    """Bars, time in parts, pressure at the station."""
    parts = [stamp(p).alias(n) for n, p in (("Year", "yyyy"), ("Month", "M"), ("Day", "d"), ("Hour", "H"))]
    x = obs(spark, d).select("station_id", *parts, F.col("temp_c").alias("temperature"), F.col("pressure_hpa").alias("station_level_pressure"), F.col("rh_pct").alias("relative_humidity"))
    return readings(files.load_ghcnh(spark, delimited(x, "|")))


@query
def meteostat_source(spark: SparkSession, d: str) -> DataFrame:
    """One station's file without its name; `pres` is sea-level pressure."""
    x = obs(spark, d).where("station_id = 'S03'").select(stamp("yyyy-MM-dd HH:mm:ss").alias("time"), F.col("temp_c").alias("temp"), F.col("rh_pct").alias("rhum"), F.col("pressure_hpa").alias("pres"))
    return readings(files.load_meteostat(spark, delimited(x, ","), "S03", 655.0))


@query
def station_file_source(spark: SparkSession, d: str) -> DataFrame:
    """The registry with some names, elevations, terrains, ids and positions left out."""
    without = lambda c, *ids: F.when(~F.col("station_id").isin(*ids), F.col(c))
    x = source.stations(spark).select(
        without("station_id", "S01").alias("id"), without("name", "S02").alias("name"), without("lat", "S06").alias("latitude"), F.col("lon").alias("longitude"),
        without("elevation_m", "S03").alias("elev"), F.upper(without("terrain", "S04")).alias("terrain"),
    )
    return files.load_stations(spark, delimited(x, ","))


@query
def message_source(spark: SparkSession, d: str) -> DataFrame:
    """JSON messages, sound ones and such as must be refused."""
    temp = cases(7, F.col("temp_c").cast("string"), F.concat(F.lit('"'), F.col("temp_c").cast("string"), F.lit('"')), "true", '"warm"', '"NaN"', "null", F.col("temp_c").cast("string"))
    station = F.when(F.col("seq") % 17 == 0, F.lit(" ")).otherwise(F.col("station_id"))
    time = F.when(F.col("seq") % 19 == 0, F.lit("soon")).otherwise(stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    body = F.concat(F.lit('{"station_id":"'), station, F.lit('","timestamp":"'), time, F.lit('","temp_c":'), F.coalesce(temp, F.lit("null")), F.lit(',"pressure_hpa":'), F.coalesce(F.col("pressure_hpa").cast("string"), F.lit("null")), F.lit(',"extra":[1]}'))
    m = files.parse_messages(obs(spark, d).select(body.alias("value")))
    return m.select("station_id", "timestamp", *[F.when(F.col("error").isNull(), F.col(v)).alias(v) for v in VARIABLES], "error")


@query
def archive_source(spark: SparkSession, d: str) -> DataFrame:
    """Responses with parallel arrays, one for each day of a station."""
    o = obs(spark, d).where("station_id = 'S05'")
    day = o.groupBy(F.to_date("timestamp").alias("day")).agg(F.collect_list(F.struct(stamp("yyyy-MM-dd'T'HH:mm").alias("time"), *VARIABLES)).alias("x"))
    names = {"time": "time", "temp_c": "temperature_2m", "pressure_hpa": "surface_pressure", "rh_pct": "relative_humidity_2m"}
    hourly = F.struct(*[F.col("x")[c].alias(n) for c, n in names.items()])
    return files.archive_rows(day.select(F.to_json(F.struct(hourly.alias("hourly"))).alias("value")), "S05")


def stored(spark: SparkSession, d: str) -> files.AuditStore:
    """A table to which two thirds of the records were written first, then all of them with another probability."""
    store = files.AuditStore(spark, f"{files.shared_dir(spark)}/audit-{uuid.uuid4().hex}")
    r = obs(spark, d).select("seq", "station_id", "timestamp", (F.expr("seq * 37 % 1000") / 1000.0).alias("probability"))
    r = r.withColumn("is_anomaly", F.col("probability") >= 0.5)
    store.append(r.where("seq % 3 <> 0"))
    store.append(r.withColumn("probability", F.col("probability") + 1.0))
    return store


@query
def audit_range(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).station("S03", "2024-01-05 00:00:00", "2024-01-12 00:00:00").select("seq", "station_id", "timestamp", r6("probability").alias("probability"))


@query
def audit_worklist(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).anomalies("S05").select("seq", "station_id", "timestamp", r6("probability").alias("probability"))


@query
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).records().groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))


@query
def scaled_values(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d)
    z = temporal.transform(o, temporal.fit_scaler(o))
    return z.select("seq", *[r6(f"z_{v}").alias(f"z_{v}") for v in VARIABLES], *[r6(temporal.inverse(v, F.col(f"z_{v}"))).alias(f"back_{v}") for v in VARIABLES])


@query
def station_distances(spark: SparkSession, d: str) -> DataFrame:
    s = source.stations(spark)
    a, b = (s.select(F.col("station_id").alias(n), F.col("lat").alias(f"lat_{n}"), F.col("lon").alias(f"lon_{n}")) for n in ("one", "other"))
    return a.join(F.broadcast(b), F.col("one") < F.col("other")).select("one", "other", r6(physics.haversine(F.col("lat_one"), F.col("lon_one"), F.col("lat_other"), F.col("lon_other"), clamped=False)).alias("km"))


@query
def flag_details(spark: SparkSession, d: str) -> DataFrame:
    o = rules.flags(rules.layer(obs(spark, d))).select("seq", F.explode("flags").alias("f"))
    return o.select("seq", F.col("f.name").alias("name"), F.coalesce("f.variable", F.lit("record")).alias("variable"), r6("f.score").alias("score"), F.col("f.detail").alias("detail"))


@query
def rendered_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Severity, recommended action, explanation and time of every record, with classes made up from integers."""
    f = fusion.fuse(evidence(spark, d)).withColumn("p", F.expr("(seq * 7919 % 101) / 100.0D"))
    classes = [*text.ACTIONS, "unheard_of"]
    f = f.withColumn("cls", F.element_at(F.array(*[F.lit(c) for c in classes]), (F.col("seq") % len(classes) + 1).cast("int")))
    said = text.explanation(F.col("band"), F.col("p"), F.col("cls"), F.expr("(seq % 101) / 100.0D"), F.when(F.expr("seq % 2") == 0, "rate"), F.col("damped"), F.col("dominant_variable"))
    return f.select("seq", text.severity(F.col("cls"), F.col("p")).alias("severity"), text.action(F.col("cls")).alias("action"), said.alias("explanation"), text.iso(F.col("timestamp")).alias("time"))


@query
def station_timelines(spark: SparkSession, d: str) -> DataFrame:
    t = metrics.timelines(fusion.fuse(evidence(spark, d)), ["timestamp", "band", "is_anomaly"])
    return t.select("station_id", F.col("day").cast("string").alias("day"), F.array_join("band", ",").alias("bands"), F.size(F.filter("is_anomaly", lambda x: x)).cast("long").alias("anomalies"))
