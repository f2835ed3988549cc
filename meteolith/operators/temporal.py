"""Layer 2 around the model: robust scaling, windows, thresholds and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meteolith.config import DEFAULT, VARIABLES, Threshold
from meteolith.functions.physics import cyclic_time, sigmoid

MAD = 1.4826


def median(c: str | Column) -> Column:
    return F.percentile(c, 0.5)


def fit_scaler(obs: DataFrame, by: tuple = ("station_id",), floor: float = 1e-6) -> DataFrame:
    """med_<v>, scale_<v> of each station: median and 1.4826 MAD, with a floor."""
    med = obs.groupBy(*by).agg(*[median(v).alias(f"med_{v}") for v in VARIABLES])
    dev = obs.join(med, list(by)).groupBy(*by, *[f"med_{v}" for v in VARIABLES]).agg(*[F.greatest(MAD * median(F.abs(F.col(v) - F.col(f"med_{v}"))), F.lit(floor)).alias(f"scale_{v}") for v in VARIABLES])
    return dev


def transform(obs: DataFrame, scaler: DataFrame) -> DataFrame:
    """z_<v>; stations without a scaler get nulls."""
    joined = obs.join(scaler, "station_id", "left")
    return joined.withColumns({f"z_{v}": (F.col(v) - F.col(f"med_{v}")) / F.col(f"scale_{v}") for v in VARIABLES})


def inverse(v: str, z: Column) -> Column:
    return z * F.col(f"scale_{v}") + F.col(f"med_{v}")


def complete() -> Column:
    out = F.lit(True)
    for v in VARIABLES:
        out = out & F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(out, F.lit(False))


def spans(z: DataFrame) -> DataFrame:
    """complete, island: an incomplete row begins another."""
    z = z.withColumn("complete", complete())
    return z.withColumn("island", F.sum((~F.col("complete")).cast("long")).over(Window.partitionBy("station_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def windows(z: DataFrame, width: int) -> DataFrame:
    """window: array of `width` rows of 7 features (3 scaled, 4 of time), null until so many complete rows stand in a
    row; an incomplete row clears the window."""
    z = spans(z)
    frame = Window.partitionBy("station_id", "island", "complete").orderBy("seq").rowsBetween(1 - width, 0)
    features = F.array(*[F.col(f"z_{v}") for v in VARIABLES], *cyclic_time(F.col("timestamp")))
    rows = F.collect_list(features).over(frame)
    return z.withColumn("window", F.when(F.col("complete") & (F.count(F.lit(1)).over(frame) == width) & F.col("z_temp_c").isNotNull(), rows))


def training_windows(z: DataFrame, width: int, stride: int) -> DataFrame:
    """Every stride-th full window of each station."""
    w = windows(z, width).where("window is not null")
    n = F.row_number().over(Window.partitionBy("station_id").orderBy("seq"))
    return w.withColumn("__n", n - 1).where(F.col("__n") % stride == 0).drop("__n")


def level(errors: str, cfg: Threshold) -> list[Column]:
    """med, q of an error column; sigma needs a second pass."""
    return [median(errors).alias("med"), F.percentile(errors, cfg.quantile).alias("q"), F.count(errors).alias("n")]


def fit_levels(errors: DataFrame, by: list[str], cfg: Threshold = DEFAULT.threshold, column: str = "error") -> DataFrame:
    """threshold = max(med + k sigma, quantile), med, sigma, n of each group."""
    one = errors.groupBy(*by).agg(*level(column, cfg))
    if by:
        both = errors.join(one, by)
    else:
        both = errors.crossJoin(F.broadcast(one))  # one row
    out = both.groupBy(*by, "med", "q", "n").agg((MAD * median(F.abs(F.col(column) - F.col("med")))).alias("sigma"))
    return out.withColumn("threshold", F.greatest(F.col("med") + cfg.k * F.col("sigma"), F.col("q"))).select(*by, "threshold", "med", "sigma", "n")


def fit_station_thresholds(errors: DataFrame, cfg: Threshold = DEFAULT.threshold) -> DataFrame:
    """Levels of each station; stations with too few samples take the network's (fallback)."""
    own, net = fit_levels(errors, ["station_id"], cfg), fit_levels(errors, [], cfg)
    net = net.select(*[F.col(c).alias(f"net_{c}") for c in ("threshold", "med", "sigma")])
    few = F.col("n") < cfg.min_samples
    own = own.crossJoin(F.broadcast(net))  # one row
    return own.select("station_id", *[F.when(few, F.col(f"net_{c}")).otherwise(F.col(c)).alias(c) for c in ("threshold", "med", "sigma")], few.alias("fallback"), "n")


def fit_buckets(errors: DataFrame, cfg: Threshold = DEFAULT.threshold) -> DataFrame:
    """Levels of (station, bucket) with enough samples."""
    return fit_levels(errors, ["station_id", "bucket"], cfg).where(F.col("n") >= cfg.min_bucket)


def probability(error: Column, threshold: Column, sigma: Column, cfg: Threshold = DEFAULT.threshold) -> Column:
    return sigmoid(cfg.steepness * (error - threshold) / F.greatest(sigma, F.lit(1e-9)))


def score(errors: DataFrame, thresholds: DataFrame, buckets: DataFrame | None = None, cfg: Threshold = DEFAULT.threshold) -> DataFrame:
    """recon_p and used_threshold; a bucket's threshold where it has one, always the station's sigma."""
    df = errors.join(thresholds.select("station_id", "threshold", "sigma"), "station_id", "left")
    if buckets is not None:
        df = df.join(buckets.select("station_id", "bucket", F.col("threshold").alias("bucket_threshold")), ["station_id", "bucket"], "left")
        df = df.withColumn("used_threshold", F.coalesce("bucket_threshold", "threshold")).drop("bucket_threshold")
    else:
        df = df.withColumn("used_threshold", F.col("threshold"))
    return df.withColumn("recon_p", probability(F.col("error"), F.col("used_threshold"), F.col("sigma"), cfg)).drop("threshold", "sigma")
