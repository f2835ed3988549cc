"""Evaluation: point, event, class, calibration and ranking metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meteolith.config import BENIGN, VARIABLES


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def point_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """truth, pred (booleans) -> tp, fp, fn, tn, precision, recall, f1, false_alarm_rate."""
    t, p = F.col("truth"), F.col("pred")
    g = df.groupBy(*(by or [])).agg(_sum(t & p).alias("tp"), _sum(~t & p).alias("fp"), _sum(t & ~p).alias("fn"), _sum(~t & ~p).alias("tn"))
    g = g.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))
    g = g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return g.withColumn("false_alarm_rate", F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1)))


def label_spans(df: DataFrame) -> DataFrame:
    """station_id, start, end (inclusive positions) of runs of truth."""
    w = Window.partitionBy("station_id").orderBy("seq")
    x = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("isle", F.sum((~F.col("truth")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("truth")
    return x.groupBy("station_id", "isle").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.min(F.when(F.col("pred"), F.col("pos"))).alias("hit"))


def event_recall(df: DataFrame) -> DataFrame:
    """n_events, detected, recall, mean_delay (steps to the first hit; null if none). Spans do not cross stations."""
    s = label_spans(df)
    hit = F.col("hit").isNotNull()
    g = s.agg(F.count(F.lit(1)).alias("n_events"), _sum(hit).alias("detected"), F.avg(F.when(hit, F.col("hit") - F.col("start"))).alias("mean_delay"))
    return g.withColumn("recall", F.col("detected") / F.greatest("n_events", F.lit(1)))


def class_recall(df: DataFrame) -> DataFrame:
    return df.where(~F.col("fault_class").isin(*BENIGN)).groupBy("fault_class").agg(F.avg(F.col("pred").cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def genuine_far(df: DataFrame) -> DataFrame:
    return df.where(F.col("fault_class") == "genuine_extreme").agg(F.coalesce(F.avg(F.col("pred").cast("double")), F.lit(0.0)).alias("genuine_far"))


def confusion(df: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each true class, one column for each predicted one; unknown labels drop."""
    x = df.where(F.col("true_class").isin(*labels) & F.col("pred_class").isin(*labels))
    return x.groupBy("true_class").pivot("pred_class", labels).agg(F.count(F.lit(1))).na.fill(0)


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_prob, mean_truth over (lo, hi] bins, the first including 0; edges are literals."""
    bin_ = sum(((F.col("score") > i / bins).cast("int") for i in range(1, bins)), F.lit(0))
    return df.withColumn("bin", bin_).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_prob"), F.avg(F.col("truth").cast("double")).alias("mean_truth"))


def ece(df: DataFrame, bins: int = 10) -> DataFrame:
    c = calibration(df, bins)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("mean_truth"))) / F.sum("n")).alias("ece"))


def cuts(df: DataFrame) -> DataFrame:
    """score, tp, fp cumulated from the highest score down, one row for each distinct score.

    Counts are first summed by score (partially, before any shuffle); the window then sees distinct scores only, in
    buckets of their own whose totals are added, so no task holds all scores."""
    g = df.groupBy("score").agg(_sum(F.col("truth")).alias("p"), _sum(~F.col("truth")).alias("n")).withColumn("bucket", F.floor(F.col("score") * 256))
    totals = g.groupBy("bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    w = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # at most 257 rows for probabilities
    totals = totals.select("bucket", F.coalesce(F.sum("bp").over(w), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(w), F.lit(0)).alias("n0"))
    own = Window.partitionBy("bucket").orderBy(F.desc("score"))
    return g.join(totals, "bucket").select("score", (F.col("p0") + F.sum("p").over(own)).alias("tp"), (F.col("n0") + F.sum("n").over(own)).alias("fp"), "p", "n")


def roc_auc(df: DataFrame) -> DataFrame:
    """auc (exact, every cut): each cut adds a trapezoid of its own counts, so no row needs its neighbour. Null if one
    kind of label is missing."""
    c = cuts(df)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0))
    return c.agg((area / F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.sum("p") * F.sum("n"))).alias("auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """average_precision, baseline over every cut."""
    c = cuts(df)
    ap = F.sum(F.col("p") * F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))) / F.when(F.sum("p") > 0, F.sum("p"))
    return c.agg(ap.alias("average_precision"), (F.sum("p") / F.sum(F.col("p") + F.col("n"))).alias("baseline"))


def thinned(curve: DataFrame, points: int = 200) -> DataFrame:
    """About `points` cuts of a curve, spread evenly over its rank, first and last included."""
    # tp + fp is the rank of a cut, so tiles are even steps of rank and need no window over all cuts.
    rank = F.col("tp") + F.col("fp")
    most = curve.agg(F.max(rank).alias("most"))
    g = curve.join(F.broadcast(most)).withColumn("tile", F.floor((rank - 1) * (points - 1) / F.greatest("most", F.lit(1))))
    ends = g.groupBy("tile").agg(F.max_by(F.struct("score", "tp", "fp"), rank).alias("c")).select("c.*")
    return ends.unionByName(curve.orderBy(F.desc("score")).limit(1).select("score", "tp", "fp")).distinct()


def histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    return df.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def two_tier(df: DataFrame) -> DataFrame:
    """Point metrics of quarantine (is_anomaly) and review (status is not PASS)."""
    both = df.select("truth", F.explode(F.array(F.struct(F.lit("quarantine").alias("tier"), F.col("is_anomaly").alias("pred")), F.struct(F.lit("review").alias("tier"), (F.col("qc_status") != "PASS").alias("pred")))).alias("x")).select("truth", "x.*")
    return point_metrics(both, ["tier"])


def latency(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("latency").alias("mean"), *[F.percentile("latency", q).alias(n) for n, q in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))])


def case_studies(df: DataFrame, top: int = 8) -> DataFrame:
    """The likeliest detected row of each fault class (first of equals) and the likeliest genuine extreme that was left
    alone; the `top` likeliest of those."""
    quiet = (F.col("fault_class") == "genuine_extreme") & ~F.col("pred")
    told = df.where((~F.col("fault_class").isin(*BENIGN) & F.col("pred")) | quiet)
    best = told.groupBy("fault_class").agg(F.min_by(F.struct(*df.columns), F.struct((-F.col("probability")).alias("p"), "seq")).alias("x"))
    return best.select("x.*").orderBy(F.desc("probability"), "seq").limit(top)


def compare(df: DataFrame, detectors: dict[str, Column], cut: float = 0.5) -> DataFrame:
    """One row for each detector: point metrics at `cut`, the share of genuine extremes it flags, and the exact area
    under its curve. Genuine extremes count as normal. Needs truth, fault_class; scores lie in [0, 1]."""
    scores = F.array(*[F.struct(F.lit(n).alias("detector"), c.cast("double").alias("score")) for n, c in detectors.items()])
    rows = df.select("truth", "fault_class", F.explode(scores).alias("x")).select("truth", "fault_class", "x.*").withColumn("pred", F.col("score") >= cut)
    points = point_metrics(rows, ["detector"])
    genuine = rows.groupBy("detector").agg(F.coalesce(F.avg(F.when(F.col("fault_class") == "genuine_extreme", F.col("pred").cast("double"))), F.lit(0.0)).alias("genuine_far"))
    # As cuts(), by detector: counts by score, totals of 256 ranges of it, then cumulated within a range.
    g = rows.groupBy("detector", "score").agg(_sum(F.col("truth")).alias("p"), _sum(~F.col("truth")).alias("n")).withColumn("bucket", F.floor(F.col("score") * 256))
    above = Window.partitionBy("detector").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = g.groupBy("detector", "bucket").agg(F.sum("p").alias("bp")).withColumn("p0", F.coalesce(F.sum("bp").over(above), F.lit(0))).drop("bp")
    own = Window.partitionBy("detector", "bucket").orderBy(F.desc("score"))
    c = g.join(totals, ["detector", "bucket"]).withColumn("tp", F.col("p0") + F.sum("p").over(own))
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.sum("p") * F.sum("n"))
    return points.join(genuine, "detector").join(c.groupBy("detector").agg(area.alias("auc")), "detector")


def reconstruction_by_variable(df: DataFrame) -> DataFrame:
    """variable, n, mean_error of rows that are not anomalous and have a reconstruction."""
    errors = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"recon_error_{v}").alias("error")) for v in VARIABLES])
    x = df.where(~F.col("is_anomaly") & F.col("recon_available")).select(F.explode(errors).alias("x")).select("x.*")
    return x.groupBy("variable").agg(F.count("error").alias("n"), F.avg("error").alias("mean_error"))


def timelines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Arrays in time order for each station, in chunks of days so that no list grows without bound."""
    rows = F.array_sort(F.collect_list(F.struct("seq", *columns)))
    g = df.groupBy("station_id", F.to_date("timestamp").alias("day")).agg(rows.alias("rows"))
    return g.select("station_id", "day", *[F.col("rows")[c].alias(c) for c in columns])
