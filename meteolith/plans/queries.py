"""Registered queries over the driver's tables; each takes (spark, sf_dir)."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meteolith.config import DEFAULT, VARIABLES
from meteolith.functions import physics
from meteolith.operators import baselines, diagnosis, fusion, grid, injection, metrics, multivariate, response, rules, spatial, temporal
from meteolith.operators.lstm import reconstruct
from meteolith.plans import pipeline
from meteolith.sources import files
from meteolith.sources import observations as source
from meteolith.streaming import stateful

QUERIES = {}
LOOSE = dataclasses.replace(DEFAULT.rules, tolerance={v: 2.0 for v in VARIABLES}, repeats={v: 3 for v in VARIABLES})


def query(f):
    QUERIES[f.__name__] = f
    return f


def obs(spark: SparkSession, d: str) -> DataFrame:
    return source.from_events(spark, d)


def chronological(df: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """df before and from the time by which `share` of its readings have come."""
    cut = df.agg(F.percentile(F.unix_micros(F.col("timestamp").cast("timestamp")), share)).first()[0]
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    return df.where(at < F.lit(cut)), df.where(at >= F.lit(cut))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(v).alias(v) for v in values])


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Readings with made-up layer results from integers, to drive fusion and what follows in plain SQL too."""
    h = lambda a, m: F.expr(f"(seq * {a}) % {m}")
    o = obs(spark, d)
    return o.withColumns({
        "rule_score": h(7919, 1000) / 1000.0, "persistence_score": F.when(h(31, 7) == 0, h(17, 1000) / 1000.0).otherwise(0.0), "has_hard": h(13, 97) == 0,
        "recon_available": h(3, 5) != 0, "recon_p": h(37, 1000) / 1000.0, "multi_available": h(5, 7) != 0, "multi_p": h(53, 1000) / 1000.0,
        "spatial_available": h(7, 4) != 0, "spatial_p": h(71, 1000) / 1000.0,
        **{f"rule_{v}": h(a, 10) / 10.0 for v, a in zip(VARIABLES, (3, 7, 9), strict=True)}, **{f"recon_error_{v}": h(a, 8) / 4.0 for v, a in zip(VARIABLES, (3, 5, 7), strict=True)},
        "complete": temporal.complete(),
    })


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """seq, station_id, timestamp, truth, score, pred, fault_class, true_class, pred_class."""
    o = rules.sentinel_range(obs(spark, d))
    hard = F.col("hard_temp_c") | F.col("hard_pressure_hpa") | F.col("hard_rh_pct")
    o = o.withColumn("truth", hard | (F.col("event_type") == "error"))
    h = F.expr("(seq * 7919) % 1000")
    score = F.when(F.col("truth"), F.expr("(300 + ((seq * 7919) % 1000) * 7 div 10)") / 1000.0).otherwise(h / 1000.0)
    o = o.withColumn("score", score).withColumn("pred", F.col("score") >= 0.5)
    cls = F.when(F.col("corrupt_temp_c"), "corrupt").when(F.col("truth") & (F.expr("seq % 3") == 0), "spike").when(F.col("truth"), "noise").when(F.expr("seq % 11") == 0, "genuine_extreme").otherwise("none")
    o = o.withColumn("fault_class", cls).withColumn("true_class", cls)
    return o.withColumn("pred_class", F.when(~F.col("pred"), "none").when(F.expr("seq % 5") == 0, "spike").otherwise(F.col("true_class")))


# Layer 1


@query
def l1_sentinel_range(spark, d):
    o = rules.sentinel_range(obs(spark, d))
    return o.select("seq", "station_id", *[f"{p}_{v}" for p in ("corrupt", "range", "hard") for v in VARIABLES])


@query
def l1_missing_run(spark, d):
    o = rules.missing_runs(obs(spark, d))
    return rounded(o, ["seq", *[f"missing_run_{v}" for v in VARIABLES]], [f"missing_score_{v}" for v in VARIABLES])


@query
def l1_timestamp_integrity(spark, d):
    """In an arrival order that turns blocks of 64 events round."""
    o = rules.clock(obs(spark, d).withColumn("seq", F.col("seq").bitwiseXOR(63)), dataclasses.replace(DEFAULT.rules, interval_minutes=30))
    o = o.withColumn("gap_us", F.coalesce("gap_us", F.lit(0).cast("long")))
    return rounded(o, ["seq", "gap_us"], ["duplicate_score", "reversal_score", "gap_score"])


@query
def l1_rate_of_change(spark, d):
    o = rules.rates(rules.clock(rules.sentinel_range(obs(spark, d))))
    return rounded(o, ["seq"], [f"{p}_{v}" for p in ("delta", "rate_score") for v in VARIABLES])


@query
def l1_persistence_fold(spark, d):
    o = rules.persistence(rules.persistence_runs(obs(spark, d), LOOSE), LOOSE)
    return rounded(o, ["seq", *[f"run_{v}" for v in VARIABLES]], [f"persistence_score_{v}" for v in VARIABLES])


@query
def l1_record_score(spark, d):
    o = rules.layer(obs(spark, d))
    return rounded(o, ["seq", "station_id", "has_hard"], [*[f"rule_{v}" for v in VARIABLES], "rule_score"])


@query
def l1_flag_counts(spark, d):
    o = rules.flags(rules.layer(obs(spark, d))).select(F.explode("flags").alias("f"))
    return o.groupBy(F.col("f.name").alias("name"), F.coalesce("f.variable", F.lit("record")).alias("variable"), F.col("f.hard").alias("hard")).agg(F.count(F.lit(1)).alias("n"))


@query
def hard_violations(spark, d):
    o = rules.sentinel_range(obs(spark, d))
    return o.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"hard_{v}").cast("long")).alias(f"hard_{v}") for v in VARIABLES])


@query
def trusted_gate(spark, d):
    o = source.trusted(obs(spark, d))
    return o.groupBy("station_id").agg(F.sum(F.col("keep").cast("long")).alias("kept"), F.sum((~F.col("keep")).cast("long")).alias("dropped"))


# Layer 2


@query
def robust_scaler_fit(spark, d):
    return rounded(temporal.fit_scaler(obs(spark, d)), ["station_id"], [f"{p}_{v}" for p in ("med", "scale") for v in VARIABLES])


@query
def l2_window_availability(spark, d):
    o = obs(spark, d)
    w = temporal.windows(temporal.transform(o, temporal.fit_scaler(o)), 8)
    return w.select("seq", "complete", "island", F.col("window").isNotNull().alias("available"))


def errors(spark, d) -> DataFrame:
    o = obs(spark, d).where("rh_pct is not null")
    return o.select("seq", "station_id", (F.abs(F.col("rh_pct") - 65.0) / 10.0).alias("error"), F.floor(F.hour("timestamp") / 6).cast("int").alias("bucket"))


@query
def threshold_levels(spark, d):
    return rounded(temporal.fit_station_thresholds(errors(spark, d)), ["station_id", "fallback", "n"], ["threshold", "med", "sigma"])


@query
def threshold_bucketed(spark, d):
    return rounded(temporal.fit_buckets(errors(spark, d)), ["station_id", "bucket", "n"], ["threshold", "med", "sigma"])


@query
def error_probability(spark, d):
    e = errors(spark, d)
    s = temporal.score(e, temporal.fit_station_thresholds(e), temporal.fit_buckets(e))
    return rounded(s, ["seq"], ["used_threshold", "recon_p"])


@query
def lstm_reconstruction(spark, d):
    f = fitted(spark, d)
    z = temporal.transform(obs(spark, d).where(temporal.complete()), f.scaler)
    return reconstruct(temporal.windows(z, f.model.window), f.model).select("seq", "station_id", "recon_error", *[f"recon_error_{v}" for v in VARIABLES])


# Layer 3


@query
def multivariate_moments(spark, d):
    m = multivariate.moments(source.trusted(obs(spark, d)).where("keep"))
    return rounded(m, ["station_id", "n"], [c for c in m.columns if c not in ("station_id", "n")])


@query
def multivariate_evaluate(spark, d):
    o = rules.layer(obs(spark, d))
    m = multivariate.fit(source.trusted(obs(spark, d)).where("keep"))
    return multivariate.evaluate(o, m).select("seq", "multi_available", "mahalanobis", "multi_p", "dewpoint_c", "physical_violation", *[f"multi_share_{v}" for v in VARIABLES])


@query
def physics_functions(spark, d):
    o = source.trusted(obs(spark, d)).where("keep")
    t, p, h = F.col("temp_c"), F.col("pressure_hpa"), F.col("rh_pct")
    dew = physics.dewpoint(t, h)
    cols = {
        "dew_qc": dew, "dew_network": physics.dewpoint(t, h, physics.MAGNUS_NETWORK), "rh_back": physics.rh_from_dewpoint(t, dew), "rh_grid": physics.rh_from_dewpoint(t, dew, 0.5),
        "saturation": physics.saturation_pressure(t), "celsius": physics.fahrenheit_to_celsius(t), "station_p": physics.station_pressure(p, F.lit(560.0), t),
        "lapse": physics.lapse_corrected(t, F.lit(14.0), F.lit(560.0), 0.0065), "barometric": physics.pressure_at(p, F.lit(14.0), F.lit(560.0), t),
        **dict(zip(("hour_sin", "hour_cos", "day_sin", "day_cos"), physics.cyclic_time(F.col("timestamp")), strict=True)), "sigmoid": physics.sigmoid((t - 20.0) / 3.0),
    }
    return o.select("seq", *[r6(c).alias(n) for n, c in cols.items()])


# Layer 4


@query
def station_pairs(spark, d):
    return rounded(spatial.station_pairs(source.stations(spark)), ["target", "neighbour"], ["distance_km", "dz", "weight"])


@query
def spatial_neighbours_topk(spark, d):
    n = spatial.neighbours(obs(spark, d).drop(*VARIABLES), source.stations(spark))  # who is near does not depend on values
    return rounded(n, ["target_seq", "neighbour", "n_seq", "rank"], ["weight"])


@query
def spatial_consensus(spark, d):
    c = spatial.consensus(spatial.heaviest(obs(spark, d), source.stations(spark)))
    c = c.withColumn("neighbour_ids", F.array_join("neighbour_ids", ","))
    return rounded(c, ["target_seq", "n_neighbours", "neighbour_ids", "spatial_available"], ["spatial_p", *[f"{p}_{v}" for p in ("expected", "residual", "normalised") for v in VARIABLES]])


# Layer 5, status, correction


@query
def fusion_probability(spark, d):
    return rounded(fusion.fuse(evidence(spark, d)), ["seq", "damped", "band", "is_anomaly", "dominant_variable"], ["probability"])


@query
def fusion_ablation(spark, d):
    return rounded(fusion.ablation(evidence(spark, d)), ["seq"], ["p_rules", "p_recon", "p_multi", "p_full"])


@query
def qc_status(spark, d):
    f = fusion.fuse(evidence(spark, d))
    f = f.withColumn("qc_status", fusion.status(F.expr("seq % 2") == 0))
    return f.groupBy("station_id", "qc_status").agg(F.count(F.lit(1)).alias("n"))


@query
def correction_blend(spark, d):
    f = response.carried(fusion.fuse(evidence(spark, d)))
    f = f.withColumns({"n_neighbours": F.expr("cast(seq % 7 as int)"), **{f"expected_{v}": F.when(F.expr("seq % 3") != 0, F.col(v) + 0.5) for v in VARIABLES}, **{f"recon_value_{v}": F.when(F.col("recon_available"), F.col(v) - 0.25) for v in VARIABLES}})
    c = response.correct(f).where("is_anomaly and complete")
    return rounded(c, ["seq", "bad_run", "correction_method_temp_c", "correction_method_rh_pct"], [*[f"corrected_{v}" for v in VARIABLES], "correction_confidence_temp_c"])


# Events, health


@query
def event_aggregation(spark, d):
    f = fusion.fuse(evidence(spark, d))
    f = f.withColumn("fault_class", F.when(F.expr("seq % 4") == 0, "none").when(F.expr("seq % 4") == 1, "spike").otherwise("noise")).withColumn("confidence", F.col("rule_score")).withColumn("variables", F.array("dominant_variable"))
    e = response.events(f.withColumn("variables", F.filter("variables", lambda v: v.isNotNull())))
    return e.withColumn("variables", F.array_join("variables", ",")).select("station_id", "event_id", "start", "end", "n_points", "fault_class", r6("confidence").alias("confidence"), r6("probability").alias("probability"), "variables", r6("duration_minutes").alias("duration_minutes"))


def ledger(spark, d) -> DataFrame:
    f = fusion.fuse(evidence(spark, d))
    rows = [F.struct(F.lit(v).alias("variable"), (F.col("is_anomaly") & F.coalesce(F.col("dominant_variable") == v, F.lit(False))).alias("blamed"), F.col(f"recon_error_{v}").alias("error"), (F.col(v) - m).alias("residual")) for v, m in zip(VARIABLES, (20.0, 1000.0, 65.0), strict=True)]
    return f.select("station_id", "seq", (F.col("recon_available") & ~F.col("is_anomaly")).alias("usable"), F.explode(F.array(*rows)).alias("x")).select("station_id", "seq", "usable", "x.*")


@query
def health_indicators(spark, d):
    s = response.sensor_health(response.indicators(ledger(spark, d)))
    return rounded(s, ["station_id", "variable", "n_points", "status"], ["anomaly_rate", "error_trend", "bias", "drift", "score"])


@query
def station_health(spark, d):
    return rounded(response.station_health(response.sensor_health(response.indicators(ledger(spark, d)))), ["station_id", "n_points", "status", "maintenance_risk"], ["overall_score"])


# Grid


def gridded(spark, d) -> DataFrame:
    return grid.build(grid.hourly(obs(spark, d)), source.stations(spark))


@query
def grid_fill(spark, d):
    return gridded(spark, d)


@query
def interval_mode(spark, d):
    return grid.interval_counts(grid.hourly(obs(spark, d)))


@query
def centred_mean(spark, d):
    g = gridded(spark, d)
    g = g.withColumn("loose", grid.centred_mean(F.col("pressure_hpa"), ["station_id"], 6)).withColumn("full", grid.centred_mean(F.col("pressure_hpa"), ["station_id"], 6, full=True))
    return rounded(g, ["station_id", "step"], ["loose", "full"])


@query
def temperature_anomaly(spark, d):
    return rounded(grid.temperature_anomaly(gridded(spark, d).where("temp_c > -100 or temp_c is null")), ["step"], ["anomaly"])


@query
def extreme_spans(spark, d):
    """With low bars, as the view's values are nearly independent."""
    g = gridded(spark, d).where("temp_c > -100 or temp_c is null")
    return rounded(grid.extremes(g, 0.3, 0.5, 3), ["kind", "start", "end"], ["peak"])


@query
def chronological_split(spark, d):
    return grid.split(gridded(spark, d), 720).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi"))


@query
def diurnal_profile(spark, d):
    f = fusion.fuse(evidence(spark, d)).withColumn("recon_value_temp_c", F.when(F.col("recon_available"), F.col("temp_c") - 0.25))
    return grid.diurnal_profile(f.where("temp_c > -100"))


# Injection, baselines


@query
def injected_network(spark, d):
    g = gridded(spark, d)
    steps = g.agg(F.max("step")).first()[0] + 1
    sigma = {r["station_id"]: {v: r[f"sigma_{v}"] for v in VARIABLES} for r in injection.robust_sigma(g).collect()}
    plan = injection.plan(sorted(sigma), steps, sigma)
    return injection.inject(g, spark.createDataFrame(plan, injection.SPANS)).select("station_id", "step", *VARIABLES, "fault_class", "is_fault")


@query
def injection_sigma(spark, d):
    return rounded(injection.robust_sigma(gridded(spark, d)), ["station_id"], [f"sigma_{v}" for v in VARIABLES])


@query
def robust_zscore_baseline(spark, d):
    return rounded(baselines.zscore(obs(spark, d)), ["seq"], ["zscore"])


@query
def ecdf_scores(spark, d):
    x = labelled(spark, d)
    return rounded(baselines.ecdf(x, ~F.col("truth")), ["seq"], ["calibrated"])


def _detector(name: str):
    def f(spark, d):
        return baselines.detect(obs(spark, d), name).select("seq", "station_id", "score")

    QUERIES[name] = f


for _name in baselines.DETECTORS:
    _detector(_name)


# Metrics


@query
def point_metrics(spark, d):
    m = metrics.point_metrics(labelled(spark, d))
    return rounded(m, ["tp", "fp", "fn", "tn"], ["precision", "recall", "f1", "false_alarm_rate"])


@query
def event_recall(spark, d):
    return rounded(metrics.event_recall(labelled(spark, d)), ["n_events", "detected"], ["recall", "mean_delay"])


@query
def per_class_recall(spark, d):
    return rounded(metrics.class_recall(labelled(spark, d)), ["fault_class", "n"], ["recall"])


@query
def genuine_false_alarms(spark, d):
    return rounded(metrics.genuine_far(labelled(spark, d)), [], ["genuine_far"])


@query
def confusion_matrix(spark, d):
    return metrics.confusion(labelled(spark, d), ["none", "spike", "noise", "corrupt"])


@query
def ece_bins(spark, d):
    return rounded(metrics.calibration(labelled(spark, d)), ["bin", "n"], ["mean_prob", "mean_truth"])


@query
def expected_calibration_error(spark, d):
    return rounded(metrics.ece(labelled(spark, d)), [], ["ece"])


@query
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(labelled(spark, d)), [], ["auc"])


@query
def average_precision(spark, d):
    return rounded(metrics.average_precision(labelled(spark, d)), [], ["average_precision", "baseline"])


@query
def score_histogram(spark, d):
    return metrics.histogram(labelled(spark, d))


@query
def two_tier_scorecard(spark, d):
    f = fusion.fuse(evidence(spark, d))
    f = f.withColumn("qc_status", fusion.status(F.lit(False))).withColumn("truth", F.col("has_hard"))
    return rounded(metrics.two_tier(f), ["tier", "tp", "fp", "fn", "tn"], ["precision", "recall", "f1", "false_alarm_rate"])


@query
def latency_percentiles(spark, d):
    x = labelled(spark, d).withColumn("latency", F.expr("((seq * 131) % 977)") / 1000.0)
    return rounded(metrics.latency(x, ["pred"]), ["pred"], ["mean", "median", "p95", "p99"])


@query
def case_studies(spark, d):
    x = labelled(spark, d).withColumn("probability", F.col("score"))
    return metrics.case_studies(x).select("seq", "fault_class", "probability")


def judged(spark, d) -> DataFrame:
    """The made-up evidence with truth and classes."""
    e = evidence(spark, d).withColumn("truth", F.col("has_hard") | (F.col("event_type") == "error"))
    return e.withColumn("fault_class", F.when(F.col("truth"), "noise").when(F.expr("seq % 11") == 0, "genuine_extreme").otherwise("none"))


@query
def detector_comparison(spark, d):
    e = fusion.fuse(judged(spark, d))
    detectors = {"rules": F.col("rule_score"), "autoencoder": F.when(F.col("recon_available"), F.col("recon_p")).otherwise(0.0), "consensus": F.when(F.col("spatial_available"), F.col("spatial_p")).otherwise(0.0), "fused": F.col("probability")}
    return rounded(metrics.compare(e, detectors), ["detector", "tp", "fp", "fn", "tn"], ["precision", "recall", "f1", "false_alarm_rate", "genuine_far", "auc"])


@query
def ablation_ladder(spark, d):
    """The layers added one by one, figures to four places."""
    steps = {"rules": "p_rules", "with autoencoder": "p_recon", "with joint state": "p_multi", "full": "p_full"}
    c = metrics.compare(fusion.ablation(judged(spark, d)), {n: F.col(c) for n, c in steps.items()})
    return c.select("detector", *[F.round(x, 4).alias(x) for x in ("f1", "precision", "false_alarm_rate", "genuine_far", "auc")])


@query
def reconstruction_by_variable(spark, d):
    return rounded(metrics.reconstruction_by_variable(fusion.fuse(evidence(spark, d))), ["variable", "n"], ["mean_error"])


# Serving reads


@query
def worklist_topn(spark, d):
    f = fusion.fuse(evidence(spark, d)).where("is_anomaly").orderBy(F.desc("timestamp"), F.desc("seq")).limit(200)
    return rounded(f, ["seq", "station_id", "timestamp", "band"], ["probability"])


@query
def station_range_scan(spark, d):
    o = obs(spark, d)
    lo, hi = (F.lit(f"2024-01-{x} 00:00:00").cast("timestamp_ntz") for x in ("05", "12"))
    return o.where((F.col("station_id") == "S03") & (F.col("timestamp") >= lo) & (F.col("timestamp") <= hi)).select("seq", "timestamp", *VARIABLES)


@query
def record_counts(spark, d):
    return obs(spark, d).groupBy("station_id").count().withColumnRenamed("count", "n")


@query
def station_registry(spark, d):
    return source.stations(spark)


# Whole engine


_FITTED: dict[int, tuple[DataFrame, pipeline.Fitted]] = {}


def fitted(spark, d) -> pipeline.Fitted:
    """All trusted readings; the model is trained on the earlier and stopped by the later ones. Queries over the same
    table of observations share what was fitted."""
    o = obs(spark, d)
    if id(o) not in _FITTED:
        clean = source.trusted(o).where("keep").drop("keep")
        _FITTED[id(o)] = (o, pipeline.fit(*chronological(clean), whole=clean))
    return dataclasses.replace(_FITTED[id(o)][1])


def readings(spark, d) -> DataFrame:
    """What the layers read: a column that no result needs would go through every shuffle of the chain."""
    return obs(spark, d).drop("event_type")


@query
def engine_without_models(spark, d):
    """The whole chain where nothing was fitted: rules, consensus, fusion; the model's layers abstain."""
    out = pipeline.process(readings(spark, d), source.stations(spark), pipeline.Fitted(), explain=False)
    return rounded(out, ["seq", "station_id", "has_hard", "spatial_available", "band", "is_anomaly", "dominant_variable"], ["rule_score", "spatial_p", "probability"])


@query
def full_pipeline(spark, d):
    out = pipeline.process(readings(spark, d), source.stations(spark), fitted(spark, d), explain=False)
    return out.select("seq", "station_id", "timestamp", "rule_score", "recon_p", "multi_p", "spatial_p", "probability", "band", "is_anomaly", "dominant_variable", "qc_status", "explanation")


def trained_forest(spark, d, f: pipeline.Fitted) -> diagnosis.FaultForest:
    """Fitted on all fingerprints of faults put into the clean hourly grid, in the order of their hashes."""
    g = files.written(gridded(spark, d).where(temporal.complete()))  # several actions read it
    rows = pipeline.training_set(g.drop("event_type"), source.stations(spark), f).orderBy(F.xxhash64("fingerprint"), "fault_class").toArrow()
    x = rows.column("fingerprint").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, len(diagnosis.FEATURES))
    return diagnosis.FaultForest(DEFAULT.forest).fit(x, rows.column("fault_class").to_pylist())


@query
def fault_diagnosis(spark, d):
    f = fitted(spark, d)
    f.forest = trained_forest(spark, d, f)  # a copy's: what is shared stays as it is
    out = pipeline.process(readings(spark, d), source.stations(spark), f, flagged=True).withColumn("narrative", F.array_join(diagnosis.narrative(), "\n"))
    return out.select("seq", "station_id", "fault_class", "confidence", "severity", "recommended_action", F.to_json(diagnosis.shares()).alias("evidence"), "narrative", "explanation")


@query
def audit_documents(spark, d):
    return pipeline.document(pipeline.process(readings(spark, d), source.stations(spark), fitted(spark, d), explain=False))


@query
def stream_l1_replay(spark, d):
    """The stateful operator over the same readings as a file stream, in one go."""
    stream = stateful.score_stream(source.stream_events(spark, d).drop("event_type"))
    out = stateful.replay(stream, f"{files.shared_dir(spark)}/replay-{uuid.uuid4().hex}")
    return rounded(out, ["seq", "station_id", "has_hard"], [*[f"rule_{v}" for v in VARIABLES], "rule_score"])


ENTRY = hard_violations
