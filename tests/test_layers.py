"""Hand-checked cases of each layer."""

import dataclasses
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meteolith.config import DEFAULT, VARIABLES
from meteolith.functions import text
from meteolith.operators import baselines, diagnosis, fusion, grid, injection, lstm, metrics, response, rules, spatial, temporal
from meteolith.plans import pipeline
from meteolith.sources import files, observations
from meteolith.streaming import stateful

T0 = dt.datetime(2025, 6, 1)


def series(spark, n=5, station="A", **changes):
    rows = []
    for i in range(n):
        r = {"temp_c": 28 + 0.1 * i, "pressure_hpa": 1005 + 0.1 * i, "rh_pct": 60 - 0.1 * i, "timestamp": T0 + dt.timedelta(hours=i)} | {k: v[i] for k, v in changes.items() if i in v}
        rows.append((i, station, r["timestamp"], r["temp_c"], r["pressure_hpa"], r["rh_pct"]))
    return spark.createDataFrame(rows, observations.SCHEMA)


def last(df, column):
    return df.orderBy(F.desc("seq")).select(column).first()[0]


def flags(df):
    return [[f["name"] for f in r["flags"]] for r in rules.flags(df).orderBy("seq").collect()]


def test_clean_series_has_no_flags(spark):
    assert flags(rules.layer(series(spark))) == [[]] * 5


def test_hard_values(spark):
    got = flags(rules.layer(series(spark, temp_c={1: -9999.0, 2: 75.0}, rh_pct={3: 100.0, 4: 101.0})))
    assert got == [[], ["corrupt_encoding"], ["range"], [], ["range"]]


def test_missing_run_grows_and_resets(spark):
    df = rules.missing_runs(series(spark, temp_c={1: None, 2: None, 4: None}))
    assert [r[0] for r in df.orderBy("seq").select("missing_run_temp_c").collect()] == [0, 1, 2, 0, 1]
    assert last(df, "missing_score_temp_c") == pytest.approx(0.415)


def test_rate_ignores_sentinels_and_long_gaps(spark):
    df = rules.layer(series(spark, temp_c={1: -9999.0, 2: 45.0}))
    assert flags(df) == [[], ["corrupt_encoding"], ["rate_of_change"], ["rate_of_change"], []]
    far = rules.layer(series(spark, temp_c={2: 45.0}, timestamp={2: T0 + dt.timedelta(hours=9), 3: T0 + dt.timedelta(hours=14), 4: T0 + dt.timedelta(hours=18)}))
    assert flags(far) == [[]] * 5


def test_clock_never_moves_back(spark):
    df = rules.layer(series(spark, timestamp={2: T0, 3: T0 + dt.timedelta(hours=1)}))
    assert flags(df) == [[], [], ["timestamp_reversal"], ["duplicate_timestamp"], []]


def test_gap_rounds_half_even(spark):
    cfg = dataclasses.replace(DEFAULT.rules, interval_minutes=60)
    df = rules.clock(series(spark, 2, timestamp={1: T0 + dt.timedelta(minutes=150)}), cfg)
    assert last(df, "gap_score") == pytest.approx(0.37)


def test_persistence_is_anchored(spark):
    cfg = dataclasses.replace(DEFAULT.rules, tolerance={v: 0.25 for v in VARIABLES})
    creep = {i: 20 + 0.1 * i for i in range(8)}
    assert [r[0] for r in rules.persistence_runs(series(spark, 8, temp_c=creep), cfg).orderBy("seq").select("run_temp_c").collect()] == [1, 2, 3, 1, 2, 3, 1, 2]
    held = {0: 20.0, 1: 20.0, 2: -9999.0, 3: 20.0, 4: None, 5: 20.0, 6: 20.0, 7: 20.0}
    assert [r[0] for r in rules.persistence_runs(series(spark, 8, temp_c=held), cfg).orderBy("seq").select("run_temp_c").collect()] == [1, 2, 0, 3, 0, 1, 2, 3]


def test_saturated_air_may_persist_longer(spark):
    for n, want in ((39, 0.0), (40, 0.6)):
        df = rules.layer(series(spark, n, rh_pct={i: 99.0 for i in range(n)}))
        assert last(df, "persistence_score_rh_pct") == pytest.approx(want)


def test_empty_input(spark):
    assert rules.layer(spark.createDataFrame([], observations.SCHEMA)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, f"S{i % 3}", T0 + dt.timedelta(minutes=int(rng.integers(0, 5000))), *(None if rng.random() < 0.1 else float(x) for x in (rng.choice([20.0, 20.01, 50.0, -9999.0]), 1000 + rng.normal(), 60.0))) for i in range(300)]
    df = spark.createDataFrame(rows, observations.SCHEMA)
    df.write.parquet(f"{tmp_path}/in")
    stream = stateful.score_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    got = {r["seq"]: r for r in stateful.replay(stream, f"{tmp_path}/run").collect()}
    for r in rules.layer(df).collect():
        for c in ("rule_score", "persistence_score", *[f"rule_{v}" for v in VARIABLES]):
            assert got[r["seq"]][c] == pytest.approx(r[c]), (r["seq"], c)


def test_window_clears_on_incomplete_rows(spark):
    df = series(spark, 9, temp_c={4: None})
    w = temporal.windows(temporal.transform(df, temporal.fit_scaler(df)), 3).orderBy("seq").collect()
    assert [r["window"] is not None for r in w] == [False, False, True, True, False, False, False, True, True]
    assert len(w[2]["window"]) == 3 and len(w[2]["window"][0]) == 7


def test_thresholds_fall_back(spark):
    rows = [("A", float(i % 10)) for i in range(300)] + [("B", 5.0)] * 10
    t = {r["station_id"]: r for r in temporal.fit_station_thresholds(spark.createDataFrame(rows, "station_id string, error double")).collect()}
    assert t["B"]["fallback"] and not t["A"]["fallback"] and t["A"]["threshold"] == pytest.approx(max(4.5 + 4 * 1.4826 * 2.5, 9.0))


def test_gradients():
    x = np.random.default_rng(2).normal(size=(4, 5, 7))
    assert lstm.gradient_error(lstm.Autoencoder(5, 4), x) < 1e-5


def test_training_and_artifact():
    t = np.arange(400)
    x = np.stack([np.stack([np.sin(t[i : i + 6] / 4)] * 3 + [np.zeros(6)] * 4, axis=1) for i in range(300)])
    net = lstm.Autoencoder(6, 8)
    before = net.loss(x[250:])
    net.fit(x[:250], x[250:], dataclasses.replace(DEFAULT.model, epochs=8, learning_rate=0.02))
    assert net.loss(x[250:]) < 0.7 * before
    again = lstm.Autoencoder.from_bytes(net.to_bytes())
    assert np.allclose(net.forward(x[:3])[0], again.forward(x[:3])[0])


STATIONS = [("TGT", "t", 18.50, 73.90, 200.0, "inland"), ("N1", "n", 18.55, 73.95, 250.0, "inland"), ("N2", "m", 18.70, 74.10, 300.0, "inland"), ("HILL", "h", 18.52, 73.92, 1300.0, "hill"), ("FAR", "f", 22.0, 78.0, 250.0, "inland")]


def reading(station, seq, t, at=T0):
    return (seq, station, at, t, 1005.0, 60.0)


def consensus(spark, rows):
    s = spark.createDataFrame(STATIONS, observations.STATIONS)
    return {r["target_seq"]: r for r in spatial.consensus(spatial.heaviest(spark.createDataFrame(rows, observations.SCHEMA), s)).collect()}


def test_neighbours_are_near_and_alike(spark):
    got = consensus(spark, [reading("TGT", 0, 40.0), reading("N1", 1, 28.0), reading("N2", 2, 28.0), reading("HILL", 3, 5.0), reading("FAR", 4, 5.0)])
    assert got[0]["neighbour_ids"] == ["N1", "N2"] and got[0]["spatial_p"] > 0.9


def test_late_neighbours_and_single_ones_do_not_count(spark):
    got = consensus(spark, [reading("TGT", 0, 40.0), reading("N1", 1, 28.0), reading("N2", 2, 28.0, T0 + dt.timedelta(minutes=21))])
    assert got[0]["n_neighbours"] == 1 and not got[0]["spatial_available"]
    edge = consensus(spark, [reading("TGT", 0, 40.0), reading("N1", 1, 28.0), reading("N2", 2, 28.0, T0 + dt.timedelta(minutes=20))])
    assert edge[0]["spatial_available"]


def test_dense_neighbours_are_searched_not_joined(spark, monkeypatch):
    """Readings by the second and with equal times: one nearest reading of each neighbour, without a row for each pair of
    readings within the skew."""
    network = spark.createDataFrame(STATIONS, observations.STATIONS)
    rng = np.random.default_rng(3)
    ids = ["TGT", "N1", "N2", "HILL", "NONE", None]
    rows = [(i, ids[k], None if rng.random() < 0.02 else T0 + dt.timedelta(seconds=int(x)), *(None if rng.random() < 0.1 else float(v) for v in rng.normal(20, 2, 3))) for i, (k, x) in enumerate(zip(rng.integers(0, len(ids), 500), rng.integers(-3600, 9000, 500), strict=True))]
    o = spark.createDataFrame(rows, observations.SCHEMA)
    top = spatial.heaviest(o, network)
    assert "Join" not in top._jdf.queryExecution().executedPlan().toString()
    pairs = {(r["target"], r["neighbour"]): r["weight"] for r in spatial.station_pairs(network).collect()}
    expected = {}
    for seq, station, at, *_ in rows:
        best = []
        for (a, b), weight in pairs.items():
            near = sorted((abs(at - t), n) for n, s, t, *_ in rows if s == b and t is not None and abs(at - t) <= dt.timedelta(minutes=20)) if a == station and at is not None else []
            best += [(-weight, b, near[0][1])] if near else []
        if best:
            expected[seq] = [x[1:] for x in sorted(best)[:6]]
    values = {r[0]: r[3:] for r in rows}
    for pairs_at_once, lookups, stretch in ((spatial.PAIRS, spatial.LOOKUPS, spatial.STRETCH), (1, 5, 50)):
        for name, x in (("PAIRS", pairs_at_once), ("LOOKUPS", lookups), ("STRETCH", stretch)):
            monkeypatch.setattr(spatial, name, x)
        got = spatial.heaviest(o, network).collect()
        assert len(got) == len(expected) and {r["target_seq"]: [(y["neighbour"], y["x"]["n_seq"]) for y in r["top"]] for r in got} == expected
        assert all(tuple(r[f"t_{v}"] for v in VARIABLES) == values[r["target_seq"]] and all(tuple(y["x"][f"n_{v}"] for v in VARIABLES) == values[y["x"]["n_seq"]] for y in r["top"]) for r in got)


def test_readings_without_values_have_the_same_neighbours_and_shuffle_no_values(spark, small):
    o = observations.from_events(spark, small)
    bare = spatial.neighbours(o.drop(*VARIABLES), observations.stations(spark))
    plan = bare._jdf.queryExecution().executedPlan().toString()
    assert not any(v in plan for v in VARIABLES)
    keys = ["target_seq", "neighbour", "rank", "n_seq", "skew_us", "weight"]
    full = spatial.neighbours(o, observations.stations(spark)).select(*keys)
    bare = bare.select(*keys)
    assert bare.count() == full.count() > 0 and bare.exceptAll(full).count() == 0


def test_copies_of_readings_keep_their_neighbours(spark, small):
    """Copies of all readings at the same times with later seqs: each copy's neighbours are those of the first, found with
    two passes over the readings and no join."""
    o = observations.from_events(spark, small)
    n = o.count()
    copies = o.join(F.broadcast(spark.range(20).withColumnRenamed("id", "copy"))).withColumn("seq", F.col("seq") + F.col("copy") * n).drop("copy")
    copies = files.written(copies)
    got = spatial.neighbours(copies, observations.stations(spark))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    keys = ["neighbour", "rank", "n_seq", "skew_us"]
    once = spatial.neighbours(o, observations.stations(spark)).select("target_seq", *keys)
    each = got.groupBy((F.col("target_seq") % n).alias("target_seq"), *keys).count()
    assert each.where("count <> 20").count() == 0 and each.select("target_seq", *keys).exceptAll(once).count() == 0 and each.count() == once.count()


def evidence(spark, **x):
    base = {"rule_score": 0.0, "persistence_score": 0.0, "has_hard": False, "recon_available": True, "recon_p": 0.0, "multi_available": True, "multi_p": 0.0, "spatial_available": True, "spatial_p": 0.0, **{f"rule_{v}": 0.0 for v in VARIABLES}, **{f"recon_error_{v}": 0.0 for v in VARIABLES}} | x
    return fusion.fuse(spark.createDataFrame([base])).first()


def test_fusion(spark):
    assert evidence(spark, recon_p=1.0, multi_p=1.0, spatial_p=1.0)["probability"] == pytest.approx(2.2 / 4.05)
    assert evidence(spark, rule_score=0.4, recon_available=False, multi_available=False, spatial_available=False)["probability"] == pytest.approx(0.4 / 1.85)
    assert evidence(spark, has_hard=True)["probability"] == pytest.approx(0.95)
    damped = evidence(spark, recon_p=1.0)
    assert damped["damped"] and damped["probability"] == pytest.approx(0.75 / 4.05 * 0.65)
    assert evidence(spark)["dominant_variable"] is None and evidence(spark, rule_rh_pct=0.5, rule_temp_c=0.5)["dominant_variable"] == "temp_c"


def test_events_of_late_readings_and_beyond_ten_thousand(spark):
    """A time that goes back makes a negative duration, in whole seconds rounded down; every event has an id of its own."""
    points = spark.range(60_000).select(
        F.lit("A").alias("station_id"), F.col("id").alias("seq"), (F.lit(T0).cast("timestamp_ntz") - F.expr("make_dt_interval(0, 0, 0, id * 0.5)")).alias("timestamp"), (F.col("id") % 6 < 2).alias("is_anomaly"),
        F.lit("spike").alias("fault_class"), F.lit(0.5).alias("confidence"), F.lit(0.9).alias("probability"), F.array(F.lit("temp_c")).alias("variables"),
    )
    got = response.events(points).agg(F.count(F.lit(1)), F.countDistinct("event_id"), F.max("duration_minutes"), F.min("duration_minutes"), F.max(F.length("event_id"))).first()
    assert tuple(got) == (10_000, 10_000, -1 / 60, -1 / 60, len("A-E10000"))


def test_blend(spark):
    f = lambda run=1, c=0.8: spark.range(1).select(*[x.alias(n) for n, x in zip("vcm", response.blend({"temporal": F.lit(30.0), "spatial": F.lit(31.0), "reconstruction": F.lit(29.0)}, {"temporal": F.lit(c), "spatial": F.lit(0.6), "reconstruction": F.lit(0.4)}, F.lit(run)), strict=True)]).first()
    r = f()
    assert (r["v"], r["c"], r["m"]) == (pytest.approx(30.2), pytest.approx(0.64), "reconstruction+spatial+temporal")
    assert f(run=13)["v"] is None


def test_events_merge_over_short_gaps(spark):
    bad = {0, 1, 5, 10}
    rows = [("A", i, T0 + dt.timedelta(hours=i), i in bad, "spike" if i != 1 else "drop", 0.5, 0.9, ["temp_c"]) for i in range(12)]
    df = spark.createDataFrame(rows, "station_id string, seq long, timestamp timestamp_ntz, is_anomaly boolean, fault_class string, confidence double, probability double, variables array<string>")
    got = [(r["event_id"], r["n_points"], r["fault_class"]) for r in response.events(df).orderBy("event_id").collect()]
    assert got == [("A-E0001", 3, "spike"), ("A-E0002", 1, "spike")]


def test_even_width_means_one_row_more(spark):
    g = spark.createDataFrame([("A", i, float(i)) for i in range(6)], "station_id string, step long, x double")
    got = [r[0] for r in g.withColumn("m", grid.centred_mean(F.col("x"), ["station_id"], 4, full=True)).orderBy("step").select("m").collect()]
    assert got == [None, 1.5, 2.0, 3.0, 3.5, None]


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(0.1, False)] * 40 + [(0.9, True)] * 10, "score double, truth boolean")
    assert metrics.roc_auc(df).first()[0] == 1.0 and metrics.average_precision(df).first()["average_precision"] == 1.0
    flat = spark.createDataFrame([(0.5, i % 2 == 0) for i in range(20)], "score double, truth boolean")
    assert metrics.roc_auc(flat).first()[0] == 0.5
    assert metrics.roc_auc(df.where("truth")).first()[0] is None


def test_forest_and_shapley():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 14))
    y = ["none"] * 30 + ["spike"] * 30 + ["stuck"] * 30
    x[30:60, 0] += 3
    x[60:, 4] += 4
    f = diagnosis.FaultForest(dataclasses.replace(DEFAULT.forest, trees=15)).fit(x, y)
    assert np.mean([f.classes[k] == c for k, c in zip(f.probabilities(x).argmax(axis=1), y, strict=True)]) > 0.9
    g = lambda m: f.probabilities(m)[:, 1]
    phi = diagnosis.shapley_sampled(g, x[40], x[:30].mean(axis=0), 60, 5)
    assert phi.sum() == pytest.approx(g(x[40:41])[0] - g(x[:30].mean(axis=0)[None])[0]) and np.abs(phi).argmax() == 0
    lin = lambda m: m @ np.array([1.0, -2.0, 0.5])
    assert np.allclose(diagnosis.shapley_exact(lin, np.ones(3), np.zeros(3)), [1.0, -2.0, 0.5])
    with pytest.raises(ValueError):
        f.fit(np.full((2, 14), np.nan), ["none", "none"])


def test_outliers_score_high():
    x = np.random.default_rng(0).normal(size=(200, 3))
    q = np.array([[9.0, 9.0, 9.0], [0.0, 0.0, 0.0]])
    for d in (baselines.IsolationForest(), baselines.LocalOutlierFactor(), baselines.PlainAutoencoder()):
        far, near = d.fit(x).score(q)
        assert far > near


def test_injection(spark):
    g = spark.createDataFrame([("A", i, 20.0 + 0.01 * i, 1000.0, 60.0) for i in range(50)], "station_id string, step long, temp_c double, pressure_hpa double, rh_pct double")
    spans = spark.createDataFrame([(0, "A", 5, 6, "spike", "temp_c", 9.0), (1, "A", 10, 14, "stuck", "temp_c", 0.0), (2, "A", 20, 21, "missing", "rh_pct", 0.0), (3, "A", 30, 40, "drift", "temp_c", 4.0)], injection.SPANS)
    r = {x["step"]: x for x in injection.inject(g, spans).collect()}
    assert r[5]["temp_c"] == pytest.approx(29.05) and r[12]["temp_c"] == pytest.approx(20.1) and r[20]["rh_pct"] is None
    assert r[40]["temp_c"] == pytest.approx(24.4) and r[7]["fault_class"] == "none" and r[40]["is_fault"]
    plan = injection.plan(["A", "B"], 500, {})
    cells = [(s, i) for _, s, a, b, *_ in plan for i in range(a, b + 1)]
    assert len(cells) == len(set(cells)) and len(plan) >= 6 and plan == injection.plan(["A", "B"], 500, {})


def test_text_functions(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("NA",), ("-",), ("x",), ("nan",), ("-9999",), (None,)], "s string")
    assert [r[0] for r in df.select(text.parse_float(F.col("s"))).collect()] == [1.5, None, None, None, None, -9999.0, None]
    t = spark.createDataFrame([("2024/01/02 03:04",), ("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+02:00",), ("junk",)], "s string")
    assert [r[0] for r in t.select(text.parse_timestamp(F.col("s"))).collect()] == [dt.datetime(2024, 1, 2, 3, 4), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 1, 4, 5), None]
    p = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (0.8,), (0.95,)], "p double")
    assert [r[0] for r in p.select(text.band(F.col("p"))).collect()] == ["NORMAL", "WATCH", "SUSPICIOUS", "HIGH", "CRITICAL"]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.psv").write_text("Station_ID|Year|Month|Day|Hour|datetime|temperature|dew_point|sea_level_pressure\nX|2024|1|2|3|junk|50|50|1013.25\n|2024|1|2|4|junk|NA|50|\nX|2024|13|2|4|junk|1|1|1\n")
    r = files.load_csv(spark, str(tmp_path / "a.psv"), station_id="Z", elevation_m=100.0, temperature_unit="F").collect()
    assert [x["station_id"] for x in r] == ["X", "Z"]
    assert r[0]["temp_c"] == pytest.approx(10.0) and r[0]["rh_pct"] == pytest.approx(100.0)
    assert r[0]["pressure_hpa"] == pytest.approx(1013.25 * math.exp(-9.80665 * 100 / (287.058 * 283.15))) and r[1]["rh_pct"] is None
    (tmp_path / "s.csv").write_text("id,lat,lon,terrain\nA,1,2,HILL\n,1,2,x\nB,,2,x\n")
    s = files.load_stations(spark, str(tmp_path / "s.csv")).collect()
    assert [(x["station_id"], x["name"], x["elevation_m"], x["terrain"]) for x in s] == [("A", "A", 0.0, "hill")]
    (tmp_path / "n.csv").write_text("time,temp\n2024-01-01 00:00,1\n")
    with pytest.raises(ValueError):
        files.load_csv(spark, str(tmp_path / "n.csv"))


def test_messages(spark):
    raw = spark.createDataFrame([('{"station_id":"A","timestamp":"2024-01-01T00:00:00Z","temp_c":"21.5","pressure_hpa":1000,"rh_pct":null}',), ('{"station_id":"A","timestamp":"2024-01-01","temp_c":"hot"}',), ('{"station_id":"A","temp_c":1}',), ('{"station_id":"A","timestamp":"2024-01-01","temp_c":true}',), ("no",)], "value string")
    assert [r["error"] for r in files.parse_messages(raw).collect()] == [None, "values must be finite numbers", "timestamp is required", "values must be finite numbers", "station_id is required"]


def test_store_is_append_only_and_idempotent(spark, tmp_path):
    store = files.AuditStore(spark, str(tmp_path / "audit"))
    df = series(spark, 30).withColumn("is_anomaly", F.col("seq") % 4 == 1)
    store.append(df)
    store.append(df.withColumn("temp_c", F.lit(0.0)))
    assert store.count() == 30 and store.count("A") == 30 and store.count("B") == 0
    assert store.station("A", T0, T0 + dt.timedelta(hours=2)).count() == 3
    assert store.station("A", limit=1, newest=True).first()["seq"] == 29
    assert [r["seq"] for r in store.anomalies(limit=2).collect()] == [29, 25]
    assert store.station("A").first()["temp_c"] == 28.0


def test_limits():
    assert files.bounded_limit(None) == 200 and files.bounded_limit("9999") == 5000
    with pytest.raises(ValueError):
        files.bounded_limit("0")


def test_pipeline_without_models(spark, small):
    out = pipeline.process(observations.from_events(spark, small), observations.stations(spark), pipeline.Fitted(), explain=False)
    rows = {r["qc_status"]: r["n"] for r in out.groupBy("qc_status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(rows.values()) == 1000 and not out.where("has_hard and not is_anomaly").count()
    assert rows["ESTIMATED"] + rows["QUARANTINED"] == out.where("is_anomaly").count()
    assert pipeline.document(out).where("doc like '%\"fusion\"%'").count() == 1000


def test_anchored_runs_equal_the_plain_fold():
    import numpy as np

    from meteolith.operators.rules import anchored_runs

    rng = np.random.default_rng(5)
    for _ in range(300):
        x = np.round(np.cumsum(rng.normal(size=int(rng.integers(0, 40))) * rng.choice([0.01, 0.3, 3.0])), 2)
        x[rng.random(len(x)) < 0.1] = np.nan
        anchor, length, want = None, 0, []
        for v in x.tolist():
            if v != v:
                anchor, length = None, 0
            else:
                anchor, length = (anchor, length + 1) if anchor is not None and abs(v - anchor) <= 0.5 else (v, 1)
            want.append(length)
        cut = int(rng.integers(0, len(x) + 1))
        first, a, n = anchored_runs(x[:cut], 0.5, None, 0)
        second, a, n = anchored_runs(x[cut:], 0.5, a, n)
        assert [*first, *second] == want and (a, n) == (anchor, length)


def test_thinned_curve_keeps_its_ends(spark):
    from meteolith.operators import metrics

    rows = spark.createDataFrame([(i / 1000, i % 3 == 0) for i in range(1000)], "score double, truth boolean")
    got = sorted(tuple(r) for r in metrics.thinned(metrics.cuts(rows).select("score", "tp", "fp"), 20).collect())
    assert got[0] == (0.0, 334, 666) and got[-1][0] == 0.999 and 18 <= len(got) <= 22


def test_coalitions_of_a_forest_equal_its_predictions():
    """Walking x and base together gives the very numbers of the mixed rows, and each distinct coalition is asked once."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 14))
    forest = diagnosis.FaultForest().fit(x, [diagnosis.FAULT_CLASSES[int(k)] for k in (x[:, 0] > 0) + 2 * (x[:, 3] * x[:, 5] > 0)])
    masks = rng.random((500, 14)) < 0.5
    for a, b in ((x[0], x[1]), (x[2], x[2]), (x[3], x.mean(axis=0))):
        assert np.array_equal(forest.coalitions(a, b, masks), forest.probabilities(np.where(masks, a, b)))
    asked = []
    phi = diagnosis.sampled(lambda m: asked.append(m) or forest.coalitions(x[0], x[1], m)[:, 1], 14, 220, 5)
    assert len(asked[0]) == len(np.unique(asked[0], axis=0)) < 220 * 15
    ends = forest.probabilities(x[:2])[:, 1]
    assert phi.sum() == pytest.approx(ends[0] - ends[1])


def scaled(spark, n, holes=()):
    """Two stations of n readings, some incomplete, as transform() leaves them."""
    z = spark.range(2 * n).select(
        F.col("id").alias("seq"), F.concat(F.lit("S"), (F.col("id") % 2).cast("string")).alias("station_id"), F.expr("timestampadd(MINUTE, int(id), timestamp_ntz'2024-01-01 00:00:00')").alias("timestamp"),
        *[(F.sin(F.col("id") / (20.0 + i))).alias(v) for i, v in enumerate(VARIABLES)],
    )
    z = z.withColumn("temp_c", F.when(F.col("seq").isin(list(holes)), None).otherwise(F.col("temp_c")))
    return z.withColumns({f"z_{v}": F.col(v) for v in VARIABLES})


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_shards_hold_every_training_window(spark, monkeypatch, stride):
    """Every stride-th full window of each station stands in the shards exactly once, over holes and Arrow batches."""
    monkeypatch.setattr(lstm, "SHARD", 300)
    z = scaled(spark, 1500, holes=(301, 302, 340, 341, 346, 2000, 2999)).localCheckpoint()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    try:
        shards = lstm.sharded(z, z, 8, stride).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for late, step in ((False, stride), (True, 1)):
        want = np.array([r["window"] for r in temporal.training_windows(z, 8, step).select("window").collect()], np.float32)
        some = [r for r in shards if r["late"] == late]
        got = np.concatenate([lstm.unpacked(r["parts"], 8, r["stride"]) for r in some])
        assert len(some) > 1 and [len(lstm.unpacked(r["parts"], 8, r["stride"])) for r in some] == [r["n"] for r in some]
        assert sorted(w.tobytes() for w in want) == sorted(w.tobytes() for w in got)


def test_training_goes_over_more_windows_than_one_shard_holds(spark, monkeypatch):
    """More than 20,000 windows of a table are all trained on; one shard alone is fit() itself, several learn as well."""
    seen = []
    monkeypatch.setattr(lstm, "fit_shards", lambda model, shards, cfg: seen.append({r[0]: r[1] for r in shards.groupBy("late").agg(F.sum("n")).collect()}))
    pipeline.train(scaled(spark, 22_000), scaled(spark, 11_000), stride=1)
    assert seen == [{False: 2 * (22_000 - 23), True: 2 * (11_000 - 23)}]
    monkeypatch.undo()
    cfg = dataclasses.replace(DEFAULT.model, epochs=4, patience=4, learning_rate=0.02)
    z = scaled(spark, 600).localCheckpoint()
    one = lstm.sharded(z, z, 6, 2).localCheckpoint()
    x, y = (lstm.unpacked(r["parts"], 6, r["stride"]) for r in one.orderBy("late").collect())
    alone, dealt, several = (lstm.Autoencoder(6, 8) for _ in range(3))
    before = dealt.loss(y.astype(float))
    assert lstm.fit_shards(dealt, one, cfg) == pytest.approx(alone.fit(x, y, cfg), rel=1e-4)
    assert all(np.allclose(alone.p[k], dealt.p[k], atol=1e-4) for k in alone.p)
    monkeypatch.setattr(lstm, "SHARD", 200)
    history = lstm.fit_shards(several, lstm.sharded(z, z, 6, 2).localCheckpoint(), cfg)
    assert len(history) == 4 and several.loss(y.astype(float)) == pytest.approx(min(history), rel=1e-4) and min(history) < 0.7 * before


def test_contributions_of_many_rows_equal_sampled_values_one_by_one():
    """One walk for all rows gives the Shapley values of the same permutations, far faster than coalition by coalition."""
    import time

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 14)).round(1)
    forest = diagnosis.FaultForest().fit(x, [diagnosis.FAULT_CLASSES[int(k)] for k in (x[:, 0] > 0) + 2 * (x[:, 3] * x[:, 5] > 0)])
    x, base = x[:200], np.vstack([x[200:390], x[190:200]])  # the last ten are their own background
    k = forest.probabilities(x).argmax(axis=1)
    t = time.perf_counter()
    got = diagnosis.contributions(forest, x, base, k, 220, 5)
    t, at = time.perf_counter() - t, time.perf_counter()
    want = np.array([diagnosis.sampled(lambda m, i=i: forest.coalitions(x[i], base[i], m)[:, k[i]], 14, 220, 5) for i in range(0, 200, 5)])
    assert np.allclose(got[::5], want, atol=1e-12) and not got[190:].any()
    assert t / 200 < 0.5 * (time.perf_counter() - at) / 40
    assert np.allclose(got[:20], diagnosis.contributions(forest, x[:20], base[:20], k[:20], 220, 5), rtol=0, atol=0)
