"""Every query against its SQL twin; those without one by their properties."""

import pytest
from conftest import comparable

from meteolith.plans import exchange, oracles, queries  # noqa: F401 (registers its queries)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_matches_sql(spark, duck, small, name):
    assert comparable(queries.QUERIES[name](spark, small).toPandas()) == duck(oracles.SQL[name])


def test_joint_state_equals_numpy(spark, small):
    """Moments, inverse and distances of the registered query against plain numpy, station by station."""
    import numpy as np

    from meteolith.config import DEFAULT, VARIABLES
    from meteolith.operators import rules
    from meteolith.sources import observations as source

    o = source.trusted(rules.layer(queries.obs(spark, small))).toPandas()
    got = queries.multivariate_evaluate(spark, small).toPandas().set_index("seq")
    cfg = DEFAULT.multivariate
    compared = 0
    for _, g in o.groupby("station_id"):
        clean = g[g["keep"]].sort_values(["timestamp", "seq"])
        x = clean[list(VARIABLES)].to_numpy(float)
        f = np.concatenate([x[1:], np.diff(x, axis=0)], axis=1)
        med = np.median(f, axis=0)
        scale = np.maximum(1.4826 * np.median(np.abs(f - med), axis=0), 1e-9)
        z = (f - med) / scale
        inverse = np.linalg.inv((1 - cfg.shrinkage) * (z.T @ z / len(z)) + cfg.shrinkage * np.eye(6))
        last = x[-1]
        for r in g.sort_values("seq").itertuples():
            v = np.array([getattr(r, name) for name in VARIABLES], float)
            if np.isnan(v).any() or r.has_hard or len(z) < cfg.min_samples:
                assert not got.loc[r.seq, "multi_available"]
                continue
            q = (np.concatenate([v, v - last]) - med) / scale
            assert got.loc[r.seq, "mahalanobis"] == pytest.approx(np.sqrt(q @ inverse @ q), rel=1e-6)
            last, compared = v, compared + 1
    assert compared > 500


def test_detectors_score_every_row_alike(spark, small):
    """A row's score is finite, equal readings of a station have equal scores, and far values score higher."""
    o = queries.obs(spark, small).toPandas()
    for name in ("isolation_forest", "lof"):
        got = queries.QUERIES[name](spark, small).toPandas()
        assert sorted(got["seq"]) == sorted(o["seq"]) and got["score"].dropna().between(-1e9, 1e9).all(), name
        x = o.merge(got, on=["seq", "station_id"])
        far = x[x["temp_c"] == -9999.0]["score"].dropna()
        assert far.empty or far.median() > x[x["temp_c"] > -100]["score"].median(), name


def test_injected_network_follows_its_plan(spark, small):
    """Cells outside the spans are untouched; inside, each class changes its variable as defined."""
    from meteolith.config import VARIABLES

    g = queries.gridded(spark, small).toPandas().set_index(["station_id", "step"])
    got = queries.injected_network(spark, small).toPandas().set_index(["station_id", "step"])
    assert len(got) == len(g) and got["is_fault"].sum() > 0.03 * len(g)
    clean = got[~got["is_fault"]]
    for v in VARIABLES:
        a, b = clean[v], g.loc[clean.index, v]
        same = (a.isna() & b.isna()) | ((a - (b.clip(0, 100) if v == "rh_pct" else b)).abs() < 1e-9)
        assert same.all(), v
    assert (got[got["fault_class"] == "corrupt"][list(VARIABLES)] == -9999.0).any(axis=1).all()
    assert got[got["fault_class"] == "missing"][list(VARIABLES)].isna().any(axis=1).all()


def test_training_set_and_narrative(spark, small):
    """The forest learns from injected faults; its verdicts on them come with evidence in words."""
    import numpy as np
    from pyspark.sql import functions as F

    from meteolith.operators import diagnosis, grid
    from meteolith.plans import pipeline
    from meteolith.sources import observations as source

    rng = np.random.default_rng(0)
    rows = [(s, t, 20 + 5 * np.sin(t / 4) + rng.normal() * 0.2, 1000 + rng.normal() * 0.3, 60 + rng.normal()) for s in ("S00", "S03", "S07") for t in range(500)]
    g = spark.createDataFrame([(s, int(t), float(a), float(b), float(c)) for s, t, a, b, c in rows], "station_id string, step bigint, temp_c double, pressure_hpa double, rh_pct double")
    g = g.withColumn("timestamp", F.expr("timestampadd(HOUR, int(step), timestamp_ntz'2024-01-01 00:00:00')"))
    clean = grid.observations(g).drop("step")
    fitted = pipeline.Fitted(multivariate=pipeline.multivariate.fit(clean))
    learned = pipeline.training_set(g, source.stations(spark), fitted).toPandas()
    assert len(learned) > 5 and {"drift", "spatial"} <= set(learned["fault_class"]) and set(map(len, learned["fingerprint"])) == {len(diagnosis.FEATURES)}
    one = spark.createDataFrame([("drift", "HIGH", 0.8, [("temperature", 0.3), ("rate", -0.1)], "inspect")], "fault_class string, severity string, confidence double, evidence array<struct<label:string,contribution:double>>, recommended_action string")
    assert one.select(diagnosis.narrative().alias("x")).first()[0] == ["drift, severity HIGH, confidence 0.80", "temperature speaks for it (75 %)", "rate speaks against it (25 %)", "inspect"]


def test_stream_keeps_arrival_order_over_many_frames(spark, small, tmp_path):
    """Eight files and Arrow frames of a hundred rows give the scores of the batch rules."""
    import uuid

    from meteolith.config import VARIABLES
    from meteolith.operators import rules
    from meteolith.sources import observations as source
    from meteolith.streaming import stateful

    o = source.from_events(spark, "/root/testdata/sf0.01").drop("event_type")
    folder = str(tmp_path / uuid.uuid4().hex)
    o.repartition(8).write.parquet(folder)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        stream = stateful.score_stream(spark.readStream.schema(o.schema).parquet(folder))
        got = stateful.replay(stream, str(tmp_path / "run")).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    columns = ["seq", "rule_score", *[f"rule_{v}" for v in VARIABLES]]
    want = rules.layer(o).select(*columns).toPandas()
    assert comparable(got[columns]) == comparable(want)


def test_fitted_on_whole_data_with_the_defaults(spark, small):
    from meteolith.config import DEFAULT
    from meteolith.operators import temporal
    from meteolith.sources import observations as source

    f = queries.fitted(spark, small)
    clean = source.trusted(queries.obs(spark, small)).where("keep")
    scaler = lambda df: comparable(df.toPandas())
    assert scaler(f.scaler) == scaler(temporal.fit_scaler(clean)) and (f.model.window, f.model.hidden) == (DEFAULT.model.window, DEFAULT.model.hidden)
    early, late = queries.chronological(clean)
    assert early.count() + late.count() == clean.count() and early.agg({"timestamp": "max"}).first()[0] < late.agg({"timestamp": "min"}).first()[0]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(oracles.SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_two_writers_of_a_key_leave_one_record(spark, small, tmp_path):
    """A key stored twice, as by two writers at once, reads as the record of the file written first."""
    import time

    from pyspark.sql import functions as F

    from meteolith.sources import files

    r = queries.obs(spark, small).where("station_id = 'S03'").select("seq", "station_id", "timestamp", F.lit(False).alias("is_anomaly"))
    store = files.AuditStore(spark, str(tmp_path / "audit"))
    store.append(r)
    time.sleep(1.1)
    late = r.withColumn("is_anomaly", F.lit(True)).withColumn("day", F.to_date("timestamp"))
    late.write.mode("append").partitionBy("day").parquet(store.path)
    assert store.count() == r.count() and store.anomalies().count() == 0 and store.station("S03").count() == r.count()


def test_absent_humidity_stays_absent(spark):
    from pyspark.sql import functions as F

    from meteolith.functions import physics

    x = spark.sql("select 10.0D as t, cast(null as double) as n")
    assert x.select(physics.rh_from_dewpoint(F.col("t"), F.col("n")), physics.dewpoint(F.col("t"), F.col("n")), physics.clamp(F.col("n"))).first() == (None, None, None)


def test_series_cut_into_blocks_give_the_whole_series(spark, small):
    """Blocks of eight arrival numbers, and of one, equal one block for all: scores, runs and what rows hand on."""
    import dataclasses

    from pyspark.sql import functions as F

    from meteolith.config import VARIABLES
    from meteolith.operators import rules

    o = queries.obs(spark, small)
    # Long runs of nulls and of equal values, over many blocks, in one busy station.
    stuck = F.expr("seq % 400 between 100 and 260")
    o = o.withColumn("station_id", F.when(F.col("seq") % 3 == 0, F.lit("S00")).otherwise(F.col("station_id")))
    o = o.withColumns({"temp_c": F.when(stuck, 20.0).otherwise(F.col("temp_c")), "pressure_hpa": F.when(F.expr("seq % 500 > 350"), None).otherwise(F.round(F.col("pressure_hpa"))), "rh_pct": F.when(stuck, F.lit(50.0) + F.expr("seq % 3")).otherwise(F.col("rh_pct"))})
    cfg = dataclasses.replace(queries.LOOSE, interval_minutes=30)
    names = ["seq", "gap_us", "has_hard", "rule_score", *[f"{p}_{v}" for p in ("missing_run", "delta", "run", "rule") for v in VARIABLES]]
    whole, *cut = [comparable(rules.layer(o, cfg, bits).select(*names).toPandas()) for bits in (40, 3, 0)]
    assert whole == cut[0] == cut[1]
    longest = rules.layer(o, cfg, 3).agg(*[F.max(c) for c in ("run_temp_c", "missing_run_pressure_hpa", "run_rh_pct")]).first()
    assert min(longest) >= 10, longest
    homes = rules.arrival(o, cfg, 3).groupBy("station_id", "__home").count().agg(F.max("count")).first()[0]
    assert homes < o.count() / 8, homes


def test_cut_series_equal_the_stream(spark, small):
    """The state machine of the stream, reading by reading, against blocks of four arrival numbers."""
    import math

    from meteolith.config import VARIABLES
    from meteolith.functions.physics import micros
    from meteolith.operators import rules
    from meteolith.streaming import stateful

    o = queries.obs(spark, small)
    got = rules.layer(o, queries.LOOSE, 2).select("seq", "rule_score", "persistence_score").toPandas().set_index("seq")
    states, n = {}, 0
    for r in o.withColumn("us", micros(o["timestamp"])).orderBy("seq").toPandas().itertuples():
        station = states.setdefault(r.station_id, stateful.Station(None, queries.LOOSE))
        want = station.step(int(r.us), {v: None if math.isnan(getattr(r, v)) else getattr(r, v) for v in VARIABLES})
        assert got.loc[r.seq, "rule_score"] == pytest.approx(want["rule_score"]), r
        assert got.loc[r.seq, "persistence_score"] == pytest.approx(want["persistence_score"]), r
        n += want["persistence_score"] > 0
    assert n > 0


def test_reset_row_clears_its_station_alone(spark, small, tmp_path):
    """After a row without time and values, its station starts anew; other stations go on."""
    from pyspark.sql import functions as F

    from meteolith.operators import rules
    from meteolith.streaming import stateful

    o = queries.obs(spark, small).drop("event_type").where("station_id in ('S01', 'S02')")
    o = o.withColumn("temp_c", F.when(F.col("station_id") != "S01", F.col("temp_c")))  # a run of nulls that the reset ends
    half = o.agg(F.percentile("seq", 0.5).cast("long")).first()[0]
    reset = spark.createDataFrame([(half, "S01", None, None, None, None)], o.schema)
    folder = str(tmp_path / "in")
    o.where(F.col("seq") != half).unionByName(reset).coalesce(1).write.parquet(folder)
    got = stateful.replay(stateful.score_stream(spark.readStream.schema(o.schema).parquet(folder)), str(tmp_path / "run"))
    parts = o.where(F.col("seq") != half).withColumn("station_id", F.when((F.col("station_id") == "S01") & (F.col("seq") > half), "S01 anew").otherwise(F.col("station_id")))
    want = rules.layer(parts)
    columns = ["seq", "rule_score", "has_hard"]
    assert comparable(got.select(columns).toPandas()) == comparable(want.select(columns).toPandas())
    whole = rules.layer(o.where(F.col("seq") != half)).select(columns)
    assert comparable(whole.toPandas()) != comparable(want.select(columns).toPandas())  # the reset shows


def test_anomalies_alone_are_explained_as_within_all_readings(spark, small):
    import numpy as np

    from meteolith.operators import diagnosis
    from meteolith.plans import pipeline
    from meteolith.sources import observations as source

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, len(diagnosis.FEATURES)))
    fitted = pipeline.Fitted(forest=diagnosis.FaultForest().fit(x, [("spike", "noise")[int(v > 0)] for v in x[:, 3]]))
    names = ["seq", "station_id", "fault_class", "confidence", "severity", "evidence", "explanation"]
    run = lambda flagged: pipeline.process(queries.obs(spark, small), source.stations(spark), fitted, flagged=flagged)
    alone = run(True)
    alone, within = ([r for r in df.select(*names).orderBy("seq").collect()] for df in (alone, run(False).where("is_anomaly")))
    assert alone == within and any(r["evidence"] for r in alone)
    # The wide chain stands in no branch of the plan that explains: anomalies were written once.
    assert "Window" not in run(True)._jdf.queryExecution().executedPlan().toString()


def test_the_chain_carries_no_column_that_nothing_reads(spark, small):
    assert "event_type" not in queries.QUERIES["engine_without_models"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_forest_learns_from_every_fingerprint(spark, small, monkeypatch):
    """More than 2,000 fingerprints are not cut."""
    import numpy as np

    from meteolith.operators import diagnosis
    from meteolith.plans import pipeline

    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=len(diagnosis.FEATURES)).tolist(), ("spike", "drift")[i % 2]) for i in range(2500)]
    monkeypatch.setattr(pipeline, "training_set", lambda *_: spark.createDataFrame(rows, "fingerprint array<double>, fault_class string"))
    seen = []
    monkeypatch.setattr(diagnosis.FaultForest, "fit", lambda self, x, y: seen.append(sorted(zip(map(tuple, x.tolist()), y, strict=True))) or self)
    queries.trained_forest(spark, small, pipeline.Fitted())
    assert seen == [sorted((tuple(x), y) for x, y in rows)]


def test_what_is_fitted_is_computed_once(spark, small):
    """Scaler, joint state and thresholds are tables: no later plan runs the model over all readings again for them."""
    import dataclasses

    from meteolith.config import DEFAULT
    from meteolith.plans import pipeline
    from meteolith.sources import observations as source

    clean = source.trusted(queries.obs(spark, small)).where("keep").drop("keep")
    cfg = dataclasses.replace(DEFAULT, model=dataclasses.replace(DEFAULT.model, window=6, hidden=4, epochs=1))
    f = pipeline.fit(*queries.chronological(clean), cfg, whole=clean)
    for table in (f.scaler, f.multivariate, f.thresholds):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and not any(x in plan for x in ("Exchange", "MapInArrow", "Aggregate"))
    assert f.thresholds.count() == f.scaler.count() == 8
