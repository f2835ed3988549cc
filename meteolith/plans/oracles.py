"""SQL twins of the queries, for DuckDB over the same tables. They are written from the definitions, not generated."""

from __future__ import annotations

from meteolith.config import VARIABLES
from meteolith.functions.text import ACTIONS
from meteolith.sources.observations import REGISTRY

T, P, H = VARIABLES
_SENTINELS = (999, -999, 9999, -9999, 99.9, -99.9, 32767)
_RANGES = {T: (-90, 60), P: (500, 1085), H: (0, 100)}

OBS = """obs AS (
 SELECT event_id AS seq, 'S0' || (user_id % 8)::VARCHAR AS station_id, ts AS timestamp, event_type,
  CASE WHEN k = 13 THEN -9999.0::DOUBLE WHEN event_type = 'error' AND k < 20 THEN NULL ELSE (1500 + floor(v100 * 12 / 100.0::DOUBLE)) / 100.0::DOUBLE END AS temp_c,
  CASE WHEN event_type = 'signup' AND k < 10 THEN NULL ELSE (9800 + 4 * k) / 10.0::DOUBLE END AS pressure_hpa,
  CASE WHEN event_type = 'view' AND k < 10 THEN NULL ELSE (300 + 7 * k + floor(v100 / 500.0::DOUBLE)) / 10.0::DOUBLE END AS rh_pct
 FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k, round(value * 100)::BIGINT AS v100 FROM events))"""


def each(template: str, sep: str = ", ") -> str:
    """The template for each variable ({v}, {lo}, {hi})."""
    return sep.join(template.format(v=v, lo=_RANGES[v][0], hi=_RANGES[v][1]) for v in VARIABLES)


def sentinel(v: str) -> str:
    return "coalesce(" + " OR ".join(f"abs({v} - ({s})) < 1e-6" for s in _SENTINELS) + ", false)"


HARD = (
    "hard AS (SELECT *, "
    + ", ".join(f"corrupt_{v} OR range_{v} AS hard_{v}" for v in VARIABLES)
    + " FROM (SELECT *, "
    + ", ".join(f"{sentinel(v)} AS corrupt_{v}, NOT {sentinel(v)} AND coalesce({v} < {_RANGES[v][0]} OR {v} > {_RANGES[v][1]}, false) AS range_{v}" for v in VARIABLES)
    + " FROM obs))"
)
KEEP = f"keep AS (SELECT *, {each('{v} IS NOT NULL AND NOT hard_{v}', ' AND ')} AS keep FROM hard)"
STATIONS = "stations AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{n}', {a}::DOUBLE, {o}::DOUBLE, {z}::DOUBLE, '{t}')" for i, n, a, o, z, t in REGISTRY) + ") AS s(station_id, name, lat, lon, elevation_m, terrain))"
W = "(PARTITION BY station_id ORDER BY seq)"
WP = "(PARTITION BY station_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
RUNS = "runs AS (SELECT *, " + ", ".join(f"CASE WHEN {v} IS NULL THEN count(*) FILTER ({v} IS NULL) OVER (PARTITION BY station_id, i_{v} ORDER BY seq) ELSE 0 END AS missing_run_{v}" for v in VARIABLES) + " FROM (SELECT *, " + ", ".join(f"count({v}) OVER {W} AS i_{v}" for v in VARIABLES) + " FROM hard))"
MISSING = "missing AS (SELECT *, " + each("CASE WHEN {v} IS NULL THEN least(1.0, 0.35 + 0.065 * missing_run_{v})::DOUBLE ELSE 0.0::DOUBLE END AS missing_score_{v}") + " FROM runs)"
CLOCK = f"clock AS (SELECT *, epoch_us(timestamp) - max(epoch_us(timestamp)) OVER {WP} AS gap_us FROM missing)"
_RATE = {T: 12.0, P: 12.0, H: 60.0}
RATES = (
    "deltas AS (SELECT *, "
    + ", ".join(f"CASE WHEN gap_us > 0 AND gap_us <= 3 * 3.6e9 AND NOT hard_{v} THEN abs({v} - last_value(CASE WHEN NOT hard_{v} THEN {v} END IGNORE NULLS) OVER {WP}) END AS delta_{v}" for v in VARIABLES)
    + " FROM clock), rates AS (SELECT *, "
    + ", ".join(f"coalesce(CASE WHEN delta_{v} > {_RATE[v]}::DOUBLE * greatest(gap_us / 3.6e9::DOUBLE, 0.25) THEN least(1.0::DOUBLE, 0.55 + 0.15 * (delta_{v} / ({_RATE[v]}::DOUBLE * greatest(gap_us / 3.6e9::DOUBLE, 0.25)) - 1)) END, 0.0::DOUBLE) AS rate_score_{v}" for v in VARIABLES)
    + " FROM deltas)"
)
L1 = ", ".join([OBS, HARD, RUNS, MISSING, CLOCK, RATES])


def r6(names: str) -> str:
    return ", ".join(f"round({n.strip()}, 6) AS {n.strip()}" for n in names.split(","))


EVIDENCE = OBS + """, ev AS (SELECT *,
  (seq * 7919 % 1000) / 1000.0::DOUBLE AS rule_score, CASE WHEN seq * 31 % 7 = 0 THEN (seq * 17 % 1000) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS persistence_score, seq * 13 % 97 = 0 AS has_hard,
  seq * 3 % 5 <> 0 AS recon_available, (seq * 37 % 1000) / 1000.0::DOUBLE AS recon_p, seq * 5 % 7 <> 0 AS multi_available, (seq * 53 % 1000) / 1000.0::DOUBLE AS multi_p,
  seq * 7 % 4 <> 0 AS spatial_available, (seq * 71 % 1000) / 1000.0::DOUBLE AS spatial_p,
  (seq * 3 % 10) / 10.0::DOUBLE AS rule_temp_c, (seq * 7 % 10) / 10.0::DOUBLE AS rule_pressure_hpa, (seq * 9 % 10) / 10.0::DOUBLE AS rule_rh_pct,
  (seq * 3 % 8) / 4.0::DOUBLE AS recon_error_temp_c, (seq * 5 % 8) / 4.0::DOUBLE AS recon_error_pressure_hpa, (seq * 7 % 8) / 4.0::DOUBLE AS recon_error_rh_pct,
  temp_c IS NOT NULL AND pressure_hpa IS NOT NULL AND rh_pct IS NOT NULL AS complete FROM obs)"""


def fused(layers: tuple) -> str:
    w = {"recon": 0.75, "multi": 0.65, "spatial": 0.80}
    num = "1.0 * rule_score + 0.85 * persistence_score" + "".join(f" + CASE WHEN {n}_available THEN {w[n]}::DOUBLE * {n}_p ELSE 0 END" for n in layers)
    den = "1.85::DOUBLE" + "".join(f" + CASE WHEN {n}_available THEN {w[n]}::DOUBLE ELSE 0 END" for n in layers)
    p = f"(({num}) / ({den}))"
    p = f"(CASE WHEN has_hard THEN greatest({p}, 0.95) ELSE {p} END)"
    if len(layers) == 3:
        p = f"(CASE WHEN {DAMPED} THEN {p} * 0.65::DOUBLE ELSE {p} END)"
    return f"least(greatest({p}, 0), 1)"


DAMPED = "(recon_available AND recon_p >= 0.5 AND spatial_available AND multi_available AND spatial_p < 0.35 AND multi_p < 0.40)"
ALL = ("recon", "multi", "spatial")
FUSED = (
    EVIDENCE
    + f", f0 AS (SELECT *, {DAMPED} AS damped, {fused(ALL)} AS probability, recon_error_temp_c + recon_error_pressure_hpa + recon_error_rh_pct AS te FROM ev), f1 AS (SELECT *, "
    + each("rule_{v} + CASE WHEN te > 0 THEN recon_error_{v} / te ELSE 0 END AS s_{v}")
    + """ FROM f0), fused AS (SELECT *, probability >= 0.5 AS is_anomaly,
  CASE WHEN probability < 0.3 THEN 'NORMAL' WHEN probability < 0.6 THEN 'WATCH' WHEN probability < 0.8 THEN 'SUSPICIOUS' WHEN probability < 0.95 THEN 'HIGH' ELSE 'CRITICAL' END AS band,
  CASE WHEN greatest(s_temp_c, s_pressure_hpa, s_rh_pct) <= 0 THEN NULL WHEN s_temp_c >= s_pressure_hpa AND s_temp_c >= s_rh_pct THEN 'temp_c' WHEN s_pressure_hpa >= s_rh_pct THEN 'pressure_hpa' ELSE 'rh_pct' END AS dominant_variable
  FROM f1)"""
)
LABELLED = f"""{OBS}, {HARD}, l0 AS (SELECT *, {each('hard_{v}', ' OR ')} OR event_type = 'error' AS truth FROM hard),
 l1 AS (SELECT *, CASE WHEN truth THEN (300 + (seq * 7919 % 1000) * 7 // 10) / 1000.0::DOUBLE ELSE (seq * 7919 % 1000) / 1000.0::DOUBLE END AS score FROM l0),
 l2 AS (SELECT *, score >= 0.5 AS pred, CASE WHEN corrupt_temp_c THEN 'corrupt' WHEN truth AND seq % 3 = 0 THEN 'spike' WHEN truth THEN 'noise' WHEN seq % 11 = 0 THEN 'genuine_extreme' ELSE 'none' END AS fault_class FROM l1),
 lab AS (SELECT *, fault_class AS true_class, CASE WHEN NOT pred THEN 'none' WHEN seq % 5 = 0 THEN 'spike' ELSE fault_class END AS pred_class FROM l2)"""
ERRORS = f"{OBS}, err AS (SELECT seq, station_id, abs(rh_pct - 65.0) / 10.0::DOUBLE AS error, (extract(hour FROM timestamp) // 6)::INT AS bucket FROM obs WHERE rh_pct IS NOT NULL)"


def levels(name: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    join = f"JOIN {name}_a USING ({by})" if by else f", {name}_a"
    return f"""{name}_a AS (SELECT {keys}quantile_cont(error, 0.5) AS med, quantile_cont(error, 0.995) AS q, count(*) AS n FROM err {'GROUP BY ' + by if by else ''}),
 {name} AS (SELECT {keys}med, n, 1.4826 * quantile_cont(abs(error - med), 0.5) AS sigma, greatest(med + 4.0 * 1.4826 * quantile_cont(abs(error - med), 0.5), q) AS threshold FROM err {join} GROUP BY {keys}med, q, n)"""


THRESHOLDS = f"""{ERRORS}, {levels('own', 'station_id')}, {levels('net', '')}, {levels('buck', 'station_id, bucket')},
 thr AS (SELECT station_id, own.n, own.n < 200 AS fallback, CASE WHEN own.n < 200 THEN net.threshold ELSE own.threshold END AS threshold, CASE WHEN own.n < 200 THEN net.med ELSE own.med END AS med, CASE WHEN own.n < 200 THEN net.sigma ELSE own.sigma END AS sigma FROM own, net)"""
PAIRS = f"""{STATIONS}, pr AS (SELECT a.station_id AS target, b.station_id AS neighbour, a.elevation_m AS zt, b.elevation_m AS zn, abs(a.elevation_m - b.elevation_m) AS dz,
  2 * 6371.0 * asin(sqrt(least(greatest(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 0), 1))) AS distance_km
  FROM stations a JOIN stations b ON a.station_id <> b.station_id),
 pairs AS (SELECT *, exp(-distance_km / 80.0) * exp(-dz / 300.0) AS weight FROM pr WHERE distance_km <= 250 AND dz <= 900)"""
NEAR = f"""{OBS}, {PAIRS}, j AS (SELECT t.seq AS target_seq, t.station_id AS target, n.station_id AS neighbour, n.seq AS n_seq, weight, zt, zn, {each('t.{v} AS t_{v}, n.{v} AS n_{v}')}, abs(epoch_us(t.timestamp) - epoch_us(n.timestamp)) AS skew
  FROM obs t JOIN pairs p ON p.target = t.station_id JOIN obs n ON n.station_id = p.neighbour AND n.timestamp BETWEEN t.timestamp - INTERVAL 20 MINUTE AND t.timestamp + INTERVAL 20 MINUTE),
 j1 AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY target_seq, neighbour ORDER BY skew, n_seq) = 1),
 near AS (SELECT *, row_number() OVER (PARTITION BY target_seq ORDER BY weight DESC, neighbour) AS rank FROM j1 QUALIFY rank <= 6)"""
HOURLY = f"{OBS}, hourly AS (SELECT station_id, date_trunc('hour', timestamp)::TIMESTAMP AS timestamp, seq, temp_c, pressure_hpa, rh_pct FROM obs QUALIFY row_number() OVER (PARTITION BY station_id, date_trunc('hour', timestamp) ORDER BY seq DESC) = 1)"
GRID = f"""{HOURLY}, {STATIONS}, b AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM hourly), axis AS (SELECT unnest(range(0, date_diff('hour', lo, hi) + 1)) AS step, lo FROM b),
 grid AS (SELECT s.station_id, step, lo + to_hours(step) AS timestamp, temp_c, pressure_hpa, rh_pct FROM axis CROSS JOIN stations s LEFT JOIN hourly h ON h.station_id = s.station_id AND h.timestamp = lo + to_hours(step))"""


def centred(expr: str, by: str, half: int, width: int, full: bool) -> str:
    frame = f"({by} ORDER BY step ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    mean = f"avg({expr}) OVER {frame}"
    return f"CASE WHEN count(*) OVER {frame} >= least({width}, count(*) OVER ({by})) THEN {mean} END" if full else mean


ST = "PARTITION BY station_id"
CLEAN_GRID = f"{GRID}, g AS (SELECT * FROM grid WHERE temp_c > -100 OR temp_c IS NULL)"


def anomaly(season: int) -> str:
    return f"""d AS (SELECT *, {centred('temp_c', ST, 12, 24, True)} AS daily FROM g), s AS (SELECT *, {centred('daily', ST, 12 * season, 24 * season, False)} AS seasonal FROM d),
 anomaly AS (SELECT step, avg(daily - seasonal) AS anomaly FROM s GROUP BY step)"""


def island(name: str, source: str, cond: str, peak: str, kind: str) -> str:
    return f"""{name} AS (SELECT '{kind}' AS kind, min(step) AS start, max(step) + 1 AS "end", {peak} AS peak FROM (SELECT *, step - row_number() OVER (ORDER BY step) AS isle FROM {source} WHERE {cond}) GROUP BY isle HAVING max(step) + 1 - min(step) >= 3)"""


LEDGER = FUSED + ", ledger AS (" + " UNION ALL ".join(
    f"SELECT station_id, seq, recon_available AND NOT is_anomaly AS usable, '{v}' AS variable, is_anomaly AND coalesce(dominant_variable = '{v}', false) AS blamed, recon_error_{v} AS error, {v} - {m} AS residual FROM fused" for v, m in ((T, 20.0), (P, 1000.0), (H, 65.0))
) + """), l2 AS (SELECT *, row_number() OVER (PARTITION BY station_id, variable ORDER BY seq DESC) AS r, row_number() OVER (PARTITION BY station_id, variable, usable ORDER BY seq DESC) AS u FROM ledger),
 agg AS (SELECT station_id, variable, count(*) AS n_points, avg(blamed::INT) FILTER (r <= 168) AS anomaly_rate, count(error) FILTER (usable AND u <= 168) AS en, avg(error) FILTER (usable AND u <= 168) AS em,
  regr_slope(error, -u::DOUBLE) FILTER (usable AND u <= 168) AS es, count(residual) FILTER (usable AND u <= 168) AS rn, avg(residual) FILTER (usable AND u <= 168) AS rm, stddev_pop(residual) FILTER (usable AND u <= 168) AS rs,
  regr_slope(residual, -u::DOUBLE) FILTER (usable AND u <= 168) AS rl FROM l2 GROUP BY 1, 2),
 ind AS (SELECT station_id, variable, n_points, anomaly_rate, CASE WHEN en < 2 OR em <= 0 THEN 0 ELSE coalesce(least(greatest(es * en / em, 0), 1), 0) END AS error_trend,
  CASE WHEN rn = 0 THEN 0 WHEN rs <= 0 THEN (rm <> 0)::INT ELSE least(abs(rm) / rs, 1) END AS bias, CASE WHEN rn < 2 THEN 0 ELSE least(abs(rl) * rn / CASE WHEN rs > 0 THEN rs ELSE 1 END, 1) END AS drift FROM agg),
 health AS (SELECT *, CASE WHEN n_points >= 48 THEN greatest(100 - 40 * least(greatest(anomaly_rate, 0), 1) - 25 * error_trend - 20 * bias - 15 * drift, 0) ELSE 100 END AS score FROM ind)"""
STATUS = "CASE WHEN {n} < 48 THEN 'UNKNOWN' WHEN {s} < 40 THEN 'CRITICAL' WHEN {s} < 60 THEN 'DEGRADING' WHEN {s} < 80 THEN 'WARNING' ELSE 'HEALTHY' END"
QC = "CASE WHEN temp_c IS NULL AND pressure_hpa IS NULL AND rh_pct IS NULL THEN 'MISSING' WHEN is_anomaly THEN CASE WHEN {c} THEN 'ESTIMATED' ELSE 'QUARANTINED' END WHEN NOT complete THEN 'MISSING' WHEN band = 'WATCH' THEN 'SUSPECT' ELSE 'PASS' END"
POINT = """sum((truth AND pred)::INT)::BIGINT AS tp, sum((NOT truth AND pred)::INT)::BIGINT AS fp, sum((truth AND NOT pred)::INT)::BIGINT AS fn, sum((NOT truth AND NOT pred)::INT)::BIGINT AS tn"""
SCORES = "round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(fp / greatest(fp + tn, 1), 6) AS false_alarm_rate"
CONSENSUS = f"""{NEAR}, x AS (SELECT *, CASE WHEN t_temp_c IS NOT NULL THEN n_temp_c + 0.0065 * (zn - zt) END AS x_temp_c,
      CASE WHEN t_pressure_hpa IS NOT NULL THEN n_pressure_hpa * exp(-9.80665 * (zt - zn) / (287.058 * CASE WHEN n_temp_c IS NULL OR n_temp_c + 273.15 < 200 THEN 288.15 ELSE n_temp_c + 273.15 END)) END AS x_pressure_hpa, CASE WHEN t_rh_pct IS NOT NULL THEN n_rh_pct END AS x_rh_pct FROM near),
     m AS (SELECT *, {each('sum(weight * x_{v}) OVER (PARTITION BY target_seq) / sum(CASE WHEN x_{v} IS NOT NULL THEN weight END) OVER (PARTITION BY target_seq) AS e_{v}')} FROM x),
     g AS (SELECT target_seq, count(*) AS n_neighbours, string_agg(neighbour, ',' ORDER BY rank) AS neighbour_ids, {each('any_value(t_{v}) AS t_{v}, any_value(e_{v}) AS e_{v}, sum(weight * pow(x_{v} - e_{v}, 2)) / sum(CASE WHEN x_{v} IS NOT NULL THEN weight END) AS var_{v}')} FROM m GROUP BY 1),
     e AS (SELECT *, {each('CASE WHEN n_neighbours >= 2 THEN e_{v} END AS expected_{v}')} FROM g), r AS (SELECT *, {each('abs(t_{v} - expected_{v}) AS residual_{v}')} FROM e),
     z AS (SELECT *, {", ".join(f"residual_{v} / greatest(sqrt(var_{v}), {f}) AS normalised_{v}" for v, f in ((T, 1.0), (P, 0.8), (H, 4.0)))} FROM r), w AS (SELECT *, greatest({each('normalised_{v}')}) AS worst FROM z)"""
RECORD = f"{L1}, s AS (SELECT *, {each('greatest(hard_{v}::INT::DOUBLE, missing_score_{v}, rate_score_{v}) AS rule_{v}')}, {each('hard_{v}', ' OR ')} AS has_hard, CASE WHEN gap_us = 0 THEN 0.7 WHEN gap_us < 0 THEN 0.8 ELSE 0 END AS rec FROM rates)"
BAND = "CASE WHEN probability < 0.3 THEN 'NORMAL' WHEN probability < 0.6 THEN 'WATCH' WHEN probability < 0.8 THEN 'SUSPICIOUS' WHEN probability < 0.95 THEN 'HIGH' ELSE 'CRITICAL' END"


def compared(scores: dict[str, str]) -> str:
    """CTEs from `judged` (truth, fault_class and columns of scores) to `compared`, one row for each detector."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS detector, truth, fault_class, ({c})::DOUBLE AS score FROM judged" for n, c in scores.items())
    return f"""rows_ AS ({rows}), pts AS (SELECT detector, {POINT}, coalesce(avg(pred::INT) FILTER (fault_class = 'genuine_extreme'), 0) AS genuine_far FROM (SELECT *, score >= 0.5 AS pred FROM rows_) GROUP BY 1),
     cnt AS (SELECT detector, score, sum(truth::INT) AS p, sum((NOT truth)::INT) AS n FROM rows_ GROUP BY 1, 2), cum AS (SELECT *, sum(p) OVER (PARTITION BY detector ORDER BY score DESC) AS tp FROM cnt),
     area AS (SELECT detector, sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auc FROM cum GROUP BY 1),
     compared AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, fp / greatest(fp + tn, 1) AS false_alarm_rate FROM pts JOIN area USING (detector))"""


JUDGED = "judged AS (SELECT *, CASE WHEN truth THEN 'noise' WHEN seq % 11 = 0 THEN 'genuine_extreme' ELSE 'none' END AS fault_class FROM (SELECT *, has_hard OR event_type = 'error' AS truth FROM {t}))"
SQL = {
    "l1_sentinel_range": f"WITH {OBS}, {HARD} SELECT seq, station_id, {each('corrupt_{v}, range_{v}, hard_{v}')} FROM hard",
    "l1_missing_run": f"WITH {OBS}, {HARD}, {RUNS}, {MISSING} SELECT seq, {each('missing_run_{v}')}, {r6(each('missing_score_{v}'))} FROM missing",
    "l1_timestamp_integrity": f"""WITH {OBS}, o AS (SELECT xor(seq, 63) AS seq, station_id, epoch_us(timestamp) AS us FROM obs), g AS (SELECT seq, us - max(us) OVER {WP} AS gap_us FROM o)
     SELECT seq, coalesce(gap_us, 0) AS gap_us, CASE WHEN gap_us = 0 THEN 0.7::DOUBLE ELSE 0::DOUBLE END AS duplicate_score, CASE WHEN gap_us < 0 THEN 0.8::DOUBLE ELSE 0::DOUBLE END AS reversal_score,
     round(CASE WHEN gap_us > 2.7e9 THEN least(1.0::DOUBLE, 0.3 + 0.07 * (round_even(gap_us / 1.8e9::DOUBLE, 0) - 1)) ELSE 0::DOUBLE END, 6) AS gap_score FROM g""",
    "l1_rate_of_change": f"WITH {L1} SELECT seq, {r6(each('delta_{v}, rate_score_{v}'))} FROM rates",
    "l1_persistence_fold": f"""WITH RECURSIVE {OBS}, {HARD}, n AS (SELECT *, row_number() OVER {W} AS i FROM hard),
     fold AS (SELECT station_id, i, seq, rh_pct, {each('CASE WHEN {v} IS NULL OR hard_{v} THEN NULL ELSE {v} END AS a_{v}, CASE WHEN {v} IS NULL OR hard_{v} THEN 0 ELSE 1 END AS c_{v}, CASE WHEN {v} IS NULL OR hard_{v} THEN 0 ELSE 1 END AS run_{v}')} FROM n WHERE i = 1
      UNION ALL SELECT n.station_id, n.i, n.seq, n.rh_pct, {each('CASE WHEN n.hard_{v} THEN f.a_{v} WHEN n.{v} IS NULL THEN NULL WHEN f.a_{v} IS NOT NULL AND abs(n.{v} - f.a_{v}) <= 2.0 THEN f.a_{v} ELSE n.{v} END, CASE WHEN n.hard_{v} THEN f.c_{v} WHEN n.{v} IS NULL THEN 0 WHEN f.a_{v} IS NOT NULL AND abs(n.{v} - f.a_{v}) <= 2.0 THEN f.c_{v} + 1 ELSE 1 END, CASE WHEN n.hard_{v} OR n.{v} IS NULL THEN 0 WHEN f.a_{v} IS NOT NULL AND abs(n.{v} - f.a_{v}) <= 2.0 THEN f.c_{v} + 1 ELSE 1 END')}
      FROM fold f JOIN n ON n.station_id = f.station_id AND n.i = f.i + 1)
     SELECT seq, {each('run_{v}::BIGINT AS run_{v}')}, {", ".join(f"round(CASE WHEN run_{v} >= {lim} THEN least(1.0::DOUBLE, 0.6 + 0.2 * (run_{v} / ({lim})::DOUBLE - 1)) ELSE 0::DOUBLE END, 6) AS persistence_score_{v}" for v, lim in ((T, '3'), (P, '3'), (H, 'CASE WHEN rh_pct >= 97 THEN 7 ELSE 3 END')))} FROM fold""",
    "l1_record_score": f"WITH {L1}, s AS (SELECT *, {each('greatest(hard_{v}::INT::DOUBLE, missing_score_{v}, rate_score_{v}) AS rule_{v}')}, CASE WHEN gap_us = 0 THEN 0.7 WHEN gap_us < 0 THEN 0.8 ELSE 0 END AS rec FROM rates) SELECT seq, station_id, {each('hard_{v}', ' OR ')} AS has_hard, {r6(each('rule_{v}'))}, round(greatest({each('rule_{v}')}, rec), 6) AS rule_score FROM s",
    "l1_flag_counts": f"WITH {L1} "
    + " UNION ALL ".join(f"SELECT '{n}' AS name, '{v}' AS variable, {h} AS hard, count(*) AS n FROM rates WHERE {c} HAVING count(*) > 0" for v in VARIABLES for n, h, c in (("corrupt_encoding", "true", f"corrupt_{v}"), ("range", "true", f"range_{v}"), ("missing", "false", f"{v} IS NULL"), ("rate_of_change", "false", f"rate_score_{v} > 0"))),
    "hard_violations": f"WITH {OBS}, {HARD} SELECT station_id, count(*) AS n, {each('sum(hard_{v}::INT)::BIGINT AS hard_{v}')} FROM hard GROUP BY station_id",
    "trusted_gate": f"WITH {OBS}, {HARD}, {KEEP} SELECT station_id, sum(keep::INT)::BIGINT AS kept, sum((NOT keep)::INT)::BIGINT AS dropped FROM keep GROUP BY station_id",
    "robust_scaler_fit": f"WITH {OBS}, m AS (SELECT station_id, {each('quantile_cont({v}, 0.5) AS med_{v}')} FROM obs GROUP BY station_id) SELECT station_id, {each('round(med_{v}, 6) AS med_{v}')}, {each('round(greatest(1.4826 * quantile_cont(abs({v} - med_{v}), 0.5), 1e-6), 6) AS scale_{v}')} FROM obs JOIN m USING (station_id) GROUP BY station_id, {each('med_{v}')}",
    "l2_window_availability": f"WITH {OBS}, c AS (SELECT *, {each('{v} IS NOT NULL', ' AND ')} AS complete FROM obs), i AS (SELECT *, sum((NOT complete)::INT) OVER {W} AS island FROM c) SELECT seq, complete, island::BIGINT AS island, complete AND count(*) OVER (PARTITION BY station_id, island, complete ORDER BY seq ROWS 7 PRECEDING) = 8 AS available FROM i",
    "threshold_levels": f"WITH {THRESHOLDS} SELECT station_id, fallback, n, {r6('threshold, med, sigma')} FROM thr",
    "threshold_bucketed": f"WITH {THRESHOLDS} SELECT station_id, bucket, n, {r6('threshold, med, sigma')} FROM buck WHERE n >= 50",
    "error_probability": f"WITH {THRESHOLDS}, e AS (SELECT seq, error, thr.sigma, CASE WHEN buck.n >= 50 THEN buck.threshold ELSE thr.threshold END AS used_threshold FROM err JOIN thr USING (station_id) LEFT JOIN buck USING (station_id, bucket)) SELECT seq, round(used_threshold, 6) AS used_threshold, round(1 / (1 + exp(-(2.5 * (error - used_threshold) / greatest(sigma, 1e-9)))), 6) AS recon_p FROM e",
    "multivariate_moments": f"WITH {OBS}, {HARD}, {KEEP}, x AS (SELECT station_id, temp_c AS x0, pressure_hpa AS x1, rh_pct AS x2, "
    + ", ".join(f"{v} - lag({v}) OVER (PARTITION BY station_id ORDER BY timestamp, seq) AS x{i + 3}" for i, v in enumerate(VARIABLES))
    + " FROM keep WHERE keep QUALIFY x3 IS NOT NULL), m AS (SELECT station_id, "
    + ", ".join(f"quantile_cont(x{i}, 0.5) AS med_{i}" for i in range(6))
    + " FROM x GROUP BY 1), s AS (SELECT station_id, "
    + ", ".join(f"greatest(1.4826 * quantile_cont(abs(x{i} - med_{i}), 0.5), 1e-9) AS scale_{i}" for i in range(6))
    + " FROM x JOIN m USING (station_id) GROUP BY 1) SELECT station_id, count(*) AS n, "
    + ", ".join(f"round(any_value(med_{i}), 6) AS med_{i}, round(any_value(scale_{i}), 6) AS scale_{i}" for i in range(6))
    + ", "
    + ", ".join(f"round(avg((x{i} - med_{i}) / scale_{i} * ((x{j} - med_{j}) / scale_{j})), 6) AS m_{i}{j}" for i in range(6) for j in range(i, 6))
    + " FROM x JOIN m USING (station_id) JOIN s USING (station_id) GROUP BY 1",
    "physics_functions": f"""WITH {OBS}, {HARD}, {KEEP}, g AS (SELECT *, ln(least(greatest(rh_pct, 0.1), 100) / 100) + 17.625 * temp_c / (243.04 + temp_c) AS g1, ln(least(greatest(rh_pct, 0.1), 100) / 100) + 17.67 * temp_c / (243.5 + temp_c) AS g2,
      (extract(hour FROM timestamp) + extract(minute FROM timestamp) / 60.0 + floor(extract(second FROM timestamp)) / 3600.0) * 2 * pi() / 24 AS ha, extract(doy FROM timestamp) * 2 * pi() / 365 AS da FROM keep WHERE keep),
     d AS (SELECT *, 243.04 * g1 / (17.625 - g1) AS dew FROM g), e AS (SELECT *, 100 * exp(17.67 * dew / (dew + 243.5)) / exp(17.67 * temp_c / (temp_c + 243.5)) AS rb FROM d)
     SELECT seq, round(dew, 6) AS dew_qc, round(243.5 * g2 / (17.67 - g2), 6) AS dew_network, round(least(greatest(rb, 0), 100), 6) AS rh_back, round(least(greatest(rb, 0.5), 100), 6) AS rh_grid, round(6.112 * exp(17.67 * temp_c / (temp_c + 243.5)), 6) AS saturation,
      round((temp_c - 32) * 5 / 9, 6) AS celsius, round(pressure_hpa * exp(-9.80665 * 560 / (287.058 * (temp_c + 273.15))), 6) AS station_p, round(temp_c + 0.0065 * (14.0 - 560.0), 6) AS lapse, round(pressure_hpa * exp(-9.80665 * (560.0 - 14.0) / (287.058 * (temp_c + 273.15))), 6) AS barometric,
      round(sin(ha), 6) AS hour_sin, round(cos(ha), 6) AS hour_cos, round(sin(da), 6) AS day_sin, round(cos(da), 6) AS day_cos, round(1 / (1 + exp(-(temp_c - 20) / 3)), 6) AS sigmoid FROM e""",
    "station_pairs": f"WITH {PAIRS} SELECT target, neighbour, {r6('distance_km, dz, weight')} FROM pairs",
    "spatial_neighbours_topk": f"WITH {NEAR} SELECT target_seq, neighbour, n_seq, rank::INT AS rank, round(weight, 6) AS weight FROM near",
    "spatial_consensus": f"WITH {CONSENSUS} SELECT target_seq, n_neighbours, neighbour_ids, worst IS NOT NULL AS spatial_available, round(coalesce(1 / (1 + exp(-(worst - 3.5))), 0), 6) AS spatial_p, {r6(each('expected_{v}, residual_{v}, normalised_{v}'))} FROM w",
    "fusion_probability": f"WITH {FUSED} SELECT seq, damped, band, is_anomaly, dominant_variable, round(probability, 6) AS probability FROM fused",
    "fusion_ablation": f"WITH {EVIDENCE} SELECT seq, round({fused(())}, 6) AS p_rules, round({fused(ALL[:1])}, 6) AS p_recon, round({fused(ALL[:2])}, 6) AS p_multi, round({fused(ALL)}, 6) AS p_full FROM ev",
    "qc_status": f"WITH {FUSED} SELECT station_id, {QC.format(c='seq % 2 = 0')} AS qc_status, count(*) AS n FROM fused GROUP BY 1, 2",
    "correction_blend": f"""WITH {FUSED}, c0 AS (SELECT *, sum((NOT is_anomaly)::INT) OVER {W} AS isle, {each('last_value(CASE WHEN NOT is_anomaly AND complete AND NOT has_hard THEN {v} END IGNORE NULLS) OVER ' + WP + ' AS good_{v}')} FROM fused),
     c1 AS (SELECT *, sum(is_anomaly::INT) OVER (PARTITION BY station_id, isle ORDER BY seq) AS bad_run, least(0.9, 0.4 + 0.1 * (seq % 7))::DOUBLE AS cs, 1 - recon_p AS cr, {each('CASE WHEN seq % 3 <> 0 THEN {v} + 0.5 END AS expected_{v}, CASE WHEN recon_available THEN {v} - 0.25 END AS value_{v}')} FROM c0),
     c2 AS (SELECT *, {each('good_{v} IS NOT NULL AS ut_{v}, expected_{v} IS NOT NULL AS us_{v}, value_{v} IS NOT NULL AND cr > 0 AS ur_{v}')} FROM c1 WHERE is_anomaly AND complete),
     c3 AS (SELECT *, {each('0.4::DOUBLE * ut_{v}::INT + 0.4::DOUBLE * us_{v}::INT + 0.2::DOUBLE * ur_{v}::INT AS w_{v}')} FROM c2),
     c4 AS (SELECT *, {each('(CASE WHEN ut_{v} THEN 0.4 * 0.8::DOUBLE ELSE 0 END + CASE WHEN us_{v} THEN 0.4 * cs ELSE 0 END + CASE WHEN ur_{v} THEN 0.2 * cr ELSE 0 END) / nullif(w_{v}, 0) AS k_{v}, (CASE WHEN ut_{v} THEN 0.4 * good_{v} ELSE 0 END + CASE WHEN us_{v} THEN 0.4 * expected_{v} ELSE 0 END + CASE WHEN ur_{v} THEN 0.2 * value_{v} ELSE 0 END) / nullif(w_{v}, 0) AS x_{v}')} FROM c3)
     SELECT seq, bad_run::BIGINT AS bad_run, {each('round(CASE WHEN bad_run <= 12 AND k_{v} >= 0.35 THEN x_{v} END, 6) AS corrected_{v}')}, round(CASE WHEN bad_run <= 12 AND k_temp_c >= 0.35 THEN k_temp_c END, 6) AS correction_confidence_temp_c,
      {", ".join(f"CASE WHEN bad_run <= 12 AND k_{v} >= 0.35 THEN array_to_string(list_filter([CASE WHEN ur_{v} THEN 'reconstruction' END, CASE WHEN us_{v} THEN 'spatial' END, CASE WHEN ut_{v} THEN 'temporal' END], lambda x: x IS NOT NULL), '+') END AS correction_method_{v}" for v in (T, H))} FROM c4""",
    "event_aggregation": f"""WITH {FUSED}, e0 AS (SELECT *, row_number() OVER {W} AS pos, CASE seq % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'spike' ELSE 'noise' END AS fc FROM fused), e1 AS (SELECT *, coalesce((pos - lag(pos) OVER {W} > 4)::INT, 1) AS new FROM e0 WHERE is_anomaly),
     e2 AS (SELECT *, sum(new) OVER {W} AS island FROM e1), v AS (SELECT station_id, island, fc, count(*) AS n, min(pos) AS f FROM e2 WHERE fc <> 'none' GROUP BY ALL), best AS (SELECT station_id, island, fc FROM v QUALIFY row_number() OVER (PARTITION BY station_id, island ORDER BY n DESC, f) = 1),
     g AS (SELECT station_id, island, min(pos) AS f, arg_min(timestamp, pos) AS start, arg_max(timestamp, pos) AS "end", count(*) AS n_points, max(rule_score) AS confidence, max(probability) AS probability, coalesce(string_agg(DISTINCT dominant_variable, ',' ORDER BY dominant_variable), '') AS variables FROM e2 GROUP BY 1, 2)
     SELECT station_id, station_id || '-E' || lpad((row_number() OVER (PARTITION BY station_id ORDER BY f))::VARCHAR, 4, '0') AS event_id, start, "end", n_points, coalesce(fc, 'none') AS fault_class, {r6('confidence, probability')}, variables, round(floor((epoch_us("end") - epoch_us(start)) / 1e6) / 60.0, 6) AS duration_minutes FROM g LEFT JOIN best USING (station_id, island)""",
    "health_indicators": f"WITH {LEDGER} SELECT station_id, variable, n_points, {STATUS.format(n='n_points', s='score')} AS status, {r6('anomaly_rate, error_trend, bias, drift, score')} FROM health",
    "station_health": f"WITH {LEDGER}, s AS (SELECT station_id, max(n_points) AS n_points, min(score) AS m FROM health GROUP BY 1), t AS (SELECT *, {STATUS.format(n='n_points', s='m')} AS status FROM s) SELECT station_id, n_points, status, CASE status WHEN 'CRITICAL' THEN 'HIGH' WHEN 'DEGRADING' THEN 'MEDIUM' ELSE 'LOW' END AS maintenance_risk, round(CASE WHEN n_points >= 48 THEN m ELSE 100 END, 6) AS overall_score FROM t",
    "grid_fill": f"WITH {GRID} SELECT * FROM grid",
    "interval_mode": f"WITH {HOURLY}, d AS (SELECT DISTINCT timestamp FROM hourly), g AS (SELECT epoch_us(timestamp) AS us, round_even((epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (ORDER BY timestamp)) / 6e7::DOUBLE, 0)::BIGINT AS minutes FROM d) SELECT minutes, count(*) AS n, min(us) AS first FROM g WHERE minutes > 0 GROUP BY 1",
    "centred_mean": f"WITH {GRID} SELECT station_id, step, round({centred(P, ST, 3, 6, False)}, 6) AS loose, round({centred(P, ST, 3, 6, True)}, 6) AS \"full\" FROM grid",
    "temperature_anomaly": f"WITH {CLEAN_GRID}, {anomaly(15)} SELECT step, round(anomaly, 6) AS anomaly FROM anomaly",
    "extreme_spans": f"""WITH {CLEAN_GRID}, {anomaly(15)}, pm AS (SELECT step, avg(pressure_hpa) AS p FROM g GROUP BY step), pd AS (SELECT step, {centred('p', '', 12, 24, True)} AS daily FROM pm), pa AS (SELECT step, daily - {centred('daily', '', 120, 240, False)} AS anomaly FROM pd),
     {island('hot', 'anomaly', 'anomaly >= 0.3', 'round(max(anomaly), 2)', 'heatwave')}, {island('low', 'pa', 'anomaly <= -0.5', 'round(abs(min(anomaly)), 2)', 'pressure_depression')} SELECT * FROM hot UNION ALL SELECT * FROM low""",
    "chronological_split": f"WITH {GRID} SELECT CASE WHEN step < 432 THEN 'train' WHEN step < 576 THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(step) AS lo, max(step) AS hi FROM grid GROUP BY 1",
    "diurnal_profile": f"WITH {FUSED} SELECT extract(hour FROM timestamp)::INT AS hour, round(avg(temp_c), 3) AS observed, round(avg(temp_c - 0.25), 3) AS reconstructed, count(*) AS n FROM fused WHERE NOT is_anomaly AND recon_available AND temp_c > -100 GROUP BY 1",
    "injection_sigma": f"WITH {GRID}, d AS (SELECT station_id, {each('{v} - lag({v}) OVER (PARTITION BY station_id ORDER BY step) AS {v}')} FROM grid), m AS (SELECT station_id, {each('quantile_cont({v}, 0.5) AS m_{v}, count({v}) AS n_{v}')} FROM d GROUP BY 1) SELECT station_id, {each('round(CASE WHEN any_value(n_{v}) < 8 THEN 1.0::DOUBLE ELSE greatest(1.4826 * quantile_cont(abs({v} - m_{v}), 0.5), 1e-3) END, 6) AS sigma_{v}')} FROM d JOIN m USING (station_id) GROUP BY 1",
    "robust_zscore_baseline": f"WITH {OBS}, m AS (SELECT station_id, {each('quantile_cont({v}, 0.5) AS med_{v}')} FROM obs GROUP BY 1), s AS (SELECT station_id, {each('any_value(med_{v}) AS med_{v}, greatest(1.4826 * quantile_cont(abs({v} - med_{v}), 0.5), 1e-9) AS scale_{v}')} FROM obs JOIN m USING (station_id) GROUP BY 1) SELECT seq, round(greatest({each('coalesce(abs({v} - med_{v}) / scale_{v}, 0)')}), 6) AS zscore FROM obs JOIN s USING (station_id)",
    "ecdf_scores": f"WITH {LABELLED}, c AS (SELECT score, sum((NOT truth)::INT) AS c FROM lab GROUP BY 1), e AS (SELECT score, sum(c) OVER (ORDER BY score) / sum(c) OVER () AS calibrated FROM c) SELECT seq, round(calibrated, 6) AS calibrated FROM lab JOIN e USING (score)",
    "point_metrics": f"WITH {LABELLED}, c AS (SELECT {POINT} FROM lab) SELECT tp, fp, fn, tn, {SCORES} FROM c",
    "two_tier_scorecard": f"WITH {FUSED}, q AS (SELECT has_hard AS truth, is_anomaly, {QC.format(c='false')} AS st FROM fused), b AS (SELECT 'quarantine' AS tier, truth, is_anomaly AS pred FROM q UNION ALL SELECT 'review', truth, st <> 'PASS' FROM q), c AS (SELECT tier, {POINT} FROM b GROUP BY 1) SELECT tier, tp, fp, fn, tn, {SCORES} FROM c",
    "event_recall": f"WITH {LABELLED}, a AS (SELECT *, row_number() OVER {W} - 1 AS pos, sum((NOT truth)::INT) OVER {W} AS isle FROM lab), s AS (SELECT station_id, isle, min(pos) AS st, min(pos) FILTER (pred) AS hit FROM a WHERE truth GROUP BY 1, 2) SELECT count(*) AS n_events, count(hit) AS detected, round(count(hit) / greatest(count(*), 1), 6) AS recall, round(avg(hit - st), 6) AS mean_delay FROM s",
    "per_class_recall": f"WITH {LABELLED} SELECT fault_class, count(*) AS n, round(avg(pred::INT), 6) AS recall FROM lab WHERE fault_class NOT IN ('none', 'genuine_extreme') GROUP BY 1",
    "genuine_false_alarms": f"WITH {LABELLED} SELECT round(coalesce(avg(pred::INT), 0), 6) AS genuine_far FROM lab WHERE fault_class = 'genuine_extreme'",
    "confusion_matrix": f"WITH {LABELLED} SELECT true_class, " + ", ".join(f"count(*) FILTER (pred_class = '{c}') AS \"{c}\"" for c in ("none", "spike", "noise", "corrupt")) + " FROM lab WHERE true_class IN ('none', 'spike', 'noise', 'corrupt') AND pred_class IN ('none', 'spike', 'noise', 'corrupt') GROUP BY 1",
    "ece_bins": f"WITH {LABELLED} SELECT ({' + '.join(f'(score > {i / 10}::DOUBLE)::INT' for i in range(1, 10))})::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_prob, round(avg(truth::INT), 6) AS mean_truth FROM lab GROUP BY 1",
    "expected_calibration_error": f"WITH {LABELLED}, b AS (SELECT {' + '.join(f'(score > {i / 10}::DOUBLE)::INT' for i in range(1, 10))} AS bin, count(*) AS n, avg(score) AS p, avg(truth::INT) AS t FROM lab GROUP BY 1) SELECT round(sum(n * abs(p - t)) / sum(n), 6) AS ece FROM b",
    "roc_auc": f"WITH {LABELLED}, g AS (SELECT score, sum(truth::INT) AS p, sum((NOT truth)::INT) AS n FROM lab GROUP BY 1), c AS (SELECT p, n, sum(p) OVER (ORDER BY score DESC) AS tp FROM g) SELECT round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM c",
    "average_precision": f"WITH {LABELLED}, g AS (SELECT score, sum(truth::INT) AS p, sum((NOT truth)::INT) AS n FROM lab GROUP BY 1), c AS (SELECT p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM g) SELECT round(sum(p * tp / greatest(tp + fp, 1)) / sum(p), 6) AS average_precision, round(sum(p) / sum(p + n), 6) AS baseline FROM c",
    "score_histogram": f"WITH {LABELLED} SELECT least(floor(score * 20), 19)::BIGINT AS bin, count(*) AS n FROM lab GROUP BY 1",
    "latency_percentiles": f"WITH {LABELLED}, x AS (SELECT pred, (seq * 131 % 977) / 1000.0::DOUBLE AS l FROM lab) SELECT pred, round(avg(l), 6) AS mean, round(quantile_cont(l, 0.5), 6) AS median, round(quantile_cont(l, 0.95), 6) AS p95, round(quantile_cont(l, 0.99), 6) AS p99 FROM x GROUP BY 1",
    "case_studies": f"WITH {LABELLED}, b AS (SELECT seq, fault_class, score AS probability FROM lab WHERE (fault_class NOT IN ('none', 'genuine_extreme') AND pred) OR (fault_class = 'genuine_extreme' AND NOT pred) QUALIFY row_number() OVER (PARTITION BY fault_class ORDER BY score DESC, seq) = 1) SELECT * FROM b ORDER BY probability DESC, seq LIMIT 8",
    "detector_comparison": f"WITH {FUSED}, {JUDGED.format(t='fused')}, {compared({'rules': 'rule_score', 'autoencoder': 'CASE WHEN recon_available THEN recon_p ELSE 0 END', 'consensus': 'CASE WHEN spatial_available THEN spatial_p ELSE 0 END', 'fused': 'probability'})} SELECT detector, tp, fp, fn, tn, {r6('precision, recall, f1, false_alarm_rate, genuine_far, auc')} FROM compared",
    "ablation_ladder": f"WITH {EVIDENCE}, {JUDGED.format(t='ev')}, {compared({'rules': fused(()), 'with autoencoder': fused(ALL[:1]), 'with joint state': fused(ALL[:2]), 'full': fused(ALL)})} SELECT detector, " + ", ".join(f"round({x}, 4) AS {x}" for x in ("f1", "precision", "false_alarm_rate", "genuine_far", "auc")) + " FROM compared",
    "reconstruction_by_variable": f"WITH {FUSED} " + " UNION ALL ".join(f"SELECT '{v}' AS variable, count(*) AS n, round(avg(recon_error_{v}), 6) AS mean_error FROM fused WHERE NOT is_anomaly AND recon_available" for v in VARIABLES),
    "engine_without_models": f"""WITH {RECORD}, near_ AS (WITH {CONSENSUS} SELECT target_seq, worst IS NOT NULL AS spatial_available, coalesce(1 / (1 + exp(-(worst - 3.5))), 0) AS spatial_p FROM w),
     j AS (SELECT s.*, greatest({each('rule_{v}')}, rec) AS rule_score, coalesce(spatial_available, false) AS spatial_available, coalesce(spatial_p, 0) AS spatial_p FROM s LEFT JOIN near_ ON target_seq = seq),
     p AS (SELECT *, least(greatest(CASE WHEN has_hard THEN greatest(q, 0.95::DOUBLE) ELSE q END, 0), 1) AS probability FROM (SELECT *, (rule_score + CASE WHEN spatial_available THEN 0.8::DOUBLE * spatial_p ELSE 0 END) / (1.85::DOUBLE + CASE WHEN spatial_available THEN 0.8::DOUBLE ELSE 0 END) AS q FROM j))
     SELECT seq, station_id, has_hard, spatial_available, {BAND} AS band, probability >= 0.5 AS is_anomaly, CASE WHEN greatest({each('rule_{v}')}) <= 0 THEN NULL WHEN rule_temp_c >= rule_pressure_hpa AND rule_temp_c >= rule_rh_pct THEN 'temp_c' WHEN rule_pressure_hpa >= rule_rh_pct THEN 'pressure_hpa' ELSE 'rh_pct' END AS dominant_variable, {r6('rule_score, spatial_p, probability')} FROM p""",
    "worklist_topn": f"WITH {FUSED} SELECT seq, station_id, timestamp, band, round(probability, 6) AS probability FROM fused WHERE is_anomaly ORDER BY timestamp DESC, seq DESC LIMIT 200",
    "station_range_scan": f"WITH {OBS} SELECT seq, timestamp, temp_c, pressure_hpa, rh_pct FROM obs WHERE station_id = 'S03' AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'",
    "record_counts": f"WITH {OBS} SELECT station_id, count(*) AS n FROM obs GROUP BY 1",
    "station_registry": f"WITH {STATIONS} SELECT * FROM stations",
}
SQL["stream_l1_replay"] = SQL["l1_record_score"]

# Formats, stored records, rendered texts

_C = "((temp_c * 1.8 + 32.0) - 32.0) * 5.0 / 9.0"
_DEW = "((temp_c * 1.8 + 32.0 - 9.0) - 32.0) * 5.0 / 9.0"


def at_station(slp: str, metres: float, celsius: str) -> str:
    return f"{slp} * exp(-9.80665 * {metres}::DOUBLE / (287.058 * (coalesce({celsius}, 15.0) + 273.15)))"


def vapour(celsius: str) -> str:
    return f"(6.112 * exp(17.67::DOUBLE * ({celsius}) / (({celsius}) + 243.5)))"


def place(by: int, *values: str) -> str:
    return "CASE " + " ".join(f"WHEN seq % {by} = {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


STORED = f"""{OBS}, r AS (SELECT seq, station_id, timestamp, (seq * 37 % 1000) / 1000.0::DOUBLE AS p, row_number() OVER (PARTITION BY station_id, timestamp ORDER BY seq % 3 = 0, seq) AS n FROM obs),
 audit AS (SELECT seq, station_id, timestamp, round(CASE WHEN seq % 3 = 0 THEN p + 1 ELSE p END, 6) AS probability, p >= 0.5 AS is_anomaly FROM r WHERE n = 1)"""
_MESSAGE = f"""{OBS}, m AS (SELECT *, seq % 17 = 0 AS nameless, seq % 19 = 0 AS timeless, seq % 7 IN (2, 3, 4) AS worded FROM obs),
 e AS (SELECT *, CASE WHEN nameless THEN 'station_id is required' WHEN timeless THEN 'timestamp is required' WHEN worded THEN 'values must be finite numbers' END AS error FROM m)"""
_ACTION = "CASE cls " + " ".join("WHEN '{}' THEN '{}'".format(*a) for a in ACTIONS.items()) + " ELSE 'Review manually.' END"
_CLASSES = "['" + "', '".join([*ACTIONS, "unheard_of"]) + "']"
SQL |= {
    "parsed_texts": f"WITH {OBS} SELECT seq, {place(9, '(seq % 1000) + 0.5', 'NULL', 'NULL', 'NULL', 'NULL', 'NULL', '-9999.0', '1000.0', 'NULL')}::DOUBLE AS number, "
    + place(11, "date_trunc('second', timestamp)", "date_trunc('minute', timestamp)", "date_trunc('second', timestamp)", "date_trunc('minute', timestamp)", "date_trunc('hour', timestamp)", "date_trunc('minute', timestamp)", "date_trunc('day', timestamp)::TIMESTAMP", "date_trunc('day', timestamp)::TIMESTAMP", "date_trunc('second', timestamp) - INTERVAL 2 HOUR", "date_trunc('second', timestamp)", "NULL")
    + " AS time FROM obs",
    "csv_source": f"WITH {OBS} SELECT station_id, date_trunc('second', timestamp) AS timestamp, round({_C}, 6) AS temp_c, round({at_station('pressure_hpa', 250, _C)}, 6) AS pressure_hpa, round(least(greatest(100.0 * {vapour(_DEW)} / {vapour(_C)}, 0), 100), 6) + CASE WHEN temp_c IS NULL THEN NULL ELSE 0 END AS rh_pct FROM obs WHERE seq % 13 <> 0",
    "ghcnh_source": f"WITH {OBS} SELECT station_id, date_trunc('hour', timestamp) AS timestamp, round(temp_c, 6) AS temp_c, round(pressure_hpa, 6) AS pressure_hpa, round(rh_pct, 6) AS rh_pct FROM obs",
    "meteostat_source": f"WITH {OBS} SELECT station_id, date_trunc('second', timestamp) AS timestamp, round(temp_c, 6) AS temp_c, round({at_station('pressure_hpa', 655, 'temp_c')}, 6) AS pressure_hpa, round(rh_pct, 6) AS rh_pct FROM obs WHERE station_id = 'S03'",
    "station_file_source": f"WITH {STATIONS} SELECT station_id, CASE WHEN station_id = 'S02' THEN station_id ELSE name END AS name, lat, lon, CASE WHEN station_id = 'S03' THEN 0 ELSE elevation_m END AS elevation_m, CASE WHEN station_id = 'S04' THEN 'inland' ELSE terrain END AS terrain FROM stations WHERE station_id NOT IN ('S01', 'S06')",
    "message_source": f"WITH {_MESSAGE} SELECT CASE WHEN nameless THEN ' ' ELSE station_id END AS station_id, CASE WHEN NOT timeless THEN date_trunc('second', timestamp) END AS timestamp, CASE WHEN error IS NULL AND seq % 7 <> 5 THEN temp_c END AS temp_c, CASE WHEN error IS NULL THEN pressure_hpa END AS pressure_hpa, NULL::DOUBLE AS rh_pct, error FROM e",
    "archive_source": f"WITH {OBS} SELECT station_id, date_trunc('minute', timestamp) AS timestamp, temp_c, pressure_hpa, rh_pct FROM obs WHERE station_id = 'S05'",
    "audit_range": f"WITH {STORED} SELECT seq, station_id, timestamp, probability FROM audit WHERE station_id = 'S03' AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'",
    "audit_worklist": f"WITH {STORED} SELECT seq, station_id, timestamp, probability FROM audit WHERE station_id = 'S05' AND is_anomaly",
    "audit_counts": f"WITH {STORED} SELECT station_id, count(*) AS n FROM audit GROUP BY 1",
    "scaled_values": f"WITH {OBS}, m AS (SELECT station_id, {each('quantile_cont({v}, 0.5) AS med_{v}')} FROM obs GROUP BY 1), s AS (SELECT station_id, {each('any_value(med_{v}) AS med_{v}, greatest(1.4826 * quantile_cont(abs({v} - med_{v}), 0.5), 1e-6) AS scale_{v}')} FROM obs JOIN m USING (station_id) GROUP BY 1) "
    f"SELECT seq, {each('round(({v} - med_{v}) / scale_{v}, 6) AS z_{v}, round(({v} - med_{v}) / scale_{v} * scale_{v} + med_{v}, 6) AS back_{v}')} FROM obs JOIN s USING (station_id)",
    "station_distances": f"WITH {STATIONS} SELECT a.station_id AS one, b.station_id AS other, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 6) AS km FROM stations a JOIN stations b ON a.station_id < b.station_id",
    "flag_details": f"WITH {L1} "
    + " UNION ALL ".join(
        [f"SELECT seq, 'corrupt_encoding' AS name, '{v}' AS variable, 1.0::DOUBLE AS score, '{v}=' || {v}::VARCHAR || ' matches a sentinel' AS detail FROM rates WHERE corrupt_{v}" for v in VARIABLES]
        + [f"SELECT seq, 'range', '{v}', 1.0::DOUBLE, '{v}=' || {v}::VARCHAR || ' outside its range' FROM rates WHERE range_{v}" for v in VARIABLES]
        + [f"SELECT seq, 'missing', '{v}', round(missing_score_{v}, 6), '{v} missing for ' || missing_run_{v}::VARCHAR || ' readings' FROM rates WHERE {v} IS NULL" for v in VARIABLES]
        + [f"SELECT seq, 'rate_of_change', '{v}', round(rate_score_{v}, 6), printf('{v} changed by %.2f', delta_{v}) FROM rates WHERE rate_score_{v} > 0" for v in VARIABLES]
        + ["SELECT seq, 'duplicate_timestamp', 'record', 0.7::DOUBLE, 'timestamp repeats' FROM rates WHERE gap_us = 0", "SELECT seq, 'timestamp_reversal', 'record', 0.8::DOUBLE, printf('timestamp is %.1f min behind', -gap_us / 6e7::DOUBLE) FROM rates WHERE gap_us < 0"]
    ),
    "rendered_verdicts": f"""WITH {FUSED}, x AS (SELECT *, (seq * 7919 % 101) / 100.0::DOUBLE AS p, (seq % 101) / 100.0::DOUBLE AS conf, {_CLASSES}[(seq % {len(ACTIONS) + 1})::INT + 1] AS cls FROM fused)
     SELECT seq, CASE WHEN cls = 'none' THEN 'NONE' WHEN p >= 0.9 THEN 'CRITICAL' WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.5 THEN 'MODERATE' ELSE 'LOW' END AS severity, {_ACTION} AS action,
      band || printf(' p=%.2f', p) || CASE WHEN cls <> 'none' THEN ' | ' || cls || ' (' || round(conf * 100)::INT::VARCHAR || '%)' || CASE WHEN seq % 2 = 0 THEN ' via rate' ELSE '' END ELSE '' END || CASE WHEN damped THEN ' [weather-damped]' ELSE '' END || coalesce(' @ ' || dominant_variable, '') AS explanation,
      strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS time FROM x""",
    "station_timelines": f"WITH {FUSED} SELECT station_id, timestamp::DATE::VARCHAR AS day, string_agg(band, ',' ORDER BY seq) AS bands, count(*) FILTER (is_anomaly) AS anomalies FROM fused GROUP BY 1, 2",
}
