"""Layer 1: deterministic checks of single stations, as windows in arrival order.

Everything but the anchored persistence run is a running value over blocks of a station's series. The persistence run is
a fold over sorted partitions that carries two numbers for each variable. A series is cut for it where the runs of all
variables surely break, once a block at most; so one task holds a block's readings, and more only as long as runs go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meteolith.config import DEFAULT, VARIABLES, Rules
from meteolith.functions.physics import micros
from meteolith.operators import series


def ordered() -> WindowSpec:
    """Arrival order within a station."""
    return Window.partitionBy("station_id").orderBy("seq")


def earlier() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, -1)


def upto() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def is_sentinel(v: Column, cfg: Rules = DEFAULT.rules) -> Column:
    out = F.lit(False)
    for s in cfg.sentinels:
        out = out | (F.abs(v - s) < cfg.sentinel_tolerance)
    return out


def out_of_range(name: str, cfg: Rules = DEFAULT.rules) -> Column:
    return (F.col(name) < cfg.low[name]) | (F.col(name) > cfg.high[name])


def hard(name: str, cfg: Rules = DEFAULT.rules) -> Column:
    return F.coalesce(is_sentinel(F.col(name), cfg) | out_of_range(name, cfg), F.lit(False))


def sentinel_range(obs: DataFrame, cfg: Rules = DEFAULT.rules) -> DataFrame:
    """corrupt_<v>, range_<v> (never where corrupt) and hard_<v>."""
    cols = {}
    for v in VARIABLES:
        s = F.coalesce(is_sentinel(F.col(v), cfg), F.lit(False))
        cols[f"corrupt_{v}"] = s
        cols[f"range_{v}"] = ~s & F.coalesce(out_of_range(v, cfg), F.lit(False))
        cols[f"hard_{v}"] = hard(v, cfg)
    return obs.withColumns(cols)


def arrival(obs: DataFrame, cfg: Rules = DEFAULT.rules, bits: int = series.BITS) -> DataFrame:
    """What layer 1 knows of a station's earlier readings, in one pass: __clock (latest timestamp, microseconds),
    __last_<v> (last sound value), missing_run_<v> (nulls in a row up to here), __home (the block since which no row
    was a cut of the persistence runs)."""
    obs = series.blocks(obs, bits).withColumns({f"__bad_{v}": hard(v, cfg) for v in VARIABLES})
    # Unknown for a block's first sound value, which is taken as no cut.
    known = {f"__known_{v}": F.last(F.when(~F.col(f"__bad_{v}"), F.struct(F.col(v).alias("x"))), ignorenulls=True).over(series.within(-1)) for v in VARIABLES}
    obs = obs.withColumns(known | {"__place": series.place()})
    cuts = F.lit(True)
    for v in VARIABLES:
        off = F.abs(F.col(v) - F.col(f"__known_{v}.x")) > reach(cfg.tolerance[v])
        broken = F.col(v).isNull() | (F.col(f"__known_{v}").isNotNull() & F.coalesce(off, F.lit(True)))
        cuts = cuts & ~F.col(f"__bad_{v}") & broken
    obs = obs.withColumns({"__cut": F.when(cuts, F.col("__block")), "__us": micros(F.col("timestamp"))}).drop(*known)
    sound = {f"__last_{v}": F.when(~F.col(f"__bad_{v}"), F.col(v)) for v in VARIABLES}
    obs = series.running(obs, {"__clock": F.col("__us")}, sound | {"__home": F.col("__cut")}, {f"missing_run_{v}": F.col(v).isNull() for v in VARIABLES})
    return obs.withColumn("__home", F.coalesce("__cut", "__home")).drop("__block", "__cut", "__us", *[f"__bad_{v}" for v in VARIABLES])


def with_arrival(obs: DataFrame, cfg: Rules = DEFAULT.rules) -> DataFrame:
    return obs if "__clock" in obs.columns else arrival(obs, cfg)


def without_arrival(obs: DataFrame) -> DataFrame:
    return obs.drop("__clock", "__home", *[f"__last_{v}" for v in VARIABLES])


def missing_runs(obs: DataFrame) -> DataFrame:
    """missing_run_<v>: nulls in a row up to here; missing_score_<v>."""
    kept = "__clock" in obs.columns
    obs = with_arrival(obs)
    scores = {f"missing_score_{v}": F.when(F.col(v).isNull(), F.least(F.lit(1.0), 0.35 + 0.065 * F.col(f"missing_run_{v}"))).otherwise(0.0) for v in VARIABLES}
    obs = obs.withColumns(scores)
    return obs if kept else without_arrival(obs)


def clock(obs: DataFrame, cfg: Rules = DEFAULT.rules) -> DataFrame:
    """gap_us (since the latest earlier timestamp), duplicate, reversal, gap scores; the clock never moves back."""
    kept = "__clock" in obs.columns
    obs = with_arrival(obs, cfg)
    obs = obs.withColumn("gap_us", micros(F.col("timestamp")) - F.col("__clock"))
    gap = F.lit(0.0)
    if cfg.interval_minutes:
        step = cfg.interval_minutes * 60e6
        missed = F.bround(F.col("gap_us") / step) - 1
        gap = F.when(F.col("gap_us") > 1.5 * step, F.least(F.lit(1.0), 0.3 + 0.07 * missed)).otherwise(0.0)
    obs = obs if kept else without_arrival(obs).drop(*[f"missing_run_{v}" for v in VARIABLES])
    return obs.withColumns({"duplicate_score": F.when(F.col("gap_us") == 0, 0.7).otherwise(0.0), "reversal_score": F.when(F.col("gap_us") < 0, 0.8).otherwise(0.0), "gap_score": F.coalesce(gap, F.lit(0.0))})


def rates(obs: DataFrame, cfg: Rules = DEFAULT.rules) -> DataFrame:
    """delta_<v> against the last sound value in arrival order, rate_score_<v>. Needs clock() and hard flags."""
    kept = "__clock" in obs.columns
    obs = with_arrival(obs, cfg)
    hours = F.col("gap_us") / 3.6e9
    usable = (F.col("gap_us") > 0) & (hours <= cfg.max_gap_h)
    deltas = {f"delta_{v}": F.when(usable & ~F.col(f"hard_{v}"), F.abs(F.col(v) - F.col(f"__last_{v}"))) for v in VARIABLES}
    obs = obs.withColumns(deltas)
    scores = {}
    for v in VARIABLES:
        allowed = cfg.rate[v] * F.greatest(hours, F.lit(cfg.min_gap_h))
        d = F.col(f"delta_{v}")
        scores[f"rate_score_{v}"] = F.coalesce(F.when(d > allowed, F.least(F.lit(1.0), 0.55 + 0.15 * (d / allowed - 1))), F.lit(0.0))
    obs = obs.withColumns(scores)
    return obs if kept else without_arrival(obs).drop(*[f"missing_run_{v}" for v in VARIABLES])


def reach(tolerance: float) -> float:
    """A value farther than this from the one before it is out of any anchor's reach."""
    return 2.000001 * tolerance + 1e-9


def anchored_runs(x: np.ndarray, tolerance: float, anchor: float | None, length: int) -> tuple[np.ndarray, float | None, int]:
    """Length of the anchored run at each value (0 at NaN, which breaks it), and the anchor and length to go on with.

    A value more than two tolerances from the one before it is out of any anchor's reach, so a run surely begins there;
    only stretches without such a break are folded value by value."""
    out = (~np.isnan(x)).astype(np.int64)
    if not len(x):
        return out, anchor, length
    fresh = np.isnan(x)
    fresh[1:] |= np.isnan(x[:-1]) | ~(np.abs(np.diff(x)) <= reach(tolerance))
    fresh[0] |= anchor is None
    starts = np.flatnonzero(fresh)
    if not fresh[0]:
        starts = np.concatenate([[0], starts])
    ends = np.append(starts[1:], len(x))
    folded = (ends - starts > 1) | ~fresh[starts]  # a fresh value alone has run 1 already
    for i, j in zip(starts[folded].tolist(), ends[folded].tolist(), strict=True):
        if fresh[i]:
            anchor, length = None, 0
        for k, v in enumerate(x[i:j].tolist(), i):
            anchor, length = (anchor, length + 1) if anchor is not None and abs(v - anchor) <= tolerance else (v, 1)
            out[k] = length
    if not folded[-1]:
        anchor, length = (float(x[-1]), 1) if out[-1] else (None, 0)
    return out, anchor, length


def persistence_runs(obs: DataFrame, cfg: Rules = DEFAULT.rules) -> DataFrame:
    """run_<v>: length of the run anchored at the value that began it. Null breaks a run; a hard value leaves it as it
    is. Rows with a hard value or null have run 0."""
    names = [f"run_{v}" for v in VARIABLES]
    hards = [f"__hard_{v}" for v in VARIABLES]
    own = "__clock" not in obs.columns
    obs = with_arrival(obs, cfg).drop(*names).withColumns(dict(zip(hards, [hard(v, cfg) for v in VARIABLES], strict=True)))
    if own:
        obs = obs.drop("__clock", *[f"{p}_{v}" for v in VARIABLES for p in ("__last", "missing_run")])
    kept = [f for f in obs.schema.fields if f.name not in (*hards, "__home")]
    tolerances = [cfg.tolerance[v] for v in VARIABLES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[tuple[float | None, int]] = []
        station = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("station_id").dictionary_encode()
            code = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            home = batch.column("__home").fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(home) != 0)) + 1).tolist(), batch.num_rows]
            values = [batch.column(v).cast(pa.float64()).to_numpy(zero_copy_only=False) for v in VARIABLES]
            sound = [~batch.column(h).to_numpy(zero_copy_only=False).astype(bool) for h in hards]
            out = np.zeros((len(VARIABLES), batch.num_rows), np.int64)
            for a, b in zip(cuts, cuts[1:], strict=False):
                name = batch.column("station_id")[a].as_py(), batch.column("__home")[a].as_py()
                if name != station:
                    station, state = name, [(None, 0)] * len(VARIABLES)
                for k, (value, good) in enumerate(zip(values, sound, strict=True)):
                    at = np.flatnonzero(good[a:b]) + a
                    out[k, at], anchor, length = anchored_runs(value[at], tolerances[k], *state[k])
                    state[k] = anchor, length
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(o) for o in out)], names=[*(f.name for f in kept), *names])

    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in names)])
    return obs.repartition("station_id", "__home").sortWithinPartitions("station_id", "__home", "seq").mapInArrow(run, schema)


def persistence(obs: DataFrame, cfg: Rules = DEFAULT.rules) -> DataFrame:
    """persistence_score_<v> of run_<v>."""
    scores = {}
    for v in VARIABLES:
        limit = F.lit(float(cfg.repeats[v]))
        if v == "rh_pct":
            limit = F.when(F.col(v) >= cfg.saturated_rh, float(int(cfg.repeats[v] * cfg.saturated_factor))).otherwise(limit)
        run = F.col(f"run_{v}")
        scores[f"persistence_score_{v}"] = F.when((run > 0) & (run >= limit), F.least(F.lit(1.0), 0.6 + 0.2 * (run / limit - 1))).otherwise(0.0)
    return obs.withColumns(scores)


def scores(obs: DataFrame) -> DataFrame:
    """rule_<v>, rule_score, persistence_score, has_hard of all checks before."""
    per_variable = {f"rule_{v}": F.greatest(F.when(F.col(f"hard_{v}"), 1.0).otherwise(0.0), *[F.col(f"{c}_score_{v}") for c in ("missing", "rate", "persistence")]) for v in VARIABLES}
    obs = obs.withColumns(per_variable)
    return obs.withColumns({
        "rule_score": F.greatest(*[F.col(f"rule_{v}") for v in VARIABLES], "duplicate_score", "reversal_score", "gap_score"),
        "persistence_score": F.greatest(*[F.col(f"persistence_score_{v}") for v in VARIABLES]),
        "has_hard": F.col("hard_temp_c") | F.col("hard_pressure_hpa") | F.col("hard_rh_pct"),
    })


def flags(obs: DataFrame) -> DataFrame:
    """flags: array of struct<name, variable, score, hard, detail>, in the order the checks run."""
    out = []

    def flag(when: Column, name: str, variable: str | None, score: Column, is_hard: bool, detail: Column) -> None:
        out.append(F.when(when, F.struct(F.lit(name).alias("name"), F.lit(variable).cast("string").alias("variable"), score.cast("double").alias("score"), F.lit(is_hard).alias("hard"), detail.alias("detail"))))

    one = F.lit(1.0)
    for v in VARIABLES:
        flag(F.col(f"corrupt_{v}"), "corrupt_encoding", v, one, True, F.format_string(f"{v}=%s matches a sentinel", F.col(v)))
    for v in VARIABLES:
        flag(F.col(f"range_{v}"), "range", v, one, True, F.format_string(f"{v}=%s outside its range", F.col(v)))
    for v in VARIABLES:
        flag(F.col(v).isNull(), "missing", v, F.col(f"missing_score_{v}"), False, F.format_string(f"{v} missing for %d readings", F.col(f"missing_run_{v}")))
    flag(F.col("duplicate_score") > 0, "duplicate_timestamp", None, F.col("duplicate_score"), False, F.lit("timestamp repeats"))
    flag(F.col("reversal_score") > 0, "timestamp_reversal", None, F.col("reversal_score"), False, F.format_string("timestamp is %.1f min behind", -F.col("gap_us") / 6e7))
    flag(F.col("gap_score") > 0, "timestamp_gap", None, F.col("gap_score"), False, F.format_string("gap of %.1f min", F.col("gap_us") / 6e7))
    for v in VARIABLES:
        flag(F.col(f"rate_score_{v}") > 0, "rate_of_change", v, F.col(f"rate_score_{v}"), False, F.format_string(f"{v} changed by %.2f", F.col(f"delta_{v}")))
    for v in VARIABLES:
        flag(F.col(f"persistence_score_{v}") > 0, "persistence", v, F.col(f"persistence_score_{v}"), False, F.format_string(f"{v} unchanged for %d readings", F.col(f"run_{v}")))
    return obs.withColumn("flags", F.filter(F.array(*out), lambda x: x.isNotNull()))


def layer(obs: DataFrame, cfg: Rules = DEFAULT.rules, bits: int = series.BITS) -> DataFrame:
    """All of layer 1 beside the untouched readings."""
    obs = persistence_runs(arrival(obs, cfg, bits), cfg)  # only what later steps cannot work out anew goes through Arrow
    obs = rates(clock(missing_runs(sentinel_range(obs, cfg)), cfg), cfg)
    return scores(persistence(without_arrival(obs), cfg))
