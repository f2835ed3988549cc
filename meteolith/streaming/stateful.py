"""The streaming twin of layer 1: per-station state, arrival order, O(1) for each reading.

Readings are processed in the order they arrive (late ones are flagged, not dropped), so there is no watermark; state
is a few numbers for each station. A station's rows of one micro-batch come in several Arrow frames, in the order of
the shuffle; they are put into arrival order as a whole, as five plain columns of a micro-batch, whose size the source
bounds (maxFilesPerTrigger, maxBytesPerTrigger)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meteolith.config import DEFAULT, VARIABLES, Rules
from meteolith.functions.physics import micros

#: Rows of a frame of results.
FRAME = 10_000
STATE = "clock bigint, " + ", ".join(f"last_{v} double, anchor_{v} double, run_{v} bigint, missing_{v} bigint" for v in VARIABLES)
OUTPUT = "station_id string, seq bigint, rule_score double, has_hard boolean, persistence_score double, " + ", ".join(f"rule_{v} double" for v in VARIABLES)


def _is_hard(v: str, x: float | None, cfg: Rules) -> bool:
    return x is not None and (any(abs(x - s) < cfg.sentinel_tolerance for s in cfg.sentinels) or x < cfg.low[v] or x > cfg.high[v])


class Station:
    """State of a station and the score of its next reading."""

    def __init__(self, values: tuple | None, cfg: Rules):
        self.cfg = cfg
        names = [s.split()[0] for s in STATE.split(", ")]
        self.s = dict(zip(names, values or [None] * len(names), strict=True))

    def values(self) -> tuple:
        return tuple(self.s.values())

    def step(self, us: int, reading: dict[str, float | None]) -> dict:
        cfg, s = self.cfg, self.s
        gap = None if s["clock"] is None else us - s["clock"]
        hours = None if gap is None else gap / 3.6e9
        out, persist, any_hard = {}, 0.0, False
        for v in VARIABLES:
            x = reading[v]
            hard = _is_hard(v, x, cfg)
            any_hard |= hard
            score = 1.0 if hard else 0.0
            if x is None:
                s[f"missing_{v}"] = (s[f"missing_{v}"] or 0) + 1
                score = max(score, min(1.0, 0.35 + 0.065 * s[f"missing_{v}"]))
            else:
                s[f"missing_{v}"] = 0
            if not hard:
                if x is not None and s[f"last_{v}"] is not None and gap is not None and gap > 0 and hours <= cfg.max_gap_h:
                    allowed, d = cfg.rate[v] * max(hours, cfg.min_gap_h), abs(x - s[f"last_{v}"])
                    if d > allowed:
                        score = max(score, min(1.0, 0.55 + 0.15 * (d / allowed - 1)))
                if x is None:
                    s[f"anchor_{v}"], s[f"run_{v}"] = None, 0
                else:
                    same = s[f"anchor_{v}"] is not None and abs(x - s[f"anchor_{v}"]) <= cfg.tolerance[v]
                    s[f"run_{v}"] = s[f"run_{v}"] + 1 if same else 1
                    s[f"anchor_{v}"] = s[f"anchor_{v}"] if same else x
                    limit = float(int(cfg.repeats[v] * cfg.saturated_factor)) if v == "rh_pct" and x >= cfg.saturated_rh else float(cfg.repeats[v])
                    if s[f"run_{v}"] >= limit:
                        p = min(1.0, 0.6 + 0.2 * (s[f"run_{v}"] / limit - 1))
                        persist, score = max(persist, p), max(score, p)
                    s[f"last_{v}"] = x
            out[f"rule_{v}"] = score
        record = 0.0 if gap is None or gap > 0 else 0.7 if gap == 0 else 0.8
        if cfg.interval_minutes and gap is not None and gap > 1.5 * cfg.interval_minutes * 6e7:
            record = max(record, min(1.0, 0.3 + 0.07 * (round(gap / (cfg.interval_minutes * 6e7)) - 1)))
        s["clock"] = us if s["clock"] is None else max(us, s["clock"])
        return out | {"rule_score": max(record, *out.values()), "has_hard": any_hard, "persistence_score": persist}


def score_stream(obs: DataFrame, cfg: Rules = DEFAULT.rules) -> DataFrame:
    """obs (batch or stream, with seq) -> layer-1 scores. A row whose three values and timestamp are null resets its
    station."""
    names = [c.strip().split()[0] for c in OUTPUT.split(",")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        station = Station(state.get if state.exists else None, cfg)
        batch = pd.concat(list(frames), ignore_index=True).sort_values("seq", kind="stable")
        rows = []
        for r in batch.itertuples(index=False):
            if pd.isna(r.us):
                station = Station(None, cfg)
                continue
            got = station.step(int(r.us), {v: None if pd.isna(getattr(r, v)) else float(getattr(r, v)) for v in VARIABLES})
            rows.append({"station_id": key[0], "seq": r.seq} | got)
            if len(rows) == FRAME:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)
        state.update(station.values())

    keyed = obs.select("station_id", "seq", micros(F.col("timestamp")).alias("us"), *VARIABLES)
    return keyed.groupBy("station_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now into a Parquet sink, and read the sink."""
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def audit_stream(records: DataFrame, store, checkpoint: str):
    """Write a stream of records to the audit table; replayed batches change nothing, as the first write of a key wins."""
    return records.writeStream.foreachBatch(lambda batch, _: store.append(batch)).option("checkpointLocation", checkpoint).start()
