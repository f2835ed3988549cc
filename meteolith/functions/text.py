"""Parsing and rendering column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meteolith.config import DEFAULT, Fusion, Health

#: Spellings of an absent number, and the accepted timestamp formats in order.
BLANKS = ("", "na", "nan", "null", "none", "m", "-")
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH", "yyyyMMddHHmm", "yyyyMMdd", "yyyy-MM-dd")
#: An ISO time that names its zone.
OFFSET = r"(Z|z|[+-][0-9]{2}:?[0-9]{2})$"
#: What to do about each fault class.
ACTIONS = {
    "none": "No action required.",
    "spike": "Inspect connections and shielding; discard the isolated reading.",
    "drop": "Check power supply and cabling for intermittent loss.",
    "stuck": "Service the sensor; the reading is frozen.",
    "drift": "Schedule recalibration; the sensor is drifting.",
    "step": "Check for a recent relocation or a calibration change.",
    "noise": "Check grounding and interference on the signal line.",
    "missing": "Check communications and the data logger.",
    "corrupt": "Check the encoder and the transmission path.",
    "multivariate": "Cross-check temperature, pressure and humidity sensors together.",
    "spatial": "Compare with neighbouring stations and verify siting.",
    "genuine_extreme": "Genuine weather; keep the data and alert forecasters.",
}
DEFAULT_ACTION = "Review manually."


def parse_float(c: Column) -> Column:
    """Number of a text; blanks, unparseable texts and NaN are null, sentinels stay."""
    s = F.trim(c)
    v = F.when(F.lower(s).isin(*BLANKS), None).otherwise(s.try_cast("double"))
    return F.when(F.isnan(v), None).otherwise(v)


def parse_timestamp(c: Column) -> Column:
    """UTC timestamp without zone of a text; the first format that fits, else ISO 8601 with an offset, else null."""
    s = F.replace(F.trim(c), F.lit("/"), F.lit("-"))
    plain = [F.try_to_timestamp(s, F.lit(f)) for f in FORMATS]
    iso_ = s.try_cast("timestamp")
    there = F.when(s.rlike(OFFSET), F.to_utc_timestamp(iso_, F.current_timezone())).otherwise(iso_)  # UTC in any session
    return F.coalesce(*plain, there).cast("timestamp_ntz")


def _ladder(x: Column, steps: tuple, top: str) -> Column:
    out = F.lit(top)
    for limit, name in reversed(steps):
        out = F.when(x < limit, name).otherwise(out)
    return out


def band(p: Column, cfg: Fusion = DEFAULT.fusion) -> Column:
    return _ladder(p, cfg.bands, cfg.top_band)


def health_status(score: Column, cfg: Health = DEFAULT.health) -> Column:
    return _ladder(score, cfg.bands, "HEALTHY")


def severity(fault_class: Column, p: Column) -> Column:
    return F.when(fault_class == "none", "NONE").when(p >= 0.9, "CRITICAL").when(p >= 0.7, "HIGH").when(p >= 0.5, "MODERATE").otherwise("LOW")


def action(fault_class: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, fault_class), F.lit(DEFAULT_ACTION))


def explanation(band_: Column, p: Column, fault_class: Column, confidence: Column, label: Column, damped: Column, variable: Column) -> Column:
    """BAND p=0.00[ | class (NN%)[ via label]][ [weather-damped]][ @ variable]"""
    via = F.when(label.isNotNull(), F.concat(F.lit(" via "), label)).otherwise("")
    named = F.when(fault_class.isNotNull() & (fault_class != "none"), F.concat(F.lit(" | "), fault_class, F.format_string(" (%.0f%%)", confidence * 100), via)).otherwise("")
    return F.concat(
        band_, F.format_string(" p=%.2f", p), named, F.when(damped, " [weather-damped]").otherwise(""), F.when(variable.isNotNull(), F.concat(F.lit(" @ "), variable)).otherwise("")
    )


def iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
