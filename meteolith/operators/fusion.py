"""Layer 5: one probability, band and disposition from the layers' evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meteolith.config import DEFAULT, VARIABLES, Fusion
from meteolith.functions.physics import clamp
from meteolith.functions.text import band


def probability(cfg: Fusion = DEFAULT.fusion, *, recon: bool = True, multi: bool = True, spatial: bool = True) -> tuple[Column, Column]:
    """(probability, damped) with some layers left out. Rules and persistence always vote."""
    w = cfg.weights
    num = w["rule"] * clamp(F.col("rule_score")) + w["persistence"] * clamp(F.col("persistence_score"))
    den = F.lit(w["rule"] + w["persistence"])
    for name, use in (("recon", recon), ("multi", multi), ("spatial", spatial)):
        if use:
            num = num + F.when(F.col(f"{name}_available"), w[name] * clamp(F.col(f"{name}_p"))).otherwise(0.0)
            den = den + F.when(F.col(f"{name}_available"), w[name]).otherwise(0.0)
    p = num / den
    p = F.when(F.col("has_hard"), F.greatest(p, F.lit(cfg.hard_floor))).otherwise(p)
    damped = F.lit(False)
    if recon and multi and spatial:
        damped = F.col("recon_available") & (F.col("recon_p") >= 0.5) & F.col("spatial_available") & F.col("multi_available") & (F.col("spatial_p") < cfg.agree) & (F.col("multi_p") < cfg.coherence)
        p = F.when(damped, p * (1 - cfg.damping)).otherwise(p)
    return clamp(p), damped


def dominant() -> Column:
    """Variable with the largest rule score plus share of reconstruction error; the first of equals; null if all 0."""
    total = sum((F.coalesce(F.col(f"recon_error_{v}"), F.lit(0.0)) for v in VARIABLES[1:]), F.coalesce(F.col(f"recon_error_{VARIABLES[0]}"), F.lit(0.0)))
    s = [F.col(f"rule_{v}") + F.coalesce(F.col(f"recon_error_{v}") / F.when(total > 0, total), F.lit(0.0)) for v in VARIABLES]
    return F.when(F.greatest(*s) <= 0, None).when((s[0] >= s[1]) & (s[0] >= s[2]), VARIABLES[0]).when(s[1] >= s[2], VARIABLES[1]).otherwise(VARIABLES[2])


def fuse(df: DataFrame, cfg: Fusion = DEFAULT.fusion) -> DataFrame:
    """probability, damped, band, is_anomaly, dominant_variable."""
    p, damped = probability(cfg)
    df = df.withColumn("damped", damped).withColumn("probability", p)
    return df.withColumn("band", band(F.col("probability"), cfg)).withColumn("is_anomaly", F.col("probability") >= cfg.decision).withColumn("dominant_variable", dominant())


def ablation(df: DataFrame, cfg: Fusion = DEFAULT.fusion) -> DataFrame:
    """p_rules, p_recon, p_multi, p_full: the ladder of layers in one pass."""
    steps = {"p_rules": (False, False, False), "p_recon": (True, False, False), "p_multi": (True, True, False), "p_full": (True, True, True)}
    return df.withColumns({n: probability(cfg, recon=r, multi=m, spatial=s)[0] for n, (r, m, s) in steps.items()})


def status(corrected: Column) -> Column:
    """Needs temp_c ... rh_pct, is_anomaly, complete, band."""
    absent = F.col("temp_c").isNull() & F.col("pressure_hpa").isNull() & F.col("rh_pct").isNull()
    return F.when(absent, "MISSING").when(F.col("is_anomaly"), F.when(corrected, "ESTIMATED").otherwise("QUARANTINED")).when(~F.col("complete"), "MISSING").when(F.col("band") == "WATCH", "SUSPECT").otherwise("PASS")
