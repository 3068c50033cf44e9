"""Risk bands, severities, fusion and confidence as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the risk model.
BAND_EDGES = [(20.0, "low"), (40.0, "moderate"), (60.0, "elevated"), (80.0, "high")]
TOP_BAND = "critical"
SEVERITY_OF_BAND = {"moderate": "info", "elevated": "watch", "high": "warning", "critical": "critical"}
BAND_RANK = {"low": 0, "moderate": 1, "elevated": 2, "high": 3, "critical": 4}
BAND_LOWER_BOUND = {"low": 0.0, "moderate": 20.0, "elevated": 40.0, "high": 60.0, "critical": 80.0}
SEVERITY_RANK = {"info": 0, "watch": 1, "warning": 2, "critical": 3}
LAYER_WEIGHTS = (0.5, 0.3, 0.2)
L1_DECAY_M, L1_PRIOR_HIT, L1_PRIOR_WEIGHT = 3000.0, 0.5, 1.0
L1_REL_TOL, L1_MD_TOL_M, EPS = 0.10, 25.0, 1e-9
PENDING_WEIGHT = 0.5
INTERVAL_M, LOOKAHEAD_MIN_M, LOOKAHEAD_MAX_M = 25.0, 50.0, 300.0
DEDUP_ZONE_M, RETRIGGER_HYSTERESIS, PAST_ZONE_M = 50.0, 15.0, 25.0
STALE_S, LOST_S = 10.0, 30.0
ESCALATE_S = {"warning": 900.0, "critical": 300.0}
CLOSED_STATES = ("resolved", "feedback")
RISK_OF_EVENT = {
    "loss_partial": "losses",
    "loss_total": "losses",
    "kick": "kick",
    "stuck_pipe_diff": "stuck_pipe",
    "stuck_pipe_mech": "stuck_pipe",
    "tight_hole": "stuck_pipe",
    "pack_off": "stuck_pipe",
    "hole_instability": "stuck_pipe",
    "torque_spike": "torque",
    "cement_failure": "cementing",
}
TOP_SOURCE_RANK = {"actual": 1, "predicted": 2, "prognosis": 3}


def lookup(col: Column, table: dict, default=None) -> Column:
    """A fixed mapping as a CASE chain; ``default`` for other values."""
    out = reduce(lambda acc, kv: acc.when(col == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(col == next(iter(table)), F.lit(next(iter(table.values())))))
    return out.otherwise(F.lit(default))


def band(score: Column) -> Column:
    """Upper edges belong to the lower band; null stays null."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for edge, name in BAND_EDGES:
        out = out.when(score <= edge, F.lit(name))
    return out.otherwise(F.lit(TOP_BAND))


def severity(band_col: Column) -> Column:
    return lookup(band_col, SEVERITY_OF_BAND)


def fuse(layers: list[Column], floor: Column | None = None, weights: tuple[float, ...] = LAYER_WEIGHTS) -> Column:
    """Weighted mean over the layers that are not null, as 0 to 100; a floor can only raise it; null without a layer."""
    top = reduce(lambda a, b: a + b, [F.coalesce(v * w, F.lit(0.0)) for v, w in zip(layers, weights, strict=True)])
    total = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in zip(layers, weights, strict=True)])
    score = F.when(total > 0, 100.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), top / F.when(total > 0, total))))
    return score if floor is None else F.when(score.isNotNull(), F.greatest(score, F.coalesce(floor, F.lit(0.0))))


def confidence(n_offsets: Column, mean_conf: Column) -> Column:
    """high: three offsets and 0.8; medium: two offsets or 0.6; else low."""
    return F.when((n_offsets >= 3) & (F.coalesce(mean_conf, F.lit(-1.0)) >= 0.8), "high").when((n_offsets >= 2) | (F.coalesce(mean_conf, F.lit(-1.0)) >= 0.6), "medium").otherwise("low")


def cap_severity(sev: Column, conf: Column, detector_fired: Column) -> Column:
    """Low confidence without a detector allows ``watch`` at most."""
    return F.when((conf == "low") & ~detector_fired & sev.isin("warning", "critical"), F.lit("watch")).otherwise(sev)


def dedup_key(wellbore: Column, risk: Column, zone_from: Column) -> Column:
    zone = (F.floor(zone_from / DEDUP_ZONE_M) * int(DEDUP_ZONE_M)).cast("bigint")
    return F.concat_ws(":", wellbore.cast("string"), risk, zone.cast("string"))


def retrigger(fired: Column, new_band: Column, new_score: Column, old_score: Column) -> Column:
    """Whether a resolved alert may come again: a detector fired, the band rose, or the score is well within the old band."""
    old_band = F.coalesce(band(old_score), F.lit("low"))
    return fired | (lookup(new_band, BAND_RANK, 0) > lookup(old_band, BAND_RANK, 0)) | (new_score >= lookup(old_band, BAND_LOWER_BOUND, 0.0) + RETRIGGER_HYSTERESIS)


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def normalised(observed: Column, normal: float, threshold: float) -> Column:
    return clip01((observed - normal) / (threshold - normal))


# Fixed states and severities.
UNACKNOWLEDGED = ["generated", "sent", "viewed", "escalated"]
LOUD = ["warning", "critical"]


def unacknowledged(state: Column) -> Column:
    return F.coalesce(state.isin(UNACKNOWLEDGED), F.lit(False))


def loud(severity: Column) -> Column:
    return F.coalesce(severity.isin(LOUD), F.lit(False))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 below ``low``, 1 above ``high``, linear between; a step where they are equal."""
    return clip01((x - low) / max(high - low, 1e-9))


def calibrated(x: Column, knots: list[float], values: list[float]) -> Column:
    """The piecewise linear curve through the knots, in order, flat beyond the first and the last."""
    out = F.when(x.isNull(), None).when(x <= knots[0], values[0])
    for x0, x1, y0, y1 in zip(knots, knots[1:], values, values[1:]):
        out = out.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0) if x1 > x0 else F.lit(y1))
    return out.otherwise(values[-1])
