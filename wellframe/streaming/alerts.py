"""Alert lifecycle: candidates, one open alert for each key, and the periodic tick."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wellframe.functions import risk

ACTIONS = "dedup_key string, seq bigint, action string, severity string, score double"


def candidates(scores: DataFrame, detectors: DataFrame, bits: DataFrame) -> DataFrame:
    """Look-ahead cells of band moderate or more, 50 to 300 m ahead, and one candidate for each risk with a fired rule.

    scores: wellbore_id, risk_type, md_from_m, md_to_m, fused, confidence.  detectors: wellbore_id, risk_type, detector,
    fired, floor.  bits: wellbore_id, bit_md_m.  Of cells that share a key the higher score stays, the shallower on a tie.
    """
    s = scores.join(bits, "wellbore_id").where("fused is not null").withColumn("band", risk.band(F.col("fused")))
    ahead = F.col("md_from_m") - F.col("bit_md_m")
    look = s.where((ahead >= risk.LOOKAHEAD_MIN_M) & (ahead <= risk.LOOKAHEAD_MAX_M) & (F.col("band") != "low"))
    look = look.withColumn("severity", risk.cap_severity(risk.severity(F.col("band")), F.col("confidence"), F.lit(False)))
    look = look.withColumn("dedup_key", risk.dedup_key(F.col("wellbore_id"), F.col("risk_type"), F.col("md_from_m")))
    best = look.groupBy("dedup_key").agg(F.max_by(F.struct("wellbore_id", "risk_type", "severity", "band", F.col("fused").alias("score"), "md_from_m", "md_to_m"), F.struct("fused", -F.col("md_from_m"))).alias("c"))
    look = best.select("dedup_key", "c.*").withColumn("fired", F.lit(False))
    fired = detectors.where("fired").groupBy("wellbore_id", "risk_type").agg(F.max("floor").cast("double").alias("floor"))
    at = s.where("md_from_m <= bit_md_m and bit_md_m < md_to_m").select("wellbore_id", "risk_type", "fused")
    det = fired.join(bits, "wellbore_id").join(at, ["wellbore_id", "risk_type"], "left")
    det = det.withColumn("score", F.greatest("floor", F.coalesce("fused", F.lit(0.0)))).withColumn("band", risk.band(F.col("score"))).withColumn("severity", risk.severity(F.col("band")))
    det = det.withColumn("md_from_m", F.col("bit_md_m") - 25).withColumn("md_to_m", F.col("bit_md_m") + 25)
    det = det.withColumn("dedup_key", risk.dedup_key(F.col("wellbore_id"), F.col("risk_type"), F.col("md_from_m"))).withColumn("fired", F.lit(True))
    cols = ["dedup_key", "wellbore_id", "risk_type", "severity", "band", "score", "md_from_m", "md_to_m", "fired"]
    return look.select(cols).unionByName(det.select(cols))


def step(alert: dict | None, c: dict) -> tuple[dict, str]:
    """One candidate against the latest alert of its key: created, renotified, updated or suppressed."""
    if alert and alert["state"] not in risk.CLOSED_STATES:
        up = risk.SEVERITY_RANK[c["severity"]] > risk.SEVERITY_RANK[alert["severity"]]
        new = alert | {"score": c["score"]} | ({"severity": c["severity"], "state": "sent"} if up else {})
        return new, "renotified" if up else "updated"
    if alert and not c["fired"]:
        old = next((b for e, b in risk.BAND_EDGES if alert["score"] <= e), risk.TOP_BAND)
        if risk.BAND_RANK[c["band"]] <= risk.BAND_RANK[old] and c["score"] < risk.BAND_LOWER_BOUND[old] + risk.RETRIGGER_HYSTERESIS:
            return alert, "suppressed"
    return {"state": "sent", "severity": c["severity"], "score": c["score"]}, "created"


def _one(key: str | None, alert: dict | None, c: dict) -> tuple[dict | None, tuple]:
    """The alert of a key after one candidate, and what it did."""
    if c.get("resolve"):
        alert = alert and alert | {"state": "resolved"}
        return alert, (key, c["seq"], "resolved" if alert else "none", alert and alert["severity"], alert and alert["score"])
    alert, action = step(alert, c)
    return alert, (key, c["seq"], action, alert["severity"], alert["score"])


_NAMES = [c.split()[0] for c in ACTIONS.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64()]


def fold_batch(events: DataFrame) -> DataFrame:
    """What each candidate (dedup_key, seq, severity, band, score, fired, resolve) did, key by key in order of seq.

    Keys are many and short: each task runs over its sorted rows once and begins anew where the key changes, so that it holds
    a batch and one alert.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, alert, begun = None, None, False
        for b in batches:
            out = []
            for c in b.to_pylist():
                if not begun or c["dedup_key"] != key:
                    key, alert, begun = c["dedup_key"], None, True
                alert, row = _one(key, alert, c)
                out.append(row)
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)], _NAMES)

    return events.repartition("dedup_key").sortWithinPartitions("dedup_key", "seq").mapInArrow(run, ACTIONS)


def fold_stream(events: DataFrame) -> DataFrame:
    """The same on a stream; one state for each key, so that two open alerts of a key cannot be."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alert, rows = json.loads(state.get[0]) if state.exists else None, []
        for c in pd.concat(list(parts)).sort_values("seq", kind="stable").to_dict("records"):
            alert, row = _one(key[0], alert, c)
            rows.append(row)
        if alert:
            state.update((json.dumps(alert),))
        yield pd.DataFrame(rows, columns=_NAMES)

    return events.groupBy("dedup_key").applyInPandasWithState(run, ACTIONS, "alert string", "append", GroupStateTimeout.NoTimeout)


def health(streams: DataFrame, now) -> DataFrame:
    """wellbore_id, old and new status by the age of the last sample; stopped streams and unknown ages stay; strict limits."""
    age = (F.unix_micros(F.lit(now)) - F.unix_micros("last_sample_at")) / 1e6
    live = F.col("status").isin("live", "stale", "lost") & age.isNotNull()
    new = F.when(~live, F.col("status")).when(age > risk.LOST_S, "lost").when(age > risk.STALE_S, F.when(F.col("status") == "live", "stale").otherwise(F.col("status"))).otherwise("live")
    return streams.select("wellbore_id", F.col("status").alias("old_status"), new.alias("status"), age.alias("age_s"))


def tick(alerts: DataFrame, streams: DataFrame, now) -> DataFrame:
    """alert_id, state, action of one round: escalation first, then automatic resolution of what the bit has passed.

    Never resolved: while the stream is lost, without a zone, escalated, or a warning or critical that isn't acknowledged.
    """
    sent = (F.unix_micros(F.lit(now)) - F.unix_micros("sent_at")) / 1e6
    limit = risk.lookup(F.col("severity"), risk.ESCALATE_S)
    up = F.col("state").isin("sent", "viewed") & (sent > limit)
    a = alerts.join(streams.select("wellbore_id", "bit_md_m", F.col("status").alias("stream")), "wellbore_id", "left").withColumn("_up", F.coalesce(up, F.lit(False)))
    state = F.when(F.col("_up"), "escalated").otherwise(F.col("state"))
    may = (F.col("kind") != "system") & (state.isin("acknowledged") | (state.isin("sent", "viewed") & F.col("severity").isin("info", "watch")))
    past = (F.col("stream") != "lost") & (F.col("bit_md_m") > F.col("zone_md_to_m") + risk.PAST_ZONE_M)
    done = F.coalesce(may & past, F.lit(False))
    return a.select("alert_id", F.when(done, "resolved").otherwise(state).alias("state"), F.when(done, "auto_resolved").when(F.col("_up"), "escalated").alias("action"))
