"""State transitions of alerts and reviews as joins of a command log with a transition table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOUD, _QUIET = ("warning", "critical"), ("info", "watch")
_ENGINEERS = ("rig_engineer", "rtoc_engineer", "admin")
# (action, roles, severities, states it is allowed from, new state).
TRANSITIONS = [
    ("view", ("rig_engineer", "rtoc_engineer", "office_engineer", "reviewer", "admin"), _QUIET + _LOUD, ("sent",), "viewed"),
    ("ack", _ENGINEERS, _QUIET + _LOUD, ("sent", "viewed", "escalated"), "acknowledged"),
    ("resolve", ("rtoc_engineer", "admin"), _LOUD, ("acknowledged",), "resolved"),
    ("resolve", _ENGINEERS, _QUIET, ("sent", "viewed", "acknowledged"), "resolved"),
    ("dismiss", _ENGINEERS, _QUIET, ("sent", "viewed"), "resolved"),
    ("rate", ("rig_engineer", "rtoc_engineer"), _QUIET + _LOUD, ("resolved",), "feedback"),
]


def transition_table(spark) -> DataFrame:
    """action, role, severity, state, new_state: a fixed dimension."""
    rows = [(a, r, s, f, to) for a, roles, sevs, states, to in TRANSITIONS for r in roles for s in sevs for f in states]
    return spark.createDataFrame(rows, "action string, role string, severity string, state string, new_state string")


def allowed(alert_wellbore: Column, role: Column, assigned: Column) -> Column:
    """Rig engineers act on their own wellbores only."""
    return (role != "rig_engineer") | F.array_contains(assigned, alert_wellbore)


def apply_commands(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """One command for each alert at most: alert_id, action, state, new_state, result.

    alerts: alert_id, wellbore_id, severity, state.  commands: alert_id, action, role, assigned, reason.
    result: ok, or not_found, forbidden, bad_reason (a dismissal needs five characters), bad_state.
    """
    table = F.broadcast(transition_table(alerts.sparkSession))
    rows = commands.join(alerts.withColumn("_found", F.lit(True)), "alert_id", "left").join(table, ["action", "role", "severity", "state"], "left")
    short = (F.col("action") == "dismiss") & (F.length(F.trim(F.coalesce("reason", F.lit("")))) < 5)
    may = allowed(F.col("wellbore_id"), F.col("role"), F.col("assigned"))
    result = F.when(F.col("_found").isNull(), "not_found").when(~may, "forbidden").when(short, "bad_reason").when(F.col("new_state").isNull(), "bad_state").otherwise("ok")
    return rows.select("alert_id", "action", "state", F.when(result == "ok", F.col("new_state")).otherwise(F.col("state")).alias("new_state"), result.alias("result"))


def audit(results: DataFrame) -> DataFrame:
    """Append-only log rows of the commands that took effect."""
    return results.where("result = 'ok'").select("alert_id", "action", F.to_json(F.struct("state", "new_state")).alias("details"))


def review_cascade(fields: DataFrame) -> DataFrame:
    """parent_id, status of a document's or event's fields: rejected if all are, else pending while any is, else approved."""
    s = F.col("status")
    return fields.groupBy("parent_id").agg(
        F.when(F.bool_and(s == "rejected"), "rejected").when(F.bool_or(s == "pending"), "pending").when(F.bool_or(s == "edited"), "edited").otherwise("approved").alias("status"), F.count_if(s == "pending").alias("n_pending")
    )


def visible(df: DataFrame, table: str, role: str, user: str | None = None, assigned: list[str] | None = None, stream_state: DataFrame | None = None) -> DataFrame:
    """The rows of a table that a user may see: policies are part of every read."""
    if table == "depth_series" and stream_state is not None:
        bits = stream_state.select("wellbore_id", "bit_md_m")
        return df.join(bits, "wellbore_id", "left").where("bit_md_m is null or md_m <= bit_md_m").drop("bit_md_m")
    if table == "alerts" and role == "rig_engineer":
        return df.where(F.col("wellbore_id").isin(assigned or []))
    if table == "jobs" and role not in ("reviewer", "admin"):
        return df.where(F.col("created_by") == F.lit(user))
    if table == "extracted_fields" and role not in ("reviewer", "admin", "office_engineer"):
        return df.where(F.lit(False))
    if table == "alert_views":
        return df.where(F.col("user_id") == F.lit(user))
    if table == "audit_log" and role != "admin":
        return df.where(F.lit(False))
    return df
