"""The five read views of the well store, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.operators import aggregates

#: States of alerts that are no longer open, and of fields that wait for a review (fixed values).
CLOSED = ("resolved", "feedback")
PENDING = "pending"


def well_summary(wellbores: DataFrame, wells: DataFrame, events: DataFrame) -> DataFrame:
    """wellbore_id, the columns of its well, event_count, npt_h_total, top_risk_type (most events, ties by name) of every wellbore.

    Rejected events don't count; events without a risk count, but are no top risk.
    """
    e = events.where("review_status <> 'rejected'")
    n = e.groupBy("wellbore_id").agg(F.count("*").alias("event_count"), F.sum("npt_h").alias("npt_h_total"))
    top = aggregates.mode_first(e, ["wellbore_id"], "risk_type", "top_risk_type")
    out = wellbores.select("wellbore_id", "well_id").join(wells, "well_id").join(n, "wellbore_id", "left").join(top, "wellbore_id", "left")
    return out.withColumns({"event_count": F.coalesce("event_count", F.lit(0).cast("long")), "npt_h_total": F.coalesce("npt_h_total", F.lit(0.0))})


def npt_by_formation(events: DataFrame, wellbores: DataFrame) -> DataFrame:
    """formation, risk_type, event_count, npt_h_total, well_count of events that are not rejected and have a risk; a null formation is one."""
    e = events.where("review_status <> 'rejected' and risk_type is not null").join(wellbores.select("wellbore_id", "well_id"), "wellbore_id")
    return e.groupBy("formation", "risk_type").agg(F.count("*").alias("event_count"), F.coalesce(F.sum("npt_h"), F.lit(0.0)).alias("npt_h_total"), F.countDistinct("well_id").alias("well_count"))


def open_alerts(alerts: DataFrame, wellbores: DataFrame, wells: DataFrame) -> DataFrame:
    """Alerts that are neither resolved nor rated, with the name of their well."""
    names = wellbores.select("wellbore_id", "well_id").join(wells.select("well_id", F.col("name").alias("well_name")), "well_id").drop("well_id")
    return alerts.where(~F.col("state").isin(*CLOSED)).join(names, "wellbore_id").select(*alerts.columns, "well_name")


def review_queue(fields: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Pending fields with their document's title and type, and the image of their page if it has one."""
    docs = documents.select("doc_id", F.col("title").alias("doc_title"), "doc_type")
    images = pages.select("doc_id", F.col("page_no").alias("page"), "image_path")
    return fields.where(F.col("review_status") == PENDING).join(docs, "doc_id").join(images, ["doc_id", "page"], "left").select(*fields.columns, "doc_title", "doc_type", "image_path")


def trajectory_geojson(stations: DataFrame, wellbores: DataFrame, wells: DataFrame) -> DataFrame:
    """wellbore_id, well_name, geojson: a line through the stations (wellbore_id, md_m, lon, lat) by depth, without heights."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("md_m", "lon", "lat"))), lambda p: F.array(p.lon, p.lat))
    lines = stations.groupBy("wellbore_id").agg(F.to_json(F.struct(F.lit("LineString").alias("type"), points.alias("coordinates"))).alias("geojson"))
    names = wellbores.select("wellbore_id", "well_id").join(wells.select("well_id", F.col("name").alias("well_name")), "well_id")
    return lines.join(names, "wellbore_id").select("wellbore_id", "well_name", "geojson")
