"""Shapes, activity codes, and the validation of extracted items with its quarantine."""

import json

from pyspark.sql import functions as F

from wellframe.functions import activity, shapes
from wellframe.operators import extraction


def test_shapes(spark):
    shape = {"id": "uuid", "n": "int", "x": "number?", "b": "boolean?", "when": "iso?", "o": "object?", "a": "array?", "s": "string?", "kind": ["one", "two", None], "must": ["y", "z"]}
    good = {"id": "0a0b0c0d-0000-1111-2222-abcdefabcdef", "n": 3, "must": "y"}
    cases = [
        (json.dumps(good), []),
        (json.dumps({**good, "n": 3.0, "x": 1.5, "b": False, "when": "2024-01-02T03:04:05Z", "o": {}, "a": [], "s": "", "kind": "two"}), []),
        (json.dumps({**good, "kind": None, "x": None}), []),
        (json.dumps({"id": "nope", "n": 1.5, "must": "q"}), ["id: expected uuid, got nope", "n: expected int, got 1.5", "must: q is not one of y|z"]),
        (json.dumps({"x": "1", "b": 0, "when": "today", "o": [], "a": {}, "s": 1, "kind": "three"}), ["id: missing (uuid)", "n: missing (int)", "x: expected number, got 1", "b: expected boolean, got 0", "when: expected iso, got today", "o: expected object, got []", "a: expected array, got {}", "s: expected string, got 1", "kind: three is not one of one|two", "must: missing (expected one of y|z)"]),
        ("[1]", ["payload is not an object"]),
        ("3", ["payload is not an object"]),
        ("{", ["payload is not an object"]),
        (None, ["payload is not an object"]),
    ]
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(cases)], "i int, j string")
    got = [r.p for r in df.withColumn("p", shapes.problems(F.try_parse_json("j"), shape)).orderBy("i").collect()]
    assert got == [p for _, p in cases]


def test_activity_codes(spark):
    cases = {
        "Fishing for junk while drilling": 19, "Observed KICK, shut-in well": 27, "flowcheck ok": 27, "reamed tight spot": 3, "streaming data": None, "back-reaming": 3, "WOC": 13,
        "waiting on cement": 13, "testing the BOPs": 15, "bop test": 15, "run 9 casing": None, "running 9-5/8 casing": 12, "casing running tools": 12, "RIH": 6, "tripping out": 6, "wireline logs": 11,
        "logs run": 11, "drilled 12 m": 2, "drillers": None, "circulated": 5, "losses 5 m3": 24, "losses, circulated": 5, "loss of returns": 24, "lost circulation": 5, "pumped LCM": 24, "": None,
    }
    cases["run 9 casing"] = 12
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    assert {r.t: r.c for r in df.withColumn("c", activity.code(df.t)).collect()} == {**cases, None: None}


def test_items_and_quarantine(spark):
    page = "Lost 15 bbl at 6,562 ft in the Tipam. Casing shoe 1,900 m. Drilled ahead 06:00."
    payload = {
        "well_header": {"td_md_m": 3000.0, "field": "Dikom"},
        "events": [
            {"event_type": "mud_loss", "md_from_m": 2000.1, "volume_m3": 15, "formation": " TIPAM ", "page": 1, "snippet": "lost 15 bbl at 6,562 ft", "confidence": 0.9, "event_date": "2020-05-01"},
            {"event_type": "nonsense", "confidence": "high"},
            {"event_type": "kick", "md_from_m": 4000, "md_to_m": 3900, "formation": "Nowhere", "page": 1, "snippet": "not there at all", "confidence": 0.9, "event_date": "1890-01-01"},
        ],
        "formation_tops": {"formation": "Tipam"},
        "time_log": [{"description": "Drilled ahead", "page": 1, "snippet": "Drilled ahead 06:00", "confidence": 0.95}, 7],
        "mud_records": None,
    }
    kinds = [k for k in extraction.KINDS["events"]["event_type"]]
    if "mud_loss" not in kinds:
        payload["events"][0]["event_type"] = kinds[0]
    if "kick" not in kinds:
        payload["events"][2]["event_type"] = kinds[0]
    docs = spark.createDataFrame([(1, json.dumps(payload)), (2, "{broken"), (3, None), (4, "{}")], "doc int, payload string")
    pages = spark.createDataFrame([(1, 1, page, 0.99)], "doc int, page int, text string, ocr_confidence double")
    depths = spark.createDataFrame([(1, 3000.0)], "doc int, td_md_m double")
    formations = spark.createDataFrame([("tipam", "Tipam Sandstone")], "alias string, formation string")
    got = {(r.doc, r.kind, r.item_no): r for r in extraction.validated(docs, "doc", "payload", pages, depths, formations).collect()}
    assert set(got) == {(1, "well_header", 0), (1, "events", 0), (1, "events", 1), (1, "events", 2), (1, "formation_tops", None), (1, "time_log", 0), (1, "time_log", 1), (2, None, None), (3, None, None)}
    first = got[1, "events", 0]
    assert first.accepted and first.failed == [] and first.formation == "Tipam Sandstone" and first.status == "auto_approved" and first.confidence == 0.9
    assert round(first["values"]["volume_m3"], 4) == round(15 * 0.158987, 4) and first.raw == {"md_from_m": "6562 ft", "volume_m3": "15 bbl"}
    bad = got[1, "events", 1]
    assert not bad.accepted and bad.status == "rejected" and len(bad.reasons) == 2 and not bad["values"]
    odd = got[1, "events", 2]
    assert odd.accepted and odd.failed == ["depth out of range", "interval upside down", "date out of range", "unknown formation", "snippet not on page"] and odd.confidence == 0.0 and odd.status == "pending"
    assert got[1, "formation_tops", None].reasons == ["not a list"] and got[2, None, None].reasons == got[3, None, None].reasons == ["payload is not an object"]
    assert got[1, "time_log", 0].iadc_code == 2 and got[1, "time_log", 1].reasons == ["payload is not an object"]
