"""Hand-computed values for geometry, tops, rates, fusion, alerts, parsers, sinks and streams."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellframe.functions import geo, risk, text, units
from wellframe.operators import aggregates, commands, dedup, joins, restql, wells, windows
from wellframe.sources import files
from wellframe.sources.sinks import Table, latest_per_key
from wellframe.streaming import alerts, detectors


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_geodesic_and_back(spark):
    p = geo.project(F.lit(27.35), F.lit(95.3), F.lit(90.0), F.lit(2000.0))
    d = one(spark, geo.geodesic_m(F.lit(27.35), F.lit(95.3), p.lat, p.lon))
    assert abs(d - 2000) < 1e-3
    # Flinders Peak to Buninyong, a published example.
    d = one(spark, geo.geodesic_m(F.lit(-37.95103341666667), F.lit(144.42486788888888), F.lit(-37.65282113888889), F.lit(143.92649552777777)))
    assert abs(d - 54972.271) < 0.01
    assert one(spark, geo.geodesic_m(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0
    assert abs(one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - math.radians(1) * geo.EARTH_RADIUS_M) < 1e-6


def test_minimum_curvature(spark):
    df = spark.createDataFrame([("w", 0.0, 0.0, 0.0), ("w", 1000.0, 0.0, 0.0), ("w", 1100.0, 90.0, 0.0)], "k string, md_m double, inc_deg double, azi_deg double")
    rows = windows.minimum_curvature(df, "k").orderBy("md_m").collect()
    r = 100 / (math.pi / 2)  # a quarter circle of 100 m
    assert rows[1].tvd_m == pytest.approx(1000) and rows[2].tvd_m == pytest.approx(1000 + r) and rows[2].north_m == pytest.approx(r)
    assert rows[2].dls_deg_per_30m == pytest.approx(27.0)


WELLS = [("w0", "A", 95.30, 27.35, "drilling"), ("w1", "B", 95.3202, 27.35, "completed"), ("w2", "C", 95.30, 27.53, "completed")]
STATIONS = [("b0", 0.0, 0.0, 0.0, 0.0, 0.0), ("b0", 1000.0, 995.0, 0.0, 100.0, 0.0), ("b0", 2500.0, 2400.0, 0.0, 500.0, 0.0)]


@pytest.fixture(scope="module")
def field(spark):
    w = spark.createDataFrame(WELLS, "well_id string, name string, lon double, lat double, status string")
    b = spark.createDataFrame([("b0", "w0", True), ("b1", "w1", True), ("b2", "w2", True)], "wellbore_id string, well_id string, is_primary boolean")
    s = spark.createDataFrame(STATIONS, "wellbore_id string, md_m double, tvd_m double, north_m double, east_m double, inc_deg double")
    tops = [("b0", "Girujan", "actual", 1000.0), ("b0", "Tipam", "predicted", 1500.0), ("b0", "Tipam", "actual", 1800.0), ("b0", "Barail", "prognosis", 2600.0), ("b1", "Tipam", "actual", 1900.0), ("b2", "Tipam", "actual", 2100.0)]
    t = spark.createDataFrame(tops, "wellbore_id string, formation string, source string, top_md_m double")
    ev = [("e1", "b1", "losses", "Tipam", 1900.0, 1950.0, "approved", 0.9, 5.0), ("e2", "b1", "losses", "Tipam", 1910.0, 1950.0, "rejected", 0.9, 100.0), ("e3", "b1", None, None, 100.0, 101.0, "pending", None, 2.0)]
    e = spark.createDataFrame(ev, "event_id string, wellbore_id string, risk_type string, formation string, md_from_m double, md_to_m double, review_status string, confidence double, npt_h double")
    return w, b, s, t, e


def test_positions_clamp_and_vertical(spark, field):
    w, b, s, _, _ = field
    probes = spark.createDataFrame([("b0", 1750.0), ("b0", 9000.0), ("b0", -5.0), ("b1", 700.0)], "wellbore_id string, md_m double")
    rows = {(r.wellbore_id, r.md_m): r for r in wells.positions(probes, s, wells.wellbore_points(w, b)).collect()}
    assert rows["b0", 1750.0].tvd_m == pytest.approx((995 + 2400) / 2)
    assert rows["b0", 9000.0].tvd_m == 2400 and rows["b0", -5.0].tvd_m == 0
    assert rows["b1", 700.0].tvd_m == 700 and rows["b1", 700.0].lon == pytest.approx(95.3202)
    assert rows["b0", 1750.0].lon > 95.30 and rows["b0", 1750.0].lat == pytest.approx(27.35, abs=1e-5)


def test_formation_takes_source_before_depth(spark, field):
    t = field[3]
    probes = spark.createDataFrame([("b0", 1600.0), ("b0", 2000.0), ("b0", 500.0), ("b0", 2700.0)], "wellbore_id string, md_m double")
    rows = {r.md_m: r for r in wells.formations(probes, t).collect()}
    assert rows[1600.0].formation == "Girujan"  # the predicted Tipam at 1500 gives way to the actual one
    assert rows[2000.0].formation == "Tipam" and rows[2000.0].relative_depth == pytest.approx(200 / 800)
    assert rows[500.0].formation is None and rows[2700.0].relative_depth is None


def test_offsets_by_mode(spark, field):
    w, b, s, _, e = field
    probes = spark.createDataFrame([("b0", 2500.0)], "wellbore_id string, md_m double")
    near = wells.offsets_within(w, b, s, probes, e, 5000.0).where("wellbore_id = 'b0'").collect()
    assert [(r.other_id, r.n_events) for r in near] == [("b1", 2)] and near[0].surface_m == pytest.approx(2000, abs=10)
    deep = wells.offsets_within(w, b, s, probes, e, 5000.0, "depth").where("wellbore_id = 'b0'").collect()
    assert deep[0].depth_m == pytest.approx(1500, abs=15)  # 500 m nearer at depth
    far = wells.offsets_within(w, b, s, probes, e, 25_000.0).where("wellbore_id = 'b0'")
    assert [r.other_id for r in far.collect()] == ["b1", "b2"]
    found = wells.events_for_offsets(far, e).collect()
    assert [r.event_id for r in found] == ["e3", "e1"]
    assert [r.event_id for r in wells.events_for_offsets(far, e, ["Tipam"]).collect()] == ["e1"]


def test_predicted_tops(spark):
    off = spark.createDataFrame([("a", "b1", 100.0), ("a", "b2", 200.0), ("a", "b3", 5.0)], "wellbore_id string, other_id string, surface_m double")
    tops = [("b1", "T", "actual", 2000.0), ("b2", "T", "actual", 2100.0), ("b1", "U", "actual", 1990.0), ("b3", "U", "actual", 1990.0), ("b3", "V", "actual", 10.0), ("b1", "V", "predicted", 10.0)]
    t = spark.createDataFrame(tops, "wellbore_id string, formation string, source string, top_md_m double")
    order = spark.createDataFrame([("T", 1), ("U", 2), ("V", 3)], "formation string, strat_order int")
    rows = {r.formation: r for r in wells.predict_tops(off, t, order).collect()}
    assert set(rows) == {"T", "U"}
    assert rows["T"].top_md_m == pytest.approx(2020) and rows["U"].top_md_m == pytest.approx(2025)
    assert rows["U"].uncertainty_m == pytest.approx(10 + 35)


def test_l1_rates(spark):
    iv = spark.createDataFrame([("i", "T", 0.5, 1000.0, 900.0), ("j", "X", None, 0.0, None)], "interval_id string, formation string, relative_depth double, md_mid_m double, top_md_m double")
    off = spark.createDataFrame([("i", "a", 0.0, True, 800.0), ("i", "b", 3000.0, True, None), ("i", "c", 10.0, False, None)], "interval_id string, wellbore_id string, depth_distance_m double, drilled boolean, top_md_m double")
    ev = [("a", "1", "losses", "T", 0.6, 0.0, "approved", 0.8), ("a", "2", "losses", "T", 0.55, 0.0, "pending", 0.6), ("a", "3", "losses", "T", 0.7, 0.0, "approved", 0.8), ("b", "4", "losses", "T", 0.45, 0.0, "rejected", 0.8), ("a", "5", "kick", "T", None, 925.0, "approved", None)]
    e = spark.createDataFrame(ev, "wellbore_id string, event_id string, risk_type string, formation string, relative_depth double, md_from_m double, review_status string, confidence double")
    rows = {(r.interval_id, r.risk_type): r for r in wells.l1_scores(iv, off, e).collect()}
    sw = 1 + math.exp(-1)
    r = rows["i", "losses"]
    assert r.l1 == pytest.approx((1 + 0.5) / (sw + 1)) and r.n_offsets == 2 and r.mean_conf == pytest.approx(0.7) and r.n_unreviewed == 1 and r.reasons == ["1", "2"]
    assert rows["i", "kick"].l1 == pytest.approx((1 + 0.5) / (sw + 1)) and rows["i", "torque"].l1 == pytest.approx(0.5 / (sw + 1))
    assert rows["j", "losses"].l1 is None and rows["j", "losses"].n_offsets == 0


@pytest.mark.parametrize(("score", "band"), [(0.0, "low"), (20.0, "low"), (20.01, "moderate"), (40.0, "moderate"), (60.0, "elevated"), (80.0, "high"), (80.5, "critical")])
def test_band_edges(spark, score, band):
    assert one(spark, risk.band(F.lit(score))) == band


def test_fusion(spark):
    n = F.lit(None).cast("double")
    assert one(spark, risk.fuse([F.lit(0.4), n, F.lit(1.0)])) == pytest.approx(100 * (0.2 + 0.2) / 0.7)
    assert one(spark, risk.fuse([n, n, n])) is None
    assert one(spark, risk.fuse([F.lit(0.1), n, n], F.lit(65.0))) == 65
    assert one(spark, risk.cap_severity(F.lit("critical"), F.lit("low"), F.lit(False))) == "watch"
    cells = wells.lookahead(spark.createDataFrame([("a", 1013.0)], "wellbore_id string, bit_md_m double")).collect()
    assert len(cells) == 12 and cells[0].md_from_m == 1000 and cells[-1].md_to_m == 1300


def test_candidates_and_fold(spark):
    scores = [("a", "kick", 1050.0, 1075.0, 50.0, "high"), ("a", "kick", 1075.0, 1100.0, 50.0, "high"), ("a", "losses", 1025.0, 1050.0, 90.0, "high"), ("a", "torque", 1100.0, 1125.0, 90.0, "low"), ("a", "losses", 1000.0, 1025.0, 10.0, "high")]
    s = spark.createDataFrame(scores, "wellbore_id string, risk_type string, md_from_m double, md_to_m double, fused double, confidence string")
    d = spark.createDataFrame([("a", "losses", "losses", True, 65), ("a", "losses", "total_losses", True, 85), ("a", "kick", "kick", False, 85)], "wellbore_id string, risk_type string, detector string, fired boolean, floor int")
    b = spark.createDataFrame([("a", 1000.0)], "wellbore_id string, bit_md_m double")
    rows = {r.dedup_key: r for r in alerts.candidates(s, d, b).collect()}
    assert rows["a:kick:1050"].md_from_m == 1050 and rows["a:torque:1100"].severity == "watch"
    assert rows["a:losses:950"].score == 85 and rows["a:losses:950"].severity == "critical" and len(rows) == 3
    ev = [("k", 1, "watch", "elevated", 50.0, False, False), ("k", 2, "info", "moderate", 30.0, False, False), ("k", 3, "warning", "high", 70.0, False, False), ("k", 4, None, None, None, False, True), ("k", 5, "warning", "high", 70.0, False, False), ("k", 6, "warning", "high", 79.0, False, False), ("k", 7, None, None, None, False, True), ("k", 8, "watch", "elevated", 41.0, True, False)]
    e = spark.createDataFrame(ev, "dedup_key string, seq long, severity string, band string, score double, fired boolean, resolve boolean")
    got = [r.action for r in alerts.fold_batch(e).orderBy("seq").collect()]
    assert got == ["created", "updated", "renotified", "resolved", "suppressed", "created", "resolved", "created"]


def test_health_and_tick(spark):
    now = datetime(2024, 1, 1, 12)
    ago = lambda s: now - timedelta(seconds=s)
    st = spark.createDataFrame([("a", "live", ago(10), 1000.0), ("b", "live", ago(11), 1000.0), ("c", "stale", ago(31), 1000.0), ("d", "lost", ago(1), 1000.0), ("e", "stopped", ago(99), 1000.0)], "wellbore_id string, status string, last_sample_at timestamp, bit_md_m double")
    assert {r.wellbore_id: r.status for r in alerts.health(st, now).collect()} == {"a": "live", "b": "stale", "c": "lost", "d": "live", "e": "stopped"}
    al = [(1, "a", "lookahead", "warning", "sent", ago(901), 900.0), (2, "a", "lookahead", "warning", "sent", ago(900), 900.0), (3, "a", "lookahead", "info", "sent", ago(1), 974.0), (4, "a", "lookahead", "info", "viewed", ago(1), 975.0), (5, "d", "lookahead", "info", "sent", ago(1), 900.0), (6, "a", "detector", "critical", "acknowledged", ago(999), 900.0)]
    a = spark.createDataFrame(al, "alert_id int, wellbore_id string, kind string, severity string, state string, sent_at timestamp, zone_md_to_m double")
    got = {r.alert_id: (r.state, r.action) for r in alerts.tick(a, st, now).collect()}
    assert got == {1: ("escalated", "escalated"), 2: ("sent", None), 3: ("resolved", "auto_resolved"), 4: ("viewed", None), 5: ("sent", None), 6: ("resolved", "auto_resolved")}


def samples(n, start=0, **change):
    rng = np.random.default_rng(0)
    base = {"rop_m_h": 12.0, "flow_in_lpm": 2000.0, "flow_out_lpm": 2000.0, "pit_vol_m3": 40.0, "hookload_kn": 1500.0, "torque_knm": 15.0, "dxc": 1.2, "gas_total_pct": 0.5}
    out = []
    for i in range(start, start + n):
        row = {"wellbore_id": "w", "md_m": 1000 + 0.5 * i, "t": 5.0 * i} | {k: v * (1 + 0.002 * rng.normal()) for k, v in base.items()} | change
        out.append(row)
    return out


def fires(rows):
    bank, out = detectors.Bank(), set()
    for r in rows:
        out |= {name for name, fired, _ in bank.update(r) if fired}
    return out, bank


def test_detectors():
    quiet = samples(100)
    assert fires(quiet)[0] == set()
    assert "losses" not in fires(quiet + samples(20, 100, flow_out_lpm=1600.0, pit_vol_m3=40.0))[0]  # 95 s
    assert "losses" in fires(quiet + samples(31, 100, flow_out_lpm=1600.0, pit_vol_m3=40.0))[0]  # 150 s
    assert "total_losses" in fires(quiet + samples(8, 100, flow_out_lpm=500.0))[0]
    assert "kick" in fires(quiet + samples(14, 100, flow_out_lpm=2300.0))[0]
    assert "kick" in fires(quiet + samples(3, 100, pit_vol_m3=42.0))[0]
    assert "torque_spike" in fires(quiet + samples(1, 100, torque_knm=25.0))[0]
    pulls = quiet
    for k in range(3):
        pulls = pulls + samples(3, len(pulls), flow_in_lpm=0.0, hookload_kn=1900.0) + samples(10, len(pulls) + 3)
    assert "stuck_pipe" in fires(pulls)[0]
    slow = samples(500, dxc=1.2, gas_total_pct=0.5) + samples(110, 500, dxc=0.9, gas_total_pct=0.8)
    assert "overpressure_trend" in fires(slow)[0]
    _, bank = fires(quiet)
    assert dict((n, lv) for n, _, lv in bank.update(samples(1, 100, flow_in_lpm=0.0)[0]))["losses"] == 0.0
    assert dict((n, lv) for n, _, lv in bank.update(samples(1, 101, flow_in_lpm=None)[0]))["losses"] is None


def test_stream_equals_batch(spark, tmp_path):
    rows = samples(60) + samples(40, 60, flow_out_lpm=1500.0)
    cols = ["wellbore_id", "md_m", "t", *detectors.CHANNELS]
    schema = ", ".join(f"{c} {'string' if c == 'wellbore_id' else 'double'}" for c in cols)
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], schema)
    for i in range(4):
        df.where(f"md_m >= {1000 + 12.5 * i} and md_m < {1000 + 12.5 * (i + 1)}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = detectors.detect_stream(files.replay(spark, f"{tmp_path}/in", schema))
    q = live.writeStream.format("memory").queryName("live_rules").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.md_m, r.detector, r.fired, None if r.level is None else round(r.level, 9)) for r in df.collect())
    got, want = key(spark.table("live_rules")), key(detectors.detect_batch(df))
    assert [g[:3] for g in got] == [w[:3] for w in want] and any(g[2] for g in got)


def test_parsers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("MD (ft),Inclination (deg),Azimuth (deg)\n2000,20,95\n0,0,0\n1000,10,90\n1500,,\n")
    assert [round(r.md_m, 3) for r in files.survey_table(files.read_csv(spark, f"{tmp_path}/s.csv")).collect()] == [0, 304.8, 609.6]
    (tmp_path / "t.csv").write_text('Formation,Top MD (m),Top TVDSS (m)\nTipam Sst,"2,310.5",2261.0\nBarail,2850,2790\n,2900,2840\nKopili,,\n')
    assert [(r.formation, r.top_md_m) for r in files.tops_table(files.read_csv(spark, f"{tmp_path}/t.csv")).collect()] == [("Tipam Sst", 2310.5), ("Barail", 2850.0)]
    with pytest.raises(ValueError):
        files.survey_table(spark.createDataFrame([(1,)], "md int"))
    las = "~V\n VERS. 2.0 : x\n~W\n NULL.  -999.25 : null\n~C\n DEPT.FT : depth\n ROP .M/H : rate\n~A\n 1000 12.5\n 1001 -999.25\n"
    (tmp_path / "a.las").write_text(las)
    rows = files.read_las(spark, f"{tmp_path}/a.las").collect()
    assert [(round(r.depth_m, 2), r.mnemonic, r.value, r.unit) for r in rows] == [(304.8, "ROP", 12.5, "M/H"), (305.1, "ROP", None, "M/H")]
    xml = '<logs xmlns="urn:x"><log><nameWellbore>W</nameWellbore><nullValue>-999.25</nullValue><logData><mnemonicList>DEPT,ROP</mnemonicList><unitList>m,m/h</unitList><data>1,2</data><data>2,-999.25</data><data>3,</data><data>4</data></logData></log></logs>'
    (tmp_path / "l.xml").write_text(xml)
    assert [(r.row_no, r.mnemonic, r.value) for r in files.read_logs(spark, f"{tmp_path}/l.xml").collect()] == [(0, "DEPT", 1.0), (0, "ROP", 2.0), (1, "DEPT", 2.0), (1, "ROP", None), (2, "DEPT", 3.0), (2, "ROP", None)]
    st = lambda md, rest="": f'<trajectoryStation><md uom="ft">{md}</md>{rest}</trajectoryStation>'
    full = '<incl uom="dega">1</incl><azi uom="dega">2</azi>'
    (tmp_path / "t.xml").write_text(f'<trajectorys xmlns="urn:x"><trajectory><nameWellbore>W</nameWellbore>{st(2000, full)}{st(1000, full)}{st(5)}</trajectory></trajectorys>')
    assert [round(r.md_m, 1) for r in files.read_trajectories(spark, f"{tmp_path}/t.xml").collect()] == [304.8, 609.6]
    act = "<drillReport><nameWellbore>W</nameWellbore><activity><dTimStart>2024-01-01T00:00:00Z</dTimStart><proprietaryCode>2</proprietaryCode><comments>c</comments></activity></drillReport>"
    (tmp_path / "r.xml").write_text(f'<drillReports xmlns="urn:x">{act.replace("<drillReport>", "<drillReport>")}</drillReports>')
    assert [(r.code, r.ended) for r in files.read_reports(spark, f"{tmp_path}/r.xml").collect()] == [("2", None)]


def test_sinks(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "k int, v string, n int")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, n int")
    got = lambda: sorted(tuple(r) for r in t.read().collect())
    assert got() == []
    t.append(rows((1, "a", 1), (2, "b", 1)))
    t.upsert(rows((2, "c", 2), (3, "d", 2)), ["k"])
    assert got() == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    t.insert_absent(rows((3, "x", 9), (4, "y", 9)), ["k"])
    t.purge(F.col("n") == 1)
    t.update({"v": F.upper("v")}, F.col("k") == 4)
    t.replace_parent(rows((2, "p", 5), (2, "q", 5)), "k")
    assert got() == [(2, "p", 5), (2, "q", 5), (3, "d", 2), (4, "Y", 9)]
    latest_per_key(["k"], "n", t)(rows((3, "old", 6), (3, "new", 7)), 0)
    assert (3, "new", 7) in got() and (3, "old", 6) not in got()


def test_commands(spark):
    a = spark.createDataFrame([(1, "w", "critical", "acknowledged"), (2, "w", "info", "sent"), (3, "x", "info", "sent")], "alert_id int, wellbore_id string, severity string, state string")
    c = [(1, "resolve", "rig_engineer", ["w"], None), (2, "dismiss", "rig_engineer", ["w"], "no"), (3, "ack", "rig_engineer", ["w"], None), (9, "ack", "admin", [], None)]
    got = {r.alert_id: r.result for r in commands.apply_commands(a, spark.createDataFrame(c, "alert_id int, action string, role string, assigned array<string>, reason string")).collect()}
    assert got == {1: "bad_state", 2: "bad_reason", 3: "forbidden", 9: "not_found"}
    s = spark.createDataFrame([("w", 5.0), ("w", 15.0), ("v", 99.0)], "wellbore_id string, md_m double")
    bit = spark.createDataFrame([("w", 10.0)], "wellbore_id string, bit_md_m double")
    assert commands.visible(s, "depth_series", "admin", stream_state=bit).count() == 2
    assert commands.visible(a, "alerts", "rig_engineer", assigned=["x"]).count() == 1


def test_small_operators(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 2), ("a", 8.0, 3), ("a", 30.0, 4)], "k string, v double, o int")
    assert [r.o for r in dedup.first_kept(df, ["k"], "v", ["o"], 5.0).orderBy("o").collect()] == [1, 3, 4]
    assert restql.query(df, {"v": "not.in.(1,4)", "order": "o.desc", "limit": "1", "select": "o"}).first().o == 4
    assert one(spark, text.uuid5("6ba7b8109dad11d180b400c04fd430c8", F.lit("python.org"))) == "886313e1-3b8a-5372-9b90-0c9aee199e5d"
    assert text.pack("a" * 50 + "\n" + "b" * 50, 60, 10) and max(map(len, text.pack("word " * 2000))) <= 1200
    q = one(spark, units.quantities(F.lit("lost 30 bbl/h at 1200.5 m")))
    assert [(x.value, x.unit) for x in q] == [(30.0, "bbl/h"), (1200.5, "m")]
    near = joins.radius(spark.createDataFrame([(1, 0.0, 179.9999), (2, 0.0, -179.9999)], "id int, lat double, lon double"), spark.createDataFrame([(1, 0.0, 179.9999), (2, 0.0, -179.9999)], "id int, lat double, lon double"), 100.0)
    assert near.count() == 2
    ap = spark.createDataFrame([("x", 0.9, 1), ("x", 0.5, 0), ("x", 0.5, 1)], "g string, s double, y int")
    assert aggregates.average_precision(ap, ["g"], "s", "y").first().average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
