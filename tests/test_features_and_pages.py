"""Features against plain loops; reading order and windows against the running rules."""

import math
import random
import statistics

import numpy as np
import pytest

from wellframe.operators import features, pages


def test_base_features(spark):
    r = random.Random(3)
    wells, channels = ["a", "b", "c"], ["torque", "dxc", "mw"]
    series = [(w, float(md) + r.random(), *[None if r.random() < 0.3 else r.random() * 10 for _ in channels]) for w in wells[:2] for md in range(900, 3100, r.choice([3, 7]))]
    stations = [(w, md, md * 0.9, inc) for w in wells for md, inc in ((0.0, 0.0), (1000.0, 20.0), (2500.0, 89.9))]
    tops = [("a", "F1", 950.0), ("a", "F2", 1500.0), ("b", "F1", 1000.0)]
    sections = [("a", 0.0, 1200.0, 12.25), ("a", 1200.0, 2000.0, 8.5)]
    grid = [(w, float(md)) for w in wells for md in (0, 940, 1000, 1200, 1999, 2010, 2500, 3000)]
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = features.base(s(grid, "wellbore_id string, md_from_m double"), s(series, "wellbore_id string, md_m double, torque double, dxc double, mw double"), s(stations, "wellbore_id string, md_m double, tvd_m double, inc_deg double"), s(tops, "wellbore_id string, formation string, top_md_m double"), s(sections, "wellbore_id string, md_from_m double, md_to_m double, hole_size_in double"), ["torque", "dxc"], ["mw"]).collect()
    assert len(out) == len(grid)
    for x in out:
        w, md0 = x.wellbore_id, x.md_from_m
        rows = sorted(y for y in series if y[0] == w)
        st = [y for y in stations if y[0] == w and y[1] <= md0][-1]
        assert x.tvd_m == pytest.approx(st[2] + (md0 - st[1]) * max(0.1, math.cos(math.radians(st[3]))))
        top = [y for y in tops if y[0] == w and y[2] <= md0]
        assert (x.formation, x.top_md_m) == (top[-1][1:] if top else (None, None))
        assert x.hole_size_in == next((y[3] for y in sections if y[0] == w and y[1] <= md0 < y[2]), None)
        assert x.mw == next((y[4] for y in reversed(rows) if y[1] <= md0 and y[4] is not None), None)
        for i, c in ((2, "torque"), (3, "dxc")):
            p = [(y[1], y[i]) for y in rows if md0 - 30 < y[1] <= md0 and y[i] is not None]
            if len(p) < 3:
                assert x[f"{c}_mean_30m"] is None and x[f"{c}_slope_30m"] is None
            else:
                assert x[f"{c}_mean_30m"] == pytest.approx(np.mean([v for _, v in p]))
                assert x[f"{c}_slope_30m"] == pytest.approx(np.polyfit(*zip(*p, strict=True), 1)[0] * 30, abs=1e-6)
    assert any(x.torque_slope_30m for x in out)


def test_medians_without_one_well(spark):
    r = random.Random(5)
    for n in (1, 2, 3, 4, 5, 8, 9):
        gaps = [(f"w{i}", f, float(r.randrange(5))) for f in ("F1", "F2") for i in range(n)]
        own, every = features.pool_medians(spark.createDataFrame(gaps, "wellbore_id string, formation string, gap double"))
        got = {(x.wellbore_id, x.formation): x["median"] for x in own.collect()}
        for w, f, _ in gaps:
            others = [g for v, q, g in gaps if q == f and v != w]
            assert got[w, f] == (statistics.median(others) if others else None)
        assert {x.formation: x["median"] for x in every.collect()} == {f: statistics.median(g for _, q, g in gaps if q == f) for f in ("F1", "F2")}


def test_depth_in_formation(spark):
    tops = spark.createDataFrame([("a", "F1", 100.0), ("a", "F2", 300.0), ("b", "F1", 0.0), ("b", "F2", 400.0), ("c", "F2", 10.0), ("c", "F1", 20.0)], "wellbore_id string, formation string, top_md_m double")
    order = spark.createDataFrame([("F1", 1), ("F2", 2)], "formation string, strat_order int")
    rows = spark.createDataFrame([(w, md, "F1", 100.0) for w in "abc" for md in (50.0, 200.0, 900.0)] + [("a", 500.0, "F2", 300.0), ("a", 5.0, None, None)], "wellbore_id string, md_from_m double, formation string, top_md_m double")
    got = {(x.wellbore_id, x.md_from_m): (x.strat_order, x.relative_depth) for x in features.with_depth_in_formation(rows, tops, order).collect()}
    assert got == {("a", 50.0): (1, 0.0), ("a", 200.0): (1, 0.25), ("a", 900.0): (1, 1.0), ("b", 50.0): (1, 0.0), ("b", 200.0): (1, 0.5), ("b", 900.0): (1, 1.0), ("c", 50.0): (1, 0.0), ("c", 200.0): (1, pytest.approx(1 / 3)), ("c", 900.0): (1, 1.0), ("a", 500.0): (2, None), ("a", 5.0): (None, None)}


def test_reading_order(spark):
    r = random.Random(7)
    boxes = [(r.choice([1, 2, None]), r.choice(["a", "b", "c", None]), r.random(), r.choice([0.1, 0.101, 0.12, 0.5, 0.505, r.random()]), 0.1, r.choice([0.01, 0.02, 0.03])) for _ in range(150)]
    out = pages.reading_order(spark.createDataFrame(boxes, "page int, text string, x double, y double, w double, h double"), "page").collect()
    for page in (1, 2, None):
        lines = []
        for _, t, x, y, _, h in sorted((b for b in boxes if b[0] == page), key=lambda b: (b[3] + b[5] / 2, b[2], b[1] or "")):
            at = y + h / 2
            if lines and abs(at - lines[-1][0]) < 0.5 * max(h, lines[-1][1]):
                lines[-1][2].append((x, t or ""))
            else:
                lines.append((at, h, [(x, t or "")]))
        assert [x.text for x in sorted((x for x in out if x.page == page), key=lambda x: x.line)] == [" ".join(t for _, t in sorted(i)) for _, _, i in lines]


def test_page_windows(spark):
    r = random.Random(8)
    rows = [(d, p, r.choice(["", " \n", None, "x" * r.randrange(1, 90), "long " * 60, " padded \n"])) for d in (1, 2, 3) for p in range(300)]
    df = spark.createDataFrame(rows, "doc int, page int, text string").repartition(5)
    got = {}
    for x in sorted(pages.page_windows(df, "doc", "page", "text", 200).collect(), key=lambda x: x.window):
        got.setdefault(x.doc, []).append(x.text)
    for d in (1, 2, 3):
        windows, current, size = [], [], 0
        for _, p, t in rows:
            if _ != d or not (t or "").strip():
                continue
            block = f"=== PAGE {p} ===\n{t.strip()}"
            if current and size + len(block) + 2 > 200:
                windows.append("\n\n".join(current))
                current, size = [], 0
            current.append(block)
            size += len(block) + 2
        assert got[d] == [*windows, "\n\n".join(current)]
    assert pages.page_windows(df.limit(0), "doc", "page", "text").collect() == []


def test_log_windows(spark):
    head = "Daily drilling report: well {}, wellbore 1, date 2024-01-0{}"
    rows = [
        (1, 1, head.format("A-1", 1) + "\n00:00–06:00 | 100 m | drilling\nnoise\n06:00–--:-- | 120 m | trip"),
        (1, 2, head.format("?", 2) + "\r\n--:--–01:00 | x\n02:00 - 03:00 | no"),
        (2, 1, "nothing here"),
        (3, 1, head.format("B", 3)),
        (4, 1, None),
    ]
    windows, names = pages.log_windows(spark.createDataFrame(rows, "doc int, page int, text string"), "doc", "page", "text", 75)
    got = sorted((x.doc, x.window, x.text) for x in windows.collect())
    assert got == [
        (1, 0, "=== REPORT DATE 2024-01-01 ===\n[1] 00:00–06:00 | 100 m | drilling"),
        (1, 1, "[1] 06:00–--:-- | 120 m | trip\n=== REPORT DATE 2024-01-02 ==="),
        (1, 2, "[2] --:--–01:00 | x"),
    ]
    assert {x.doc: x.well_name for x in names.collect()} == {1: "A-1", 2: "unknown", 3: "B", 4: "unknown"}
