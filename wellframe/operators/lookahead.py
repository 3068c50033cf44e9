"""The hit rates of look-ahead intervals over all neighbours within a radius, summed up where the pairs are made.

``wells.l1_scores`` takes any list of neighbours, one row for each pair, and joins their events.  Within a radius there are far more
pairs than wells, and far more hits than pairs: here a pair looks its hits up in running sums of the neighbour's events by depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellframe.functions import risk
from wellframe.operators import blocks

#: Events of one well and formation that are one row.
EVENTS = 4096
#: What is summed up for each risk: hits, pending ones, those with a confidence, and these confidences in whole units and a rest in
#: units of its own, so that no order of sums and no difference of them rounds.
SUMS, UNIT, REST = 5, 2.0**-26, 2.0**-53
#: The best hits' weights, then those sums.
SUMMED = ("top", "hits", "np", "nc", "units", "rest")


class Events:
    """The events of one well and formation by depth, with running sums for each risk."""

    def __init__(self, rel: np.ndarray, md: np.ndarray, code: np.ndarray, pending: np.ndarray, confidence: np.ndarray, n_risks: int):
        known = ~np.isnan(confidence)
        units = np.rint(np.where(known, confidence, 0.0) / UNIT)
        each = np.stack([np.ones(len(code)), pending, known, units, (np.where(known, confidence, 0.0) - units * UNIT) / REST], axis=1)
        table = np.zeros((len(code), n_risks, SUMS))
        table[np.arange(len(code)), code] = each
        has_rel, has_md = ~np.isnan(rel), ~np.isnan(md)
        self.by_rel = self._sorted(rel, table, has_rel)
        self.by_md, self.other_md = self._sorted(md, table, has_md), self._sorted(md, table, has_md & ~has_rel)

    @staticmethod
    def _sorted(at: np.ndarray, table: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, table = at[use], table[use]
        order = np.argsort(at, kind="stable")
        return at[order], np.concatenate([np.zeros((1, *table.shape[1:])), np.cumsum(table[order], axis=0)])

    @staticmethod
    def _within(by: tuple[np.ndarray, np.ndarray], at: np.ndarray, tolerance: float) -> np.ndarray:
        return by[1][np.searchsorted(by[0], at + tolerance, "right")] - by[1][np.searchsorted(by[0], at - tolerance, "left")]

    def hits(self, rel: np.ndarray, md: np.ndarray) -> np.ndarray:
        """The sums of what ``wells.hit`` takes for intervals at these relative depths (NaN: none) and equivalent depths."""
        unknown = np.isnan(rel)[:, None, None]
        near_rel = self._within(self.by_rel, rel, risk.L1_REL_TOL + risk.EPS)
        near = lambda by: self._within(by, md, risk.L1_MD_TOL_M + risk.EPS)
        return np.where(unknown, near(self.by_md), near_rel + near(self.other_md))


def rates_within(intervals: DataFrame, points: DataFrame, tops: DataFrame, events: DataFrame, radius_m: float, scale: float = 1.0) -> DataFrame:
    """interval_id, risk_type, l1, n_offsets, mean_conf, n_unreviewed: the rates of ``wells.l1_scores``, without reasons, by all neighbours within a radius.

    intervals: interval_id (a wellbore), formation, relative_depth, md_mid_m, top_md_m.  points: wellbore_id, lat, lon.  tops:
    wellbore_id, formation, top_md_m.  A neighbour counts if it has the interval's formation, at its surface distance times ``scale``.
    """
    risks = sorted(set(risk.RISK_OF_EVENT.values()))
    place = points.select(F.col("wellbore_id").alias("id"), "lat", "lon")
    left = place.join(intervals.select(F.col("interval_id").alias("id"), "formation", F.col("relative_depth").alias("rel"), (F.col("md_mid_m") - F.col("top_md_m")).alias("below")), "id")
    w = Window.partitionBy("wellbore_id", "formation")
    code = F.array_position(F.array(*map(F.lit, risks)), F.col("risk_type")).cast("int") - 1
    e = events.where("review_status <> 'rejected'").where(F.col("risk_type").isin(risks) & F.col("formation").isNotNull())
    e = e.withColumn("part", F.floor((F.row_number().over(w.orderBy("event_id")) - 1) / EVENTS).cast("int"))
    e = e.select("wellbore_id", "formation", "part", F.struct(F.col("relative_depth").cast("double").alias("rel"), F.col("md_from_m").cast("double").alias("md"), code.alias("code"), (F.col("review_status") == "pending").cast("double").alias("pending"), F.col("confidence").cast("double").alias("conf")).alias("e"))
    e = e.groupBy(F.col("wellbore_id").alias("id"), "formation", "part").agg(F.collect_list("e").alias("events"))
    right = place.join(tops.select(F.col("wellbore_id").alias("id"), "formation", F.col("top_md_m").cast("double").alias("top")), "id")
    right = right.join(e, ["id", "formation"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    kind = left.schema["id"].dataType.simpleString()
    schema = f"interval_id {kind}, sw double, n bigint, " + ", ".join(f"{c}{i} double" for i in range(len(risks)) for c in SUMMED)
    part = blocks.near(left, right, ["formation"], radius_m, _summed(radius_m, scale, len(risks)), schema, ["id", "part"])
    total = part.groupBy("interval_id").agg(*[F.sum(c).alias(c) for c in part.columns[1:]])
    each = F.array(*[F.struct(F.lit(r).alias("risk_type"), *[F.col(f"{c}{i}").alias(c) for c in SUMMED]) for i, r in enumerate(risks)])
    out = intervals.select("interval_id").join(total, "interval_id", "left").select("interval_id", "sw", "n", F.inline(each))
    l1 = F.when(F.coalesce("sw", F.lit(0.0)) > 0, (F.coalesce("top", F.lit(0.0)) + risk.L1_PRIOR_HIT) / (F.col("sw") + risk.L1_PRIOR_WEIGHT))
    return out.select("interval_id", "risk_type", l1.alias("l1"), F.coalesce("n", F.lit(0)).alias("n_offsets"), ((F.col("units") * UNIT + F.col("rest") * REST) / F.nullif("nc", F.lit(0.0))).alias("mean_conf"), F.coalesce("np", F.lit(0.0)).cast("bigint").alias("n_unreviewed"))


def _summed(radius_m: float, scale: float, n_risks: int):
    """A function for the pairs of a block: the sums of its intervals over the neighbours that stream past."""

    def block(held: blocks.Held, rights: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rel, below = blocks.numbers(held.rows, "l_rel"), blocks.numbers(held.rows, "l_below")
        (classes, of) = np.unique(np.stack([rel, below], axis=1), axis=0, return_inverse=True)
        of = of.reshape(-1)
        n, sw = np.zeros(len(rel), np.int64), np.zeros(len(rel))
        sums = np.zeros((len(rel), n_risks, SUMS + 1))
        open_: tuple | None = None  # the neighbour whose events go on: its id, its pairs, their weights, its hits by class

        def close() -> None:
            _, i, weight, hits = open_
            if hits is None:
                return
            top = np.where(hits[..., 0] > hits[..., 1], 1.0, np.where(hits[..., 0] > 0, risk.PENDING_WEIGHT, 0.0))
            some = np.flatnonzero(hits[..., 0].any(axis=0))  # risks that it has
            mine = of[i]
            for r in some:
                sums[i, r, 0] += weight * top[mine, r]
                sums[i, r, 1:] += hits[mine, r]

        for right in rights:
            for some, j, i, d in held.near(right, radius_m):
                weights = np.exp(-(d * scale) / risk.L1_DECAY_M)
                ids, parts, top, lists = some.column("r_id"), some.column("r_part"), blocks.numbers(some, "r_top"), some.column("r_events")
                starts = np.searchsorted(j, np.arange(some.num_rows + 1))
                for row in range(some.num_rows):
                    mine = slice(starts[row], starts[row + 1])
                    if parts[row].as_py() == 0:
                        if open_:
                            close()
                        open_ = (ids[row], i[mine], weights[mine], None)
                        n[i[mine]] += 1
                        sw[i[mine]] += weights[mine]
                    if starts[row] == starts[row + 1] or not lists[row].is_valid:
                        continue
                    e = lists[row].values
                    get = lambda c: e.field(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    known = Events(get("rel"), get("md"), get("code"), get("pending"), get("conf"), n_risks)
                    hits = known.hits(classes[:, 0], top[row] + classes[:, 1])
                    open_ = (*open_[:3], hits if open_[3] is None else open_[3] + hits)
        if open_:
            close()
        at = np.flatnonzero(n)
        columns = [held.rows.column("l_id").take(pa.array(at)), pa.array(sw[at]), pa.array(n[at])]
        columns += [pa.array(np.ascontiguousarray(sums[at, r, c])) for r in range(n_risks) for c in range(SUMS + 1)]
        names = ["interval_id", "sw", "n", *[f"{c}{r}" for r in range(n_risks) for c in SUMMED]]
        yield pa.record_batch(columns, names)

    return block
