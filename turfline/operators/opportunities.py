"""Which opportunities suit each volunteer best: a spatial join with a score and hard constraints."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.operators.campaign_desk import EARTH_KM, haversine_km
from turfline.operators.ordering import first_in_group
from turfline.operators.skew import salted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Kilometres of a degree of latitude, rounded down, so that a cell is never narrower than the reach.
KM_PER_DEGREE = 111.0
#: Volunteers of one cell and jurisdiction that a single task compares with the opportunities there.
VOLUNTEERS_PER_TASK = 20_000
#: Volunteers compared at once, and the most opportunities they are compared with at once.
BLOCK = 256
CHUNK = 4096
_FURTHEST_LATITUDE = 85.0
_V = ["volunteer_id", "lat", "lng", "hours"]
_O = ["opportunity_id", "o_lat", "o_lng", "valid_per_hour", "need_per_day", "setup_cost", "risk"]


def _cell(lat: Column, lng: Column, lat_step: float, lng_step: float) -> list[Column]:
    return [F.floor(lat / lat_step).alias("_row"), F.floor(lng / lng_step).alias("_column")]


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [pc.cast(table[n], pa.float64()).to_numpy() for n in names]


def _unknown(table: pa.Table, *names: str) -> np.ndarray:
    return np.logical_or.reduce([pc.is_null(table[n]).to_numpy() for n in names])


def _met_in_cell(k: int, reach_km: float, cost_per_km: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The pairs of one cell that can be among a volunteer's first ``k``.

    Volunteers of like hours go together through the opportunities by the best score these can have at no distance, and stop when
    nothing ahead can reach anybody's k-th.  What is so near to the reach or to the k-th score that rounding decides is kept: the caller ranks.
    """
    near = 1e-6 * (1 + reach_km)

    def first(who, what, score, sure, rank, n, slack):
        """Which of these pairs stay, and the k-th score of each of the ``n`` volunteers."""
        order = np.lexsort((rank[what], -score, who))
        who, what, score, sure = who[order], what[order], score[order], sure[order]
        count = np.cumsum(sure)
        start = np.searchsorted(who, np.arange(n))
        place = count - np.concatenate(([0], count))[start][who]  # how many sure ones of this volunteer up to here
        least = np.full(n, -np.inf)
        full = sure & (place == k)
        least[who[full]] = score[full]
        exact = np.where(np.isfinite(least), least - slack, np.inf)[who]
        stay = ~sure & (score >= (least - slack)[who]) | (place <= k) | (score >= exact)
        return who[stay], what[stay], score[stay], sure[stay], least

    def met(v: pa.Table, o: pa.Table) -> pa.Table:
        lat, lng, hours = _numbers(v, "lat", "lng", "hours")
        o_lat, o_lng, rate, need, setup, risk = _numbers(o, *_O[1:])
        v_null, o_null = _unknown(v, "hours"), _unknown(o, *_O[3:]) if len(o) else np.zeros(0, bool)
        trained = pc.fill_null(v["trained"], False).to_numpy()
        training = pc.fill_null(o["needs_training"], False).to_numpy()
        rank = np.empty(len(o), np.int64)
        rank[pc.sort_indices(o, sort_keys=[("opportunity_id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(o))
        lat, lng, o_lat, o_lng = (np.radians(x) for x in (lat, lng, o_lat, o_lng))
        picked_v, picked_o = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        with np.errstate(all="ignore"):
            gain, loss = rate * need, setup + risk
            most = lambda x: np.max(np.abs(x[np.isfinite(x)]), initial=0.0)
            slack = 1e-9 + 1e-12 * (most(hours) * most(gain) + most(loss) + abs(cost_per_km) * reach_km)
            by_hours = np.argsort(hours, kind="stable")
            for at in range(0, len(by_hours) if len(o) else 0, BLOCK):
                rows = by_hours[at:at + BLOCK]
                low, high = hours[rows].min(), hours[rows].max()
                bound = np.maximum(low * gain, high * gain) - loss + max(0.0, -cost_per_km) * (reach_km + near) + slack
                bound[np.isnan(bound)] = np.inf
                bound[o_null] = -np.inf
                ahead = np.argsort(-bound, kind="stable")
                who, what, score, sure = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
                least, begin, size = np.full(len(rows), -np.inf), 0, min(128, CHUNK)
                while begin < len(ahead) and not (bound[ahead[begin]] < least - slack).all():
                    some = ahead[begin:begin + size]
                    begin, size = begin + size, min(CHUNK, size * 2)
                    a, b = lat[rows][:, None], o_lat[some][None, :]
                    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((o_lng[some][None, :] - lng[rows][:, None]) / 2) ** 2
                    km = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
                    fits = (km <= reach_km + near) & (trained[rows][:, None] | ~training[some][None, :])
                    worth = hours[rows][:, None] * gain[some][None, :] - cost_per_km * km - loss[some][None, :]
                    worth[np.isnan(worth)] = np.inf
                    worth[v_null[rows][:, None] | o_null[some][None, :]] = -np.inf
                    i, j = np.nonzero(fits & (worth >= (least - slack)[:, None]))
                    who, what, score, sure, least = first(
                        np.concatenate((who, i)), np.concatenate((what, some[j])), np.concatenate((score, worth[i, j])),
                        np.concatenate((sure, km[i, j] <= reach_km - near)), rank, len(rows), slack)
                picked_v.append(rows[who])
                picked_o.append(what)
        mine, theirs = v.select(_V).take(np.concatenate(picked_v)), o.select(_O).take(np.concatenate(picked_o))
        return pa.table(mine.columns + theirs.columns, names=_V + _O)

    return met


def best_opportunities(volunteers: DataFrame, opportunities: DataFrame, k: int = 5, reach_km: float = 40.0, cost_per_km: float = 0.1) -> DataFrame:
    """(volunteer_id, rank, opportunity_id, km, expected_valid, score) of every volunteer's ``k`` best opportunities.

    ``volunteers``: volunteer_id, lat, lng, hours, trained, jurisdictions (where they may circulate).  ``opportunities``: opportunity_id, jurisdiction, lat, lng,
    valid_per_hour, need_per_day, setup_cost, risk, capacity, needs_training.

    score = expected valid x need per day - travel - set-up - risk.  Only opportunities in reach, in a jurisdiction of the volunteer, with room, with a
    need, and, where training is asked for, for trained volunteers.  Ties go to the smaller opportunity.  Rows without a place are left out.

    Both sides meet in cells at least as wide as the reach: a volunteer is in one, an opportunity in its own and the eight around it, so all pairs in reach meet
    once.  Cells are as wide in longitude as the northernmost or southernmost row needs; nothing is joined across the date line.  The jurisdiction is
    part of the key and crowded cells are salted.  A cell hands on only the pairs that can be among a volunteer's first ``k``, so neither all pairs nor
    either side as a whole is ever held or sent anywhere.
    """
    here = lambda df: df.where("lat IS NOT NULL AND lng IS NOT NULL")
    far = here(volunteers).agg(F.max(F.abs("lat"))).first()[0] or 0.0
    lat_step = reach_km / KM_PER_DEGREE
    lng_step = lat_step / math.cos(math.radians(min(_FURTHEST_LATITUDE, far + lat_step)))
    v = here(volunteers).select("volunteer_id", "lat", "lng", "hours", "trained", F.explode(F.array_distinct("jurisdictions")).alias("jurisdiction"),
                                *_cell(F.col("lat"), F.col("lng"), lat_step, lng_step)).where("jurisdiction IS NOT NULL")
    near = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    o = here(opportunities).where("capacity > 0 AND need_per_day > 0 AND jurisdiction IS NOT NULL").select(
        "opportunity_id", "jurisdiction", F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), "valid_per_hour", "need_per_day", "setup_cost", "risk", "needs_training",
        *_cell(F.col("lat"), F.col("lng"), lat_step, lng_step))
    o = o.withColumn("_dr", F.explode(near)).withColumn("_dc", F.explode(near))
    o = o.withColumn("_row", F.col("_row") + F.col("_dr")).withColumn("_column", F.col("_column") + F.col("_dc")).drop("_dr", "_dc")
    key = ["_row", "_column", "jurisdiction"]
    v, o = salted(v, o, key, VOLUNTEERS_PER_TASK)
    shape = T.StructType([v.schema[c] for c in _V] + [o.schema[c] for c in _O])
    met = _met_in_cell(k, reach_km, cost_per_km)
    pairs = v.groupBy(*key, "_salt").cogroup(o.groupBy(*key, "_salt")).applyInArrow(met, shape)
    pairs = pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng"))).where(F.col("km") <= reach_km)
    expected = F.col("valid_per_hour") * F.col("hours")
    scored = pairs.withColumn("expected_valid", expected).withColumn(
        "score", expected * F.col("need_per_day") - F.lit(cost_per_km) * F.col("km") - F.col("setup_cost") - F.col("risk"))
    return first_in_group(scored, ["volunteer_id"], [F.desc("score"), F.col("opportunity_id")], k).select(
        "volunteer_id", "rank", "opportunity_id", "km", "expected_valid", "score")
