"""Live position of a unit from camera, inertial and magnetic rows, computed on arrays.

Every slice of rows becomes columns: heading and its fast stretches, trailing vibration, dark camera runs, magnetic bearings
around data gaps. Between slices only what is open goes on: the last sample, the vibration window, a turn, a dark run, the
gaps still to be judged and the magnetic samples that judge them. The processor reports how many wheels
and corners had passed; distance and place follow from those by the functions of the batch form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.motion import leg_distance
from ..operators.track import cum_to_xy
from .ordered import Ordered, keyed
from .processors import last_before

IMU, MAG, CAMERA = 0, 1, 2


def trailing_std(t: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, population deviation of each column) over the rows with a time in [t - width, t], up to each row."""
    n = np.arange(1, len(t) + 1) - (low := np.searchsorted(t, t - width))
    z = values - values.mean(0)
    s1, s2 = (np.concatenate([np.zeros((1, z.shape[1])), np.cumsum(x, 0)]) for x in (z, z * z))
    mean, square = ((s[1:] - s[low]) / n[:, None] for s in (s1, s2))
    return n, np.sqrt(np.maximum(square - mean**2, 0.0))


def bearing_step(mags: np.ndarray, gap: tuple[float, float]) -> float | None:
    """Change of the magnetic bearing (degrees) over a gap; the samples' circle gives the centre."""
    t, xy = mags[:, 0], mags[:, 1:]
    centre = np.linalg.lstsq(np.column_stack([2 * xy, np.ones(len(xy))]), (xy**2).sum(1), rcond=None)[0][:2]
    angle = []
    for a, b in ((gap[0] - 3, gap[0] - 0.2), (gap[1] + 0.2, gap[1] + 3)):
        near = xy[(t >= a) & (t <= b)] - centre
        if len(near) <= 3:
            return None
        x, y = np.median(near, axis=0)
        angle.append(np.degrees(np.arctan2(y, x)))
    return float((angle[1] - angle[0] + 180) % 360 - 180)


class Localizer(Ordered):
    """One row for each wheel, corner and recovered corner: the counts after it and whether the unit stood still."""

    key_names = ("line", "container_id")
    out_schema = ("line string, container_id string, t_us bigint, cause string, wheels bigint, corners bigint, wheels_at_corner bigint, "
                  "stopped boolean, t_host_us bigint")

    def __init__(self, d0=0.4, net_thr=0.3, min_rate=15.0, tol=0.6, win_s=0.4, lo=0.025, hi=0.06, min_stop_s=2.0, min_move_s=1.5, gap_s=0.8,
                 mag_step=70.0, mag_keep=600, mag_least=20, settle_s=3.0, apart_s=4.0):
        self.dark, self.net, self.rate, self.tol, self.step, self.keep, self.least = d0, net_thr, min_rate, tol, mag_step, mag_keep, mag_least
        self.band, self.settle, self.apart = (lo, hi), settle_s, apart_s
        self.window, self.stop, self.move, self.gap = (int(round(x * 1e6)) for x in (win_s, min_stop_s, min_move_s, gap_s))

    def start(self):
        return {"imu": None, "heading": 0.0, "turn": None, "shake": [], "side": None, "stopped": False, "run": None, "gaps": [], "mags": [], "turned": [],
                "wheels": 0, "corners": 0, "at_corner": 0}

    def turns(self, state, row, t, yaw):
        """Rows that end a quarter turn with the turn's start (s), and the data gaps that the rows show."""
        t0, y0 = state["imu"] or (None, 0.0)
        before = np.r_[t[0] if t0 is None else t0, t[:-1]]
        dt = t - before
        turned = np.where((dt > 0) & (dt <= 2_000_000), 0.5 * (yaw + np.r_[y0, yaw[:-1]]) * dt / 1e6, 0.0)
        heading = state["heading"] + np.cumsum(turned)
        state["gaps"] += [(a / 1e6, b / 1e6) for a, b in zip(before[dt > self.gap], t[dt > self.gap])]
        fast = np.abs(yaw) > self.rate
        change = np.flatnonzero(np.diff(np.r_[state["turn"] is not None, fast].astype(np.int8)))
        begins, ends = change[fast[change]], change[~fast[change]]
        opened = ([] if state["turn"] is None else [state["turn"]]) + list(zip((t[begins] / 1e6).tolist(), heading[begins].tolist()))
        since, at = (np.array(x, float) for x in (zip(*opened) if opened else ((), ())))
        quarter = np.abs(np.abs(heading[ends] - at[: len(ends)]) - 90.0) <= self.tol * 90.0
        state.update(imu=(int(t[-1]), float(yaw[-1])), heading=float(heading[-1]), turn=opened[-1] if fast[-1] else None)
        return row[ends[quarter]], since[: len(ends)][quarter]

    def standing(self, state, t, shake):
        """Whether the unit stands still after each inertial row: its side of the band must last."""
        old = np.array(state["shake"], float).reshape(-1, 3)
        times, values = np.r_[old[:, 0].astype(np.int64), t], np.concatenate([old[:, 1:], shake])
        n, deviation = (x[len(old):] for x in trailing_std(times, values, self.window))
        tail = times >= times[-1] - self.window
        state["shake"] = np.column_stack([times[tail], values[tail]]).tolist()
        known = np.flatnonzero(n > 2)
        energy = np.hypot(*deviation[known].T)
        side = np.where(energy > self.band[1], 1, np.where(energy < self.band[0], -1, 0))
        last, since = state["side"] or (None, 0)
        new = np.r_[True, side[1:] != side[:-1]][: len(side)]
        if len(side) and side[0] == last:
            new[0] = False
        begin = last_before(new)
        lasted = t[known] - np.where(begin < 0, since, t[known][np.maximum(begin, 0)] if len(known) else 0)
        if len(side):
            state["side"] = (int(side[-1]), int(t[known][-1] - lasted[-1]))
        settled = ((side == -1) & (lasted >= self.stop)) | ((side == 1) & (lasted >= self.move))
        to = np.full(len(t), -1)
        to[known[settled]] = side[settled] == -1
        at = last_before(to >= 0)
        return np.where(at < 0, state["stopped"], to[np.maximum(at, 0)] == 1)

    def passes(self, state, row, t, dark, net):
        """Rows that end a dark run with enough motion, and the time of its darkest frame (us)."""
        inside = dark > self.dark
        open_ = state["run"]
        if open_ is not None:
            row, t, dark, net, inside = np.r_[-1, row], np.r_[open_[0], t], np.r_[open_[1], dark], np.r_[open_[2], net], np.r_[True, inside]
        begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        if not len(begins):
            return np.zeros(0, int), np.zeros(0, np.int64)
        ends = np.flatnonzero(~inside & np.r_[False, inside[:-1]])
        run = np.cumsum(np.isin(np.arange(len(inside)), begins)) - 1
        rows = np.flatnonzero(inside)
        most = np.zeros(len(begins))
        np.maximum.at(most, run[rows], net[rows])
        best = rows[np.lexsort((rows, -dark[rows], run[rows]))]
        best = best[np.r_[True, run[best][1:] != run[best][:-1]]]
        closed = len(ends)
        state["run"] = (int(t[best[-1]]), float(dark[best[-1]]), float(most[-1])) if closed < len(begins) else None
        moved = most[:closed] >= self.net
        return row[ends[moved]], t[best[:closed][moved]]

    def recovered(self, state, row, t, xy, turned):
        """Rows at which a gap is judged to hide a corner; ``turned`` are the (row, time) of the turns in this slice."""
        old = np.array(state["mags"], float).reshape(-1, 3)
        mags = np.concatenate([old, np.column_stack([t, xy])])
        waiting, due = [], []
        for gap in state["gaps"]:
            i = max(np.searchsorted(t, gap[1] + self.settle), self.least - 1 - len(old))
            (due.append((int(i), gap)) if i < len(t) else waiting.append(gap))
        found = []
        for i, gap in sorted(due):
            times = np.array(state["turned"] + [s for r, s in turned if r < row[i]] + [sum(g) / 2 for _, g in found])
            marks = np.array([gap[0], gap[1], sum(gap) / 2])
            if not len(times) or np.abs(times[:, None] - marks).min() >= self.apart:
                upto = len(old) + i + 1
                change = bearing_step(mags[max(0, upto - self.keep) : upto], gap)
                if change is not None and abs(change) > self.step:
                    found.append((int(row[i]), gap))
        state.update(gaps=waiting, mags=mags[-self.keep :].tolist())
        state["turned"] += [sum(g) / 2 for _, g in found]
        return [r for r, _ in found]

    def advance(self, state, rows):
        t, kind = rows.ts_us.to_numpy(np.int64), rows.kind.to_numpy()
        at = {k: np.flatnonzero(kind == k) for k in (IMU, MAG, CAMERA)}
        standing, quarter = np.full(len(t), state["stopped"]), []
        events = []  # row, cause, time, is a wheel, is a corner
        if len(i := at[IMU]):
            ends, since = self.turns(state, i, t[i], rows.gz.to_numpy(float)[i])
            quarter = list(zip(ends.tolist(), since.tolist()))
            still = self.standing(state, t[i], rows[["ax", "ay"]].to_numpy(float)[i])
            seen = last_before(kind == IMU)
            standing = np.where(seen < 0, state["stopped"], still[np.searchsorted(i, np.maximum(seen, i[0]))])
            state["stopped"] = bool(still[-1])
            events += [(r, "anchor", int(t[r]), 0, 1) for r, _ in quarter]
        if len(i := at[MAG]):
            hidden = self.recovered(state, i, t[i] / 1e6, rows[["mx", "my"]].to_numpy(float)[i], quarter)
            events += [(r, "mag", int(t[r]), 0, 1) for r in hidden]
        if len(i := at[CAMERA]):
            ends, peak = self.passes(state, i, t[i], rows.dark.to_numpy(float)[i], rows.net.to_numpy(float)[i])
            events += [(r, "wheel", int(p), int(not standing[r]), 0) for r, p in zip(ends.tolist(), peak.tolist())]
        # no gap that is open or still to come reaches further back
        oldest = min([g[0] for g in state["gaps"]] + [(state["imu"] or t[-1:])[0] / 1e6]) - self.apart
        state["turned"] = [c for c in state["turned"] + [s for _, s in quarter] if c >= oldest]
        if not events:
            return None
        out = pd.DataFrame(sorted(events, key=lambda e: e[0]), columns=["row", "cause", "t_us", "wheel", "corner"])
        wheels, corners = state["wheels"] + out.wheel.cumsum().to_numpy(), state["corners"] + out.corner.cumsum().to_numpy()
        pinned = last_before(out.corner.to_numpy() == 1)
        at_corner = np.where(pinned < 0, state["at_corner"], wheels[np.maximum(pinned, 0)])
        state.update(wheels=int(wheels[-1]), corners=int(corners[-1]), at_corner=int(at_corner[-1]))
        return out.assign(wheels=wheels, corners=corners, wheels_at_corner=at_corner, stopped=standing[out.row], t_host_us=t[out.row])


def placed(events: DataFrame, start_corner: str | None) -> DataFrame:
    """Counts to distance, place and named segment. Without a known first corner the distance is that of the wheels."""
    corners = F.lit(0) if start_corner is None else F.col("corners")
    cum = leg_distance(F.col("wheels"), corners, F.col("wheels_at_corner"), start_corner or "BR").cast("double")
    rows = events.withColumn("cum_cm", cum).withColumn("_at", cum_to_xy(F.col("cum_cm")))
    return rows.select("line", "container_id", "t_us", "cause", "cum_cm", F.concat_ws(".", "line", "_at.piece").alias("segment"),
                       F.round(F.col("_at.x") / 100, 3).alias("x"), F.round(F.col("_at.y") / 100, 3).alias("y"), "t_host_us")


def positions(stream: DataFrame, localizer: Localizer, start_corner: str | None = None, **how) -> DataFrame:
    """Position messages of a stream."""
    return placed(keyed(stream, localizer, **how), start_corner)
