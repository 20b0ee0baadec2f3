"""Cameras and homographies from clicks, fitted for many keyframes at once.

A keyframe is a row with its clicks, an array of structs: x, y in the image; px, py for a known place of the pitch, or ax, ay, bx, by for a place
somewhere on that line; up, the height of either above the ground (null: on it); zoom of the view that was clicked in. Clicks with neither say nothing.
Rows are dealt over all cores: a task stacks its keyframes into arrays, and every step of a fit is one array operation
over all of them, their starting points and, for the search of a wrong click, their omissions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the model: pixels of a click's error, metres, radians and factors of the priors, pixels for a click behind the camera.
CLICK_PX = 3.0
LEAST_PLACE_M = 3.0
HEIGHT_M = 0.5
YAW = np.radians(15.0)
ROLL = np.radians(4.0)
ZOOM = np.log(2.2)
BEHIND = 1e3
TILTS = np.radians([-4.0, 0.0, 2.0, 5.0, 10.0, 18.0, 30.0, 45.0])
ZOOMS = np.log([1.0, 1.6, 2.5])
#: Mean pixels, as a share of the image's width, from which clicks don't fit together.
BAD_SHARE = 0.006
CLICK_FIELDS = ("x", "y", "px", "py", "ax", "ay", "bx", "by", "up", "zoom")
PARAMETERS = ("x", "y", "height", "yaw", "tilt", "roll", "log_f")
FIT = (
    "struct<h: array<double>, error: double, model: string, reason: string, camera: array<double>, camera_error: double, free_error: double, "
    "pixels: array<double>, mean_pixels: double, fits: boolean, suspect: int>"
)


class Clicks:
    """The clicks of n keyframes, padded to one length; `use` tells real ones."""

    def __init__(self, rows: list, sizes: np.ndarray) -> None:
        most = max([1, *map(len, rows)])
        raw = np.full((len(rows), most, len(CLICK_FIELDS)), np.nan)
        for k, clicks in enumerate(rows):
            for j, c in enumerate(clicks):
                raw[k, j] = [np.nan if c.get(f) is None else c[f] for f in CLICK_FIELDS]
        self.size = sizes
        self.image = raw[..., :2]
        self.line = np.isnan(raw[..., 2:4]).any(-1)
        up = np.nan_to_num(raw[..., 8])
        ends = np.where(self.line[..., None, None], raw[..., 4:8].reshape(*raw.shape[:2], 2, 2), raw[..., None, 2:4])
        self.world = np.concatenate([ends, np.broadcast_to(-up[..., None, None], (*up.shape, 2, 1))], -1)
        self.use = np.isfinite(self.image).all(-1) & np.isfinite(self.world).all((-1, -2))
        self.world = np.where(self.use[..., None, None], self.world, 0.0)
        self.image = np.where(self.use[..., None], self.image, 0.0)
        self.high = (up != 0) & self.use
        self.weight = np.clip(np.where(np.nan_to_num(raw[..., 9]) == 0, 1.0, np.nan_to_num(raw[..., 9], nan=1.0)), 1.0, 4.0)

    def picked(self, rows: np.ndarray, use: np.ndarray | None = None) -> Clicks:
        out = object.__new__(Clicks)
        for name, value in self.__dict__.items():
            setattr(out, name, value[rows])
        if use is not None:
            out.use = use
        return out

    def freedom(self, high: bool) -> np.ndarray:
        """What the clicks tell: two a point, one a click on a line, two a line at most; high: those above the ground too."""
        use = self.use if high else self.use & ~self.high
        same = (self.world[:, :, None] == self.world[:, None]).all((-1, -2)) & use[:, :, None] & use[:, None] & self.line[:, :, None] & self.line[:, None]
        of_line = same.sum(-1)
        share = np.where(of_line > 0, np.minimum(2, of_line) / np.maximum(of_line, 1), 0.0)
        return np.rint((2 * (use & ~self.line) + share * (use & self.line)).sum(-1)).astype(int)


def turned(yaw: np.ndarray, tilt: np.ndarray, roll: np.ndarray) -> np.ndarray:
    """World axes (along, across, down) in the camera's (right, down, ahead): three turns one after the other."""
    zero, one = np.zeros_like(yaw), np.ones_like(yaw)

    def stacked(*v: np.ndarray) -> np.ndarray:
        return np.stack(np.broadcast_arrays(*v), -1).reshape(*yaw.shape, 3, 3)

    about_down = stacked(-np.sin(yaw), np.cos(yaw), zero, zero, zero, one, np.cos(yaw), np.sin(yaw), zero)
    about_right = stacked(one, zero, zero, zero, np.cos(tilt), -np.sin(tilt), zero, np.sin(tilt), np.cos(tilt))
    about_ahead = stacked(np.cos(roll), np.sin(roll), zero, -np.sin(roll), np.cos(roll), zero, zero, zero, one)
    return about_ahead @ about_right @ about_down


def seen(camera: np.ndarray, world: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Homogeneous image points of world points (..., k, 3) for cameras (..., 7) and image sizes (..., 2)."""
    ahead = np.concatenate([camera[..., :2], -camera[..., 2:3]], -1)
    turn = turned(camera[..., 3], camera[..., 4], camera[..., 5])
    focal = np.exp(np.clip(camera[..., 6], 0.0, 15.0))[..., None, None]
    lens = np.concatenate([focal * turn[..., :2, :] + turn[..., 2:, :] * size[..., :, None] / 2, turn[..., 2:, :]], -2)[..., None]
    dx, dy, dz = (world[..., j] - ahead[..., j, None] for j in range(3))
    return np.stack([lens[..., i, 0, :] * dx + lens[..., i, 1, :] * dy + lens[..., i, 2, :] * dz for i in range(3)], -1)


def ground_homography(camera: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pitch-to-image matrices of cameras, positive before the camera."""
    axes = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]])
    base, along, across = np.moveaxis(seen(camera, np.broadcast_to(axes, (*camera.shape[:-1], 3, 3)), size), -2, 0)
    return np.stack([along - base, across - base, base], -1)


def off_line(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signed distance of image points from the lines through homogeneous a and b."""
    line = np.cross(a, b)
    return (line[..., 0] * at[..., 0] + line[..., 1] * at[..., 1] + line[..., 2]) / np.maximum(np.hypot(line[..., 0], line[..., 1]), 1e-300)


def click_errors(camera: np.ndarray, clicks: Clicks) -> np.ndarray:
    """Pixels (n, clicks, 2) between clicks and what the camera shows; a click on a line has one. BEHIND (in units of CLICK_PX / weight) behind it."""
    if not clicks.line.any():
        shown = seen(camera, clicks.world[..., 0, :], clicks.size)
        with np.errstate(all="ignore"):
            flat = shown[..., :2] / shown[..., 2:] - clicks.image
        behind = np.where((shown[..., 2] <= 1e-6)[..., None], (BEHIND * CLICK_PX / clicks.weight)[..., None], flat)
        return np.where(clicks.use[..., None], behind, 0.0)
    ends = clicks.world.reshape(len(clicks.world), -1, 3)
    shown = seen(camera, ends, clicks.size).reshape(*clicks.world.shape)
    with np.errstate(all="ignore"):
        flat = shown[..., 0, :2] / shown[..., 0, 2:] - clicks.image
        beside = off_line(shown[..., 0, :], shown[..., 1, :], clicks.image)
    depth = shown[..., 2]
    hidden = np.where(clicks.line, clicks.high & (depth.min(-1) <= 1e-6), depth[..., 0] <= 1e-6)
    out = np.where(clicks.line[..., None], np.stack([beside, np.zeros_like(beside)], -1), flat)
    penalty = np.stack([np.ones_like(beside), ~clicks.line], -1) * (BEHIND * CLICK_PX / clicks.weight)[..., None]
    return np.where(clicks.use[..., None], np.where(hidden[..., None], penalty, out), 0.0)


def prior_errors(camera: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Deviations from what is known, in units of its uncertainty; prior: x, y, height, focal length, uncertainty of the place, yaw or nan."""
    place = np.maximum(LEAST_PLACE_M, np.nan_to_num(prior[..., 4], nan=5.0))
    yaw = np.nan_to_num((camera[..., 3] - prior[..., 5] + np.pi) % (2 * np.pi) - np.pi) / YAW
    return np.stack(
        [(camera[..., 0] - prior[..., 0]) / place, (camera[..., 1] - prior[..., 1]) / place, (camera[..., 2] - prior[..., 2]) / HEIGHT_M, camera[..., 5] / ROLL,
         (camera[..., 6] - np.log(prior[..., 3])) / ZOOM, yaw], -1,
    )


def levenberg(residuals: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 60, damping: float = 1e-2) -> np.ndarray:
    """Levenberg-Marquardt for many independent problems; residuals(parameters, rows) gives those of the problems `rows`.

    Each problem has its own damping and stops by itself: when no step helps, when steps are small or gain a ten-billionth of the cost.
    """
    p = start.copy()
    n, k = p.shape
    damp = np.full(n, damping)
    live = np.arange(n)
    r = residuals(p, live)
    for _ in range(rounds):
        if not len(live):
            break
        now, here = p[live], r[live]
        slope = np.empty((*here.shape, k))
        for j in range(k):
            e = 1e-6 * np.maximum(1.0, np.abs(now[:, j]))
            moved = now.copy()
            moved[:, j] += e
            slope[..., j] = (residuals(moved, live) - here) / e[:, None]
        normal, pull = np.swapaxes(slope, 1, 2) @ slope, np.einsum("nrk,nr->nk", slope, here)
        normal, pull = np.nan_to_num(normal), np.nan_to_num(pull)
        diagonal = np.einsum("nkk->nk", normal)
        cost, open_, step = (here**2).sum(1), np.arange(len(live)), np.zeros_like(now)
        done, gain = np.zeros(len(live), bool), np.zeros(len(live))
        for _ in range(8):
            if not len(open_):
                break
            lifted = normal[open_] + (damp[live[open_], None] * (diagonal[open_] + 1e-9))[:, :, None] * np.eye(k)
            try:
                step[open_] = np.linalg.solve(lifted, -pull[open_][..., None])[..., 0]
            except np.linalg.LinAlgError:
                step[open_] = (np.linalg.pinv(lifted) @ -pull[open_][..., None])[..., 0]
            with np.errstate(all="ignore"):
                tried = residuals(now[open_] + step[open_], live[open_])
                better = np.isfinite(tried).all(1) & ((tried**2).sum(1) < cost[open_])
            won = open_[better]
            gain[won] = cost[won] - (tried[better] ** 2).sum(1)
            p[live[won]] = now[won] + step[won]
            r[live[won]] = tried[better]
            damp[live[won]] = np.maximum(damp[live[won]] / 3, 1e-7)
            done[won] = True
            open_ = open_[~better]
            damp[live[open_]] *= 4
        live = live[done & (np.linalg.norm(step, axis=1) >= 1e-9) & (gain > 1e-10 * cost)]
    return p


def starts(prior: np.ndarray, yaw: np.ndarray) -> np.ndarray:
    """Cameras (n, starts, 7) in all directions, or 40 degrees around a known one, tilted and zoomed; n keyframes that are alike in knowing it."""
    turns = np.radians(np.arange(0, 360, 10) if np.isnan(yaw).all() else np.arange(-40, 41, 10))
    grid = np.stack([x.ravel() for x in np.meshgrid(turns, TILTS, ZOOMS, indexing="ij")], -1)
    out = np.zeros((len(prior), len(grid), 7))
    out[..., :3] = prior[:, None, :3]
    out[..., 3] = grid[:, 0] + np.nan_to_num(yaw)[:, None]
    out[..., 4] = grid[:, 1]
    out[..., 6] = np.log(prior[:, 3])[:, None] + grid[:, 2]
    return out


def best_starts(clicks: Clicks, prior: np.ndarray, omitted: bool, keep: int = 4, at_once: int = 64) -> np.ndarray:
    """The cheapest starts of each keyframe (n, keep, 7), or, omitted, of each of its clicks left out (n, clicks, keep, 7).

    A start is looked at once: what it costs without a click is its cost less that click's.
    """
    out = []
    for lo in range(0, len(prior), at_once):
        rows = np.arange(lo, min(lo + at_once, len(prior)))
        some = starts(prior[rows], prior[rows, 5])
        n, s = some.shape[:2]
        many = np.repeat(rows, s)
        flat = some.reshape(-1, 7)
        with np.errstate(all="ignore"):
            each = ((click_errors(flat, clicks.picked(many)) * (clicks.weight[many] / CLICK_PX)[..., None]) ** 2).sum(-1).reshape(n, s, -1)
        total = np.nan_to_num(each, nan=np.inf).sum(-1) + (prior_errors(flat, prior[many]) ** 2).sum(-1).reshape(n, s)
        cost = (total[..., None] - np.nan_to_num(each)).swapaxes(1, 2) if omitted else total[:, None]
        order = np.argsort(cost, -1, kind="stable")[..., :keep]
        found = some[np.arange(n)[:, None, None], order]
        out.append(found if omitted else found[:, 0])
    return np.concatenate(out)


def camera_residuals(clicks: Clicks, prior: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def residuals(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        some = clicks.picked(rows)
        data = click_errors(p, some) * (some.weight / CLICK_PX)[..., None]
        return np.concatenate([data.reshape(len(rows), -1), prior_errors(p, prior[rows])], 1)

    return residuals


def of_best(p: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """For each row the candidate of least cost."""
    return np.take_along_axis(p, np.nan_to_num(cost, nan=np.inf).argmin(-1)[..., None, None], -2)[..., 0, :]


def by_known_yaw(prior: np.ndarray) -> Iterator[np.ndarray]:
    known = ~np.isnan(prior[:, 5])
    for some in (known, ~known):
        if some.any():
            yield np.flatnonzero(some)


def fitted_cameras(clicks: Clicks, prior: np.ndarray) -> np.ndarray:
    """Cameras (n, 7): the best of four fits from the cheapest starts."""
    out = np.full((len(prior), 7), np.nan)
    for rows in by_known_yaw(prior):
        first = best_starts(clicks.picked(rows), prior[rows], False)
        k = first.shape[1]
        many = np.repeat(rows, k)
        residuals = camera_residuals(clicks.picked(many), prior[many])
        p = levenberg(residuals, first.reshape(-1, 7))
        cost = (residuals(p, np.arange(len(p))) ** 2).sum(1)
        out[rows] = of_best(p.reshape(-1, k, 7), cost.reshape(-1, k))
    return out


def without_each(clicks: Clicks, prior: np.ndarray, camera: np.ndarray) -> np.ndarray:
    """Root mean square pixels of the others when a click is left out (n, clicks); infinite where too few are left.

    One search serves all omissions of a keyframe: its starts, and the first step from the fitted camera, are those of all clicks less the one's share.
    """
    n, most = clicks.use.shape
    near = np.concatenate([prior[:, :5], camera[:, 3:4]], 1)
    first = best_starts(clicks, near, True)
    # The first step: normal equations of all clicks, less what the omitted one adds.
    residuals = camera_residuals(clicks, prior)
    rows = np.arange(n)
    here = residuals(camera, rows)
    slope = np.empty((*here.shape, 7))
    for j in range(7):
        e = 1e-6 * np.maximum(1.0, np.abs(camera[:, j]))
        moved = camera.copy()
        moved[:, j] += e
        slope[..., j] = (residuals(moved, rows) - here) / e[:, None]
    own, own_r = slope[:, : 2 * most].reshape(n, most, 2, 7), here[:, : 2 * most].reshape(n, most, 2)
    normal = (np.swapaxes(slope, 1, 2) @ slope)[:, None] - np.einsum("ncik,ncil->nckl", own, own)
    pull = np.einsum("nrk,nr->nk", slope, here)[:, None] - np.einsum("ncik,nci->nck", own, own_r)
    lifted = np.nan_to_num(normal) + 1e-2 * np.einsum("nckk->nck", np.nan_to_num(normal))[..., None] * np.eye(7) + 1e-9 * np.eye(7)
    stepped = camera[:, None] + np.linalg.solve(lifted, -np.nan_to_num(pull)[..., None])[..., 0]
    first = np.concatenate([first, stepped[:, :, None], np.broadcast_to(camera[:, None, None], (n, most, 1, 7))], 2)
    k = first.shape[2]
    many = np.repeat(np.arange(n * most), k)
    row, gone = many // most, many % most
    use = clicks.use[row] & (np.arange(most) != gone[:, None])
    rest = clicks.picked(row, use)
    # The searched starts know the direction, as the search did; the fitted camera is only polished.
    told = np.where((np.arange(len(many)) % k < k - 2)[:, None], near[row], prior[row])
    p = levenberg(camera_residuals(rest, told), first.reshape(-1, 7))
    pixels = click_errors(p, rest) * rest.weight[..., None]
    count = (use * np.where(rest.line, 1, 2)).sum(1)
    with np.errstate(all="ignore"):
        spread = np.sqrt((pixels**2).sum((1, 2)) / count)
    left = clicks.picked(np.repeat(np.arange(n), most), clicks.use.repeat(most, 0) & ~np.tile(np.eye(most, dtype=bool), (n, 1))).freedom(True).reshape(n, most)
    spread = np.nan_to_num(spread, nan=np.inf).reshape(n, most, k).min(-1)
    return np.where(clicks.use & (left >= 3), spread, np.inf)


def suspects(spread: np.ndarray, clicks: Clicks) -> np.ndarray:
    """The click without which, and only without which, the others agree; -1 where that isn't clear."""
    if spread.shape[1] < 2:
        return np.full(len(spread), -1)
    order = np.argsort(spread, 1, kind="stable")
    best, second = np.take_along_axis(spread, order[:, :2], 1).T
    clear = (best < BAD_SHARE * clicks.size[:, 0]) & (second > 3 * best + 3) & (clicks.use.sum(1) >= 4)
    return np.where(clear, order[:, 0], -1)


def scaled(points: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Matrices that move points to their mean and to a spread of the root of two."""
    n = np.maximum(use.sum(1), 1)[:, None]
    mean = (points * use[..., None]).sum(1) / n
    spread = np.sqrt((((points - mean[:, None]) ** 2).sum(-1) * use).sum(1) / n[:, 0])
    s = np.sqrt(2) / np.maximum(spread, 1e-9)
    out = np.zeros((len(points), 3, 3))
    out[:, 0, 0] = out[:, 1, 1] = s
    out[:, :2, 2] = -s[:, None] * mean
    out[:, 2, 2] = 1
    return out


def lifted(points: np.ndarray) -> np.ndarray:
    return np.concatenate([points, np.ones((*points.shape[:-1], 1))], -1)


def through(h: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (n, k, 2) through matrices (n, 3, 3), and the divisors."""
    q = lifted(points) @ np.swapaxes(h, 1, 2)
    with np.errstate(all="ignore"):
        return q[..., :2] / q[..., 2:], q[..., 2]


def pitch_lines(clicks: Clicks) -> np.ndarray:
    """Coefficients of the lines that are clicked on, of unit normals."""
    line = np.cross(lifted(clicks.world[..., 0, :2]), lifted(clicks.world[..., 1, :2]))
    return line / np.maximum(np.hypot(line[..., 0], line[..., 1]), 1e-12)[..., None]


def metre_errors(h: np.ndarray, clicks: Clicks) -> np.ndarray:
    """Metres (n, clicks) from clicks, through image-to-pitch matrices, to their points or lines; nan for those above the ground."""
    at, _ = through(h, clicks.image)
    to_point = np.hypot(*np.moveaxis(at - clicks.world[..., 0, :2], -1, 0))
    to_line = np.abs((pitch_lines(clicks) * lifted(at)).sum(-1))
    return np.where(clicks.use & ~clicks.high, np.where(clicks.line, to_line, to_point), np.nan)


def mean_of(values: np.ndarray) -> np.ndarray:
    there = ~np.isnan(values)
    with np.errstate(all="ignore"):
        return np.where(there, values, 0.0).sum(1) / there.sum(1)


def before_clicks(h: np.ndarray, clicks: Clicks) -> np.ndarray:
    """Matrices with the sign that puts most clicks before the camera, scaled to a last element of size one."""
    last = np.abs(h[:, 2, 2])
    h = h / np.where(last > 1e-12, last, np.linalg.norm(h, axis=(1, 2)))[:, None, None]
    _, w = through(h, clicks.image)
    sign = np.where((np.sign(w) * (clicks.use & ~clicks.high)).sum(1) < 0, -1.0, 1.0)
    return h * sign[:, None, None]


def polished(h: np.ndarray, clicks: Clicks, rounds: int = 20) -> np.ndarray:
    """Image-to-pitch matrices refined on pixels: points and lines are drawn into the image. Clicks made when zoomed in count more."""
    lines = pitch_lines(clicks)
    ground = clicks.use & ~clicks.high

    def residuals(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        k = lifted(p).reshape(-1, 3, 3)
        det = np.linalg.det(k)
        safe = np.where((np.abs(det) > 1e-300)[:, None, None], k, np.eye(3))
        shown, _ = through(np.linalg.inv(safe), clicks.world[rows, :, 0, :2])
        drawn = lines[rows] @ k
        with np.errstate(all="ignore"):
            beside = (drawn * lifted(clicks.image[rows])).sum(-1) / np.maximum(np.hypot(drawn[..., 0], drawn[..., 1]), 1e-12)
        line = clicks.line[rows]
        out = np.where(line[..., None], np.stack([beside, np.zeros_like(beside)], -1), shown - clicks.image[rows]) * clicks.weight[rows][..., None]
        out = np.where(ground[rows][..., None], out, 0.0).reshape(len(rows), -1)
        return np.where((np.abs(det) > 1e-300)[:, None], out, np.inf)

    start = (h / h[:, 2:, 2:]).reshape(-1, 9)[:, :8]
    with np.errstate(all="ignore"):
        good = np.isfinite(start).all(1) & np.isfinite(residuals(np.nan_to_num(start), np.arange(len(start)))).all(1)
    out = start.copy()
    if good.any():
        rows = np.flatnonzero(good)
        # Columns of very unlike size: the fit moves multiples of the start.
        unit = np.maximum(np.abs(start[rows]), 1e-6)
        out[rows] = unit * levenberg(lambda p, some: residuals(p * unit[some], rows[some]), start[rows] / unit, rounds, 1e-4)
    return lifted(out).reshape(-1, 3, 3)


def free_fits(clicks: Clicks) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Image-to-pitch matrices from clicks on the ground alone, their mean error in metres, and the reason where there is none.

    Linear first (two rows a point, one a line, both sides scaled), then refined on pixels. A mirrored pitch, which no camera sees, is
    mirrored back at the upright or level line through the clicked places, if that fits about as well.
    """
    n = len(clicks.use)
    ground = clicks.use & ~clicks.high
    ends_used = np.concatenate([ground, ground & clicks.line], 1)
    ends = np.concatenate([clicks.world[:, :, 0, :2], clicks.world[:, :, 1, :2]], 1)
    a, b = scaled(clicks.image, ground), scaled(ends, ends_used)
    p, _ = through(a, clicks.image)
    q, _ = through(b, clicks.world[..., 0, :2])
    line = np.swapaxes(np.linalg.inv(b), 1, 2)[:, None] @ pitch_lines(clicks)[..., None]
    line = line[..., 0] / np.maximum(np.hypot(line[..., 0, 0], line[..., 1, 0]), 1e-12)[..., None]
    p = lifted(p)
    zero = np.zeros_like(p)
    for_x = np.concatenate([p, zero, -q[..., :1] * p], -1)
    for_y = np.concatenate([zero, p, -q[..., 1:] * p], -1)
    on_line = np.concatenate([line[..., :1] * p, line[..., 1:2] * p, line[..., 2:] * p], -1)
    rows = np.where(clicks.line[..., None, None], np.stack([on_line, np.zeros_like(on_line)], 2), np.stack([for_x, for_y], 2))
    rows = np.where(ground[..., None, None], rows, 0.0).reshape(n, -1, 9)
    if rows.shape[1] < 9:
        rows = np.concatenate([rows, np.zeros((n, 9 - rows.shape[1], 9))], 1)
    _, size, right = np.linalg.svd(np.nan_to_num(rows), full_matrices=False)
    enough, certain = clicks.freedom(False) >= 8, size[:, 7] >= 1e-9 * size[:, 0]
    h = np.linalg.inv(b) @ right[:, -1].reshape(-1, 3, 3) @ a
    ok = enough & certain
    h = np.where(ok[:, None, None], h, np.eye(3))
    h = before_clicks(polished(h, clicks), clicks)
    error = mean_of(metre_errors(h, clicks))
    wrong = ok & (np.linalg.det(h) < 0)
    reason = [None if x else "too little" if not e else "undetermined" for x, e in zip(ok, enough, strict=True)]
    if wrong.any():
        at = np.flatnonzero(wrong)
        some = clicks.picked(at)
        mean = (ends[at] * ends_used[at][..., None]).sum(1) / ends_used[at].sum(1)[:, None]
        tried = []
        for axis in (0, 1):
            m = np.broadcast_to(np.eye(3), (len(at), 3, 3)).copy()
            m[:, axis, axis] = -1
            m[:, axis, 2] = 2 * mean[:, axis]
            k = before_clicks(polished(m @ h[at], some), some)
            e = mean_of(metre_errors(k, some))
            tried.append((k, np.where(np.isfinite(e) & (np.linalg.det(k) > 0), e, np.inf)))
        first = tried[0][1] <= tried[1][1]
        back = np.where(first[:, None, None], tried[0][0], tried[1][0])
        least = np.minimum(tried[0][1], tried[1][1])
        fine = least <= np.maximum(2 * error[at], error[at] + 0.5)
        h[at], error[at] = back, least
        for i, x in zip(at, fine, strict=True):
            if not x:
                reason[i] = "mirrored"
    fails = np.array([r is not None for r in reason]) | ~np.isfinite(h).all((1, 2))
    return np.where(fails[:, None, None], np.nan, h), np.where(fails, np.inf, error), [r or ("failed" if f else None) for r, f in zip(reason, fails, strict=True)]


def shown_errors(h: np.ndarray, camera: np.ndarray, clicks: Clicks) -> np.ndarray:
    """Pixels (n, clicks) between clicks and where the calibration draws their points or lines; the image's diagonal for what lies behind.

    Clicks above the ground need the camera, and are nan where it is.
    """
    far = np.hypot(clicks.size[:, 0], clicks.size[:, 1])[:, None]
    out = np.full(clicks.use.shape, np.nan)
    k = np.linalg.inv(np.where(np.isfinite(h).all((1, 2))[:, None, None], h, np.eye(3)))
    shown, w = through(k, clicks.world[..., 0, :2])
    to_point = np.where(w > 1e-9, np.hypot(*np.moveaxis(shown - clicks.image, -1, 0)), far)
    share = np.linspace(0, 1, 41)[:, None]
    on = clicks.world[..., 0, None, :2] * (1 - share) + clicks.world[..., 1, None, :2] * share
    n, c = clicks.use.shape
    shown, w = through(k, on.reshape(n, -1, 2))
    w = w.reshape(n, c, 41) > 1e-9
    shown = shown.reshape(n, c, 41, 2)
    first, last = w.argmax(-1), 40 - w[..., ::-1].argmax(-1)
    a, b = (np.take_along_axis(shown, i[..., None, None], 2)[..., 0, :] for i in (first, last))
    with np.errstate(all="ignore"):
        to_line = np.where(w.sum(-1) < 2, far, np.abs(off_line(lifted(a), lifted(b), clicks.image)))
    ground = np.where(clicks.line, to_line, to_point)
    out = np.where(clicks.use & ~clicks.high, ground, out)
    with np.errstate(all="ignore"):
        high = np.hypot(*np.moveaxis(click_errors(camera, clicks), -1, 0))
    hidden = high >= BEHIND * CLICK_PX / clicks.weight - 1e-6
    high = np.where(hidden, np.where(clicks.line, np.nan, far), high)
    return np.where(clicks.high & np.isfinite(camera).all(1)[:, None], high, out)


def priors(rows: list, n: int) -> np.ndarray:
    out = np.full((n, 6), np.nan)
    for k, r in enumerate(rows):
        if r is not None and r.get("x") is not None and r.get("y") is not None and r.get("focal"):
            values = [r.get(f) for f in ("x", "y", "height", "focal", "uncertain", "yaw")]
            out[k] = [np.nan if v is None else v for v in values]
            out[k, 2] = 1.6 if np.isnan(out[k, 2]) else out[k, 2]
    return out


def calibrated(rows: list, sizes: np.ndarray, known: list, search: bool) -> list[dict]:
    """Fits of keyframes: by a camera where its place is roughly known, else free; free too if its error is below half the camera's."""
    clicks, prior = Clicks(rows, sizes), priors(known, len(rows))
    n = len(rows)
    with_camera = np.flatnonzero(~np.isnan(prior[:, 0]) & (clicks.freedom(True) >= 3))
    camera = np.full((n, 7), np.nan)
    h = np.full((n, 3, 3), np.nan)
    camera_error, free_error = np.full(n, np.inf), np.full(n, np.inf)
    if len(with_camera):
        some = clicks.picked(with_camera)
        camera[with_camera] = fitted_cameras(some, prior[with_camera])
        h[with_camera] = before_clicks(np.linalg.inv(ground_homography(camera[with_camera], some.size)), some)
        e = mean_of(metre_errors(h[with_camera], some))
        camera_error[with_camera] = np.where((some.use & ~some.high).any(1), e, 0.0)
    free, error, reasons = free_fits(clicks)
    free_error = error
    wins = (clicks.freedom(False) >= 8) & (free_error < 0.5 * camera_error)
    h = np.where(wins[:, None, None], free, h)
    pixels = shown_errors(h, camera, clicks)
    suspect = np.full(n, -1)
    if search:
        ask = np.flatnonzero(~np.isnan(camera[:, 0]) & (clicks.use.sum(1) >= 4))
        if len(ask):
            some = clicks.picked(ask)
            suspect[ask] = suspects(without_each(some, prior[ask], camera[ask]), some)
        ask = np.flatnonzero(np.isnan(camera[:, 0]) & (clicks.use.sum(1) >= 4))
        if len(ask):
            suspect[ask] = suspects(free_without_each(clicks.picked(ask)), clicks.picked(ask))
    out = []
    for k in range(n):
        there = np.isfinite(h[k]).all()
        real = pixels[k][: len(rows[k])] if there else []
        mean = float(np.nanmean(real)) if len(real) and not np.isnan(real).all() else None
        number = lambda v: float(v) if np.isfinite(v) else None
        out.append({
            "h": h[k].ravel().tolist() if there else None, "error": number(free_error[k] if wins[k] else camera_error[k]),
            "model": ("free" if wins[k] else "camera") if there else None, "reason": None if there else reasons[k] or "failed",
            "camera": None if np.isnan(camera[k]).any() else camera[k].tolist(), "camera_error": number(camera_error[k]), "free_error": number(free_error[k]),
            "pixels": [number(v) for v in real], "mean_pixels": mean, "fits": None if mean is None else bool(mean <= BAD_SHARE * sizes[k, 0]),
            "suspect": int(suspect[k]) if suspect[k] >= 0 else None,
        })
    return out


def free_without_each(clicks: Clicks) -> np.ndarray:
    """Mean pixels of the others in a free fit without a click (n, clicks); infinite where too few are left."""
    n, most = clicks.use.shape
    row, gone = np.divmod(np.arange(n * most), most)
    rest = clicks.picked(row, clicks.use[row] & (np.arange(most) != gone[:, None]))
    h, _, _ = free_fits(rest)
    pixels = mean_of(shown_errors(h, np.full((len(h), 7), np.nan), rest))
    found = np.isfinite(h).all((1, 2)) & clicks.use[row, gone]
    return np.where(found, np.nan_to_num(pixels, nan=np.inf), np.inf).reshape(n, most)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over four tasks a core: they are small and their fits long, so by size they would share a task or few."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def fit_keyframes(keyframes: DataFrame, clicks: str = "clicks", prior: str | None = "prior", size: tuple[str, str] = ("width", "height"), result: str = "fit", search: bool = True, at_once: int = 64) -> DataFrame:
    """All rows and columns of keyframes with a struct `result`. [STA-10, STA-11, STA-12, STA-13, STA-17, STA-18, SFN-24]

    h (image to pitch, row-major), its mean error in metres, model (`camera` or `free`), reason where there is none; camera (PARAMETERS), both
    models' errors; pixels of each click, their mean, whether they fit; suspect, the click that does not agree with the others (null: none, or not clear; search=False: not looked for).

    prior: struct x, y, height (default 1.6), focal, uncertain (metres), yaw (radians), any null; without place and focal length, or prior=None, fits are free.
    Null or too few clicks give no fit and a reason. Fits of a row don't depend on other rows.
    """

    def fitted(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # keyframes of as many clicks share arrays, which are as long as the longest
            frame = frame.iloc[np.argsort([0 if c is None else len(c) for c in frame[clicks]], kind="stable")]
            for lo in range(0, len(frame), at_once):
                g = frame.iloc[lo : lo + at_once].copy()
                rows = [[] if c is None else [x for x in c if x is not None] for c in g[clicks]]
                known = list(g[prior]) if prior else [None] * len(g)
                g[result] = calibrated(rows, g[list(size)].to_numpy(float), known, search)
                yield g

    kept = spread(keyframes.drop(result))
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], f"`{result}` {FIT}"])
    return kept.mapInPandas(fitted, fields)


def seen_grid(h: np.ndarray, size: np.ndarray, steps: tuple[int, int], margin_m: float, margin: float, pitch: tuple[float, float]) -> Clicks:
    """A grid of places on and around the pitch as clicks where image-to-pitch matrices show it; those outside the image by more than a margin aren't used."""
    xs = np.stack(np.meshgrid(np.linspace(-margin_m, pitch[0] + margin_m, steps[0]), np.linspace(-margin_m, pitch[1] + margin_m, steps[1])), -1).reshape(-1, 2)
    n = len(h)
    shown, w = through(np.linalg.inv(h), np.broadcast_to(xs, (n, *xs.shape)))
    inside = ((shown >= -margin * size[:, None]) & (shown <= (1 + margin) * size[:, None])).all(-1) & (w > 1e-9)
    out = object.__new__(Clicks)
    first = np.argsort(~inside, 1, kind="stable")[:, : max(1, int(inside.sum(1).max(initial=0)))]  # the used ones; no row has more
    out.size, out.use = size, np.take_along_axis(inside, first, 1)
    out.image = np.where(out.use[..., None], np.take_along_axis(shown, first[..., None], 1), 0.0)
    at = np.concatenate([xs, np.zeros((len(xs), 1))], 1)[first]
    out.world = np.stack([at, at], 2)
    out.line = out.high = np.zeros(first.shape, bool)
    out.weight = np.ones(first.shape)
    return out


def grid_distance(camera: np.ndarray, grid: Clicks) -> np.ndarray:
    """Mean pixels between a grid and where cameras show it."""
    away = np.hypot(*np.moveaxis(click_errors(camera, grid), -1, 0))
    return mean_of(np.where(grid.use, away, np.nan))


def grid_fit(camera: np.ndarray, grid: Clicks, free: slice) -> np.ndarray:
    """Cameras moved in the parameters `free` to where they show a grid best."""

    def whole(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        c = camera[rows].copy()
        c[:, free] = p
        return c

    p = levenberg(lambda p, rows: click_errors(whole(p, rows), grid.picked(rows)).reshape(len(rows), -1) / 10, camera[:, free].copy())
    return whole(p, np.arange(len(p)))


def cameras_behind(h: np.ndarray, size: np.ndarray, pitch: tuple[float, float] = (105.0, 68.0)) -> tuple[np.ndarray, np.ndarray]:
    """The camera that sees what image-to-pitch matrices show, and its mean error in pixels; nan where there is none.

    The pitch's two axes are seen as vectors of equal length at right angles: that gives the focal length, then the
    turns and the place in closed form, from which a fit to a grid of visible places starts.
    """
    n = len(h)
    g = np.linalg.inv(h)
    g = g / np.linalg.norm(g[:, :, 0], axis=1)[:, None, None]
    moved = g.copy()
    moved[:, :2] -= size[:, :, None] / 2 * g[:, 2:]
    a, b = moved[:, :, 0], moved[:, :, 1]
    with np.errstate(all="ignore"):
        upright = -(a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1]) / (a[:, 2] * b[:, 2])
        alike = (a[:, 0] ** 2 + a[:, 1] ** 2 - b[:, 0] ** 2 - b[:, 1] ** 2) / (b[:, 2] ** 2 - a[:, 2] ** 2)
        focal = np.sqrt(np.where(upright > 0, upright, np.where(alike > 0, alike, np.nan)))
    wide = size[:, 0]
    focal = np.where((focal > wide / 8) & (focal < wide * 8), focal, wide / 2 / np.tan(np.radians(57.0 / 2)))
    rays = moved / np.stack([focal, focal, np.ones(n)], 1)[:, :, None]
    rays *= (2 / (np.linalg.norm(rays[:, :, 0], axis=1) + np.linalg.norm(rays[:, :, 1], axis=1)))[:, None, None]
    for _ in range(2):  # the camera stands above the pitch: else all three vectors point the other way
        axes = np.stack([rays[:, :, 0], rays[:, :, 1], np.cross(rays[:, :, 0], rays[:, :, 1])], 2)
        place = -(np.swapaxes(axes, 1, 2) @ rays[:, :, 2:])[..., 0]
        rays = np.where((place[:, 2] > 0)[:, None, None], -rays, rays)
    ahead = axes[:, 2]
    tilt = np.arcsin(np.clip(ahead[:, 2] / np.linalg.norm(ahead, axis=1), -1, 1))
    start = np.stack([place[:, 0], place[:, 1], np.maximum(0.5, -place[:, 2]), np.arctan2(ahead[:, 1], ahead[:, 0]), tilt, np.arctan2(axes[:, 0, 2], axes[:, 1, 2]), np.log(focal)], 1)
    grid = seen_grid(h, size, (26, 18), 10.0, 0.3, pitch)
    ok = (grid.use.sum(1) >= 8) & np.isfinite(start).all(1)
    start = np.where(ok[:, None], start, [0, 0, 1, 0, 0, 0, 7.0])
    camera = grid_fit(start, grid, slice(0, 7))
    ok &= np.isfinite(camera).all(1) & (camera[:, 2] > 0)
    return np.where(ok[:, None], camera, np.nan), np.where(ok, grid_distance(camera, grid), np.nan)


def plausible_views(h: np.ndarray, station: np.ndarray, size: np.ndarray, pitch: tuple[float, float] = (105.0, 68.0), most_px: float = 25.0, most_m: float = 5.0, most_up: float = 2.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether image-to-pitch matrices fit a camera at a station's place: (ok, camera, mean pixels).

    The place and height are the station's, directions and zoom are fitted: within most_px, 0.4 to 6 times its zoom, rolled by under 15 degrees. Else a
    camera that is fitted freely must stand within most_m metres, and most_up in height. A mirrored pitch is no view.
    """
    grid = seen_grid(h, size, (24, 17), 5.0, 0.0, pitch)
    foot, _ = through(h, (size * [0.5, 0.92])[:, None])
    toward = foot[:, 0] - station[:, :2]
    yaw = np.where(np.isfinite(toward).all(1), np.arctan2(toward[:, 1], toward[:, 0]), station[:, 3])
    n, turns = len(h), np.array([0.0, -0.35, 0.35])
    many = np.repeat(np.arange(n), len(turns))
    start = station[many].copy()
    start[:, 3] = yaw[many] + np.tile(turns, n)
    start[:, 4:6] = 0.0
    tried = grid_fit(start, grid.picked(many), slice(3, 7))
    away = np.nan_to_num(grid_distance(tried, grid.picked(many)), nan=np.inf).reshape(n, -1)
    camera, error = of_best(tried.reshape(n, -1, 7), away), away.min(1)
    zoom = np.exp(camera[:, 6] - station[:, 6])
    view = (np.linalg.det(h) > 0) & (grid.use.sum(1) >= 6)
    ok = view & (error <= most_px) & (zoom >= 0.4) & (zoom <= 6) & (np.abs((camera[:, 5] + np.pi) % (2 * np.pi) - np.pi) < np.radians(15))
    ask = np.flatnonzero(view & ~ok)
    if len(ask):
        other, px = cameras_behind(h[ask], size[ask], pitch)
        with np.errstate(all="ignore"):
            fine = (px <= most_px) & (np.hypot(*(other - station[ask])[:, :2].T) <= most_m) & (np.abs(other[:, 2] - station[ask, 2]) <= most_up)
        camera[ask[fine]], error[ask[fine]], ok[ask[fine]] = other[fine], px[fine], True
    return ok, np.where(view[:, None], camera, np.nan), np.where(view, error, np.nan)


def stacked(column: pd.Series, n: int) -> np.ndarray:
    """An array column as rows of n numbers; null, short or empty arrays are nan."""
    return np.array([np.full(n, np.nan) if v is None or len(v) != n else np.asarray(v, float) for v in column]).reshape(len(column), n)


def with_struct(df: DataFrame, result: str, kind: str, made: Callable[[pd.DataFrame], list], at_once: int = 256) -> DataFrame:
    """All rows and columns of df with a struct that `made` gives for portions of rows."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), at_once):
                g = frame.iloc[lo : lo + at_once].copy()
                g[result] = made(g)
                yield g

    kept = spread(df.drop(result))
    return kept.mapInPandas(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], f"`{result}` {kind}"]))


def inverse_cameras(df: DataFrame, h: str = "h", size: tuple[str, str] = ("width", "height"), result: str = "seen_by", pitch: tuple[float, float] = (105.0, 68.0)) -> DataFrame:
    """All rows and columns with a struct `result`: the camera (PARAMETERS) behind an image-to-pitch matrix and its mean error in pixels, null where there is none. [STA-11]"""

    def made(g: pd.DataFrame) -> list:
        k = stacked(g[h], 9).reshape(-1, 3, 3)
        good = np.isfinite(k).all((1, 2)) & (np.abs(np.nan_to_num(np.linalg.det(np.nan_to_num(k)))) > 1e-300)
        camera, error = np.full((len(g), 7), np.nan), np.full(len(g), np.nan)
        if good.any():
            camera[good], error[good] = cameras_behind(k[good], g[list(size)].to_numpy(float)[good], pitch)
        return [{"camera": None if np.isnan(c).any() else c.tolist(), "error": None if np.isnan(e) else float(e)} for c, e in zip(camera, error, strict=True)]

    return with_struct(df, result, "struct<camera: array<double>, error: double>", made)


def plausible(df: DataFrame, h: str = "h", station: str = "station_camera", size: tuple[str, str] = ("width", "height"), result: str = "view", pitch: tuple[float, float] = (105.0, 68.0)) -> DataFrame:
    """All rows and columns with a struct `result`: whether a matrix fits a camera at the station's place, that camera, its mean error in pixels. [CAL-07]"""

    def made(g: pd.DataFrame) -> list:
        k, at = stacked(g[h], 9).reshape(-1, 3, 3), stacked(g[station], 7)
        good = np.isfinite(k).all((1, 2)) & np.isfinite(at).all(1) & (np.abs(np.nan_to_num(np.linalg.det(np.nan_to_num(k)))) > 1e-300)
        out = [{"ok": False, "camera": None, "error": None} for _ in range(len(g))]
        if good.any():
            rows = np.flatnonzero(good)
            for r, ok, c, e in zip(rows, *plausible_views(k[good], at[good], g[list(size)].to_numpy(float)[good], pitch), strict=True):
                out[r] = {"ok": bool(ok), "camera": None if np.isnan(c).any() else c.tolist(), "error": None if not np.isfinite(e) else float(e)}
        return out

    return with_struct(df, result, "struct<ok: boolean, camera: array<double>, error: double>", made)
