"""Steps that are sequential by definition, as grouped maps over bounded groups (a clip, a match, a keyframe).

Each function works on one group's rows in a stated order, so equal input order gives equal results.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def greedy_pairs(df: DataFrame, keys: list[str], left: str, right: str, score: str, least: float = 0.0) -> DataFrame:
    """One-to-one matching: best score first, each side once. [TOP-06]"""

    def match(g: pd.DataFrame) -> pd.DataFrame:
        g = g[g[score] >= least].sort_values([score, left, right], ascending=[False, True, True])
        a, b, keep = set(), set(), []
        for k, (i, j) in enumerate(zip(g[left], g[right], strict=True)):
            if i not in a and j not in b:
                a.add(i)
                b.add(j)
                keep.append(k)
        return g.iloc[keep]

    return df.groupBy(*keys).applyInPandas(match, df.schema)


def chains(candidates: DataFrame, keys: list[str], first: str, second: str, cost: str) -> DataFrame:
    """Links in order of cost, each track once as a predecessor and once as a successor; then each track's chain root. [TOP-07, STR-05]"""
    kind = dict(candidates.dtypes)[first]

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([cost, first, second])
        ahead, before = {}, {}
        for a, b in zip(g[first], g[second], strict=True):
            if a not in ahead and b not in before:
                ahead[a], before[b] = b, a
        rows = []
        for t in sorted(set(g[first]) | set(g[second])):
            root = t
            while root in before:
                root = before[root]
            rows.append((*[g[k].iloc[0] for k in keys], t, root))
        return pd.DataFrame(rows, columns=[*keys, "track", "root"])

    types = dict(candidates.dtypes)
    return candidates.groupBy(*keys).applyInPandas(assign, ", ".join([*[f"{k} {types[k]}" for k in keys], f"track {kind}", f"root {kind}"]))


def farthest(df: DataFrame, keys: list[str], points: list[str], n: int) -> DataFrame:
    """n rows picked so that each is farthest from those before; the first row first. [TOP-09]"""

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        p = g[points].to_numpy(float)
        chosen, d = [0], np.hypot(*(p - p[0]).T) if len(points) == 2 else np.linalg.norm(p - p[0], axis=1)
        while len(chosen) < min(n, len(p)):
            k = int(d.argmax())
            chosen.append(k)
            d = np.minimum(d, np.linalg.norm(p - p[k], axis=1))
        return g.iloc[chosen]

    return df.groupBy(*keys).applyInPandas(pick, df.schema)


def stations(clips: DataFrame, keys: list[str], east: str, north: str, accuracy: str, time: str, floor_m: float = 6.0, factor: float = 1.5, within_s: float = 1200.0, tie: str | None = None) -> DataFrame:
    """Positions grouped one after the other, in order of time (then of `tie`), around inverse-variance centroids. [STA-07, AGG-24]

    A clip belongs to the nearest centroid within max(floor_m, factor * hypot of its accuracy, two metres at least, ten where unknown, and the
    median of the group's). A clip without a position joins the group nearest in time, else the only group, else one group of all such clips.
    """

    def group(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([time, tie] if tie else [time], kind="stable", na_position="last")
        n, w, cx, cy, acc = 0, *(np.empty(len(g)) for _ in range(4))  # of the first n groups: sum of weights, centroid, accuracy
        members: list[list[float]] = []
        out: list[int | None] = []
        for x, y, a in zip(g[east], g[north], g[accuracy], strict=True):
            if pd.isna(x) or pd.isna(y):
                out.append(None)
                continue
            a = max(float(a) if not pd.isna(a) and a else 10.0, 2.0)
            d = np.hypot(x - cx[:n], y - cy[:n])
            d[d > np.maximum(floor_m, factor * np.hypot(a, acc[:n]))] = np.inf
            best = int(d.argmin()) if n else 0
            if not n or d[best] == np.inf:
                best = n
                w[n], cx[n], cy[n], acc[n] = a**-2, x, y, a
                members.append([a])
                n += 1
            else:
                v = w[best] + a**-2
                cx[best], cy[best], w[best] = (cx[best] * w[best] + x * a**-2) / v, (cy[best] * w[best] + y * a**-2) / v, v
                insort(members[best], a)
                m = members[best]
                acc[best] = (m[len(m) // 2] + m[(len(m) - 1) // 2]) / 2
            out.append(best)
        t = g[time].to_numpy(float)
        known, loose = [i for i, k in enumerate(out) if k is not None], n
        for i, k in enumerate(out):
            if k is None:
                near = min(known, key=lambda j: abs(t[j] - t[i]), default=None) if not np.isnan(t[i]) else None
                if near is not None and abs(t[near] - t[i]) <= within_s:
                    out[i] = out[near]
                else:
                    out[i] = 0 if loose == 1 else loose
        g["station"] = np.array(out, dtype="int32")
        return g

    return clips.groupBy(*keys).applyInPandas(group, ", ".join([*[f"`{c}` {t}" for c, t in clips.dtypes], "station int"]))


def prefix_products(df: DataFrame, keys: list[str], order: str, matrix: str) -> DataFrame:
    """Running products of 3x3 matrices (row-major arrays), each scaled to a last element of one. [WIN-20]"""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order).copy()
        total, out = np.eye(3), []
        for h in g[matrix]:
            total = np.asarray(h, float).reshape(3, 3) @ total
            total = total / (total[2, 2] if abs(total[2, 2]) > 1e-12 else 1.0)
            out.append(total.ravel().tolist())
        g["product"] = out
        return g

    return df.groupBy(*keys).applyInPandas(run, ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], "product array<double>"]))


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The homography that takes src to dst: normalised linear fit by singular values. [STA-10, SFN-42]"""

    def normal(p: np.ndarray) -> np.ndarray:
        c, s = p.mean(0), np.sqrt(2) / max(1e-9, np.sqrt(((p - p.mean(0)) ** 2).sum(1)).mean())
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    a, b = normal(src), normal(dst)
    p, q = (np.c_[x, np.ones(len(x))] @ m.T for x, m in ((src, a), (dst, b)))
    rows = []
    for (x, y, _), (u, v, _) in zip(p, q, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.inv(b) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ a
    return h / h[2, 2]


def homographies(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per keyframe (columns ix, iy, px, py; four points at least) the image-to-pitch homography and its mean error. [STA-10, STA-17]"""
    types = dict(points.dtypes)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "h", "error"]
        if len(g) < 4:
            return pd.DataFrame([], columns=names)
        src, dst = g[["ix", "iy"]].to_numpy(float), g[["px", "py"]].to_numpy(float)
        h = fit_homography(src, dst)
        p = np.c_[src, np.ones(len(src))] @ h.T
        error = float(np.hypot(*(p[:, :2] / p[:, 2:] - dst).T).mean())
        return pd.DataFrame([[*[g[k].iloc[0] for k in keys], h.ravel().tolist(), error]], columns=names)

    return points.groupBy(*keys).applyInPandas(fit, ", ".join([*[f"{k} {types[k]}" for k in keys], "h array<double>", "error double"]))
