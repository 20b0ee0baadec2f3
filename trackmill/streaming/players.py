"""Players followed from box to box: one step over a table of live tracks, as a grouped map over whole clips and as a stream with the tracks as its state.

Rows of boxes: clip_id, idx (frame), det (number within the frame), x1, y1, x2, y2, conf, lab (shirt colour, three numbers or null), motion (the camera's from
the frame before, nine numbers or null: none). A frame without boxes comes as a row whose x1 is null, so that time passes for tracks that are lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: Confidence of boxes that begin tracks and of those that only go on with one; least score of a match of each; frames seen before a track counts (fixed values).
SURE, WEAK, LEAST_SURE, LEAST_WEAK, HITS = 0.4, 0.15, 0.2, 0.3, 3
COLUMNS = "clip_id long, idx int, det int, track_id int, x1 double, y1 double, x2 double, y2 double, conf double"
#: A live track: box, how it moves in a frame, times seen, frames lost, shirt colour.
TRACK = ["x1", "y1", "x2", "y2", "vx1", "vy1", "vx2", "vy2", "hits", "lost", "l", "a", "b"]
TRACK_KEY, TRACK_ROW = "id int", ", ".join(f"{c} double" for c in TRACK)
BOX, SPEED, SEEN, LOST, LAB = slice(0, 4), slice(4, 8), 8, 9, slice(10, 13)


def with_camera(boxes: np.ndarray, motion: np.ndarray) -> np.ndarray:
    """Boxes moved with the camera: foot and head through its motion, the width with the height."""
    middle = (boxes[:, 0] + boxes[:, 2]) / 2
    ends = np.stack([np.stack([middle, boxes[:, 3], np.ones(len(boxes))], 1), np.stack([middle, boxes[:, 1], np.ones(len(boxes))], 1)]) @ motion.reshape(3, 3).T
    foot, head = ends[..., :2] / ends[..., 2:]
    wide = (boxes[:, 2] - boxes[:, 0]) * np.maximum(1.0, foot[:, 1] - head[:, 1]) / np.maximum(1.0, boxes[:, 3] - boxes[:, 1])
    return np.stack([foot[:, 0] - wide / 2, head[:, 1], foot[:, 0] + wide / 2, foot[:, 1]], 1)


def likeness(expected: np.ndarray, lost: np.ndarray, labs: np.ndarray, boxes: np.ndarray, box_labs: np.ndarray) -> np.ndarray:
    """How well each box (columns) goes on with each track (rows), 0 to 1: overlap or nearness of feet in body heights, like size, like shirt where both are known."""
    a, b = expected[:, None], boxes[None]
    side = np.maximum(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0)
    both = side.prod(-1)
    area = lambda r: (r[..., 2:] - r[..., :2]).prod(-1)
    share = both / (area(a) + area(b) - both + 1e-9)
    tall = np.maximum(1.0, a[..., 3] - a[..., 1])
    feet = np.hypot((a[..., 0] + a[..., 2] - b[..., 0] - b[..., 2]) / 2, a[..., 3] - b[..., 3])
    reach = 0.35 * tall * (1 + 0.5 * np.minimum(lost, 10))[:, None]
    size = np.log(np.maximum(1.0, b[..., 3] - b[..., 1]) / tall) / 0.25
    colour = np.linalg.norm((labs[:, None] - box_labs[None]) * [0.5, 1, 1], axis=-1) / 12
    shirt = np.where(np.isnan(colour), 1.0, 0.1 + 0.9 * np.exp(-0.5 * np.nan_to_num(colour) ** 2))
    return np.maximum(share, np.exp(-0.5 * (feet / reach) ** 2)) * np.exp(-0.5 * size**2) * shirt


def best_first(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """One-to-one pairs in order of score, from `least` on; of equal ones the first track, then the first box."""
    rows, cols = np.nonzero(score >= least)
    taken_r, taken_c, out = set(), set(), []
    for k in np.lexsort((cols, rows, -score[rows, cols])):
        r, c = int(rows[k]), int(cols[k])
        if r not in taken_r and c not in taken_c:
            taken_r.add(r)
            taken_c.add(c)
            out.append((r, c))
    return out


def next_frame(ids: np.ndarray, live: np.ndarray, fresh: int, boxes: np.ndarray, most_lost: int, motion: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Tracks after a frame's boxes (rows x1..y2, conf, l, a, b): ids, table, next id, and the track of each box (0: none that counts yet).

    Sure boxes are matched first, weak ones with the tracks that are left. A track that isn't seen goes on as it moved, slower each frame, and ends when lost for
    too long, or at once if it was never seen often enough to count. Sure boxes without a track begin one.
    """
    live = live.copy()
    if motion is not None and len(live):
        live[:, BOX] = with_camera(live[:, BOX], motion)
    expected, before = live[:, BOX] + live[:, SPEED], live.copy()
    track_of = np.zeros(len(boxes), int)
    free, used = np.ones(len(live), bool), np.zeros(len(boxes), bool)
    sure = boxes[:, 4] >= SURE
    for kind, least in ((sure, LEAST_SURE), (~sure & (boxes[:, 4] >= WEAK), LEAST_WEAK)):
        t, d = np.flatnonzero(free), np.flatnonzero(kind)
        for i, j in best_first(likeness(expected[t], before[t, LOST], live[t, LAB], boxes[d, :4], boxes[d, 5:8]), least) if len(t) and len(d) else []:
            r, b = t[i], d[j]
            free[r], used[b] = False, True
            live[r, SPEED] = 0.6 * before[r, SPEED] + 0.4 * (boxes[b, :4] - before[r, BOX]) / (before[r, LOST] + 1)
            live[r, BOX], live[r, LOST] = boxes[b, :4], 0
            live[r, SEEN] += 1
            lab = boxes[b, 5:8]
            if not np.isnan(lab).any():
                live[r, LAB] = lab if np.isnan(live[r, LAB]).any() else 0.85 * live[r, LAB] + 0.15 * lab
            if live[r, SEEN] >= HITS:
                track_of[b] = ids[r]
    live[free, LOST] += 1
    live[free, BOX] = expected[free]
    live[free, SPEED] *= 0.5
    new = np.flatnonzero(sure & ~used)
    rows = np.zeros((len(new), len(TRACK)))
    rows[:, BOX], rows[:, SEEN], rows[:, LAB] = boxes[new, :4], 1, boxes[new, 5:8]
    stays = (live[:, LOST] <= most_lost) & ~((live[:, LOST] > 0) & (live[:, SEEN] < HITS))
    ids = np.concatenate([ids[stays], np.arange(fresh, fresh + len(new))]).astype(int)
    return ids, np.concatenate([live[stays], rows]), fresh + len(new), track_of


def followed(rows: pd.DataFrame, ids: np.ndarray, live: np.ndarray, fresh: int, most_lost: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, int]:
    """The boxes of a clip's next frames that belong to a track, and the tracks after them."""
    parts = []
    for _, g in rows.sort_values(["idx", "det"]).groupby("idx", sort=True):
        m = next((x for x in g["motion"] if x is not None), None)
        motion = None if m is None or np.allclose(np.asarray(m, float), np.eye(3).ravel()) else np.asarray(m, float)
        g = g[g["x1"].notna()]
        labs = np.array([[np.nan] * 3 if x is None else x for x in g["lab"]], float).reshape(-1, 3)
        boxes = np.concatenate([g[["x1", "y1", "x2", "y2", "conf"]].to_numpy(float), labs], 1)
        ids, live, fresh, track_of = next_frame(ids, live, fresh, boxes, most_lost, motion)
        parts.append(g.assign(track_id=track_of)[track_of > 0])
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    out = pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)
    return out.astype({"idx": "int32", "det": "int32", "track_id": "int32"}), ids, live, fresh


def longest_lost(fps: float, seconds: float = 2.0) -> int:
    return max(1, round(seconds * fps))


def player_tracks(boxes: DataFrame, fps: float) -> DataFrame:
    """The track of each box, where it has one. A group is a clip. [STR-02, SFN-05, SFN-06, SFN-38]"""
    most = longest_lost(fps)
    return boxes.groupBy("clip_id").applyInPandas(lambda g: followed(g, np.zeros(0, int), np.zeros((0, len(TRACK))), 1, most)[0], COLUMNS)


class Players(StatefulProcessor):
    """The live tracks of each clip, as a map from their number, and the next number."""

    def __init__(self, most_lost: int) -> None:
        self.most_lost = most_lost

    def init(self, handle) -> None:
        self.tracks = handle.getMapState("tracks", TRACK_KEY, TRACK_ROW)
        self.fresh = handle.getValueState("fresh", "id int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = sorted((k[0], tuple(v)) for k, v in self.tracks.iterator()) if self.fresh.exists() else []
        ids = np.array([k for k, _ in found], int)
        live = np.array([[np.nan if x is None else x for x in v] for _, v in found], float).reshape(-1, len(TRACK))
        fresh = self.fresh.get()[0] if self.fresh.exists() else 1
        out, now, live, fresh = followed(pd.concat(list(rows)), ids, live, fresh, self.most_lost)
        for k in set(ids.tolist()) - set(now.tolist()):
            self.tracks.removeKey((int(k),))
        for k, v in zip(now, live, strict=True):
            self.tracks.updateValue((int(k),), tuple(None if np.isnan(x) else float(x) for x in v))
        self.fresh.update((int(fresh),))
        yield out

    def close(self) -> None:
        pass


def player_stream(boxes: DataFrame, fps: float) -> DataFrame:
    """The same over a stream: however frames are cut into batches, in their order and whole, the result is that of the clip at once.

    Only live tracks are kept, some dozens a clip; they change with each batch. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass). [STR-01, STR-02]
    """
    return boxes.groupBy("clip_id").transformWithStateInPandas(Players(longest_lost(fps)), COLUMNS, "Append", "None")
