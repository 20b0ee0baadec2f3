"""Queries that SQL can't express, against plain versions of their results."""

import collections

import numpy as np
import pandas as pd
import pytest

from trackmill.plans import catalogue

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def events():
    e = pd.read_parquet(f"{SF}/events.parquet")
    return pd.DataFrame({"id": e.event_id, "user": e.user_id, "kind": e.event_type, "us": e.ts.astype("datetime64[us]").astype("int64"), "v": (e.value * 100).round().astype("int64")})


@pytest.fixture(scope="module")
def vectors():
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    return e.vec_id.to_numpy(), e.label.to_numpy(), np.stack(e.embedding).astype(float)


def rows(spark, name):
    return catalogue.queries()[name](spark, SF).collect()


def test_suppression(spark, events):
    want = set()
    for (user, kind), g in events[events.v > 5000].groupby(["user", "kind"]):
        kept = []
        for r in g.sort_values(["v", "us", "id"], ascending=[False, True, True]).itertuples():
            if all(abs(r.us - u) >= 24 * HOUR for u in kept):
                kept.append(r.us)
                want.add((user, kind, r.us, r.v, r.id))
    assert {(r["user_id"], r["kind"], r["us"], r["v"], r["event_id"]) for r in rows(spark, "greedy_nms")} == want and want


def test_means_and_similarities(spark, vectors):
    ids, labels, x = vectors
    w = np.minimum(ids + 1, 200)
    got = {r["label"]: np.array(r["mean"]) for r in rows(spark, "weighted_mean_vector")}
    assert set(got) == {label for label, n in collections.Counter(labels).items() if n >= 3}
    for label, m in got.items():
        assert np.allclose(m, np.average(x[labels == label], axis=0, weights=w[labels == label]))
    means = {label: x[labels == label].mean(0) for label in set(labels)}
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    pairs = {r["vec_id"]: r["similarity"] for r in rows(spark, "similar_pairs")}
    assert pairs == pytest.approx({i: cos(v, means[label]) for i, label, v in zip(ids, labels, x, strict=True)})
    want = {}
    for i, v in zip(ids, x, strict=True):
        best = sorted(((cos(v, m), -label) for label, m in means.items()), reverse=True)
        if best[0][0] >= 0.35 and best[0][0] - (best[1][0] if len(best) > 1 else 0) >= 0.02:
            want[i] = -best[0][1]
    assert {r["vec_id"]: r["guess"] for r in rows(spark, "cosine_top1_margin")} == want


def test_centroids(spark, events):
    got = {r["user_id"]: r for r in rows(spark, "weighted_centroid")}
    for user, g in events.groupby("user"):
        w = 1 / np.maximum(g.v, 1.0)
        assert (got[user]["x"], got[user]["y"], got[user]["precision"]) == pytest.approx((np.average(g.us % 1000, weights=w), np.average(g.v, weights=w), 1 / np.sqrt(w.sum())))


def test_sketches_are_near(spark, events):
    for r in rows(spark, "sketched_counts"):
        g = events[events.kind == r["kind"]]
        assert abs(r["users"] - g.user.nunique()) <= 0.1 * g.user.nunique() + 1
        assert g.v.quantile(0.45) <= r["median"] <= g.v.quantile(0.55)


def test_chains(spark, events):
    want = {}
    for user, g in events.sort_values(["us", "id"]).groupby("user"):
        runs = []
        for r in g.itertuples():
            if runs and runs[-1]["kind"] == r.kind:
                runs[-1].update(t1=r.us, n=runs[-1]["n"] + 1)
            else:
                runs.append({"kind": r.kind, "t0": r.us, "t1": r.us, "n": 1, "tie": r.id})
            runs[-1]["tie"] = min(runs[-1]["tie"], r.id)
        runs = [r for r in runs if r["n"] >= 2]
        pairs = sorted((b["t0"] - a["t1"], a["tie"], b["tie"]) for a in runs for b in runs if a["kind"] == b["kind"] and 0 < b["t0"] - a["t1"] <= 24 * HOUR)
        after, before = {}, {}
        for _, a, b in pairs:
            if a not in after and b not in before:
                after[a], before[b] = b, a
        for t in {x for p in pairs for x in p[1:]}:
            root = t
            while root in before:
                root = before[root]
            want[user, t] = root
    assert {(r["user_id"], r["track"]): r["root"] for r in rows(spark, "stitched_chains")} == want


def test_clusters_hold_what_is_near(spark, vectors):
    ids, _, x = vectors
    of = {r["vec_id"]: r["prediction"] for r in rows(spark, "kmeans_partition")}
    at = np.array([of[i] for i in ids])
    centres = np.stack([x[at == k].mean(0) for k in sorted(set(at))])
    near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (np.array(sorted(set(at)))[near] == at).mean() > 0.95
