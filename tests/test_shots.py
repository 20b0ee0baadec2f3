"""Shots: the dribble and strike case with its variants, chances, suggestions and the score."""

import pytest

from trackmill.plans import shots

BALL = "clip_id int, idx int, t double, x double, y double"


def flight(vy, vx=20.0):
    """A dribble to (85, 34), then the ball leaves at vx, vy."""
    rows = [(1, i, i / 10, 81.0 + i * 0.2, 34.0) for i in range(20)]
    return rows + [(1, 20 + i, 2 + i / 10, 85 + vx * i / 10, 34 + vy * i / 10) for i in range(11)]


@pytest.fixture
def owner(spark):
    return spark.createDataFrame([(1, "p7", 0, 0.0, 1.9)], "clip_id int, entity string, team int, t0 double, t1 double")


def test_shot_on_target(spark, owner):
    (r,) = shots.detected(spark.createDataFrame(flight(0.0), BALL), owner).collect()
    assert abs(r["t"] - 2) < 0.2 and r["on_target"] and r["speed_kmh"] >= 70 and r["entity"] == "p7" and r["ball_at_line"]


def test_wide_and_slow(spark, owner):
    (r,) = shots.detected(spark.createDataFrame(flight(8.0), BALL), owner).collect()
    assert not r["on_target"]
    assert shots.detected(spark.createDataFrame(flight(0.0, 6.0), BALL), owner).count() == 0


def test_chance_and_suggestions(spark, owner):
    found = shots.detected(spark.createDataFrame(flight(0.0), BALL), owner)
    cheer = spark.createDataFrame([(1, "cheer", 3.5)], "clip_id int, kind string, t double")
    assert [r["chance"] for r in shots.with_chance(found, cheer).collect()] == ["likely"]
    known = spark.createDataFrame([(1, 2.5)], "clip_id int, t double")
    rated = shots.with_chance(found, cheer)
    assert shots.suggestions(rated, known).count() == 0 and shots.suggestions(rated, known.where("t > 9")).count() == 1


def test_score(spark):
    cols = "id int, match_id int, status string, goal boolean, on_target boolean, team int, player_id int, period int, minute double"
    rows = [(1, 1, "confirmed", True, True, None, 7, 1, 10.0), (2, 1, "rejected", True, True, 1, None, 1, 20.0), (3, 1, "confirmed", False, True, 1, None, 2, 50.0)]
    players = spark.createDataFrame([(7, 0)], "id int, team int")
    got = {r["side"]: (r["shots"], r["goals"]) for r in shots.totals(spark.createDataFrame(rows, cols), players).collect()}
    assert got == {0: (1, 1), 1: (1, 0)}
    line = shots.timeline(spark.createDataFrame([(1, 1, "confirmed", True, True, 0, 7, 1, 10.0), (2, 1, "confirmed", True, True, 1, 8, 2, 60.0)], cols)).orderBy("id").collect()
    assert [(r["score0"], r["score1"]) for r in line] == [(1, 0), (1, 1)]
