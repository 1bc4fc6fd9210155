"""Queries without an SQL twin, over every row of a table."""

from datetime import datetime, timedelta

import numpy as np

from pixelloom.operators.outlines import detect_page
from pixelloom.plans.catalog import QUERIES
from pixelloom.streaming.tracker import CornerTrack


def test_page_tracks_of_every_user(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i), i % 60, float(i * 37 % 101)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.track_id, r.frame): (r.locked, r.missed, r.x, r.y) for r in QUERIES["q_page_tracks"](spark, str(tmp_path)).collect()}
    want = {}
    for user in range(60):
        track = CornerTrack()
        for frame, (event, _, _, value) in enumerate((r for r in rows if r[2] == user), 1):
            z = value % 20
            measured = np.array([(100, 80), (400, 90), (420, 500), (80, 480)], float) + z
            track.update(measured if event % 7 else None, 1 / 30, 1.0)
            want[str(user), frame] = (track.locked, track.missed, track.p[:, 0].tolist(), track.p[:, 1].tolist())
    assert got.keys() == want.keys()
    for k, (locked, missed, x, y) in want.items():
        assert got[k][:2] == (locked, missed)
        assert np.allclose(got[k][2], x) and np.allclose(got[k][3], y)


def test_page_of_every_image(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.uniform(-0.2, 0.2, 8).tolist()) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.image_id: (r["shape"], r.px, r.py) for r in QUERIES["q_page_detect"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(60))
    base = np.array([10, 10, 90, 10, 90, 90, 10, 90], float)
    y, x = np.mgrid[:48, :60]
    for i, vector in vectors:
        q = (base + 40 * np.array(vector)).reshape(4, 2)
        sides = [((b[0] - a[0]) * (y * 100.0 / 48 - a[1]) - (b[1] - a[1]) * (x * 100.0 / 60 - a[0])) / np.hypot(*(b - a)) for a, b in zip(q, np.roll(q, -1, axis=0))]
        shape, points = detect_page(np.where((np.min(sides, axis=0) >= -0.5) | (np.max(sides, axis=0) <= 0.5), 0.9, 0.1))
        assert got[i] == (shape, points[:, 0].tolist(), points[:, 1].tolist())
