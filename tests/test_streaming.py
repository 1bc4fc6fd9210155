import math

import numpy as np
from pyspark.sql import functions as F

from pixelloom.streaming.tracker import CornerTrack, smoothed_points, track_corners, track_corners_stream

BASE = np.array([[100.0, 80], [400, 90], [420, 500], [80, 480]])


def frames(n=31):
    return [BASE + [[2 * math.sin(0.7 * f), 2 * math.cos(0.5 * f)]] * 4 for f in range(n)]


def test_filter_smooths_and_drops_the_lock_after_eight_misses():
    track, raw, smooth = CornerTrack(1000.0), [], []
    for z in frames():
        assert track.update(z, 1 / 30)
        raw.append(z[0, 0])
        smooth.append(track.p[0, 0])
    assert np.std(smooth) < np.std(raw)
    for i in range(8):
        locked = track.update(BASE + 200.0, 1 / 30)
        assert locked == (i < 7)
    assert track.update(BASE, 1 / 30) and track.missed == 0
    track.frozen = True
    before = track.p.copy()
    assert track.update(None, 1.0) and (track.predict(1.0) == before).all()


def rows():
    return [("a", f, 1 / 30, True, 1.0, z[:, 0].tolist(), z[:, 1].tolist()) for f, z in enumerate(frames())] + [("b", f, 1 / 30, f % 3 > 0, 0.5, z[:, 0].tolist(), z[:, 1].tolist()) for f, z in enumerate(frames(9))]


SCHEMA = "track_id string, frame long, dt double, ok boolean, score double, x array<double>, y array<double>"


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    batch = sorted(map(str, track_corners(df).collect()))
    source = str(tmp_path / "in")
    for part in range(3):
        df.where((F.col("frame") >= part * 11) & (F.col("frame") < part * 11 + 11)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    started = track_corners_stream(stream).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    started.awaitTermination()
    assert sorted(map(str, spark.table("tracks").collect())) == batch


def test_fold_equals_the_filter(spark):
    data = [("a", i, float(z[0, 0]), 1 / 30 if i else 0.0) for i, z in enumerate(frames())]
    df = spark.createDataFrame(data, "k string, n long, z double, dt double")
    got = [r.position for r in smoothed_points(df, ["k"], ["n"], F.col("dt"), "z").orderBy("i").collect()]
    track, want = CornerTrack(1000.0), []
    for z in frames():
        track.update(z, 1 / 30)
        want.append(track.p[0, 0])
    assert np.allclose(got, want)
