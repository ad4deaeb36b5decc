import wave

import numpy as np
from pyspark.sql import functions as F

from groundwork.operators.regimes import Tracker, regimes, segments
from groundwork.sources import files
from groundwork.streaming.regimes import track


def test_readers(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(2, 3))
    assert [r.v for r in files.npy_series(spark, str(tmp_path / "a.npy")).orderBy("i").collect()] == [0, 1, 2, 3, 4, 5]
    with wave.open(str(tmp_path / "b.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[0, 16384], [-32768, -32768]], "<i2").tobytes())
    assert [r.v for r in files.wav_series(spark, str(tmp_path / "b.wav")).orderBy("i").collect()] == [0.25, -1.0]
    (tmp_path / "c.csv").write_text('x,y\n1,"a\nb"\n,c\nz,d\n2.5,e\n')
    assert [r.v for r in files.csv_series(spark, str(tmp_path / "c.csv"), "x").collect()] == [1.0, None, None, 2.5]
    (tmp_path / "d.net").write_text('*Vertices 2\n1 "Ann"\n2 "Bo B"\n*Edges\n1 2 3\n2 1\n')
    assert sorted((r.source, r.target, r.weight) for r in files.pajek_edges(spark, str(tmp_path / "d.net")).collect()) == [("Ann", "Bo B", 3.0), ("Bo B", "Ann", 1.0)]
    assert files.texts(spark, str(tmp_path / "d.net")).first().text.startswith("*Vertices")


def _rows():
    r = np.random.default_rng(3)
    return [(sid, i, float(v)) for sid in (1, 2) for i, v in enumerate(np.concatenate([r.normal(0, 1, 60), r.normal(30 * sid, 1, 60)]))]


def test_regimes_find_the_shift(spark):
    s = spark.createDataFrame(_rows(), "sid long, i long, v double")
    tracked = regimes(s, reach=6.0)
    assert {(r.sid, r.i) for r in tracked.filter("fresh").collect()} == {(1, 60), (2, 60)}
    assert segments(tracked).count() == 4
    want, t = {}, Tracker()
    for sid, i, v in [x for x in _rows() if x[0] == 1]:
        want[i] = t.step(v, 6.0, 8)[0]
    assert {r.i: r.regime for r in tracked.filter("sid = 1").collect()} == want


def test_stream_equals_batch(spark, tmp_path):
    rows = _rows()
    spark.createDataFrame([x for x in rows if x[1] < 70], "sid long, i long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sid long, i long, v double").parquet(str(tmp_path / "in"))
    q = track(stream, reach=6.0).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame([x for x in rows if x[1] >= 70], "sid long, i long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    batch = regimes(spark.createDataFrame(rows, "sid long, i long, v double"), reach=6.0)
    key = lambda df: sorted(map(tuple, df.select("sid", "i", "regime", F.col("fresh").cast("int")).collect()))
    assert key(spark.table("tracked")) == key(batch)


def test_stream_leaves_late_rows_out(spark, tmp_path):
    rows = [(1, i, float(i % 5) + (40.0 if i > 30 else 0.0)) for i in range(60)]
    parts = [rows[:20], rows[25:40], rows[20:25] + rows[40:]]
    for part in parts:
        spark.createDataFrame(part, "sid long, i long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("sid long, i long, v double").parquet(str(tmp_path / "in"))
        q = track(stream, reach=6.0).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
    got = {r.i: (r.regime, r.fresh) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    in_time = spark.createDataFrame(rows[:20] + rows[25:], "sid long, i long, v double")
    assert got == {r.i: (r.regime, r.fresh) for r in regimes(in_time, reach=6.0).collect()} and len(got) == 55
