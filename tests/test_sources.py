import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlight.sources import images, sinks
from gridlight.streaming import ticks


def png(path, a):
    h, w, _ = a.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folder(spark, tmp_path):
    want = {}
    for c, name in enumerate(("b", "a")):
        (tmp_path / "set" / name).mkdir(parents=True)
        for k in range(2):
            a = np.random.default_rng(10 * c + k).integers(0, 256, (6, 5, 3), dtype=np.uint8)
            png(tmp_path / "set" / name / f"{k}.png", a)
            want[name, k] = a
    df = images.image_folder(spark, str(tmp_path / "set"), "*.png")
    rows = df.orderBy("image_id").collect()
    assert [(r.image_id, r.category, r.label) for r in rows] == [(0, "a", 0), (1, "a", 0), (2, "b", 1), (3, "b", 1)]
    assert rows[0].pixels == want["a", 0].tobytes() and rows[3].pixels == want["b", 1].tobytes()
    small = images.resize_nearest(df, 3).orderBy("image_id").first()
    assert len(small.pixels) == 27 and images.unpack(df).select(F.array_max("values").alias("m")).first().m <= 1


def test_digits(spark, tmp_path):
    grid = np.arange(3 * 4, dtype=np.uint8).reshape(3, 2, 2)
    (tmp_path / "i.idx").write_bytes(struct.pack(">IIII", 2051, 3, 2, 2) + grid.tobytes())
    (tmp_path / "l.idx").write_bytes(struct.pack(">II", 2049, 3) + bytes([7, 8, 9]))
    rows = images.digits(spark, str(tmp_path / "i.idx"), str(tmp_path / "l.idx")).orderBy("image_id").collect()
    assert [(r.image_id, r.label, r.pixels) for r in rows] == [(i, 7 + i, grid[i].tobytes()) for i in range(3)]


def test_npy_round_trip(spark, tmp_path):
    tiles = spark.createDataFrame([(f"5_00_0{i}", [float(i)] * 4) for i in range(3)], "name string, v array<double>")
    assert sinks.write_npy(tiles, str(tmp_path / "tiles"), "name", "v", 2, "mask") == 3
    rows = images.npy(spark, str(tmp_path / "tiles")).orderBy("name").collect()
    assert rows[2].name == "5_00_02_mask" and rows[2].shape == [2, 2] and rows[2].data == b"\x02" * 4
    with pytest.raises(FileNotFoundError):
        images.npy(spark, str(tmp_path / "none"))


def test_staging(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data/x.txt", "1")
    assert images.unzip_if_missing(str(tmp_path / "a.zip"), str(tmp_path / "data")) and not images.unzip_if_missing(str(tmp_path / "a.zip"), str(tmp_path / "data"))
    (tmp_path / "env").write_text("KEY_A='v'\n")
    monkeypatch.setenv("KEY_B", "w")
    assert images.config("KEY_A", env_file=str(tmp_path / "env")) == "v" and images.config("KEY_B") == "w" and images.config("KEY_C", "d") == "d"


def test_sinks(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "cache"), "key", make).count() == 3
    assert len(made) == 1
    tiles = spark.createDataFrame([("a", "train"), ("b", "val")], "name string, split string")
    sinks.write_tiles(tiles, str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).where("split = 'val'").first().name == "b"
    sinks.write_history([{"epoch": 0, "loss": 2.0}, {"epoch": 1, "loss": 1.0}], str(tmp_path / "h" / "h.json"))
    assert [tuple(r) for r in sinks.read_history(spark, str(tmp_path / "h" / "h.json"), "r").orderBy("epoch").collect()] == [("r", 0, "loss", 2.0), ("r", 1, "loss", 1.0)]
    sinks.track(spark, str(tmp_path / "track"), "r", {"a": 1}, [("loss", 0, 1.0)])
    sinks.track(spark, str(tmp_path / "track"), "s", {"a": 2}, [("loss", 0, 2.0)])
    assert spark.read.parquet(str(tmp_path / "track/runs")).count() == 2
    assert sinks.train_or_load(str(tmp_path / "m-1"), lambda: {"w": np.ones(2)})["w"].sum() == 2 and sinks.latest(str(tmp_path), "m").endswith("m-1")
    line = sinks.report(spark.createDataFrame([("x", 0.5)], "model string, mse double"), "model", "mse").first().line
    assert line.startswith("x ") and line.endswith("0.50000")


def test_streams(spark, tmp_path):
    q = ticks.ticks(spark, 5).writeStream.format("memory").queryName("ticks").start()
    for _ in range(20):
        q.processAllAvailable()
        if spark.sql("SELECT * FROM ticks").count():
            break
    q.stop()
    assert len(spark.sql("SELECT * FROM ticks").first().line) == 19
    spark.range(5).write.parquet(str(tmp_path / "in"))
    s = ticks.score_stream(spark, str(tmp_path / "in"), "id long", lambda d: d.withColumn("twice", F.col("id") * 2)).writeStream.format("memory").queryName("scores").start()
    s.processAllAvailable()
    s.stop()
    assert sorted(r.twice for r in spark.sql("SELECT * FROM scores").collect()) == [0, 2, 4, 6, 8]
