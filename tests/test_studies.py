import numpy as np
from pyspark.sql import functions as F

from gridlight import cli
from gridlight.operators import metrics, nets, reservoir, tiles
from gridlight.plans import studies


def test_denoising_study(spark):
    rng = np.random.default_rng(0)
    base = rng.random((3, 36))
    x = np.clip(base[rng.integers(0, 3, 120)] + rng.normal(0, 0.02, (120, 36)), 0, 1)
    df = spark.createDataFrame([(i, i % 3, row.tolist()) for i, row in enumerate(x)], "image_id long, label int, pixels array<double>")
    out = studies.denoise(df, 6, 6, reservoir.Config(atoms=3, steps=2), 0.3, 5, (16, 36), rate=5e-3, epochs=30, drop=0.0)
    got = {r.model: r for r in out.collect()}
    assert set(got) == {"clean", "noisy", "linear", "baseline", "hybrid"} and got["clean"].mse == 0
    assert got["linear"].mse < got["noisy"].mse and got["hybrid"].mse < 0.2


def pair(rng, n=40):
    colours = np.array([p[2:] for p in tiles.PALETTE], np.uint8)
    mask = colours[rng.integers(0, 7, (n, n))]
    return rng.integers(0, 256, (n, n, 3), dtype=np.uint8), mask


def test_tiling_study(spark):
    rng = np.random.default_rng(1)
    pairs = [pair(rng) for _ in range(7)]
    rows = [(f"im{i}", 40, 40, a.tobytes(), m.tobytes() if i else None) for i, (a, m) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "img_id string, h int, w int, rgb binary, mask_rgb binary")
    grid = studies.prepare_tiles(df, 16, 9)
    assert grid.count() == 7 * 4 and all(r.complete for r in studies.tile_counts(grid, 4).collect())
    one = grid.where("name = 'im3_01_00'").first()
    assert one.sat == pairs[3][0][16:32, :16].tobytes() and one["mask"] == studies.decode_mask(pairs[3][1])[16:32, :16].tobytes()
    assert grid.where("mask IS NULL").count() == 4 and grid.where("split = 'val'").select("img_id").distinct().count() == 1
    small = studies.prepare_tiles(df, 6, 9, downsample=True)
    assert small.count() == 28 and small.where("img_id = 'im1' AND r = 1 AND c = 1").first().sat == studies.shrink(pairs[1][0], None, 4)[0][4:, 4:].tobytes()
    matrix = studies.score_segmentation(grid, lambda sats: [np.zeros(256, int) for _ in sats])
    truth = np.concatenate([studies.decode_mask(m)[:32, :32].ravel() for _, m in pairs[1:]])
    got = {r.truth: r.n for r in matrix.collect()}
    assert got == {c: int((truth == c).sum()) for c in range(7)}
    assert 0 < metrics.mean_iou(matrix).first()[0] < 1


def test_shrink_matches_the_long_form(spark):
    rng = np.random.default_rng(2)
    image, mask = pair(rng, 8)
    ids = studies.decode_mask(mask)
    small, votes = studies.shrink(image, ids, 4)
    px = spark.createDataFrame([(1, y, x, int(ids[y, x])) for y in range(8) for x in range(8)], "id long, y int, x int, class_id int")
    got = {(r.by, r.bx): r.class_id for r in tiles.majority_vote(px, 4, "id").collect()}
    assert got == {(y, x): int(votes[y, x]) for y in range(2) for x in range(2)}
    red = spark.createDataFrame([(1, y, x, float(image[y, x, 0])) for y in range(8) for x in range(8)], "id long, y int, x int, value double")
    assert {(r.by, r.bx): r.value for r in tiles.box_downsample(red, 4, 8, 8, "id").collect()} == {(y, x): float(small[y, x, 0]) for y in range(2) for x in range(2)}


def test_classification_study(spark):
    x = np.random.default_rng(3).random((40, 8 * 8 * 3))
    df = spark.createDataFrame([(i, i % 4, row.tolist()) for i, row in enumerate(x)], "image_id long, label int, values array<double>")
    scored, accuracy = studies.classify(df, nets.ConvNet.create(8, (4, 8), 16, 4))
    assert scored.count() == 8 and 0 <= accuracy.first()[0] <= 1
    assert scored.select(F.aggregate("probs", F.lit(0.0), lambda a, b: a + b).alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_command_line_defaults():
    a = cli.parser().parse_args(["prepare", "--images", "i", "--out", "o"])
    assert (a.tile_size, a.n_tiles, a.downsample, a.workers) == (256, 9, False, None)
    b = cli.parser().parse_args(["segment", "--history", "h"])
    assert (b.epochs, b.batch_size, b.lr, b.lr_factor, b.lr_patience, b.es_patience, b.seed) == (50, 8, 1e-4, 0.5, 5, 10, 42)


def test_digits_study(spark):
    rng = np.random.default_rng(5)
    base = rng.random((4, 144))
    x = np.clip(base[rng.integers(0, 4, 90)] + rng.normal(0, 0.02, (90, 144)), 0, 1)
    df = spark.createDataFrame([(i, i % 4, row.tolist()) for i, row in enumerate(x)], "image_id long, label int, pixels array<double>")
    out, net = studies.digits(df.where("image_id < 70"), df.where("image_id >= 70"), 12, 0.3, 4, (32, 144), batch=16, epochs=15, rate=5e-3, drop=0.0)
    got = {r.model: r for r in out.collect()}
    assert set(got) == {"clean", "noisy", "linear", "network"} and got["network"].mse < got["noisy"].mse and got["network"].ssim > got["noisy"].ssim
    assert net.history[0]["val_loss"] > net.history[-1]["val_loss"] and net.weights[0].shape == (4, 32)


def test_classifier_learns(spark):
    rng = np.random.default_rng(6)
    x = rng.random((120, 8, 8, 3)) * 0.2
    for i in range(120):
        x[i, :, :, i % 3] += 0.6
    df = spark.createDataFrame([(i, i % 3, row.ravel().tolist()) for i, row in enumerate(x)], "image_id long, label int, values array<double>")
    net = studies.train_classifier(df, nets.ConvNet.create(8, (4, 8), 16, 3), epochs=4, batch=16)
    assert [set(h) for h in net.history] == [{"epoch", "loss", "accuracy", "val_loss", "val_accuracy", "rate"}] * 4
    assert studies.classify(df, net)[1].first()[0] > 0.9


def test_segmentation_learns(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(24):
        mask = np.zeros((8, 8), np.uint8)
        mask[:, rng.integers(2, 7) :] = 1
        image = np.where(mask[..., None] == 1, [200, 40, 40], [20, 160, 60]) + rng.integers(0, 30, (8, 8, 3))
        rows.append((f"t{i:02}_00_00", "val" if i % 4 == 0 else "train", image.astype(np.uint8).tobytes(), mask.tobytes() if i != 5 else None))
    tiles_table = spark.createDataFrame(rows, "name string, split string, sat binary, mask binary")
    net = studies.train_segmentation(tiles_table, nets.SegNet.create(8, (4, 6), 2, drop=0.1), 4, rate=2e-2, epochs=6)
    assert len(net.history) == 6 and max(h["val_miou"] for h in net.history) > 0.8
    assert {"val_iou_0", "val_accuracy", "rate", "loss"} <= set(net.history[0])


def test_readout_pairs_rows_by_id(spark, tmp_path, capsys):
    rng = np.random.default_rng(8)
    x = rng.random((50, 3))
    for name, values, order in (("x", x, range(50)), ("y", x[:, :2], reversed(range(50)))):
        spark.createDataFrame([(i, values[i].tolist()) for i in order], "image_id long, v array<double>").repartition(3).write.parquet(str(tmp_path / name))
    paths = [f"--{k}={tmp_path / k[0]}" for k in ("x", "y", "xval", "yval")]
    cli.main(["readout", *paths, f"--out={tmp_path / 'net'}", "--epochs=20", "--lr=0.03", "--dropout=0", "--batch=16"], hidden=(16,))
    last = eval(capsys.readouterr().out.strip().splitlines()[-1])
    assert last["val_loss"] < 0.01 and (tmp_path / "net" / "arrays.npz").exists()
