import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlight.functions import names, pixels
from gridlight.operators import history, metrics, nets, noise, pca, ranking, reservoir, scaling, splits, tiles, training
from gridlight.operators.ranking import global_rank
from gridlight.sources import images as image_sources


def frame(spark, vectors, **more):
    rows = [(i, [float(x) for x in v], *[m[i] for m in more.values()]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {n} {'string' if isinstance(m[0], str) else 'long'}" for n, m in more.items()))


def test_gray_weights_and_channels(spark):
    df = frame(spark, [[1, 0, 0, 0, 1, 0, 0, 0, 1]])
    r = df.select(pixels.grayscale(F.col("v")).alias("g"), pixels.bgr_to_rgb(F.col("v")).alias("b"), pixels.replicate(F.col("v")).alias("r")).first()
    assert r.g == [0.299, 0.587, 0.114] and r.b[:3] == [0, 0, 1] and r.r[:6] == [1, 1, 1, 0, 0, 0]


def test_shapes_and_clip(spark):
    df = frame(spark, [[-1, 0.5, 2, 1]])
    r = df.select(pixels.to_rows(F.col("v"), 2).alias("r"), pixels.head_padded(F.col("v"), 2, 4).alias("h"), pixels.argmax(F.col("v")).alias("a")).first()
    assert r.r == [[0, 0.5], [1, 1]] and r.h == [-1, 0.5, 0, 0] and r.a == 2
    assert df.select(pixels.argmax(F.array(F.lit(3), F.lit(3))).alias("a")).first().a == 0


def test_constant_column_and_unseen_values(spark):
    rows = [[float(i), 5.0] for i in range(10)]
    df = frame(spark, rows)
    stats = scaling.column_stats(df, "v")
    unseen = frame(spark, [[20.0, 9.0], [9.0, 5.0]])
    got = [r.scaled for r in scaling.minmax(unseen, "v", stats).orderBy("id").collect()]
    assert got[0][0] == 1 and got[0][1] == 1 and got[1][1] == 0 and 0 < 1 - got[1][0] < 1e-8
    z = [r.scaled for r in scaling.standardise(unseen, "v", stats).orderBy("id").collect()]
    assert z[0][1] == 4 and math.isclose(z[1][0], (9 - 4.5) / np.std(range(10)))
    assert math.isclose(scaling.column_stats(df, "v", sample=True).std[0], np.std(range(10), ddof=1))


def test_noise_does_not_depend_on_partitions(spark):
    df = frame(spark, np.random.default_rng(0).random((20, 16)))
    one, seven = (noise.speckle(df.repartition(n), "id", "v", 0.7).orderBy("id").collect() for n in (1, 7))
    assert one == seven and all(0 <= x <= 1 for r in one for x in r.noisy)
    assert noise.speckle(df, "id", "v", 0.0).first().noisy == df.first().v


def test_augment_moves_image_and_mask_alike():
    mask = np.arange(16, dtype=np.uint8).reshape(4, 4)
    image = np.stack([mask] * 3, axis=-1)
    for seed in range(20):
        i, m = noise.augment_arrays(image, mask, np.random.default_rng(seed), False)
        assert (i[..., 0] == m).all() and sorted(m.ravel()) == list(range(16))
        j, n = noise.augment_arrays(image, mask, np.random.default_rng(seed), True)
        assert j.dtype == np.uint8 and (n == m).all()


def test_splits_are_exact_disjoint_and_stable(spark):
    df = spark.range(503).select(F.col("id"), (F.col("id") % 7).alias("label"))
    a = splits.stratified_split(df.repartition(1), "id", "label").orderBy("id").collect()
    assert a == splits.stratified_split(df.repartition(7), "id", "label").orderBy("id").collect() and len(a) == 503
    n = {s: sum(r.split == s for r in a) for s in ("train", "val", "test")}
    assert n["val"] + n["test"] == math.ceil(0.2 * 503) and n["test"] == math.ceil(0.5 * (n["val"] + n["test"]))


def test_group_split_and_legacy_grouping(spark):
    df = spark.range(100).select((F.col("id") % 20).alias("g"), F.col("id"))
    out = splits.group_split(df, "g")
    assert out.where("split = 'val'").select("g").distinct().count() == 3 and splits.leaks(out, "g").count() == 0
    r = spark.range(1).select(names.group_of(F.lit("100694_00_01_sat.npy"), True).alias("a"), names.group_of(F.lit("100694_00_01_sat.npy")).alias("b")).first()
    assert (r.a, r.b) == ("100694_00", "100694")


def test_ranks(spark):
    df = spark.range(11)
    assert [r.id for r in splits.evenly_spaced(df, 10, "id").orderBy("nth").collect()] == list(range(10))
    assert [r.pos for r in global_rank(df.repartition(5), "id").orderBy("id").collect()] == list(range(11))
    assert splits.sample_n(df, 4, "id", 1).count() == 4 and splits.every_kth(df, 2, 3, "id").count() == 6
    assert sorted(r.id for r in splits.shuffled(df, "id", 1, 3).collect()) == list(range(11))


def test_pca_against_numpy(spark):
    x = np.random.default_rng(1).random((60, 8)) @ np.random.default_rng(2).random((8, 8))
    df = frame(spark, x).repartition(3)
    m = pca.fit(df, "v", 8)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(m.ratio, values / values.sum()) and np.allclose(m.components @ m.components.T, np.eye(8))
    assert (m.components[np.arange(8), np.abs(m.components).argmax(1)] > 0).all()
    back = m.inverse(m.transform(df, "v"), "scores").orderBy("id").collect()
    assert np.allclose([r.rebuilt for r in back], x)
    part = pca.PCAModel(m.components, m.mean, m.ratio)
    three = part.inverse(part.transform(df, "v", k=3), "scores").orderBy("id").collect()
    c = m.components[:3]
    assert np.allclose([r.rebuilt for r in three], (x - m.mean) @ c.T @ c + m.mean)
    assert math.isclose(pca.explained(spark, m).agg(F.max("cumulative")).first()[0], 1)


def test_tiles(spark):
    df = spark.createDataFrame([(100, list(range(81)))], "id long, v array<int>")
    grid = tiles.grid_tiles(df, "v", 9, 9, 4, "id").orderBy("name").collect()
    assert [r.name for r in grid] == ["100_00_00", "100_00_01", "100_01_00", "100_01_01"] and grid[3].tile[0] == 4 * 9 + 4
    corner = tiles.corner_tiles(df, "v", 9, 9, 4, "id").orderBy("name").collect()
    assert len(corner) == 4 and corner[3].tile[-1] == 80 and corner[0].tile == grid[0].tile
    assert tiles.grid_tiles(spark.createDataFrame([(1, [0] * 81)], "id long, v array<int>"), "v", 9, 9, 1, "id").count() == 81


def test_majority_tie_goes_to_the_smallest(spark):
    label = [[0 if (y + x) % 2 else 5 for x in range(4)] for y in range(4)]
    px = spark.createDataFrame([(1, y, x, label[y][x]) for y in range(4) for x in range(4)], "id long, y int, x int, class_id int")
    assert tiles.majority_vote(px, 4, "id").first().class_id == 0


def test_palette_round_trip_and_unmatched(spark):
    px = tiles.encode(spark.range(7).select(F.col("id").cast("int").alias("class_id"))).withColumnRenamed("class_id", "was")
    assert all(r.was == r.class_id and r.matched for r in tiles.decode(px).collect())
    lost = tiles.decode(spark.createDataFrame([(1, 2, 3)], "r int, g int, b int")).first()
    assert lost.class_id == 0 and not lost.matched


def test_image_scores(spark):
    x = np.random.default_rng(3).random((3, 16, 16))
    assert np.allclose(metrics.ssim_images(x, x), 1) and (metrics.ssim_images(x, 1 - x) < 0.5).all()
    flat = frame(spark, x.reshape(3, -1))
    got = flat.select(pixels.teng(F.col("v"), 16, 16).alias("t"), pixels.squared_error(F.col("v"), F.col("v")).alias("e")).collect()
    one = [_teng(i) for i in x]
    assert np.allclose([r.t for r in got], one) and all(r.e == 0 for r in got)
    same = np.stack([x[0]] * 3)
    assert math.isclose(metrics.teng_stack(same, 0.0), 16 * _teng(x[0], 0.0), rel_tol=1e-9)


def _teng(x, t=0.05):
    p = np.pad(x, 1, mode="symmetric")
    gx = sum(w * (p[i : i + 16, 2:] - p[i : i + 16, :-2]) for i, w in enumerate((1, 2, 1)))
    gy = sum(w * (p[2:, i : i + 16] - p[:-2, i : i + 16]) for i, w in enumerate((1, 2, 1)))
    g = gx**2 + gy**2
    return np.where(np.sqrt(g) > t, g, 0).mean()


def test_dice_counts_absent_classes(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0])], "image long, label int, p array<double>")
    assert abs(metrics.dice_loss(df, "image", "label", "p").first()[0]) < 1e-9
    assert abs(metrics.cross_entropy(df, "label", "p").first()[0]) < 1e-9


def test_history(spark):
    h = spark.createDataFrame([("r", e, abs(e - 25) / 100 + 0.1) for e in range(60)], "run_id string, epoch int, val_loss double")
    r = history.early_stop(h, "val_loss", 20).first()
    assert (r.stopped_at, r.restored) == (45, 25) and history.best_epoch(h, "val_loss").first().epoch == 25
    assert history.early_stop(h, "val_loss", 50).first().stopped_at is None
    lr = [x.lr for x in history.lr_plateau(h, "val_loss", 1e-4).orderBy("epoch").collect()]
    assert lr[29] == 1e-4 and lr[30] == 5e-5 and lr[35] == 2.5e-5


def _dense(z, cfg):
    n = cfg.atoms
    x, zed, one = np.array([[0, 1], [1, 0]]), np.diag([1, -1]), np.eye(2)
    on = lambda op, i: np.array(__import__("functools").reduce(np.kron, [op if k == i else one for k in range(n)]))
    h = sum(cfg.omega * on(x, i) + (0.5 * cfg.detuning - 0.5 * cfg.gain * z[i]) * on(zed, i) for i in range(n))
    for i in range(n):
        for j in range(i + 1, n):
            h = h + cfg.coupling / (j - i) ** cfg.power / 4 * (on(zed, i) + on(zed, j) + on(zed, i) @ on(zed, j))
    values, vectors = np.linalg.eigh(h)
    step = vectors @ np.diag(np.exp(-1j * values * cfg.dt)) @ vectors.conj().T
    psi, out = np.eye(2**n)[0].astype(complex), []
    ops = [on(zed, i) for i in range(n)] + [on(zed, i) @ on(zed, j) for i in range(n) for j in range(i + 1, n)]
    for _ in range(cfg.steps):
        psi = step @ psi
        out += [float((psi.conj() @ o @ psi).real) for o in ops]
    return out


def test_reservoir_against_diagonalisation(spark):
    cfg = reservoir.Config(atoms=5, tol=1e-12)
    z = np.array([[((i * 5 + j * 3) % 11) / 10 for j in range(5)] for i in range(8)])
    want = np.array([_dense(row, cfg) for row in z])
    assert np.abs(reservoir.embed(z, cfg) - want).max() < 1e-9
    got = reservoir.reservoir(frame(spark, z).repartition(3), "v", "e", cfg).orderBy("id").collect()
    assert np.abs(np.array([r.e for r in got]) - want).max() < 1e-9
    assert reservoir.Config().width == 1368
    shots = reservoir.embed(z, reservoir.Config(atoms=5, shots=20000))
    assert np.abs(shots - want).max() < 0.06


def test_dense_network():
    rng = np.random.default_rng(0)
    x = rng.random((200, 4))
    y = 0.2 + 0.5 * x[:, :2]
    net = nets.Dense.create([4, 16, 2]).fit(x[:160], y[:160], x[160:], y[160:], rate=1e-2, epochs=60, drop=0.0)
    assert net.history[-1]["val_loss"] < net.history[0]["val_loss"] / 5
    gw, _, loss = net.gradients(x, y)
    net.weights[0][1, 2] += 1e-6
    assert math.isclose((net.gradients(x, y)[2] - loss) / 1e-6, gw[0][1, 2], rel_tol=1e-2, abs_tol=1e-6)
    sizes = [1368, *nets.READOUT]
    assert sum(a * b + b for a, b in zip(sizes, sizes[1:])) == 79_014_912


def test_conv_network():
    net = nets.ConvNet.create(8, (4, 8), 16, 10)
    x = np.random.default_rng(1).random((2, 8, 8, 3))
    p = net.predict(x)
    assert np.allclose(p.sum(1), 1) and nets.ConvNet.create().parameters() == 1_337_002
    assert [a.shape[1:] for a in net.activations(x)] == [(8, 8, 4), (8, 8, 4), (4, 4, 8), (4, 4, 8)]
    cam = net.grad_cam(x, 3)
    assert cam.shape == (2, 4, 4) and cam.min() >= 0 and cam.max() <= 1
    assert nets.overlay(x[0], cam[0]).shape == (8, 8, 3)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 5), st.integers(1, 4))
def test_tile_grid_covers_whole_cells(size, n):
    side = size * n
    cells = [(r, c) for r in range(side // size) for c in range(side // size)]
    assert len(cells) == n * n


def test_missing_source():
    from gridlight.sources.images import require

    with pytest.raises(FileNotFoundError, match="download"):
        require("/nowhere/at/all", "download it first")


def test_splits_keep_every_row(spark):
    """Null keys, null groups, repeated keys and columns named like helpers."""
    rows = [(None if i % 7 == 0 else i // 2, None if i % 5 == 0 else i % 3, f"h{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, _h string").repartition(3)
    out = splits.stratified_split(df, "id", "label").collect()
    assert len(out) == 40 and {r["_h"] for r in out} == {f"h{i}" for i in range(40)}
    counts = Counter(r.split for r in out)
    assert counts == {"train": 32, "val": 4, "test": 4}
    grouped = splits.group_split(df, "label").collect()
    assert len(grouped) == 40 and len({(r.label, r.split) for r in grouped}) == 4
    ranked = ranking.shuffled_rank(df, "id", 1, name="_n").collect()
    assert sorted(r["_n"] for r in ranked) == list(range(1, 41)) and ranked[0].asDict().keys() == {"id", "label", "_h", "_n"}


def test_cubic_resize_against_the_definition():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (13, 9, 3), dtype=np.uint8)
    cubic = lambda x: (1.5 * x - 2.5) * x * x + 1 if x < 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0.0
    def line(values, side):
        scale = len(values) / side
        wide = max(scale, 1)
        out = []
        for i in range(side):
            centre = (i + 0.5) * scale
            at = range(max(0, int(centre - 2 * wide + 0.5)), min(len(values), int(centre + 2 * wide + 0.5)))
            w = [cubic(abs((k + 0.5 - centre) / wide)) for k in at]
            out.append(min(255, max(0, int(np.floor(sum(a * float(values[k]) for a, k in zip(w, at)) / sum(w) + 0.5)))))
        return out
    for side in (5, 16):
        wide = np.array([[line(image[y, :, c], side) for c in range(3)] for y in range(13)]).transpose(0, 2, 1)
        want = np.array([[line(wide[:, x, c], side) for c in range(3)] for x in range(side)]).transpose(2, 0, 1)
        assert np.abs(image_sources.shrink_cubic(image, side).astype(int) - want).max() <= 1
    assert (image_sources.shrink_cubic(image[:9], 9) == image[:9]).all()


def numeric(f, p, at, eps=1e-6):
    old = p[at]
    p[at] = old + eps
    up = f()
    p[at] = old - eps
    down = f()
    p[at] = old
    return (up - down) / (2 * eps)


@pytest.mark.parametrize("kind", ["classifier", "segmentation"])
def test_gradients_against_differences(kind):
    rng = np.random.default_rng(4)
    if kind == "classifier":
        net, y = nets.ConvNet.create(8, (3, 4), 5, 3), rng.integers(0, 3, (4, 1)).astype(float)
    else:
        net, y = nets.SegNet.create(8, (3, 4, 5), 3, drop=0.0), rng.integers(0, 3, (4, 64)).astype(float)
    x = rng.random((4, 8 * 8 * 3))
    grads, _ = net.step(x, y, rng)
    loss = lambda: net.step(x, y, rng)[1]["loss"]
    for p, g in zip(net.params(), grads):
        for _ in range(3):
            at = tuple(int(rng.integers(n)) for n in p.shape)
            assert abs(numeric(loss, p, at) - g[at]) < 1e-5


def test_training_streams_whole_tables(spark, monkeypatch):
    """Batches from a table: every row once, x beside its y, a new order each epoch; rates fall and best weights stay."""
    n = 230
    df = spark.createDataFrame([(i, [float(i), 1.0], [2.0 * i]) for i in range(n)], "image_id long, x array<double>, y array<double>").repartition(5)
    rows = training.Rows(df, "image_id", "x", "y", 32)
    seen = [list(rows.epoch(k)) for k in (0, 1, None)]
    for batches in seen:
        assert [len(x) for x, _ in batches[:-1]] == [32] * (n // 32) and sum(len(x) for x, _ in batches) == n
        assert all((2 * x[:, :1] == y).all() for x, y in batches)
        assert sorted(int(v) for x, _ in batches for v in x[:, 0]) == list(range(n))
    assert seen[0][0][0].tolist() != seen[1][0][0].tolist()
    monkeypatch.setattr(training, "HELD", 0)
    again = training.Rows(df, "image_id", "x", "y", 32)
    for k in (1, 2):
        kept, read = (np.concatenate([x for x, _ in r.epoch(k)]) for r in (rows, again))
        assert rows.held and not again.held and (kept == read).all()

    class Constant:
        def __init__(self, values):
            self.values, self.history, self.w = iter(values), [], np.zeros(1)

        def params(self):
            return [self.w]

        def step(self, x, y, rng):
            return [np.ones(1)], {"loss": 1.0}

        def measure(self, batches):
            return {"loss": next(self.values)}

    net = training.run(Constant([3, 2, 2, 2, 2, 2, 1]), training.Arrays(np.zeros((1, 1)), np.zeros((1, 1))), training.Arrays(np.zeros((0, 1)), np.zeros((0, 1))), training.Optimizer("sgd", 1.0), 7, patience=5, plateau=training.Plateau(0.5, 2))
    assert [h["rate"] for h in net.history] == [1, 1, 1, 1, 0.5, 0.5, 0.25] and net.w[0] == -5.25
    with pytest.raises(ValueError):
        training.Optimizer("other").update([np.zeros(1)], [np.zeros(1)])
