"""Command lines: ``python -m gridlight.cli prepare|readout|segment|vgg ...``. Names and defaults are those users know."""

from __future__ import annotations

import argparse

from gridlight.session import local_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridlight")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("prepare", help="cut images and masks into tiles")
    p.add_argument("--images", required=True, help="Parquet with img_id, h, w, rgb, mask_rgb")
    p.add_argument("--out", required=True)
    p.add_argument("--tile-size", type=int, default=256)
    p.add_argument("--n-tiles", type=int, default=9)
    p.add_argument("--downsample", action="store_true")
    p.add_argument("--workers", type=int, default=None)
    p = sub.add_parser("readout", help="train the dense read-out on Parquet of image_id and v, inputs x and targets y")
    for name in ("--x", "--y", "--xval", "--yval", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--epochs", type=int, default=500)
    p.add_argument("--batch", type=int, default=64)
    p.add_argument("--lr", type=float, default=1e-4)
    p.add_argument("--dropout", type=float, default=0.3)
    p.add_argument("--patience", type=int, default=20)
    p = sub.add_parser("segment", help="train a segmentation network on tiles, or show stopping and rates of a stored history")
    p.add_argument("--history", default=None, help="a stored history to look at instead of training")
    p.add_argument("--tiles", default=None, help="Parquet that the prepare command wrote")
    p.add_argument("--tile-size", type=int, default=256)
    p.add_argument("--out", default=None, help="folder for weights and history")
    p.add_argument("--epochs", type=int, default=50)
    p.add_argument("--batch-size", type=int, default=8)
    p.add_argument("--lr", type=float, default=1e-4)
    p.add_argument("--lr-factor", type=float, default=0.5)
    p.add_argument("--lr-patience", type=int, default=5)
    p.add_argument("--es-patience", type=int, default=10)
    p.add_argument("--seed", type=int, default=42)
    p = sub.add_parser("vgg", help="train and score a convolutional network on an image folder")
    p.add_argument("--images", required=True)
    p.add_argument("--out", default=None, help="folder for weights and history")
    p.add_argument("--epochs", type=int, default=5)
    p.add_argument("--batch-size", type=int, default=32)
    p.add_argument("--val-split", type=float, default=0.2)
    p.add_argument("--optimizer", type=str, default="rmsprop")
    return top


def keep(net, out: str | None) -> None:
    """Weights and history of a trained network, if a folder is named; the last epoch's metrics on the screen."""
    from gridlight.sources import sinks

    print(net.history[-1] if net.history else {})
    if out:
        sinks.save_arrays(out, **{f"p{k}": p for k, p in enumerate(net.params())})
        sinks.write_history(net.history, f"{out}/history.json")


def main(argv: list[str] | None = None, hidden: tuple[int, ...] | None = None) -> None:
    """Runs a command; ``hidden`` replaces the read-out's inner widths."""
    a = parser().parse_args(argv)
    spark = local_session(getattr(a, "workers", None))
    from pyspark.sql import functions as F

    from gridlight.operators import history, nets
    from gridlight.operators.training import Rows
    from gridlight.plans import studies
    from gridlight.sources import images, sinks

    hidden = nets.READOUT[:-1] if hidden is None else hidden

    if a.command == "prepare":
        tiles = studies.prepare_tiles(spark.read.parquet(images.require(a.images, "stage the images first")), a.tile_size, a.n_tiles, a.downsample)
        sinks.write_tiles(tiles, a.out)
        studies.tile_counts(spark.read.parquet(a.out), 4 if a.downsample else a.n_tiles**2).show()
    elif a.command == "readout":
        read = lambda path, name: spark.read.parquet(path).select("image_id", F.col("v").alias(name))
        train, valid = (Rows(read(x, "x").join(read(y, "y"), "image_id"), "image_id", "x", "y", a.batch) for x, y in ((a.x, a.y), (a.xval, a.yval)))
        first = train.df.select(F.size("x").alias("x"), F.size("y").alias("y")).first()
        net = nets.Dense.create([first.x, *hidden, first.y]).fit_rows(train, valid, a.lr, a.epochs, a.patience, a.dropout)
        keep(net, a.out)
    elif a.command == "segment" and not a.history:
        tiles = spark.read.parquet(images.require(a.tiles, "prepare tiles first, or name a history"))
        net = studies.train_segmentation(tiles, nets.SegNet.create(a.tile_size, seed=a.seed), a.batch_size, a.seed, rate=a.lr, epochs=a.epochs, patience=a.es_patience, factor=a.lr_factor, rate_patience=a.lr_patience)
        keep(net, a.out)
    elif a.command == "segment":
        h = sinks.read_history(spark, a.history, "run").where("metric = 'val_miou'").withColumnRenamed("value", "val_miou")
        h = h.where(f"epoch < {a.epochs}")
        history.early_stop(h, "val_miou", a.es_patience, lower=False).show()
        history.lr_plateau(h, "val_miou", a.lr, a.lr_factor, a.lr_patience, lower=False).show(a.epochs)
    else:
        rows = images.unpack(images.resize(images.image_folder(spark, a.images), 64))
        classes = rows.agg(F.max("label")).first()[0] + 1
        net = studies.train_classifier(rows, nets.ConvNet.create(classes=classes), a.epochs, a.batch_size, a.val_split, a.optimizer)
        keep(net, a.out)
        studies.classify(rows, net, a.val_split)[1].show()


if __name__ == "__main__":
    main()
