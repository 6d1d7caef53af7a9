"""File and tile names, labels from names, time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category_of(path: Column) -> Column:
    """The folder that holds a file."""
    return F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)


def image_id_of(path: Column, suffix: str = "_sat") -> Column:
    """File name without folder, extension and suffix."""
    return F.regexp_extract(path, rf"([^/]+?)(?:{suffix})?\.[^./]+$", 1)


def tile_name(image_id: Column, r: Column, c: Column) -> Column:
    return F.format_string("%s_%02d_%02d", image_id, r, c)


def tile_parts(name: Column) -> Column:
    """img_id, r, c of a tile name, whatever suffix and extension follow."""
    pattern = r"([^/]+)_(\d{2})_(\d{2})(?:_(?:sat|mask))?(?:\.[^./]+)?$"
    return F.struct(F.regexp_extract(name, pattern, 1).alias("img_id"), F.regexp_extract(name, pattern, 2).cast("int").alias("r"), F.regexp_extract(name, pattern, 3).cast("int").alias("c"))


def group_of(name: Column, legacy: bool = False) -> Column:
    """The image that a tile belongs to; ``legacy`` strips two parts of the whole stem, which leaves the tile row in."""
    stem = F.regexp_replace(name, r"\.[^./]+$", "")
    return F.regexp_replace(stem, r"_[^_]*_[^_]*$", "") if legacy else tile_parts(name)["img_id"]


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def tick(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
