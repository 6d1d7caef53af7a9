"""Column functions over images kept as one array of numbers per row, row by row, channels innermost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luma weights of red, green and blue (fixed values).
LUMA = (0.299, 0.587, 0.114)


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def normalise(v: Column) -> Column:
    """Bytes 0..255 to 0..1."""
    return F.transform(v, lambda x: x.cast("double") / 255)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def grayscale(rgb: Column) -> Column:
    """Interleaved RGB to one weighted channel."""
    red, green, blue = LUMA
    return F.transform(
        F.sequence(F.lit(0), (F.size(rgb) / 3).cast("int") - 1),
        lambda i: F.lit(red) * F.get(rgb, 3 * i) + F.lit(green) * F.get(rgb, 3 * i + 1) + F.lit(blue) * F.get(rgb, 3 * i + 2),
    )


def replicate(gray: Column, channels: int = 3) -> Column:
    """One channel to several equal ones."""
    return F.flatten(F.transform(gray, lambda x: F.array_repeat(x, channels)))


def bgr_to_rgb(v: Column) -> Column:
    """The channel order of Spark's image source, reversed."""
    return F.transform(v, lambda x, i: F.get(v, i - i % 3 + (2 - i % 3)))


def to_rows(v: Column, width: int) -> Column:
    """Flat pixels to an array of rows, clipped to 0..1."""
    return F.transform(F.sequence(F.lit(0), (F.size(v) / width).cast("int") - 1), lambda r: F.transform(F.slice(v, r * width + 1, width), clip01))


def head(v: Column, n: int) -> Column:
    """The first n components."""
    return F.slice(v, 1, n)


def head_padded(v: Column, n: int, width: int) -> Column:
    """The first n components, zeros after."""
    return F.concat(F.slice(v, 1, n), F.array_repeat(F.lit(0.0), width - n))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int"))


def argmax(v: Column) -> Column:
    """Index of the greatest element, the first of equal ones; null for an empty array."""
    return F.nullif((F.array_position(v, F.array_max(v)) - 1).cast("int"), F.lit(-1))


def scale_with(v: Column, low: Column, high: Column, eps: float = 1e-8) -> Column:
    """(x - low) / (high - low + eps) per component, cut to 0..1: a constant component gives 0."""
    return F.transform(v, lambda x, i: clip01((x - F.get(low, i)) / (F.get(high, i) - F.get(low, i) + F.lit(eps))))


def standardise_with(v: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std per component; a constant component is centred only."""
    return F.transform(v, lambda x, i: (x - F.get(mean, i)) / F.when(F.get(std, i) == 0, F.lit(1.0)).otherwise(F.get(std, i)))


def squared_error(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of one length; the first is cut to 0..1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (clip01(x) - y) * (clip01(x) - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def max_abs_error(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def teng(v: Column, height: int, width: int, threshold: float = 0.05) -> Column:
    """Mean of the squared Sobel gradient where the gradient is above the threshold; edges repeat the border pixel."""

    def at(i: Column, dy: int, dx: int) -> Column:
        y = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.floor(i / width).cast("int") + dy))
        x = F.greatest(F.lit(0), F.least(F.lit(width - 1), (i % width) + dx))
        return F.get(v, y * width + x)

    def square(i: Column) -> Column:
        gx = at(i, -1, 1) - at(i, -1, -1) + 2 * (at(i, 0, 1) - at(i, 0, -1)) + at(i, 1, 1) - at(i, 1, -1)
        gy = at(i, 1, -1) - at(i, -1, -1) + 2 * (at(i, 1, 0) - at(i, -1, 0)) + at(i, 1, 1) - at(i, -1, 1)
        return gx * gx + gy * gy

    squares = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), square)
    return F.aggregate(squares, F.lit(0.0), lambda s, g: s + F.when(F.sqrt(g) > threshold, g).otherwise(0.0)) / (height * width)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
