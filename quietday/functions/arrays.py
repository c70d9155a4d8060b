"""Image-like arrays as columns of arrays: block means, flips, differences, pooling, packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid(flat: Column, width: int) -> Column:
    """A flat array as rows of `width`."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.slice(flat, i * width + 1, width))


def block_mean(rows: Column, k: int, height: int, width: int) -> Column:
    """The mean of each k x k block."""
    cell = lambda i, j: F.aggregate(F.slice(F.get(rows, i), j + 1, k), F.lit(0.0), lambda a, x: a + x)
    return F.transform(
        F.sequence(F.lit(0), F.lit(height // k - 1)),
        lambda bi: F.transform(
            F.sequence(F.lit(0), F.lit(width // k - 1)),
            lambda bj: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda o: cell(bi * k + o, bj * k)), F.lit(0.0), lambda a, x: a + x) / (k * k),
        ),
    )


def resize_to(rows: Column, size: int, height: int) -> Column:
    """A square image on `size` rows: block means if that divides the height, else the nearest cell."""
    if size == height:
        return rows
    if height > size and height % size == 0:
        return block_mean(rows, height // size, height, height)
    places = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.floor(i * height / size).cast("int"))
    return F.transform(places, lambda i: F.transform(places, lambda j: F.get(F.get(rows, i), j)))


def flip_180(rows: Column) -> Column:
    return F.reverse(F.transform(rows, lambda r: F.reverse(r)))


def running_difference(now: Column, before: Column, scale: float) -> Column:
    """(now - before) / scale around the middle grey, clipped and truncated to 0..255."""
    value = lambda a, b: F.least(F.greatest((a - b + scale) / (2 * scale) * 255.0, F.lit(0.0)), F.lit(255.0)).cast("int")
    return F.zip_with(now, before, value)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pack_right(values: Column, length: int) -> Column:
    """Right-aligned in `length` zeros; a longer array is an error."""
    n = F.size(values)
    return F.when(n > length, F.raise_error(F.lit("window longer than the packed length")).cast("array<double>")).otherwise(
        F.concat(F.array_repeat(F.lit(0.0), F.lit(length) - n), values)
    )


def pack_mask(values: Column, length: int) -> Column:
    return F.concat(F.array_repeat(F.lit(0), F.lit(length) - F.size(values)), F.array_repeat(F.lit(1), F.size(values)))
