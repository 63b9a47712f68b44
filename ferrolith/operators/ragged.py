"""Lists of numbers folded for a whole batch of rows at once: numpy steps along the lists instead of Spark lambdas.

A batch of lists is the values of all rows and the size of each row's list. Folds step from place to place, for all rows
together that have such a place, so their work is the number of values whatever the lists' sizes. Lambdas over arrays are
interpreted value by value; these are for lists that every row of a large table has.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Decimals nearer than this to a half are rounded by their shortest digits, as Spark does.
NEAR = 1e-4
LIST = ArrayType(DoubleType())
AXIS = StructType([StructField("lines", LIST), StructField("stations", LIST), StructField("bays", LIST), StructField("labels", ArrayType(StringType()))])
SYNCED = StructType([StructField("axis", AXIS), StructField("end", DoubleType())])


def read(lists: pa.Array, null: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes; a missing list is empty, a missing value is null's or left out."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    if flat.null_count and null is None:
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        return flat.drop_null().to_numpy(), picked(there, sizes)
    return (flat if null is None else flat.fill_null(null)).to_numpy(zero_copy_only=False).astype(np.float64), sizes


def written(values: np.ndarray | pa.Array, sizes: np.ndarray, missing: pa.Array | None = None) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values) if isinstance(values, np.ndarray) else values, mask=missing)


def rows(sizes: np.ndarray) -> np.ndarray:
    """The row of every value."""
    return np.repeat(np.arange(len(sizes)), sizes)


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def places(sizes: np.ndarray) -> np.ndarray:
    """The place of every value in its list."""
    return np.arange(sizes.sum()) - np.repeat(starts(sizes), sizes)


def picked(keep: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of the lists of the kept values."""
    return np.bincount(rows(sizes)[keep], minlength=len(sizes))


def either(first: np.ndarray, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The list of a where first is true, else that of b."""
    sizes = np.where(first, a[1], b[1])
    begin = np.where(first, starts(a[1]), len(a[0]) + starts(b[1]))
    return np.concatenate((a[0], b[0]))[np.repeat(begin, sizes) + places(sizes)], sizes


def steps(sizes: np.ndarray):
    """(rows, indices of their values) for each place that some list has."""
    by = np.argsort(-sizes, kind="stable")
    begin, falling = starts(sizes)[by], -sizes[by]
    for place in range(int(sizes.max(initial=0))):
        n = np.searchsorted(falling, -place)
        yield by[:n], begin[:n] + place


def ascending(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    row = rows(sizes)
    sorted_already = ((values[1:] >= values[:-1]) | (row[1:] != row[:-1])).all()
    return values if sorted_already else values[np.lexsort((values, row))]


def thinned(values: np.ndarray, sizes: np.ndarray, gap: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists without values nearer than gap to the last one kept (more: at gap neither)."""
    values = ascending(values, sizes)
    keep, last = np.zeros(len(values), bool), np.full(len(sizes), np.nan)
    for row, at in steps(sizes):
        apart = values[at] - last[row]
        # what has no distance (the first value, or no number) is far, as in Spark's order of doubles
        far = ~(apart <= gap[row]) if more else ~(apart < gap[row])
        keep[at] = far
        last[row[far]] = values[at[far]]
    return values[keep], picked(keep, sizes)


def chain_means(values: np.ndarray, sizes: np.ndarray, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the clusters of sorted lists: a new one starts where the gap to the value before exceeds tol."""
    values, row = ascending(values, sizes), rows(sizes)
    new = np.ones(len(values), bool)
    new[1:] = (row[1:] != row[:-1]) | ~(values[1:] - values[:-1] <= tol[row[1:]])
    first = np.flatnonzero(new)
    sums = np.add.reduceat(values, first) if len(first) else values
    return sums / np.diff(np.append(first, len(values))), picked(new, sizes)


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Spark's round of doubles: the shortest decimal of a value, halves away from zero."""
    size = np.abs(values) * 10.0**digits
    whole = np.floor(size + 0.5)
    out = np.copysign(whole, values) / 10.0**digits + 0.0
    with np.errstate(invalid="ignore"):
        hard = np.flatnonzero(np.isfinite(values) & ((np.abs(size - np.floor(size) - 0.5) < NEAR) | (size > 1e9)))
    unit = Decimal(1).scaleb(-digits)
    for i in hard.tolist():
        exact = Decimal(repr(float(values[i])))
        out[i] = float(exact.quantize(unit, ROUND_HALF_UP)) + 0.0 if abs(exact) < 10**20 else values[i]
    return np.where(np.isfinite(values), out, values)


def positions(values: np.ndarray, sizes: np.ndarray, tol: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """`grid.axis_positions` of lists (compat)."""
    values = ascending(np.maximum(values, 0.0), sizes)
    nan = np.isnan(values)
    again = np.concatenate(([False], nan[1:] & nan[:-1] & (rows(sizes)[1:] == rows(sizes)[:-1]))) if nan.any() else np.zeros(len(values), bool)
    seq, n = thinned(values[~again], picked(~again, sizes), np.full(len(sizes), tol), more=True)
    wide = ~(seq <= tol)
    bays, n_bays = seq[wide], picked(wide, n)
    sums, total = np.zeros(len(bays) + len(n)), np.zeros(len(n))
    for row, at in steps(n_bays):
        total[row] += bays[at]
        sums[at + row + 1] = total[row]  # each list has one value more, the 0 that it starts with
    lead = np.zeros(len(n), bool)
    lead[n > 0] = seq[starts(n)[n > 0]] <= tol
    out, size = either((n < 2) | lead | (n_bays < 2), (seq, n), (sums, n_bays + 1))
    kept = places(size) < most
    return out[kept], np.minimum(size, most)


def differences(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value but the first less the one before it."""
    later = places(sizes) > 0
    return (values - np.concatenate(([0.0], values[:-1])) if len(values) else values)[later], np.maximum(sizes - 1, 0)


def snapped(labels: np.ndarray, vectors: np.ndarray, tol: float) -> np.ndarray:
    """Labels in order at the nearest vector within tol that no label has, else at their own place; sorted."""
    vectors, out = np.sort(vectors), labels.copy()
    free = np.ones(len(vectors), bool)
    for i, label in enumerate(labels if len(vectors) else ()):
        away = np.abs(vectors - label)
        away = np.where(free & (away <= tol), away, np.inf)
        best = away.argmin()
        if away[best] <= tol:
            out[i] = vectors[best]
            free &= vectors != vectors[best]
    return np.sort(out)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


@F.arrow_udf(LIST)
def spaced(lists: pa.Array, gap: pa.Array) -> pa.Array:
    return written(*thinned(*read(lists), _numbers(gap), more=False), lists.is_null())


@F.arrow_udf(LIST)
def means(lists: pa.Array, tol: pa.Array) -> pa.Array:
    return written(*chain_means(*read(lists), _numbers(tol)), lists.is_null())


@F.arrow_udf(LIST)
def snapped_labels(labels: pa.Array, vectors: pa.Array, tol: pa.Array) -> pa.Array:
    (at, n), (lines, m) = read(labels), read(vectors)
    a, b = np.cumsum(n)[:-1], np.cumsum(m)[:-1]
    out = [snapped(x, y, t) for x, y, t in zip(np.split(at, a), np.split(lines, b), _numbers(tol), strict=True)]
    return written(np.concatenate([np.zeros(0), *out]), n, labels.is_null())


def bay_stations(bays: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """0 and the running sums of bays, each rounded to a tenth, their sizes and the last ones; from a missing bay on none is known."""
    there = bays.flatten().is_valid().to_numpy(zero_copy_only=False)
    (width, n), known = read(bays, 0.0), np.ones(len(bays), bool)
    sums, total = np.zeros(len(width) + len(n)), np.zeros(len(n))
    for row, at in steps(n):
        known[row] &= there[at]
        total[row] = rounded(total[row] + width[at], 1)
        sums[at + row + 1] = np.where(known[row], total[row], 0.0)
    return sums, n + 1, pa.array(total, mask=~known)


def synced(letters: bool, tol: float, most: int):
    """Lists of lines, the gap between them, their origin and millimetres a pixel, stations and bays: the axis as a struct,
    and end, the last of the given stations.

    Stations are read as `grid.axis_positions` does; of fewer than two of them the bays make some. Two lines or more in
    pixels give the axis other ones. Labels are letters (26 at most) or numbers. Missing stations count as 0.
    """

    @F.arrow_udf(SYNCED)
    def axis(lines: pa.Array, gap: pa.Array, origin: pa.Array, scale: pa.Array, stations: pa.Array, bays: pa.Array) -> pa.Array:
        given, count = positions(*read(stations, 0.0), tol, most)
        sums, sum_count, total = bay_stations(bays)
        built = (count < 2) & (sum_count > 1)
        last = np.zeros(len(count))
        last[count > 0] = given[np.cumsum(count)[count > 0] - 1]
        end = pc.if_else(pa.array(built), total, pa.array(last, mask=count == 0))
        at, n = thinned(*read(lines), _numbers(gap), more=False)
        row, place = rows(n), places(n)
        along = rounded((at - _numbers(origin)[row]) * _numbers(scale)[row], 1)
        stops, m = positions(*either(n >= 2, (along, n), either(built, (sums, sum_count), (given, count))), tol, most)
        widths, k = differences(stops, m)
        longest = int(n.max(initial=0))
        names = pa.array([chr(65 + i) for i in range(min(26, longest))] if letters else [str(i + 1) for i in range(longest)], pa.string())
        labels = written(names.take(pa.array(place[place < len(names)])), np.minimum(n, len(names)))
        parts = written(at, n), written(stops, m), written(rounded(widths, 1), k), labels
        return pa.StructArray.from_arrays((pa.StructArray.from_arrays(parts, names=AXIS.names), end), names=SYNCED.names)

    return axis
