"""Whitening of embeddings; the covariance comes from exact integer cross-products of bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried
from .vectors import common_length, finite, matrix, whole_numbers

RESULT = ["n", "deviation", "whitened", "explained", "identity_error"]
#: Eigenvalues below this share of the largest one count as zero: no direction of theirs can be scaled to unit variance.
ZERO = 1e-12
SUMS = "i int, j int, s decimal(38,0)"
#: Above this bound sums of a block's products could leave 64 bits; Python's integers are used there.
SMALL = 1 << 24


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of non-negative numbers, rows packed into words: (words by plane, dimension by plane, bit by plane)."""
    high = y.max(axis=0) if len(y) else np.zeros(y.shape[1], dtype=np.int64)
    lengths = np.array([int(v).bit_length() for v in high])
    dims = np.repeat(np.arange(y.shape[1]), lengths)
    bits = np.concatenate([np.arange(n) for n in lengths]) if len(dims) else np.zeros(0, dtype=np.int64)
    padded = np.zeros((-(-len(y) // 64) * 64, len(dims)), dtype=np.uint8)
    padded[: len(y)] = (y[:, dims] >> bits) & 1
    return np.ascontiguousarray(np.packbits(padded, axis=0).T).view(np.uint64), dims, bits


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and sums of products of the columns of x, by popcounts of planes that are ANDed."""
    n, d = x.shape
    low = x.min(axis=0)
    wide = max(abs(int(x.max())), abs(int(low.min()))) >= SMALL
    kind = object if wide else np.int64
    words, dims, bits = bit_planes(x - low)
    counts = np.zeros((len(dims), len(dims)), dtype=np.int64)
    for p in range(len(dims)):
        counts[p, p:] = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
    counts += np.triu(counts, 1).T
    weight = np.array([1 << int(b) for b in bits], dtype=kind)
    weighted = counts.astype(kind) * weight[:, None] * weight
    products, firsts = np.zeros((d, d), dtype=kind), np.zeros(d, dtype=kind)
    starts = np.searchsorted(dims, np.unique(dims))
    if len(dims):
        at = np.unique(dims)
        products[np.ix_(at, at)] = np.add.reduceat(np.add.reduceat(weighted, starts, axis=0), starts, axis=1)
        firsts[at] = np.add.reduceat(np.diagonal(counts).astype(kind) * weight, starts)
    low = low.astype(kind)
    # y = x - low: put the shift back
    return firsts + n * low, products + np.outer(low, firsts) + np.outer(firsts, low) + n * np.outer(low, low)


@dataclass
class Whitening:
    """n rows; base + rest / n is the mean; axes are the unit eigenvectors by falling eigenvalue, as rows."""

    n: int
    base: np.ndarray
    rest: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), np.nan)
        return (self.centred(x) @ self.axes.T) * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - S) ** 2, exact."""
        far = x - self.base
        top = int(np.abs(far).max(initial=0)) * self.n + self.n
        small = top * top * max(1, x.shape[1]) < 1 << 63
        d = far.astype(np.int64 if small else object) * self.n - np.array(self.rest, dtype=np.int64 if small else object)
        return [int(v) for v in (d * d).sum(axis=1)]


def _widths(rows: DataFrame, vec_col: str, scale: int, offset: int) -> tuple[DataFrame, int]:
    sound = rows.where(finite(F.col(vec_col)))
    width = common_length(sound, vec_col)
    return sound.where(F.size(vec_col) == width).withColumn("__x", whole_numbers(F.col(vec_col), scale, offset)), width


def _fit(rows: DataFrame, width: int, components: int) -> Whitening | None:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        for batch in batches:
            x = matrix(batch.column(0), width)
            for start in range(0, len(x), 8192):
                s, p = cross_products(x[start : start + 8192])
                n, first, second = n + len(x[start : start + 8192]), first + s.astype(object), second + p.astype(object)
        if n:
            i, j = np.triu_indices(width)
            sums = [n, *(int(v) for v in first), *(int(v) for v in second[i, j])]
            ij = [np.concatenate([np.full(1, -1), np.arange(width), i]), np.concatenate([np.full(1 + width, -1), j])]
            values = pa.array([Decimal(v) for v in sums], type=pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(ij[0].astype(np.int32)), pa.array(ij[1].astype(np.int32)), values], ["i", "j", "s"])

    # one row a pair of dimensions: the driver gets width * (width + 3) / 2 + 1 numbers, whatever the number of rows
    found = {(r["i"], r["j"]): int(r["s"]) for r in rows.select("__x").mapInArrow(partial, SUMS).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    if not found:
        return None
    n, sums = found[-1, -1], [found[i, -1] for i in range(width)]
    covariance = np.empty((width, width))
    for i in range(width):
        for j in range(i, width):
            covariance[i, j] = covariance[j, i] = (n * found[i, j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, width)]
    axes = vectors[:, order].T.copy()
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    kept = np.where(values[order] > max(values[order][0], 0) * ZERO, values[order], 0.0)
    trace = float(np.trace(covariance))
    base = np.array([s // n for s in sums], dtype=np.int64)
    return Whitening(n, base, [s - n * int(b) for s, b in zip(sums, base)], axes, kept, kept / trace if trace > 0 else np.zeros(len(kept)))


def _identity_error(rows: DataFrame, width: int, model) -> float | None:
    """The largest entry of the covariance of the whitened rows minus the identity, over components with variance."""
    k = len(model.value.values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            z = np.nan_to_num(model.value.project(matrix(batch.column(0), width)))
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)
        i, j = (a.ravel().astype(np.int32) for a in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    total = np.zeros((k + 1, k))
    for r in rows.select("__x").mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"]
    mean = total[k] / model.value.n
    error = np.abs(total[:k] / model.value.n - np.outer(mean, mean) - np.eye(k))
    some = np.flatnonzero(model.value.values > 0)
    return float(error[np.ix_(some, some)].max()) if len(some) else None


def _whiten_udf(model, width: int):
    @F.pandas_udf("deviation decimal(38,0), whitened array<double>")
    def whitened(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_list()).astype(np.int64) if len(vectors) else np.zeros((0, width), dtype=np.int64)
        return pd.DataFrame({"deviation": [Decimal(v) for v in model.value.deviations(x)], "whitened": list(model.value.project(x))})

    return whitened


def whiten(df: DataFrame, vec_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Adds n, deviation, whitened, explained and identity_error to every row with a sound vector.

    Entries become whole numbers x = floor(scale * entry) + offset. Each task shifts its rows to begin at zero, slices
    them into bit planes, packs each plane's rows into 64-bit words, and gets all cross-products as weighted popcounts
    of ANDed planes. They are exact and leave a task as one number a pair of dimensions. The centred covariance of n
    rows is (n * sum(xy) - sum(x) * sum(y)) / n², computed in integers before it is divided once; its eigenvectors are
    the axes. whitened has x minus the mean on the first axes, over the roots of their eigenvalues; deviation is the
    sum of (n * x - sum(x))² over dimensions, exact; explained has the shares of the total variance; identity_error is
    measured on the whitened rows in a pass of its own.

    Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are left out, and so are rows
    of another length than most vectors have (of two lengths equally frequent, the larger stays). Repeated rows count
    each. Where an eigenvalue is zero to double precision (one row, equal rows, dependent dimensions), whitened is null
    and the component does not count for identity_error, which is null if there is no other. Vectors shorter than
    components have as many components as dimensions. Deviations of more than 38 digits, and entries of 2**62 or
    more after scaling, fail the job. An empty table gives an empty result. Input columns named like a result column
    are replaced by it.
    """
    carried = Carried(df)
    rows, width = _widths(df.select(*carried.hide(df)), carried[vec_col], scale, offset)
    fit = _fit(rows, width, components) if width else None
    if fit is None:
        none = rows.where(F.lit(False))
        return none.select(*carried.show(RESULT), *(F.lit(None).cast(t).alias(c) for c, t in zip(RESULT, ("long", "decimal(38,0)", "array<double>", "array<double>", "double"))))
    context = df.sparkSession.sparkContext
    fit.identity_error = _identity_error(rows, width, context.broadcast(fit))
    out = rows.withColumn("__w", _whiten_udf(context.broadcast(fit), width)("__x"))
    return out.select(
        *carried.show(RESULT), F.lit(fit.n).cast("long").alias("n"), F.col("__w.deviation").alias("deviation"), F.col("__w.whitened").alias("whitened"),
        F.array(*(F.lit(float(v)) for v in fit.explained)).alias("explained"), F.lit(fit.identity_error).cast("double").alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector and component; deviation is null where it does not fit a long."""
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    each = rows.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("place")).alias("explained"), "identity_error")
