"""Embedding whitening: principal components of a vector column, decorrelated and scaled to unit variance.

Entries are first put on a lattice, x = floor(64 * c) + 1000000, so that counts, sums and deviations are
exact integers. The fit list has each distinct lattice vector once: a vector that is copied a million times
weighs as much as any other, and partial aggregation drops its copies before anything is shuffled.

The covariance is one aggregation with generated sums of centred products, over the upper triangle only.
The triangle is cut into tiles of `TILE` x `TILE` pairs, as Spark compiles no aggregate of more than a hundred
columns: a row is dealt to its tiles, the sums of a tile are its columns, and partial aggregation leaves a row a tile
and task. Centring is exact up to one rounding: the whole part of the mean is taken off as an integer, the rest
as a fraction. Only the d x d matrix comes to the driver, where LAPACK decomposes it. With 64 dimensions a row
makes 36 tiles; tiles grow with d * d, and `MAX_DIMENSIONS` is the most that is taken.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do
rows of another length than the commonest (of equally common ones the longest). Rows with a null or repeated
id, and copies, get a result each. Entries beyond the range of a long are held at its 2**62. A deviation
that doesn't fit a long is null. Components whose variance is zero within rounding are left out, so equal vectors
throughout, a single one, or an empty table give no rows; fewer dimensions than components give as many
as there are. Each component's largest entry is positive. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

# The lattice, and the components returned.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Dimensions along the side of a tile.
TILE = 8
MAX_DIMENSIONS = 1_024
#: Share of the largest variance under which a component's variance counts as zero.
RANK = 1e-12
FAR = float(1 << 62)


@dataclass(frozen=True)
class Fitted:
    n: int  # distinct lattice vectors
    sums: list[int]  # of each dimension over them
    values: np.ndarray  # variances of the components, falling
    axes: np.ndarray  # their unit vectors, a column each
    total: float  # variance over all dimensions

    @property
    def whole(self) -> list[int]:
        return [s // self.n for s in self.sums]

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]


def on_lattice(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows of vectors(vec_id, embedding) that take part."""
    sound = vectors.select("vec_id", "embedding").filter(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    usual = sound.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual["d"] if usual else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {d} dimensions; whitening takes {MAX_DIMENSIONS} at most")
    held = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(FAR)), F.lit(-FAR))
    return sound.filter(F.size("embedding") == d).select("vec_id", F.transform("embedding", lambda c: F.floor(held(c)).cast("long") + OFFSET).alias("x"))


def _constants(values: list, kind: str) -> Column:
    """An array as one expression, parsed at once: a literal for each entry costs a call to the JVM."""
    return F.expr(f"array({', '.join(map(repr, values))})").cast(f"array<{kind}>")


def _reals(values: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def centred(fitted: Fitted) -> Column:
    """x less its means, rounded once, as an array of doubles."""
    whole, rest = _constants(fitted.whole, "long"), _reals([r / fitted.n for r in fitted.rest])
    return F.transform("x", lambda v, i: (v - F.get(whole, i)).cast("double") - F.get(rest, i))


def mean_products(rows: DataFrame, column: str, d: int, n: int) -> np.ndarray:
    """The d x d matrix of the products of the entries of an array column, summed over rows and divided by n."""
    side = -(-d // TILE)
    corners = [(i * TILE, j * TILE) for i in range(side) for j in range(i, side)]
    tops, lefts = _constants([i for i, _ in corners], "int"), _constants([j for _, j in corners], "int")
    dealt = rows.select(column, F.explode(F.sequence(F.lit(0), F.lit(len(corners) - 1))).alias("tile"))
    parts = [F.get(column, F.get(start, F.col("tile")) + p).alias(f"{side}{p}") for side, start in (("a", tops), ("b", lefts)) for p in range(TILE)]
    sums = [F.expr(f"sum(a{p} * b{q})").alias(f"s{p}_{q}") for p in range(TILE) for q in range(TILE)]
    matrix = np.zeros((side * TILE, side * TILE))
    for row in dealt.select("tile", *parts).groupBy("tile").agg(*sums).collect():  # as many rows as tiles
        i, j = corners[row["tile"]]
        tile = np.array([[row[f"s{p}_{q}"] or 0.0 for q in range(TILE)] for p in range(TILE)])
        matrix[i : i + TILE, j : j + TILE] = tile
        if i != j:
            matrix[j : j + TILE, i : i + TILE] = tile.T
    return matrix[:d, :d] / n


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fitted | None:
    """Means, covariance and its leading components over distinct(x); None where nothing varies."""
    totals = distinct.select(F.posexplode("x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum(F.col("col").cast("decimal(19,0)")).alias("s")).collect()  # a row a dimension
    if not totals:
        return None
    d = len(totals)
    start = Fitted(totals[0]["n"], [int(r["s"]) for r in sorted(totals)], np.zeros(0), np.zeros((d, 0)), 0.0)
    covariance = mean_products(distinct.select(centred(start).alias("c")), "c", d, start.n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    rank = int((values > RANK * values[0]).sum()) if values[0] > 0 else 0
    if not rank:
        return None
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    kept = min(components, rank)
    return Fitted(start.n, start.sums, values[:kept], axes[:, :kept], float(np.trace(covariance)))


def whiten(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """rows with `whitened`, an array with each component's coordinate in units of its standard deviation."""
    factors = F.array(*map(_reals, (fitted.axes / np.sqrt(fitted.values)).T))
    dot = lambda c, f: F.aggregate(F.zip_with(c, f, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    once = F.transform(F.array(centred(fitted)), lambda c: F.transform(factors, lambda f: dot(c, f)))  # else each component centres anew
    return rows.withColumn("whitened", F.get(once, F.lit(0)))


def deviation(fitted: Fitted) -> Column:
    """The squared distance of n * x from the sums, an exact long; null where none fits."""
    whole, rest = _constants(fitted.whole, "long"), _constants(fitted.rest, "long")
    apart = lambda v, i: F.try_subtract(F.try_multiply(F.lit(fitted.n).cast("long"), v - F.get(whole, i)), F.get(rest, i)).cast("decimal(19,0)")
    total = lambda s, a: F.try_add(s, a * a).cast("decimal(38,0)")
    return F.aggregate(F.transform("x", apart), F.lit(0).cast("decimal(38,0)"), total).try_cast("long")


def identity_error(distinct: DataFrame, fitted: Fitted) -> float:
    """The largest entry, without sign, of the whitened fit list's covariance less the identity, measured over the list.

    The list's coordinates have the mean zero, as centring is exact.
    """
    k = len(fitted.values)
    return float(np.abs(mean_products(whiten(distinct, fitted), "whitened", k, fitted.n) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Fitted | None, float]:
    """The rows of vectors that take part as (vec_id, x, whitened, deviation), what was fitted, and the identity error."""
    rows = on_lattice(vectors)
    distinct = stored(rows.select("x").distinct(), "fit-list")
    fitted = fit(distinct, components)
    if fitted is None:
        empty = rows.filter(F.lit(False)).select("*", F.array().cast("array<double>").alias("whitened"), F.lit(None).cast("long").alias("deviation"))
        return empty, None, 0.0
    return whiten(rows, fitted).withColumn("deviation", deviation(fitted)), fitted, identity_error(distinct, fitted)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fitted, error = whitened(table(spark, sf_dir, "embeddings"))
    n, shares = (fitted.n, [float(v / fitted.total) for v in fitted.values]) if fitted else (0, [])
    listed = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("place"))
    return listed.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
