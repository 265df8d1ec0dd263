"""Whitening of embeddings: an exact fit list, RowMatrix's Gramian, eigenvectors on the driver, projection in tasks."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import drop_path, store

#: An entry c counts as floor(STEPS * c) + OFFSET; beyond +-LARGEST as LARGEST, so that this is always a long.
STEPS, OFFSET, LARGEST = 64, 1_000_000, float(1 << 56)
#: Eigenvalues below this share of the largest are rounding errors of zero.
LEAST_SHARE = 1e-12


def whole_vectors(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): rows whose vector has finite entries only, as whole numbers."""
    entry = lambda c: F.floor(F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)) * STEPS) + F.lit(OFFSET)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    wide = frame.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    return wide.where(F.col("e").isNotNull() & F.forall("e", finite)).select("id", F.transform("e", entry).alias("x"))


def dimension(vectors: DataFrame) -> int:
    """The commonest length, of these the largest; 0 without rows."""
    sizes = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sizes.d if sizes else 0


def column_sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sums of each dimension: halves of 32 bits are summed by batch, so that no sum overflows."""

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array((x >> 32).sum(0)), pa.array((x & 0xFFFFFFFF).sum(0))], names=["k", "high", "low"])

    halves = fit.select("x").mapInArrow(run, "k long, high long, low long")
    sums = halves.groupBy("k").agg(*(F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low"))).collect()
    return [(int(r.high) << 32) + int(r.low) for r in sorted(sums, key=lambda r: r.k)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where they hold it, else as Python's integers."""
    most = max(int(x.max()), -int(x.min())) * n + max(map(abs, sums)) if x.size else 0
    if most < 1 << 63:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(c: np.ndarray) -> list[int]:
    """Sum of squares of each row, exactly."""
    if c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * c.shape[1] < 2**62:
        return (c * c).sum(1).tolist()
    return [sum(v * v for v in row) for row in c.tolist()]


def over_n(c: np.ndarray, n: int) -> np.ndarray:
    """c / n as doubles; each is rounded once where n * x - S is below 2^53."""
    return c.astype(np.float64) / n


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of outer products of the rows' vectors, by MLlib's RowMatrix."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest entry positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    turn = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return values, vectors * turn


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16) -> DataFrame:
    """Whitened coordinates of every vector along the first `most` principal components, one row for each.

    Columns: the id, component (from 1, by falling variance), n (vectors of the fit), deviation (decimal(38,0): sum over dimensions
    of (n*x-S)^2, exact), whitened, explained, identity_error. The fit holds each distinct x vector once; S are its sums.
    The covariance is the Gramian of rows (n*x-S)/n, that is of x less its exact mean, over n. The components come from its
    d x d matrix on the driver and go to all tasks; d, not the number of rows, bounds both.

    Vectors that are null or have a null or non-finite entry give no rows, nor do vectors whose length is not the commonest one. Repeated rows
    and ids, and null ids, each give their rows. Entries beyond +-2^56 count as +-2^56. Where a component has no variance
    (fewer distinct vectors than dimensions, or one only), whitened is null, explained 0 (null if nothing varies), and identity_error
    leaves it out; it is null if no component is left. A deviation beyond 38 digits is null. An empty table gives no rows. Other
    columns are not read.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[id_col].dataType.simpleString()
    vectors = whole_vectors(embeddings, id_col, vector_col)
    d = dimension(vectors)
    columns = f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], columns)
    vectors = vectors.where(F.size("x") == d)
    fit, fit_path = store(vectors.select("x").distinct(), "fit")
    n, sums = fit.count(), column_sums(fit, d)

    def centred_rows(frames):
        for frame in frames:
            c = centred(np.stack(frame.x.to_numpy()), n, sums) if len(frame) else np.zeros((0, d), np.int64)
            yield pd.DataFrame({"v": list(over_n(c, n))})

    covariance = gramian(fit.mapInPandas(centred_rows, "v array<double>"), "v") / n
    values, axes = components_of(covariance, most)
    total, live = float(np.trace(covariance)), values > LEAST_SHARE * max(values[0], 0)
    explained = (values / total).tolist() if total > 0 else [None] * len(values)
    basis = spark.sparkContext.broadcast(np.where(live, axes / np.sqrt(np.where(live, values, 1)), 0))

    def project(frames):
        for frame in frames:
            c = centred(np.stack(frame.x.to_numpy()), n, sums) if len(frame) else np.zeros((0, d), np.int64)
            exact = [Decimal(s) if s < 10**38 else None for s in squares(c)]
            yield pd.DataFrame({"id": frame.id, "deviation": pd.Series(exact, dtype=object), "w": list(over_n(c, n) @ basis.value)})

    shape = "id string, deviation decimal(38,0), w array<double>"
    error = None
    if live.any():
        kept = np.flatnonzero(live).tolist()
        own = fit.select(F.lit("").alias("id"), "x").mapInPandas(project, shape).select(*(F.col("w")[k].alias(f"w{k}") for k in kept))
        means = own.agg(*(F.avg(c).alias(c) for c in own.columns)).first()
        spread = gramian(own.select(F.array(*(F.col(c) - F.lit(means[c]) for c in own.columns)).alias("v")), "v") / n
        error = float(np.abs(spread - np.eye(len(kept))).max())
    drop_path(spark, fit_path)
    out = vectors.select(F.col("id").cast("string").alias("id"), "x").mapInPandas(project, shape)
    facts = F.array(*(F.struct(F.lit(k + 1).alias("component"), F.lit(bool(live[k])).alias("live"), F.lit(explained[k]).cast("double").alias("explained")) for k in range(len(values))))
    long = out.select("id", "deviation", "w", F.explode(facts).alias("f"))
    return long.select(
        F.col("id").cast(kind).alias(id_col),
        "f.component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("f.live"), F.element_at("w", F.col("f.component"))).alias("whitened"),
        "f.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
