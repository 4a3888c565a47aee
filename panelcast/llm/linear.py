"""Linear models fitted from sums over partitions.

Each partition sums its share of a matrix; the shares are added up by Spark in
blocks of rows, and only the finished matrix, whose size depends on the number of
features alone, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.session import ship_package

#: Rows of a matrix that are added up together.
BLOCK = 32


def summed(rows: DataFrame, share: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int, int]) -> np.ndarray:
    """The sum of ``share(batch)``, an array of ``shape``, over all batches of ``rows``."""
    many, height, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += share(batch)
        spots = [(k, lo) for k in range(many) for lo in range(0, height, BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in spots], pa.int32()), pa.array([lo for _, lo in spots], pa.int32()), pa.array([total[k, lo : lo + BLOCK].tobytes() for k, lo in spots], pa.binary())],
            names=["k", "lo", "part"],
        )

    def add(batches: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in batches.column("part").to_pylist())
        return pa.table({"k": batches.column("k")[:1], "lo": batches.column("lo")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    ship_package(rows.sparkSession)
    shares = common.map_arrow(rows, run, "k int, lo int, part binary")
    out = np.zeros(shape)
    for r in shares.groupBy("k", "lo").applyInArrow(add, "k int, lo int, part binary").collect():
        block = np.frombuffer(bytes(r["part"]), np.float64).reshape(-1, width)
        out[r["k"], r["lo"] : r["lo"] + len(block)] = block
    return out


def features_of(batch: pa.RecordBatch, column: str = "features") -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.float64)


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` if they are at most ``most``, else the share of them, chosen by a hash
    of their id, that is expected to be so many."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * most / n))


def isotonic(positions: np.ndarray, weights: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (position, rising value) for interpolation."""
    pools: list[list[float]] = []  # weight, sum of values, sum of positions
    for p, w, m in zip(positions, weights, means, strict=True):
        pools.append([w, w * m, w * p])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p / w for w, _, p in pools]), np.array([v / w for w, v, _ in pools])
