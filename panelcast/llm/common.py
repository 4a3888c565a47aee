"""Shared helpers: scratch tables in the cluster's shared folder, Arrow batches
cut by bytes, table loading and column handling.

Null handling common to all operators: a null text counts as the empty text, a
null id is kept as a null id. Columns that an operator does not use are ignored,
so extra columns with clashing names do no harm.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import ship_package

#: Bytes of text handled at a time inside a Python task; bounds its memory.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir``. Where it
    is unset, a local master gets a fresh local folder; a cluster is refused,
    because its executors would not see such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="panelcast-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"


def open_fs(uri: str):
    """(file system, path) of a folder that Python tasks read or write themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def staged(df: DataFrame, what: str, small: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: cuts
    the lineage, survives lost executors, and lets later jobs prune columns.

    ``small`` is for tables much smaller than the documents: their finished rows are
    dealt out again, to as many files as their size asks for. The work before that
    keeps all its tasks."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    if small:
        df = df.hint("rebalance")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(f, schema)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose texts take about ``limit`` bytes; a
    longer text makes a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < n:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def strings(column: pa.Array) -> pa.Array:
    """A plain string array without nulls."""
    return pc.fill_null(column.cast(pa.string()), "")


_WHITE = re.compile(r"[\x20\x09-\x0D]")


def slices(text: str, limit: int = BATCH_BYTES) -> Iterator[str]:
    """Consecutive parts of ``text`` of about ``limit`` characters, cut before ASCII
    white space; a longer word is not cut."""
    lo = 0
    while lo < len(text):
        cut = _WHITE.search(text, lo + limit)
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def parts(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """``texts`` as they are; of a single text beyond ``limit`` bytes its ``slices``, one
    at a time, so that what is counted along a text takes bounded memory."""
    if is_long(texts, limit):
        for part in slices(texts[0].as_py(), limit // 2):
            yield pa.array([part], pa.string())
    else:
        yield texts


def is_long(texts: pa.Array, limit: int = BATCH_BYTES) -> bool:
    """Whether ``texts`` is a slice of ``by_bytes`` that one text beyond ``limit`` fills."""
    return len(texts) == 1 and texts.nbytes > limit
