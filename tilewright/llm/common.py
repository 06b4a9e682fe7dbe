"""What the operators of this subpackage share: table reading, Arrow batches cut to a byte bound, durable cuts of lineage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import durable, spread

__all__ = ["durable", "table", "steps", "raw", "texts", "map_steps", "sha", "fold_of", "py_fold", "hashed_sample"]

#: Bytes of text that one step of a Python operator holds at once; a longer single text is one step of its own.
STEP_BYTES, STEP_ROWS = 2 << 20, 10_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch of at most `rows` rows whose texts have at most limit bytes together (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.fromiter((x or 0 for x in pc.binary_length(col).to_pylist()), np.int64, n))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + limit, "right"))))
        yield batch.slice(at, to - at)
        at = to


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_steps(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, limit: int = STEP_BYTES, rows: int = STEP_ROWS) -> DataFrame:
    """mapInArrow over slices of a bounded size. make() runs once a task and returns the function for a slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in steps(batch, column, limit, rows):
                yield f(part)
        pa.default_memory_pool().release_unused()  # workers live on: what Arrow keeps for later goes back

    return df.mapInArrow(run, schema)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def fold_of(column: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def py_fold(doc_id: int, folds: int) -> int:
    return crc32(str(doc_id).encode()) % folds


def hashed_sample(rows: DataFrame, id_col: str, group: str, want: dict[Any, int]) -> tuple[dict[Any, list], dict[Any, int]]:
    """Ids by group, want[group] of them at most, those with the smallest hashes; and how many rows each group has.

    Rows are first thinned to hashes below a threshold that leaves about half as many ids again as are wanted, so what tasks
    hand on together is bounded however many partitions there are. Null ids and groups outside `want` are left out.
    """
    spark, hashed = rows.sparkSession, F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    rows = rows.select(F.col(id_col).alias("id"), F.col(group).alias("g")).where(F.col("id").isNotNull())
    kind = rows.schema["g"].dataType.simpleString()
    wanted = F.broadcast(spark.createDataFrame([(g,) for g in want], f"g {kind}"))
    sizes = rows.join(wanted, "g").groupBy("g").agg(F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids")).collect()
    if not sizes:
        return {}, {}
    limits = F.broadcast(spark.createDataFrame([(r.g, (1.5 * want[r.g] + 50) / max(1, r.ids) * (1 << 32)) for r in sizes], f"g {kind}, below double"))
    few = rows.join(limits, "g").select("g", "id", hashed.alias("h"), "below").where(F.col("h") < F.col("below")).select("g", "id", "h").distinct().collect()
    chosen: dict[Any, list] = {}
    for r in sorted(few, key=lambda r: (r.h, r.id)):
        own = chosen.setdefault(r.g, [])
        if len(own) < want[r.g]:
            own.append(r.id)
    return chosen, {r.g: r.n for r in sizes}
