"""Durable cuts of lineage, global row numbers and connected components, all distributed."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or the folder that the context was given for checkpoints. Where both are unset, a local session
    gets a temporary folder; on a cluster that is an error, since other machines couldn't read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or tempfile.mkdtemp(prefix="tilewright-")).rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder: computed once, and safe when an executor is lost."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tidy(df: DataFrame) -> None:
    """Frees shuffle and checkpoint files that nothing refers to any more; Spark only looks for them when the driver collects garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table for work that is heavy for its bytes: where its files make fewer tasks than there are cores, its rows are
    dealt to as many tasks as cores. Large tables have more and stay as they are. Only for plain scans: it looks at their plan."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def dealt(df: DataFrame, *by: str | Column) -> DataFrame:
    """df's rows dealt by key to as many tasks as shuffles have, for work that is heavy for its bytes: those of small rows would
    otherwise be put together in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with row numbers from 0 in the given order, without a one-partition sort.

    Rows are range-partitioned and sorted; only the partitions' row counts come to the driver, to become offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(df.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("_id", F.monotonically_increasing_id())
    counts = sorted((r.p, r.n) for r in rows.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, at = [], 0
    for p, k in counts:
        offsets.append((p, at))
        at += k
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p bigint, _at bigint"))
    return rows.join(known, F.shiftright("_id", 33) == F.col("_p")).withColumn(name, F.col("_at") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_p", "_at")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of the edges can reach. Nodes without edges aren't in it.

    Alternates large-star and small-star contractions (Kiveris et al. 2014), O(log n) rounds for most graphs. A hot node's
    neighbours are only ever reduced to a minimum before the shuffle and joined, never gathered in a list.
    Null ends are left out; loops and repeated edges don't matter.
    """
    size = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
    pairs = durable(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        # large-star: every neighbour above a node is linked to the smallest of the node and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: every neighbour below a node, and the node, is linked to the smallest of them
        down = large.distinct()
        joined = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = durable(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = size(pairs)
        if now == before:
            break
        before = now
        tidy(pairs)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
