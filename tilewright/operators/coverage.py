"""Unions, gaps and coverage of intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Places of a cell. A locus is scanned cell by cell: each cell's rows alone, after a scan of one summary row a cell has told
#: what comes in from the cells before. So one locus is as many keys as it has cells, and a key has at most CELL starts.
CELL = 1 << 16


def _cell(cell: int) -> Column:
    return F.floor(F.col("start") / cell)


def _carried(rows: DataFrame, group: str, summary: Column, scan: Callable[[Column], Column], name: str, cell: int) -> DataFrame:
    """rows with _cell and what `scan` makes of the summaries of all cells of the group before the row's own, as column `name`."""
    placed = rows.withColumn("_cell", _cell(cell))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(group, "_cell").agg(summary.alias("_s")).select(group, "_cell", scan(F.col("_s")).over(before).alias(name))
    return placed.join(cells, [group, "_cell"])


def _reach(rows: DataFrame, group: str, cell: int) -> DataFrame:
    """rows with `reach`: the furthest end of the rows before, in the order of start and end; null for a group's first row."""
    by = Window.partitionBy(group, "_cell").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(rows, group, F.max("end"), F.max, "_reach", cell)
    return carried.withColumn("reach", F.greatest(F.max("end").over(by), "_reach")).drop("_cell", "_reach")


def union(intervals: DataFrame, group: str, cell: int = CELL) -> DataFrame:
    """(group, start, end): maximal runs of covered places. Touching intervals become one; empty ones are left out."""
    own = intervals.where(F.col("end") > F.col("start")).select(group, "start", "end").groupBy(group, "start").agg(F.max("end").alias("end"))
    marked = _reach(own, group, cell).withColumn("_new", F.when(F.col("start") <= F.col("reach"), 0).otherwise(1))
    numbered = _carried(marked, group, F.sum("_new"), F.sum, "_runs", cell)
    by = Window.partitionBy(group, "_cell").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("_new").over(by) + F.coalesce("_runs", F.lit(0))
    return numbered.withColumn("_run", run).groupBy(group, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def gaps(intervals: DataFrame, loci: DataFrame, group: str, least: int, cell: int = CELL) -> DataFrame:
    """(group, gap_start, gap_end): runs of [0, length) that nothing covers, of at least `least` places. loci: group, length."""
    islands = union(intervals, group, cell).select(group, "start", "end")
    ends = loci.select(group, F.lit(0).alias("start"), F.lit(0).alias("end")).unionByName(loci.select(group, F.col("length").alias("start"), F.col("length").alias("end")))
    rows = islands.join(loci.select(group), group, "left_semi").unionByName(ends)
    found = _reach(rows, group, cell).select(group, F.col("reach").alias("gap_start"), F.col("start").alias("gap_end"))
    return found.where(F.col("gap_end") - F.col("gap_start") >= least)


def summary(amplicons: DataFrame, loci: DataFrame, group: str = "serotype") -> DataFrame:
    """group, locus_length, num_amplicons, covered_bases, coverage_percent; loci without amplicons have zeros. loci: group, length."""
    covered = union(amplicons, group).groupBy(group).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    counts = amplicons.groupBy(group).agg(F.count("*").alias("n"))
    rows = loci.select(group, F.col("length").alias("locus_length")).join(counts, group, "left").join(covered, group, "left")
    bases = F.coalesce("covered", F.lit(0)).cast("bigint")
    return rows.select(group, "locus_length", F.coalesce("n", F.lit(0)).cast("bigint").alias("num_amplicons"), bases.alias("covered_bases"), F.when(F.col("locus_length") > 0, bases / F.col("locus_length") * 100).otherwise(0.0).alias("coverage_percent"))


BINS = ((0, 25), (25, 50), (50, 75), (75, 90), (90, 100))


def bins(covered: DataFrame, overflow: bool = False) -> DataFrame:
    """(bin, loci) of the half-open bins; empty bins have 0. Exactly 100 % is in none, or in 100+ with overflow."""
    c = F.col("coverage_percent")
    label = F.lit(None).cast("string")
    for a, b in BINS:
        label = F.when((c >= a) & (c < b), f"{a}-{b}").otherwise(label)
    names = [f"{a}-{b}" for a, b in BINS]
    if overflow:
        label, names = F.when(c >= 100, "100+").otherwise(label), [*names, "100+"]
    every = covered.sparkSession.createDataFrame([(x,) for x in names], "bin string")
    return every.join(covered.select(label.alias("bin")).groupBy("bin").count(), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("loci"))


def stats(covered: DataFrame) -> DataFrame:
    c = F.col("coverage_percent")
    return covered.agg(F.count("*").alias("loci"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))


def top(covered: DataFrame, k: int = 30, group: str = "serotype") -> DataFrame:
    """The k best covered loci, ties by name."""
    return covered.orderBy(F.desc("coverage_percent"), group).limit(k)


def plot_rows(amplicons: DataFrame, loci: DataFrame, group: str = "serotype", cell: int = CELL) -> DataFrame:
    """What a locus plot draws: level and colour of each amplicon by its place, a label where it is long enough."""
    rows = amplicons.join(loci.select(group, F.col("length").alias("_n")), group)
    here = F.row_number().over(Window.partitionBy(group, "_cell").orderBy("start", "end", "primer_name")) - 1
    rows = _carried(rows, group, F.count("*"), F.sum, "_before", cell).withColumn("_k", here + F.coalesce("_before", F.lit(0)))
    label = F.when(F.col("end") - F.col("start") > F.col("_n") * 0.05, F.split_part("gene", F.lit("_"), F.lit(1)))
    return rows.select(group, "primer_name", "start", "end", (F.col("_k") % 3).cast("int").alias("level"), (F.col("_k") % 20).cast("int").alias("colour"), label.alias("label"))
