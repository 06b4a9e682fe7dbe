"""Primer tables in, result tables and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import numbered
from ..schemas import EXPORTED, PRIMERS

TYPES = dict(c.split() for c in PRIMERS.split(", "))


def read_primers(spark: SparkSession, path: str) -> DataFrame:
    """A primer table with header; tab-separated if the name ends in .tsv. Known columns have fixed types; primer_ord is the row order."""
    sep = "\t" if path.endswith(".tsv") else ","
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    typed = raw.select([F.col(f"`{c}`").cast(TYPES.get(c, "string")).alias(c) for c in raw.columns])
    # a file's rows are read in order, and files in the order of their names
    placed = typed.withColumn("_f", F.input_file_name()).withColumn("_k", F.monotonically_increasing_id())
    return numbered(placed, "primer_ord", "_f", "_k").drop("_f", "_k")


def export_columns(primers: DataFrame) -> DataFrame:
    """The known columns that the table has, in the fixed order; adds left_name and right_name where there is a name."""
    if "name" in primers.columns:
        primers = primers.withColumns({f"{s}_name": F.concat("name", F.lit(f"_{s.upper()}")) for s in ("left", "right") if f"{s}_name" not in primers.columns})
    return primers.select([c for c in EXPORTED if c in primers.columns])


def write_primers(primers: DataFrame, path: str, sep: str = ",", order: str | None = "primer_ord", by_pool: bool = True) -> list[str] | None:
    """Writes all primers, and one table a pool that has any; nothing (None) if there are none. Returns the paths."""
    if primers.isEmpty():
        return None
    rows = primers.orderBy(order) if order and order in primers.columns else primers
    options = {"header": True, "sep": sep}
    export_columns(rows).write.mode("overwrite").options(**options).csv(f"{path}/all")
    written = [f"{path}/all"]
    if by_pool and "pool" in primers.columns:
        for r in primers.select("pool").where("pool is not null").distinct().orderBy("pool").collect():
            export_columns(rows.where(F.col("pool") == r.pool)).write.mode("overwrite").options(**options).csv(f"{path}/{r.pool}")
            written.append(f"{path}/{r.pool}")
    return written


def semi_export(primers: DataFrame, chosen: DataFrame, key: str = "name", need_pool: bool = False) -> DataFrame:
    """The rows whose key was chosen. need_pool: a table without a pool column is an error."""
    if need_pool and "pool" not in primers.columns:
        raise ValueError("the primer table has no column pool")
    return primers.join(chosen.select(key).distinct(), key, "left_semi")


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> str:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def coverage_text(stats: dict, bins: list[tuple[str, int]], rows: list[tuple[str, float, int]]) -> str:
    lines = ["Coverage summary", f"Loci: {stats['loci']}"]
    lines += [f"{k.capitalize()} coverage: {stats[k]:.1f}%" for k in ("mean", "least", "most") if stats.get(k) is not None]
    lines += ["", "Loci by coverage"] + [f"  {b}%: {n}" for b, n in bins]
    lines += ["", "Locus, coverage, amplicons"] + [f"  {name}: {c:.1f}% ({n})" for name, c, n in rows]
    return "\n".join(lines) + "\n"


def selection_text(given: int, kept: int, rows: list[tuple[str, int, str]]) -> str:
    saved = (1 - kept / given) * 100 if given else 0.0
    return "\n".join([f"Primers given: {given}", f"Primers kept: {kept}", f"Reduction: {saved:.1f}%", "", *[f"  {name}: {n} {status}" for name, n, status in rows]]) + "\n"


def design_text(loci: int, windows: int, clusters: int, primers: int, pools: dict[str, int], total_bp: int, amplicon: int, best: list[tuple[str, int]]) -> str:
    naive = total_bp / amplicon
    saved = (naive - primers) / naive * 100 if naive else 0.0
    lines = [f"Loci: {loci}", f"Windows: {windows}", f"Clusters: {clusters}", f"Primer pairs: {primers}", *[f"{p}: {n}" for p, n in sorted(pools.items())], f"Total length: {total_bp}", f"Without sharing: {int(naive)}", f"Reduction: {saved:.1f}%", "", "Most shared"]
    return "\n".join(lines + [f"  {name}: {n}" for name, n in best]) + "\n"
