"""Sliding windows over loci, and tiles over consensus sequences and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import cut, few_unknown, sanitise
from .graph import numbered


def starts(length: Column, size: int, step: int) -> Column:
    """0, step, ... while a whole window of `size` fits."""
    return F.when(length >= size, F.sequence(F.lit(0), length - size, F.lit(step))).otherwise(F.array().cast("array<int>"))


def sliding_windows(loci: DataFrame, size: int, step: int, unknown_share: float = 0.1, number: bool = True) -> DataFrame:
    """All whole windows with at most unknown_share * size N. window_idx runs over loci by locus_ord, then start."""
    cutout = loci.withColumn("start", F.explode(starts(F.length("sequence"), size, step))).withColumn("end", F.col("start") + size)
    kept = cutout.withColumn("sequence", cut(F.col("sequence"), F.col("start"), F.col("end"))).where(few_unknown(F.col("sequence"), size, unknown_share))
    kept = kept.select("locus_ord", "serotype", "start", "end", "sequence", F.length("sequence").alias("length"))
    if not number:
        return kept
    ordered = numbered(kept.select("locus_ord", "start"), "window_idx", "locus_ord", "start")
    return kept.join(ordered, ["locus_ord", "start"]).withColumn("window_id", F.concat(F.lit("win_"), F.col("window_idx")))


def tiles(templates: DataFrame, amplicon: int = 500, overlap: int = 75, min_region: int = 400, reach: int = 100) -> DataFrame:
    """Tiles of each template's sequence: regions of `amplicon` and `reach` on both sides, every amplicon - overlap bases.

    amp_num counts from 1; the target is relative to the region. Regions shorter than min_region end a template, sequences
    shorter than `reach` have no tile. Characters other than ACGTN become N.
    """
    step, n = amplicon - overlap, F.length("sequence")
    rows = templates.where(n > 0).withColumn("_n", n).withColumn("region_start", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(step))))
    rows = rows.withColumn("region_end", F.least(F.col("region_start") + amplicon + 2 * reach, F.col("_n"))).where((F.col("region_end") - F.col("region_start")) >= min_region)
    return (
        rows.withColumn("amp_num", (F.col("region_start") / step).cast("int") + 1)
        .withColumn("region", sanitise(cut(F.col("sequence"), F.col("region_start"), F.col("region_end"))))
        .withColumn("target_start", F.lit(reach))
        .withColumn("target_end", F.least(F.lit(reach + amplicon), F.col("region_end") - F.col("region_start")))
        .drop("_n", "sequence")
    )


def gap_tiles(loci: DataFrame, gaps: DataFrame, amplicon: int = 500, overlap: int = 75, min_region: int = 400, reach: int = 100) -> DataFrame:
    """Tiles inside gaps (locus_ord, serotype, gap_start, gap_end). amp_num runs over all gaps of a locus; places are the locus'."""
    inside = gaps.join(loci.select("locus_ord", F.col("sequence").alias("_s")), "locus_ord").withColumn("sequence", cut(F.col("_s"), F.col("gap_start"), F.col("gap_end"))).drop("_s")
    found = tiles(inside, amplicon, overlap, min_region, reach).drop("amp_num")
    order = Window.partitionBy("locus_ord").orderBy("gap_start", "region_start")
    return found.withColumn("amp_num", F.row_number().over(order)).withColumn("offset", F.col("gap_start") + F.col("region_start"))
