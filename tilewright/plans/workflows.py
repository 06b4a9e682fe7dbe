"""The three workflows, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import pool_of
from ..operators import consensus, coverage, design, evaluate, pcr, readmap, selection, similarity, simulate, windows
from ..operators.graph import durable, numbered
from ..params import Design, Selection, Simulation


def design_primers(loci: DataFrame, p: Design = Design()) -> dict[str, DataFrame]:
    """windows, clusters, primers (clusters' and gaps') of loci (locus_ord, serotype, sequence, length)."""
    cut = durable(windows.sliding_windows(loci, p.window, p.step))
    pairs = similarity.band_pairs(cut, p.k, p.similarity, p.band) if p.band else similarity.all_links(cut, p.k, p.similarity)
    member = durable(similarity.clusters(cut, pairs, p.min_cluster))
    summary = similarity.cluster_summary(cut, member)
    template = consensus.representatives(cut.select("window_idx", "sequence").join(member, "window_idx"), "cluster_no", p.consensus)
    tiled = windows.tiles(template.join(summary.drop("num_windows"), "cluster_no"), p.amplicon, p.overlap, p.min_amplicon)
    keys = ["cluster_no", "cluster_id", "amp_num", "num_windows", "num_serotypes", "serotypes_covered"]
    own = design.named(design.design(tiled, keys), "cluster_id").withColumns({"gene": F.col("cluster_id"), "num_alleles": F.col("num_windows").cast("int"), "primer_type": F.lit("universal")})
    gaps = coverage.gaps(cut.join(member, "window_idx", "left_semi").select("serotype", "start", "end"), loci.select("serotype", "length"), "serotype", p.min_amplicon)
    gap_tiled = windows.gap_tiles(loci, gaps.join(loci.select("serotype", "locus_ord"), "serotype"), p.amplicon, p.overlap, p.min_amplicon)
    found = design.design(gap_tiled, ["serotype", "gap_start", "gap_end", "amp_num"], "offset").withColumn("gene", F.concat("serotype", F.lit("_gap")))
    more = design.named(found, "gene").withColumns({"num_alleles": F.lit(1), "num_serotypes": F.lit(1).cast("bigint"), "serotypes_covered": F.col("serotype"), "primer_type": F.lit("gap"), "gap_region": F.concat_ws("-", "gap_start", "gap_end")})
    both = own.unionByName(more, allowMissingColumns=True).withColumn("pool", pool_of(F.col("amplicon_num")))
    return {"windows": cut, "clusters": summary, "primers": numbered(both, "primer_ord", F.col("cluster_no").asc_nulls_last(), "serotype", "amp_num")}


def select_primers(loci: DataFrame, primers: DataFrame, p: Selection = Selection(), per_locus: bool = False) -> dict[str, DataFrame]:
    """amplicons, the chosen primers and the state of each locus."""
    found = pcr.amplify(loci, primers, p.max_mismatches)
    amplicons = durable(found if per_locus else found.where(pcr.by_size()))
    if per_locus:
        picked = durable(selection.select_per_locus(amplicons, p.overlap_threshold))
        chosen = selection.top_up(amplicons, picked, p.min_per_locus).select("primer_ord").distinct()
    else:
        chosen = selection.select_globally(primers, amplicons, p.min_gap, p.keep_unmapped).select("primer_ord")
    chosen = durable(chosen)
    return {"amplicons": amplicons, "chosen": primers.join(chosen, "primer_ord", "left_semi"), "loci": pcr.per_locus(amplicons.join(chosen, "primer_ord", "left_semi"), loci, p.min_per_locus)}


def cover(loci: DataFrame, primers: DataFrame, p: Selection = Selection()) -> dict[str, DataFrame]:
    """amplicons of a plausible size for their primers, and the coverage tables."""
    amplicons = durable(pcr.amplify(loci, primers, p.max_mismatches).join(primers.select("primer_ord", "product_size", *[c for c in ("gene",) if c in primers.columns]), "primer_ord").where(pcr.by_product()))
    covered = durable(coverage.summary(amplicons, loci.select("serotype", F.length("sequence").alias("length"))))
    return {"amplicons": amplicons, "summary": covered, "bins": coverage.bins(covered), "stats": coverage.stats(covered), "top": coverage.top(covered)}


def simulate_suite(loci: DataFrame, primers: DataFrame, mixtures: DataFrame, p: Simulation = Simulation(), strict: bool = False) -> dict[str, DataFrame]:
    """Reads, results by mixture and replicate, and their statistics. mixtures: mixture, replicate, serotypes, proportions.

    Mixtures whose proportions don't add up to 1 are skipped, or, if strict, end the run with an error.
    """
    keyed = mixtures.withColumn("mixture", F.concat_ws("#", "mixture", F.col("replicate").cast("string")))
    amplicons = pcr.amplify(loci, primers).where(pcr.by_size()).join(loci.select("locus_ord", "sequence"), "locus_ord")
    amplicons = durable(amplicons.withColumn("amplicon_seq", F.substring("sequence", F.col("start") + 1, F.col("size"))).drop("sequence"))
    member = durable(simulate.members(keyed, loci, strict=strict))
    counts = simulate.amplified(member, amplicons, p.templates, cycles=p.cycles, efficiency=p.efficiency)
    shares = simulate.allocation(counts, p.depth, ("mixture",))
    source = shares.join(amplicons.select(F.col("primer_name").alias("primer"), "serotype", "amplicon_seq"), ["primer", "serotype"])
    reads = simulate.reads(source, p.read_length, p.error_rate, p.seed, ("mixture", "primer", "serotype"))
    reads = durable(reads.withColumn("read_id", F.concat_ws("|", "mixture", "primer", "serotype", "read_no")))
    mapped = readmap.map_by_kmers(reads, amplicons, p.k).join(amplicons.select("primer_ord", "locus_ord", "serotype"), ["primer_ord", "locus_ord"])
    guessed = evaluate.deconvolve(mapped.join(reads.select("read_id", "mixture"), "read_id"), ("mixture",))
    result = evaluate.accuracy(member, guessed)
    split = result.withColumns({"replicate": F.split_part("mixture", F.lit("#"), F.lit(-1)).cast("int"), "mixture": F.substring_index("mixture", "#", 1)})
    return {"reads": reads, "results": split, "stats": evaluate.suite_stats(split)}
