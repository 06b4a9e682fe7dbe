"""Reads that arrive as a stream: mapped without state, counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import kmers
from ..operators.readmap import postings


def hits(reads: DataFrame, amplicons: DataFrame, k: int = 31) -> DataFrame:
    """(read_id, primer_ord, locus_ord, hits) of a streaming table of reads against a static index; a stream-static join and one count.

    Run it in update or complete mode. The index is joined by hash, not broadcast by force.
    """
    index = postings(amplicons, k).select(F.xxhash64("kmer").alias("h"), "primer_ord", "locus_ord")
    asked = reads.select("read_id", F.explode(kmers(F.col("read"), k, skip_unknown=False)).alias("kmer")).select("read_id", F.xxhash64("kmer").alias("h"))
    return asked.join(index, "h").groupBy("read_id", "primer_ord", "locus_ord").agg(F.count("*").alias("hits"))
