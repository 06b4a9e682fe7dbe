"""Keeps a tile catalogue of all reference loci up to date as new loci arrive.

New texts arrive as Parquet files in a folder. A file stream takes the files that the checkpoint doesn't know yet, turns each text into
a locus, cuts it into amplicon tiles and appends them to OUTPUT/tiles, partitioned by their GC share in steps of ten percent, which
is what primer design filters by. A tile's key is the same for both strands. After the stream has ended OUTPUT/shared is written anew
from all tiles: which keys stand in several loci, so that one primer pair can serve them.

    spark-submit --py-files ... jobs/locus_intake.py --input .../documents.parquet --output OUT --checkpoint CHECK --config jobs/locus_intake.json

A run that ends early is repeated: the stream's checkpoint and the file sink's log make every file's tiles appear once. Without
new files a run leaves the tiles as they are and writes the same table of shared tiles.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.tables import stored  # noqa: E402
from tilewright.functions import sequences as sq  # noqa: E402
from tilewright.operators import windows  # noqa: E402

log = logging.getLogger("jobs.locus_intake")
TILES = "locus_ord bigint, amp_num int, region_start int, region_end int, n_gc int, tile_key string, gc_bin int"


def tiles_of(texts: DataFrame, amplicon: int, overlap: int, min_amplicon: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TILES of every text. Texts with too few letters, empty and null ones have none; a null id is kept."""
    loci = texts.select(texts[id_col].cast("bigint").alias("locus_ord"), sq.dna(texts[text_col]).alias("sequence"))
    cut = windows.tiles(loci, amplicon, overlap, min_amplicon)
    n_gc = sq.count_base(F.col("region"), "G") + sq.count_base(F.col("region"), "C")
    key = F.sha2(F.least("region", sq.reverse_complement(F.col("region"))), 256)
    rows = cut.select("locus_ord", "amp_num", "region_start", "region_end", n_gc.alias("n_gc"), key.alias("tile_key"), F.length("region").alias("n"))
    return rows.withColumn("gc_bin", F.expr("CAST(n_gc * 10 DIV n * 10 AS INT)")).drop("n")


def run(spark: SparkSession, input: str, output: str, checkpoint: str, amplicon: int = 500, overlap: int = 75, min_amplicon: int = 400, files_per_batch: int = 1000) -> dict[str, int]:
    """Takes the files of `input` that are new since the last run with this checkpoint. Returns how many texts were read and tiles written.

    input: a folder of Parquet files, or one file, with the columns doc_id and text; other columns are left aside.
    """
    schema = spark.read.parquet(input).select("doc_id", "text").schema
    input = input.rstrip("/")
    folder = input if any(c in input for c in "*?[{") else f"{input[:-1]}[{input[-1]}]"  # as a pattern; else a stream takes no single file
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    cut = tiles_of(source, amplicon, overlap, min_amplicon)
    writer = cut.writeStream.format("parquet").partitionBy("gc_bin").option("path", f"{output}/tiles").option("checkpointLocation", f"{checkpoint}/locus_intake").outputMode("append")
    before = tiles(spark, output).count()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    texts = sum(p["numInputRows"] for p in query.recentProgress)
    catalogue = tiles(spark, output)
    shared = catalogue.groupBy("tile_key").agg(F.count("*").alias("n_tiles"), F.count_distinct("locus_ord").alias("n_loci")).where("n_tiles > 1")
    shared.withColumn("loci", F.when(F.col("n_loci") > 1, "several").otherwise("one")).write.mode("overwrite").partitionBy("loci").parquet(f"{output}/shared")
    done = {"texts": texts, "tiles": catalogue.count() - before, "all_tiles": catalogue.count()}
    log.info("read %d new texts of %s; wrote %d tiles to %s/tiles, which has %d now; wrote %s/shared", texts, input, done["tiles"], output, done["all_tiles"], output)
    return done


def tiles(spark: SparkSession, output: str) -> DataFrame:
    """The catalogue as it stands; empty before the first run."""
    return stored(spark, f"{output}/tiles", TILES)


def read_back(spark: SparkSession, output: str) -> DataFrame:
    """All tiles, each with how often its key stands in the catalogue and in how many loci."""
    shared = stored(spark, f"{output}/shared", "tile_key string, n_tiles bigint, n_loci bigint, loci string")
    joined = tiles(spark, output).join(shared.drop("loci"), "tile_key", "left")
    one = F.when(F.col("locus_ord").isNull(), 0).otherwise(1)
    return joined.withColumns({"n_tiles": F.coalesce("n_tiles", F.lit(1)).cast("bigint"), "n_loci": F.coalesce("n_loci", one).cast("bigint")})


if __name__ == "__main__":
    from jobs.cli import main

    main("locus_intake", run, ("input", "output", "checkpoint"))
