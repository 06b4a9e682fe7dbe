"""FASTA databases: <db>/reference.fasta and <db>/<directory>/reference.fasta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import numbered

FILE = "reference.fasta"


#: Orders the records of a file, across its splits.
ORDER = "decimal(38,0)"


def records(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, record_ord, record_id, sequence): every record of the files; the id is the header's first word, sequences in upper case.

    A record is what stands between two line ends with a > behind them, so Spark's text reader splits a large file between records
    as it splits others between lines; record_ord ascends over a file but isn't dense. What stands before a file's first record is
    left out if it is blank or begins with ; as comments do.
    """
    text = spark.read.option("lineSep", "\n>").text(list(paths))
    order = F.col("_metadata.file_block_start").cast(ORDER) * F.lit(1 << 60).cast("decimal(19,0)") + F.monotonically_increasing_id()
    rows = text.select(F.replace("value", F.lit("\r"), F.lit("")).alias("r"), F.col("_metadata.file_path").alias("path"), order.cast(ORDER).alias("record_ord"))
    rows = rows.where(~F.col("r").rlike(r"^\s*(;|$)")).withColumn("r", F.regexp_replace("r", r"^\s*>", ""))
    header = F.substring_index("r", "\n", 1)
    body = F.when(F.instr("r", "\n") > 0, F.substr("r", F.length(header) + 2)).otherwise("")
    return rows.select("path", "record_ord", F.split_part(F.regexp_replace(header, r"\s+", " "), F.lit(" "), F.lit(1)).alias("record_id"), F.upper(F.regexp_replace(body, r"\s", "")).alias("sequence"))


def precedence(root: DataFrame, directories: DataFrame) -> DataFrame:
    """(serotype, record_id, sequence, source, place): root records first, then directories whose name no root record has.

    root: record_ord, record_id, sequence. Of several records with one id the last sequence counts, at the first place.
    directories: directory, record_ord, record_id, sequence. Only a directory's first record counts; directories go by name.
    """
    own = root.groupBy("record_id").agg(F.max_by("sequence", "record_ord").alias("sequence"), F.min("record_ord").alias("k"))
    own = own.select(F.col("record_id").alias("serotype"), "record_id", "sequence", F.lit("root").alias("source"), F.struct(F.lit(0).alias("part"), F.col("k").cast(ORDER).alias("k"), F.lit("").alias("name")).alias("place"))
    first = directories.groupBy("directory").agg(F.min_by(F.struct("record_id", "sequence"), "record_ord").alias("r"))
    more = first.select(F.col("directory").alias("serotype"), "r.record_id", "r.sequence", F.col("directory").alias("source"), F.struct(F.lit(1).alias("part"), F.lit(0).cast(ORDER).alias("k"), F.col("directory").alias("name")).alias("place"))
    return own.unionByName(more.join(own.select("serotype"), "serotype", "left_anti"))


def read_database(spark: SparkSession, db: str) -> DataFrame:
    """The loci of a database, in the order of `precedence`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(db)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    has = lambda p: fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p)) or []
    root_path, dirs = f"{db}/{FILE}", f"{db}/*/{FILE}"
    empty = spark.createDataFrame([], f"path string, record_ord {ORDER}, record_id string, sequence string")
    root = records(spark, root_path) if len(has(root_path)) else empty
    below = records(spark, dirs) if len(has(dirs)) else empty
    found = precedence(root, below.withColumn("directory", F.url_decode(F.element_at(F.split("path", "/"), -2))))
    return numbered(found, "locus_ord", "place").select("locus_ord", "serotype", "record_id", "sequence", F.length("sequence").alias("length"), "source")
