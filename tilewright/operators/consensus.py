"""Representatives of clusters: the only window, a majority of aligned columns or of places, or the first longest window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alignment

#: Clusters of up to this many windows vote in groups of several clusters, larger ones alone or in parts.
FEW = 10


def column_majority(members: DataFrame, key: str, seq_col: str = "sequence") -> DataFrame:
    """(key, sequence): per column the base that more than half of the A, C, G, T have, else N; columns without any are skipped.

    Columns are places from the left: sequences are taken as aligned, as equally long windows of one cut are.
    """
    cells = members.select(key, F.posexplode(F.split(F.col(seq_col), "")).alias("pos", "base")).where(F.col("base").isin("A", "C", "G", "T"))
    counts = cells.groupBy(key, "pos", "base").agg(F.count("*").alias("n"))
    columns = counts.groupBy(key, "pos").agg(F.max(F.struct("n", "base")).alias("m"), F.sum("n").alias("total"))
    letter = F.when(F.col("m.n") * 2 > F.col("total"), F.col("m.base")).otherwise("N")
    return columns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", letter.alias("b")))).alias("cs")).select(key, F.array_join(F.transform("cs", lambda c: c["b"]), "").alias("sequence"))


def representatives(members: DataFrame, key: str = "cluster_no", mode: str = "majority") -> DataFrame:
    """(key, sequence, num_windows). members: key, window_idx, sequence.

    mode "aligned" votes over the columns of an alignment, "majority" over places from the left, as equally long windows of one cut
    are aligned; all windows of a cluster vote, however many there are. "first" takes the first longest window always.
    Places are counted in parts of a cluster, which are added up; an alignment lays one window after the other, so a cluster passes through one task.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("num_windows"), F.max_by("sequence", F.struct(F.length("sequence"), -F.col("window_idx"))).alias("longest"))
    if mode == "first":
        return sizes.select(key, F.col("longest").alias("sequence"), "num_windows")
    few, many = sizes.where(F.col("num_windows").between(2, FEW)).select(key), sizes.where(F.col("num_windows") > FEW).select(key, "num_windows")
    large = members.join(many, key)
    rest = alignment.consensus(large, key, True, together=1) if mode == "aligned" else alignment.place_majority(large, key, "num_windows")
    voted = alignment.consensus(members.join(few, key, "left_semi"), key, mode == "aligned").unionByName(rest).select(key, F.col("sequence").alias("voted"))
    # nothing but N in all windows: the longest one stands, as where there is no vote
    return sizes.join(voted, key, "left").select(key, F.when(F.length("voted") > 0, F.col("voted")).otherwise(F.col("longest")).alias("sequence"), "num_windows")
