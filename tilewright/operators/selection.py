"""Order-dependent selections of non-overlapping amplicons."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import crowding, near, neighbours, shared_fraction
from .graph import dealt, durable, numbered, tidy


def conflicts(amplicons: DataFrame, min_gap: int, width: int = 0) -> DataFrame:
    """(primer_ord, other): primers with amplicons of one locus less than min_gap apart; each pair once, smaller number first."""
    own = amplicons.select("serotype", "start", "end", "primer_ord")
    g = max(min_gap, 1)
    both = neighbours(own, own, "serotype", g, width or 4 * g).where((F.col("l.primer_ord") < F.col("r.primer_ord")) & near(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end"), min_gap))
    return both.select(F.col("l.primer_ord").alias("primer_ord"), F.col("r.primer_ord").alias("other")).distinct()


def _refused(edges: DataFrame) -> DataFrame | None:
    """Who is refused when primers are taken in turn: edges (primer_ord, other) lead from a primer to one behind it that it is in conflict
    with. Whoever has no edge before it is taken and refuses all behind it. None where there are no edges."""
    edges, refused = durable(edges), None
    while not edges.isEmpty():
        behind = edges.select(F.col("other").alias("primer_ord")).distinct()
        out = durable(edges.join(behind, "primer_ord", "left_anti").select("other").distinct())
        refused = out if refused is None else refused.unionByName(out)
        edges = durable(edges.join(out, "other", "left_anti").join(out.withColumnRenamed("other", "primer_ord"), "primer_ord", "left_anti").select("primer_ord", "other"))
    return refused


def select_globally(primers: DataFrame, amplicons: DataFrame, min_gap: int = 100, keep_unmapped: bool = True, width: int = 0) -> DataFrame:
    """Primers taken one by one, those in the most loci first (ties by primer_ord), each if no amplicon of it is in conflict with an
    amplicon of one taken before. (primer_ord, loci). Primers without amplicons have no conflict; keep_unmapped takes them.

    Done in steps over ever longer heads of that order: only a head's own conflicts become pairs, and those that it takes strike out all
    behind it that they are in conflict with before the next head, which is 8 times as long. What is left has few conflicts by then, so
    pairs stay about as many as amplicons. A head whose places are too crowded for that is cut to an eighth. That gives the
    sequential result whatever the number of executors; nothing is collected.
    """
    g = max(min_gap, 1)
    width = width or 4 * g
    own = amplicons.where(F.col("serotype").isNotNull())
    loci = own.groupBy("primer_ord").agg(F.count_distinct("serotype").alias("loci"))
    all_loci = primers.select("primer_ord").distinct().join(loci, "primer_ord", "left").select("primer_ord", F.coalesce("loci", F.lit(0)).alias("loci"))
    nodes = numbered(all_loci, "rank", F.desc("loci"), "primer_ord")
    # from here on a primer's number is its place in the order
    left = durable(own.join(nodes.select("primer_ord", "rank"), "primer_ord").select("serotype", "start", "end", F.col("rank").alias("primer_ord")))
    most, last = max(left.count(), 10_000), nodes.where("loci > 0").count()
    at, upto, taken = 0, max(last // 64, 1), nodes.where("loci = 0").select("rank") if keep_unmapped else nodes.where("false").select("rank")
    while at < last:
        upto = min(upto, last)
        while upto > at + 1 and crowding(left.where(F.col("primer_ord") < upto), "serotype", g, width) > 4 * most:
            upto = at + max((upto - at) // 8, 1)
        head, rest = left.where(F.col("primer_ord") < upto), left.where(F.col("primer_ord") >= upto)
        refused = _refused(conflicts(head, min_gap, width))
        now = head.select("primer_ord").distinct()
        now = durable(now if refused is None else now.join(refused.withColumnRenamed("other", "primer_ord"), "primer_ord", "left_anti"))
        taken = taken.unionByName(now.withColumnRenamed("primer_ord", "rank"))
        if upto < last:
            meet = neighbours(head.join(now, "primer_ord", "left_semi"), rest, "serotype", g, width).where(near(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end"), min_gap))
            struck = meet.select(F.col("r.primer_ord").alias("primer_ord")).distinct()
            left = durable(rest.join(struck, "primer_ord", "left_anti"))
            tidy(left)
        at, upto = upto, 8 * upto
    return nodes.join(taken, "rank", "left_semi").select("primer_ord", "loci")


def select_per_locus(amplicons: DataFrame, overlap: float = 0.7) -> DataFrame:
    """Of each locus the amplicons by start (ties by primer_ord) that share less than `overlap` of the shorter one with every
    amplicon taken before. (serotype, primer_ord, start, end, mismatches). A locus' intervals pass through one task in their order;
    it holds those taken that reach beyond the last start, not the locus."""
    slim = amplicons.select("serotype", "primer_ord", "start", "end", "mismatches")

    def plain(values: pa.Array) -> list:
        return values.to_pylist() if values.null_count else values.to_numpy(zero_copy_only=False).tolist()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        locus: object = None
        near_by: list[tuple[int, int]] = []
        for batch in batches:
            keep = []
            for g, s, e in zip(*(plain(batch.column(c)) for c in ("serotype", "start", "end"))):
                if g != locus:
                    locus, near_by = g, []
                if s is None or e is None:
                    keep.append(True)
                    continue
                near_by = [x for x in near_by if x[1] > s]  # the others end before every later start
                ok = True
                for a, b in near_by:
                    shared, shorter = (b if b < e else e) - s, b - a if b - a < e - s else e - s  # a is no later than s
                    if shared > 0 and shorter > 0 and shared / shorter >= overlap:
                        ok = False
                        break
                keep.append(ok)
                if ok:
                    near_by.append((s, e))
            yield batch.filter(pa.array(keep, pa.bool_()))

    order = [F.asc_nulls_last(c) for c in ("serotype", "start", "primer_ord", "end")]
    return dealt(slim, "serotype").sortWithinPartitions(*order).mapInArrow(pick, slim.schema)


def top_up(amplicons: DataFrame, picked: DataFrame, least: int = 5) -> DataFrame:
    """Names by locus after each locus with fewer than `least` picks got its best others. (serotype, primer_ord, added).

    Loci follow each other by name, and what one adds no later one may add again. Done in rounds: every short locus proposes its
    best candidates, as many as it lacks; each primer stays with the first of the loci that propose it; who lost some proposes as
    many more. Candidates that a locus before holds are left out, since they stay with it or go to one further before; so are loci
    before the first one that lacks something, since nobody takes from them any more. When nobody has more to propose, each
    locus holds what it would have got in turn. Nothing meets in one task but a locus' own candidates, to be ranked.
    """
    counts = picked.groupBy("serotype").agg(F.count("*").alias("n"))
    # a primer that a locus before this one picked can't be added; picks of later loci don't matter
    first = picked.groupBy("primer_ord").agg(F.min("serotype").alias("first"))
    open_to = amplicons.where(F.col("serotype").isNotNull()).join(first, "primer_ord", "left").where(F.col("first").isNull() | (F.col("first") > F.col("serotype")))
    once = open_to.groupBy("serotype", "primer_ord").agg(F.min(F.struct("mismatches", "start")).alias("by"))
    short = once.join(counts, "serotype", "left").withColumn("need", least - F.coalesce("n", F.lit(0))).where("need > 0")
    in_turn = Window.partitionBy("serotype")
    rows = durable(short.select("serotype", "primer_ord", "need", F.row_number().over(in_turn.orderBy("by", "primer_ord")).alias("k"), F.col("need").alias("lacks")))
    held = rows.where("false").select("serotype", "primer_ord")
    while (at := rows.where("k <= lacks").agg(F.min("serotype")).first()[0]) is not None:
        proposed = rows.where("k <= lacks").select("serotype", "primer_ord")
        held = durable(held.unionByName(proposed).groupBy("primer_ord").agg(F.min("serotype").alias("serotype")))
        holds = held.groupBy("serotype").agg(F.count("*").alias("n"))
        others = rows.where((F.col("serotype") >= at) & (F.col("k") > F.col("lacks"))).join(held.withColumnRenamed("serotype", "by"), "primer_ord", "left").where(F.col("by").isNull() | (F.col("by") > F.col("serotype")))
        rows = durable(others.join(holds, "serotype", "left").select("serotype", "primer_ord", "need", F.row_number().over(in_turn.orderBy("k")).alias("k"), F.greatest(F.col("need") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("lacks")))
        tidy(rows)
    return picked.select("serotype", "primer_ord", F.lit(False).alias("added")).unionByName(held.select("serotype", "primer_ord", F.lit(True).alias("added")))


def overlap_pairs(intervals: DataFrame, group: str, key: str, min_gap: int | None = None, fraction: float | None = None, width: int = 128) -> DataFrame:
    """(group, a, b): pairs of one group, a < b by key, that are near (min_gap) or share at least `fraction` of the shorter one."""
    reach = max(min_gap or 0, 1)
    both = neighbours(intervals, intervals, group, reach, width).where(F.col(f"l.{key}") < F.col(f"r.{key}"))
    l, r = (F.col("l.start"), F.col("l.end")), (F.col("r.start"), F.col("r.end"))
    test = near(*l, *r, min_gap) if fraction is None else shared_fraction(*l, *r) >= fraction
    return both.where(test).select(F.col(f"l.{group}").alias(group), F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"))
