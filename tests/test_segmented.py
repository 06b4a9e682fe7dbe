import random

import pytest

from tilewright.operators import coverage


def world(seed):
    """One locus that holds most rows, others with few or none."""
    rng = random.Random(seed)
    rows = []
    for k in range(700):
        locus = "hot" if k % 10 else f"s{k % 7}"
        start = rng.randrange(0, 2000)
        rows.append((locus, start, start + rng.choice([0, -3, 1, 2, 5, 9, 40]), f"p{k % 50}", f"gene_{k % 5}"))
    rows += [("hot", 5, 1800, "long", "g_1")] if seed % 2 else []  # reaches over many cells
    rows += [("hot", 7, 7, "empty", "g_1"), ("hot", None, 9, "null", "g_1"), ("gone", 1, 5, "p", "g_1"), ("edge", 0, 10, "p", "g_1"), ("edge", 10, 20, "q", "g_1"), ("edge", 21, 30, "r", "g_1")]
    loci = [("hot", 2100), ("edge", 30), ("none", 50), *[(f"s{k}", 2000) for k in range(7)]]
    return rows, loci


def covered(rows, locus):
    return {p for g, a, b, *_ in rows if g == locus and a is not None for p in range(a, b)}


def runs(places):
    out = []
    for p in sorted(places):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed, cell", [(1, 1 << 16), (1, 20), (2, 20), (2, 1), (3, 7)])
def test_cells_don_t_change_the_rows(spark, seed, cell):
    rows, loci = world(seed)
    intervals = spark.createDataFrame(rows, "serotype string, start int, end int, primer_name string, gene string").selectExpr("*", "1 AS run", "2 AS new", "3 AS cell")
    known = spark.createDataFrame(loci, "serotype string, length int")
    names = {r[0] for r in rows}
    want = {(g, *r) for g in names for r in runs(covered(rows, g))}
    assert {tuple(r) for r in coverage.union(intervals, "serotype", cell).collect()} == want
    for least in (1, 4):
        free = {(g, *r) for g, n in loci for r in runs(set(range(n)) - covered(rows, g)) if r[1] - r[0] >= least}
        got = [tuple(r) for r in coverage.gaps(intervals, known, "serotype", least, cell).collect()]
        assert set(got) == free and len(got) == len(free)


@pytest.mark.parametrize("cell", [1 << 16, 20])
def test_numbers_run_on_over_cells(spark, cell):
    rows, loci = world(1)
    rows = [r for r in rows if r[1] is not None]
    intervals = spark.createDataFrame(rows, "serotype string, start int, end int, primer_name string, gene string")
    got = coverage.plot_rows(intervals, spark.createDataFrame(loci, "serotype string, length int"), cell=cell).collect()
    own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == "hot")
    assert sorted((r.start, r.end, r.primer_name, r.level, r.colour) for r in got if r.serotype == "hot") == sorted((*x, k % 3, k % 20) for k, x in enumerate(own))


def test_one_locus_is_many_tasks(spark):
    """With 2000 cells on one locus its rows are dealt to all of 100 partitions."""
    rows = spark.range(0, 200_000, 50, 4).selectExpr("'hot' AS serotype", "CAST(id AS int) AS start", "CAST(id + 60 AS int) AS end")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "100")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        reach = coverage._reach(rows, "serotype", 100)
        sizes = [n for n in reach.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
        assert sum(sizes) == 4000 and len(sizes) > 90 and max(sizes) < 120
        assert [tuple(r) for r in coverage.union(rows, "serotype", 100).collect()] == [("hot", 0, 200_010)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
