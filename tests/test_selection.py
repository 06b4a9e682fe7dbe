import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions.intervals import near, shared_fraction
from tilewright.operators import selection, similarity


def conflict(a, b, gap):
    return a[0] == b[0] and b[1] - a[2] < max(gap, 1) and a[1] - b[2] < max(gap, 1)


def fraction(a, b):
    shared, shorter = min(a[1], b[1]) - max(a[0], b[0]), min(a[1] - a[0], b[1] - b[0])
    return shared / shorter if shared > 0 and shorter > 0 else 0.0


def rows(seed=1, n=120):
    rng = random.Random(seed)
    return [(f"s{rng.randrange(5)}", rng.randrange(40), s, s + rng.randrange(1, 40), rng.randrange(4)) for s in (rng.randrange(800) for _ in range(n))]


SCHEMA = "serotype string, primer_ord bigint, start int, end int, mismatches int"


@pytest.mark.parametrize("gap", [0, 1, 15])
def test_global_selection_is_the_sequential_one(spark, gap):
    own = rows(gap)
    got = {r.primer_ord for r in selection.select_globally(spark.range(45).select(F.col("id").alias("primer_ord")), spark.createDataFrame(own, SCHEMA), gap).collect()}
    loci = {p: len({r[0] for r in own if r[1] == p}) for p in range(45)}
    taken = []
    for p in sorted(range(45), key=lambda p: (-loci[p], p)):
        mine = [(r[0], r[2], r[3]) for r in own if r[1] == p]
        if not any(conflict(a, b, gap) for a in mine for q in taken for b in [(r[0], r[2], r[3]) for r in own if r[1] == q]):
            taken.append(p)
    assert got == set(taken) and {40, 44} <= got
    few = selection.select_globally(spark.range(45).select(F.col("id").alias("primer_ord")), spark.createDataFrame(own, SCHEMA), gap, keep_unmapped=False)
    assert {r.primer_ord for r in few.collect()} == {p for p in taken if loci[p]}


def sequential_per_locus(own, f):
    out = []
    for s in sorted({r[0] for r in own}):
        taken = []
        for r in sorted((r for r in own if r[0] == s), key=lambda r: (r[2], r[1], r[3])):
            if all(fraction((r[2], r[3]), (t[2], t[3])) < f for t in taken):
                taken.append(r)
        out += taken
    return out


@pytest.mark.parametrize("f", [0.05, 0.7, 1.0])
def test_per_locus(spark, f):
    own = rows(7)
    got = sorted(tuple(r) for r in selection.select_per_locus(spark.createDataFrame(own, SCHEMA), f).collect())
    assert got == sorted(sequential_per_locus(own, f))


def test_top_up(spark):
    own = sorted(set(rows(3)))
    picked = sequential_per_locus(own, 0.05)
    least = 18
    got = {(r.serotype, r.primer_ord) for r in selection.top_up(spark.createDataFrame(own, SCHEMA), spark.createDataFrame(picked, SCHEMA), least).where("added").collect()}
    kept, want = set(), set()
    for s in sorted({r[0] for r in own}):
        mine = [r for r in picked if r[0] == s]
        kept |= {r[1] for r in mine}
        need = least - len(mine)
        for r in sorted((r for r in own if r[0] == s), key=lambda r: (r[4], r[2], r[1])):
            if need <= 0:
                break
            if r[1] not in kept:
                kept.add(r[1])
                want.add((s, r[1]))
                need -= 1
    assert got == want and want


@pytest.mark.parametrize("width", [7, 128])
def test_overlap_pairs(spark, width):
    own = [(s, k, a, b, m) for k, (s, _, a, b, m) in enumerate(rows(11))] + [("s0", 900, 5, 5, 0)]
    df = spark.createDataFrame(own, SCHEMA)
    for gap in (0, 1, 30):
        got = sorted((r.a, r.b) for r in selection.overlap_pairs(df, "serotype", "primer_ord", min_gap=gap, width=width).collect())
        assert got == sorted((x[1], y[1]) for x in own for y in own if x[1] < y[1] and conflict((x[0], x[2], x[3]), (y[0], y[2], y[3]), gap))
    got = sorted((r.a, r.b) for r in selection.overlap_pairs(df, "serotype", "primer_ord", fraction=0.5, width=width).collect())
    assert got == sorted((x[1], y[1]) for x in own for y in own if x[1] < y[1] and x[0] == y[0] and fraction((x[2], x[3]), (y[2], y[3])) >= 0.5)


def test_predicates(spark):
    df = spark.createDataFrame([(0, 10, 10, 20), (0, 10, 11, 20), (0, 10, 5, 8), (0, 0, 0, 5)], "a int, b int, c int, d int")
    cols = [F.col(x) for x in "abcd"]
    assert [(r.n, r.f) for r in df.select(near(*cols, 0).alias("n"), shared_fraction(*cols).alias("f")).collect()] == [(True, 0.0), (False, 0.0), (True, 1.0), (True, 0.0)]


def test_top_up_equals_taking_turns(spark):
    """Rounds of proposals give each locus what it would get in turn, with many loci after the same primers."""
    rng = random.Random(11)
    own = [(f"L{rng.randrange(12):02}", rng.randrange(25), rng.randrange(5), rng.randrange(50)) for _ in range(260)]
    rows = [(s, p, a, a + 10, m) for s, p, m, a in own]
    picked = [r for k, r in enumerate(rows) if k % 23 == 0]
    least = 6
    amplicons, taken = (spark.createDataFrame(x, "serotype string, primer_ord bigint, start int, end int, mismatches int") for x in (rows, picked))
    used, want = set(), set()
    for locus in sorted({r[0] for r in rows}):
        need = least - sum(r[0] == locus for r in picked)
        before = {r[1] for r in picked if r[0] <= locus}
        for p in dict.fromkeys(r[1] for r in sorted((r for r in rows if r[0] == locus), key=lambda r: (r[4], r[2], r[1]))):
            if need > 0 and p not in used and p not in before:
                used.add(p)
                want.add((locus, p))
                need -= 1
    got = selection.top_up(amplicons, taken, least)
    assert {(r.serotype, r.primer_ord) for r in got.where("added").collect()} == want
    assert got.where("not added").count() == len(picked)


def test_kmer_counts_equal_plain_loops(spark):
    rng = random.Random(12)
    rows = [(k, "".join(rng.choice(letters) for _ in range(n))) for k, (letters, n) in enumerate([("ACGT", 300), ("ACGTN", 300), ("ACGTNx", 200), ("A", 50), ("ACGT", 5), ("A", 0)])] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, sequence string").selectExpr("*", "1 AS n_kmers")
    for k in (1, 6, 11, 31, 33):
        for r in similarity.kmer_counts(df, k).collect():
            s = r.sequence or ""
            own = [x for i in range(len(s) - k + 1) if "N" not in (x := s[i : i + k])]
            assert (r.n_kmers, r.n_distinct) == (len(own), len(set(own)))


@pytest.mark.parametrize("n", [3000, 20_000])
def test_global_selection_makes_about_as_many_pairs_as_amplicons(spark, monkeypatch, n):
    """All amplicons of one locus meet each other; so do those of every hundredth primer in a second one."""
    made, conflicts = [], selection.conflicts

    def counted(*args):
        made.append((pairs := conflicts(*args)).count())
        return pairs

    monkeypatch.setattr(selection, "conflicts", counted)
    ids = spark.range(n).select(F.col("id").alias("primer_ord"))
    first = ids.where("primer_ord % 100 <> 7").selectExpr("'a' AS serotype", "primer_ord", "cast(primer_ord % 5 AS int) AS start", "cast(primer_ord % 5 + 30 AS int) AS end")
    second = ids.where(f"primer_ord % 100 = 7 OR primer_ord = {n - 1}").selectExpr("'b' AS serotype", "primer_ord", "0 AS start", "9 AS end")
    got = selection.select_globally(ids, first.unionByName(second), 1, width=64)
    # the last one is in both loci, so it comes first and refuses everyone
    assert [tuple(r) for r in got.collect()] == [(n - 1, 2)]
    alone = selection.select_globally(ids, first.unionByName(second.where(f"primer_ord <> {n - 1}")), 1, width=64)
    assert sorted(tuple(r) for r in alone.collect()) == [(0, 1), (7, 1)]
    assert sum(made) < 4 * n


def test_per_locus_is_the_same_over_many_batches(spark):
    """A locus that passes in several batches, missing places, and a locus without a name."""
    own = sorted({(f"s{k % 3}", k % 17, (k * 7919) % 5000, (k * 7919) % 5000 + 1 + k % 40, 0) for k in range(3000)})
    odd = [(None, 1, 5, 15, 0), (None, 2, 6, 16, 0), ("s9", 3, None, 4, 0), ("s9", 4, None, 4, 0), ("s9", 5, 1, 3, 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r) for r in selection.select_per_locus(spark.createDataFrame(own + odd, SCHEMA), 0.3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {*sequential_per_locus(own, 0.3), odd[0], *odd[2:]}


def test_top_up_passes_over_what_earlier_loci_hold(spark, monkeypatch):
    """B lacks one, and A before it holds B's 50 best: that takes a few rounds, not one for each."""
    steps, durable = [], selection.durable
    monkeypatch.setattr(selection, "durable", lambda df: steps.append(1) or durable(df))
    picked = [("B", 1000 + k, 2000 + 50 * k, 2010 + 50 * k, 0) for k in range(49)]
    shared = [(s, k, 10 * k, 10 * k + 10, 0) for s in "AB" for k in range(50)]
    amplicons = spark.createDataFrame([*picked, *shared, ("B", 77, 900, 910, 1), ("B", 78, 910, 920, 1), (None, 79, 0, 9, 0)], SCHEMA)
    added = selection.top_up(amplicons, spark.createDataFrame(picked, SCHEMA), 50).where("added")
    assert sorted((r.serotype, r.primer_ord) for r in added.collect()) == [*(("A", k) for k in range(50)), ("B", 77)]
    assert len(steps) < 12
