import random

import pytest

from tilewright.operators import pcr, readmap


def brute(reads, amplicons, limit):
    out = {}
    for i, read in reads:
        if not read:
            continue
        found = []
        for primer, locus, seq in amplicons:
            for at in range(len(seq or "") - len(read) + 1):
                wrong = sum(a != b for a, b in zip(read, seq[at : at + len(read)]))
                if wrong <= limit:
                    found.append((wrong, primer, locus))
        if found:
            out[i] = min(found)
    return out


def world(seed, lengths, limit):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    amplicons = [(k % 7, k, word(rng.randrange(5, 400))) for k in range(40)]
    amplicons += [(3, 90, amplicons[5][2]), (0, 91, amplicons[5][2]), (2, 92, "ACAC" * 60), (1, 93, "A" * 200), (1, 94, ""), (4, 95, amplicons[8][2][:100] + "N" + amplicons[8][2][101:])]
    reads = []
    for k in range(150):
        seq = rng.choice(amplicons)[2]
        n = rng.choice(lengths)
        if len(seq) < n:
            seq = word(n)
        at = rng.randrange(len(seq) - n + 1)
        own = list(seq[at : at + n])
        for _ in range(rng.randrange(0, limit + 3)):
            own[rng.randrange(n)] = rng.choice("ACGTN")
        reads.append((f"r{k}", "".join(own)))
    return reads + [("copy", reads[0][1]), ("copy2", reads[0][1]), ("empty", ""), ("null", None), ("odd", "é" * 60), ("far", word(200))], amplicons


@pytest.mark.parametrize("limit, lengths", [(5, [150, 149, 100, 97, 72, 48]), (2, [25, 30, 36, 80]), (0, [8, 12, 40]), (5, [10, 30, 47])])
def test_as_by_brute_force(spark, limit, lengths):
    reads, amplicons = world(limit, lengths, limit)
    left = spark.createDataFrame(reads, "read_id string, read string").selectExpr("*", "1 AS q", "2 AS site")
    right = spark.createDataFrame(amplicons, "primer_ord bigint, locus_ord bigint, amplicon_seq string").selectExpr("*", "3 AS start", "4 AS seed")
    got = {r.read_id: (r.mismatches, r.primer_ord, r.locus_ord) for r in readmap.map_by_mismatches(left, right, limit, block=20).collect()}
    assert got == brute(reads, amplicons, limit)


def test_empty(spark):
    reads, amplicons = world(1, [80], 5)
    left, right = spark.createDataFrame(reads, "read_id string, read string"), spark.createDataFrame(amplicons, "primer_ord bigint, locus_ord bigint, amplicon_seq string")
    assert readmap.map_by_mismatches(left.limit(0), right).collect() == [] and readmap.map_by_mismatches(left, right.limit(0)).collect() == []


def test_nothing_is_collected_or_broadcast(spark):
    """The plan joins both sides on seeds."""
    reads, amplicons = world(2, [150], 5)
    found = readmap.map_by_mismatches(spark.createDataFrame(reads, "read_id string, read string"), spark.createDataFrame(amplicons, "primer_ord bigint, locus_ord bigint, amplicon_seq string"))
    assert "seed" in found._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in found._jdf.queryExecution().toString()


def test_many_loci_are_searched_as_one_by_one(monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    probes = [word(n) for n in (25, 25, 24, 30, 12, 9, 7, 3, 1)] + [""]
    loci = [word(rng.randrange(0, 900)) for _ in range(60)] + ["", probes[0], "N" * 40, "é" + probes[1]]
    loci += [loci[0] + p + loci[1] for p in probes]
    whole = pcr.Probes(probes, 2)
    want = [(k, p, *b) for k, seq in enumerate(loci) for p, b in sorted(whole.best(seq).items())]
    by_hand = []
    for k, seq in enumerate(loci):
        for p, probe in enumerate(probes):
            sites = [(w, s) for s in range(len(seq) - len(probe) + 1) if probe and (w := sum(x != y for x, y in zip(probe, seq[s : s + len(probe)]))) <= 2]
            by_hand += [(k, p, *min(sites))] if sites else []
    assert want == by_hand
    for together in (1 << 20, 50, 1):  # loci in pieces that overlap
        monkeypatch.setattr(pcr, "TOGETHER", together)
        assert list(zip(*(x.tolist() for x in pcr.Probes(probes, 2).search(loci)))) == want


def test_primers_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    loci = spark.createDataFrame([(k, f"s{k}", word(700)) for k in range(12)] + [(20, "none", None)], "locus_ord bigint, serotype string, sequence string")
    flip = str.maketrans("ACGT", "TGCA")
    primers = spark.createDataFrame([(r.locus_ord, f"p{r.locus_ord}", r.sequence[50:75], r.sequence[400:425].translate(flip)[::-1]) for r in loci.collect() if r.sequence], "primer_ord bigint, name string, left_seq string, right_seq string")
    whole = sorted(map(tuple, pcr.amplify(loci, primers).collect()))
    assert len(whole) == 12 and {x[4:6] for x in whole} == {(50, 425)}
    monkeypatch.setattr(pcr, "BLOCK_PRIMERS", 3)
    assert sorted(map(tuple, pcr.amplify(loci, primers).collect())) == whole
    assert pcr.amplify(loci, primers.limit(0)).collect() == [] and pcr.amplify(loci.limit(0), primers).collect() == []
