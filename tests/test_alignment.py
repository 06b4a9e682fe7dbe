import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import queries
from tilewright.operators import alignment, consensus

SF = "/root/testdata/sf0.001"


def full(counts, members, seq):
    """The best score over every cell, by the rules themselves."""
    m, n = len(counts), len(seq)
    best = {(0, j): 0 for j in range(m + 1)} | {(i, 0): 0 for i in range(n + 1)}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            c, b = counts[j - 1], seq[i - 1]
            pair = 0 if b == 4 else alignment.MATCH * c[b] - alignment.MISMATCH * (c.sum() - c[b])
            best[i, j] = max(best[i - 1, j - 1] + pair, best[i - 1, j] - alignment.GAP * members, best[i, j - 1] - alignment.GAP * c.sum())
    return max([best[n, j] for j in range(m + 1)] + [best[i, m] for i in range(n + 1)])


def worth(counts, members, seq, path):
    """What a path scores: ends that hang over are free."""
    used = [k for k, (c, p) in enumerate(path) if c >= 0 and p >= 0]
    if not used:
        return 0
    total = 0
    for k, (c, p) in enumerate(path):
        if c >= 0 and p >= 0:
            total += 0 if seq[p] == 4 else alignment.MATCH * counts[c][seq[p]] - alignment.MISMATCH * (counts[c].sum() - counts[c][seq[p]])
        elif used[0] < k < used[-1]:
            total -= alignment.GAP * (members if c < 0 else counts[c].sum())
    return total


@pytest.mark.parametrize("band", [1, 3, 32])
def test_as_by_full_dynamic_programming(band):
    rng, jobs, alone = random.Random(band), [], []
    for _ in range(150):
        base = [rng.choice("ACGT") for _ in range(rng.randrange(0, 40))]
        texts = []
        for _ in range(rng.randrange(2, 5)):
            own = base[rng.randrange(0, 8) :]
            for _ in range(rng.randrange(0, 4)):
                if own:
                    at = rng.randrange(len(own))
                    own = own[:at] + rng.choice([[], ["N"], [rng.choice("ACGT")], [own[at], "A"]]) + own[at + 1 :]
            texts.append("".join(own))
        counts, members = alignment.columns([texts[:-1]], band)[0], len(texts) - 1
        seq = alignment.encode(texts[-1])
        job = alignment.Job(counts, members, seq)
        [(total, path, _)] = alignment._lay([job], [0], len(counts) + seq.size + 1)
        assert total == full(counts, members, seq) == worth(counts, members, seq, path)
        assert [c for c, _ in path if c >= 0] == list(range(len(counts))) and [p for _, p in path if p >= 0] == list(range(seq.size))
        jobs.append((job, total))
        inside, walked = alignment.lay([job], band)[0]
        assert inside == worth(counts, members, seq, walked) <= total
        alone.append((inside, walked))
    # jobs of all sizes that advance together go the ways they go alone
    assert alignment.lay([j for j, _ in jobs], band) == alone


def test_the_band_widens_until_the_path_lies_inside():
    rng = random.Random(2)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    gone = base[:100] + base[160:]  # 60 bases lost: beyond a band of 8
    counts, seq = alignment.columns([[base]])[0], alignment.encode(gone)
    assert alignment.lay([alignment.Job(counts, 1, seq)], 8)[0][0] == full(counts, 1, seq)


def test_shifted_windows_vote_in_step(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(260))
    rows = [(k, 1, base[k * 9 : k * 9 + 200]) for k in range(6)]
    rows[2] = (2, 1, rows[2][2][:80] + "N" + rows[2][2][81:])
    rows[4] = (4, 1, rows[4][2][:50] + rows[4][2][51:])  # a base lost
    rows += [(20, 2, "ACGT"), (30, 3, "NNN"), (31, 3, "NN"), (40, 4, None), (41, 4, "ACGTACGT"), *[(50 + k, 5, "A" * k) for k in range(11)]]
    members = spark.createDataFrame(rows, "window_idx bigint, cluster_no bigint, sequence string")
    got = {r.cluster_no: (r.sequence, r.num_windows) for r in consensus.representatives(members, mode="aligned").collect()}
    assert got == {1: (base[:245], 6), 2: ("ACGT", 1), 3: ("NNN", 2), 4: ("ACGTACGT", 2), 5: ("A" * 10, 11)}
    by_place = {r.cluster_no: r.sequence for r in consensus.representatives(members).collect()}
    assert by_place[1] != base[:245] and by_place[4] == "ACGTACGT"


def test_votes_as_by_rows(spark):
    rng = random.Random(5)
    rows = [(k, k // 4, "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    members = spark.createDataFrame(rows, "window_idx bigint, cluster_no bigint, sequence string")
    want = {r.cluster_no: r.sequence for r in consensus.column_majority(members, "cluster_no").collect()}
    assert {r.cluster_no: r.sequence for r in alignment.consensus(members, "cluster_no", False).collect()} == want


def test_query_against_the_loci(spark):
    """Every consensus has the locus' own 328 bases but where pieces disagree."""
    got = queries.QUERIES["consensus_aligned"](spark, SF)
    rows = queries.shifted(spark, SF).groupBy("cluster_no").agg(F.sort_array(F.collect_list(F.struct("window_idx", "sequence"))).alias("m")).collect()
    want = {r.cluster_no: alignment.vote(alignment.columns([[x.sequence for x in r.m]])[0]) for r in rows}
    import hashlib

    assert {r.cluster_no: r.seq_md5 for r in got.collect()} == {k: hashlib.md5(s.encode()).hexdigest() for k, s in want.items()}
    own = {r.locus_ord: r.sequence for r in queries.loci(spark, SF).collect()}
    near = [np.mean([a == b for a, b in zip(want[k], own[k])]) > 0.97 for k in want if k is not None]
    assert np.mean(near) > 0.9


def test_small_groups_are_dealt_to_all_tasks(spark):
    """A few hundred bytes are much work, so Spark mustn't put them together in one task."""
    rows = [(k // 2, k, "ACGTTGCAAC" * 5) for k in range(1200)]
    found = alignment.consensus(spark.createDataFrame(rows, "key bigint, window_idx bigint, sequence string"), "key", True)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.key, r.sequence) for r in found.collect()} == {(k, "ACGTTGCAAC" * 5) for k in range(600)}


@pytest.mark.parametrize("mode", ["majority", "aligned"])
def test_all_windows_of_large_clusters_vote(spark, monkeypatch, mode):
    """The longest window of a large cluster is not what most of its windows say."""
    monkeypatch.setattr(alignment, "PART", 7)
    rng = random.Random(9)
    rows, want = [], {}
    for c in range(3):
        base = "".join(rng.choice("ACGT") for _ in range(60))
        want[c] = base, 11 + 10 * c
        for k in range(11 + 10 * c):
            at = rng.randrange(0, 60) if k else 30
            rows.append((len(rows), c, base[:at] + {"A": "C", "C": "G", "G": "T", "T": "A"}[base[at]] + base[at + 1 :]))
    rows += [(1000 + k, None, "ACGT" if k % 3 else "ACG") for k in range(12)] + [(2000 + k, 9, "N") for k in range(20)] + [(3000, 10, "AC")]
    members = spark.createDataFrame(rows, "window_idx bigint, cluster_no bigint, sequence string")
    got = {r.cluster_no: (r.sequence, r.num_windows) for r in consensus.representatives(members, mode=mode).collect()}
    own = {k: v for k, v in got.items() if k is not None}
    assert own == want | {9: ("N", 20), 10: ("AC", 1)}
    plain = {r.cluster_no: r.sequence for r in consensus.column_majority(members.where("cluster_no < 9"), "cluster_no").collect()}
    assert {k: v for k, (v, _) in want.items()} == plain


def test_numbers_of_32_bits_and_of_64_give_one_alignment(monkeypatch):
    """Jobs of all shifts are laid in one frame; sums that 32 bits can't hold take 64."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    base = word(120)
    texts = [[base[x : x + 60] for x in (0, 9, 40, 3)], [base, base[:50] + base[90:], word(70)], ["", word(5)], [word(3), ""], [base[:30], base[80:]]]
    narrow = [alignment.columns(texts, band) for band in (1, 8, 200)]
    many = [alignment.Job(c * 10**7, 10**7, alignment.encode(base[5:70])) for c in narrow[0][:2]]
    few = [alignment.Job(c, 1, alignment.encode(base[5:70])) for c in narrow[0][:2]]
    assert [(t, p) for t, p in alignment.lay(many)] == [(t * 10**7, p) for t, p in alignment.lay(few)]
    monkeypatch.setattr(alignment, "LOW32", 0)
    assert all(np.array_equal(x, y) for a, band in zip(narrow, (1, 8, 200)) for x, y in zip(a, alignment.columns(texts, band)))


def test_seeds_are_numbers_of_their_bases():
    x = np.random.default_rng(1).integers(0, 5, 40)
    assert alignment._seeded(x).tolist() == [sum(int(b) * 5 ** (alignment.SEED - 1 - k) for k, b in enumerate(x[i : i + alignment.SEED])) for i in range(41 - alignment.SEED)]
