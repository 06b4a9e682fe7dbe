import random

from pyspark.sql import functions as F

from tilewright.functions import sequences as sq
from tilewright.operators import consensus, coverage, pcr, readmap, similarity, windows
from tilewright.operators.graph import components, numbered


def test_functions(spark):
    df = spark.createDataFrame([("ACGTNRY",), ("",), ("AAAA",), ("acgtx",)], "s string")
    s = F.col("s")
    rows = df.select("s", sq.reverse_complement(s).alias("rc"), sq.gc_percent(s).alias("gc"), sq.kmers(s, 3).alias("k"), sq.sanitise(F.upper(s)).alias("c")).collect()
    got = {r.s: r for r in rows}
    assert got["ACGTNRY"].rc == "RYNACGT" and got[""].rc == "" and got[""].gc == 0.0
    assert got["ACGTNRY"].k == ["ACG", "CGT"] and got[""].k == [] and got["AAAA"].k == ["AAA", "AAA"]
    assert got["acgtx"].c == "ACGTN"
    pair = spark.createDataFrame([("ACGN", "ACTN"), ("", "")], "a string, b string").select(sq.mismatches(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in pair] == [1, 0]
    sim = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>").select(sq.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r.j for r in sim] == [1 / 3, 0.0]


def test_windows(spark):
    loci = spark.createDataFrame([(0, "a", "A" * 25), (1, "b", "N" * 2 + "C" * 8 + "N" * 10), (2, "c", "A" * 9), (3, "d", "G" * 10)], "locus_ord bigint, serotype string, sequence string")
    got = sorted((r.window_idx, r.serotype, r.start, r.window_id) for r in windows.sliding_windows(loci, 10, 5, 0.2).collect())
    assert got == [(0, "a", 0, "win_0"), (1, "a", 5, "win_1"), (2, "a", 10, "win_2"), (3, "a", 15, "win_3"), (4, "b", 0, "win_4"), (5, "d", 0, "win_5")]
    assert windows.sliding_windows(loci.limit(0), 10, 5).count() == 0


def test_window_counts_of_long_loci(spark):
    """Whole windows only: (length - 1000) // 500 + 1 of each locus."""
    sizes = [999, 1000, 1499, 1500, 17123]
    loci = spark.createDataFrame([(k, str(k), "A" * n) for k, n in enumerate(sizes)], "locus_ord bigint, serotype string, sequence string")
    counts = {r.serotype: r["count"] for r in windows.sliding_windows(loci, 1000, 500, number=False).groupBy("serotype").count().collect()}
    assert [counts.get(str(k), 0) for k in range(5)] == [0, 1, 1, 2, 33]


def test_tiles_of_a_window_length_template(spark):
    """The second tile of a 1000-base template has its target at the template's end, so no right primer fits there."""
    df = spark.createDataFrame([("x", "A" * 1000), ("y", "A" * 399), ("z", "")], "name string, sequence string")
    got = sorted((r.name, r.amp_num, r.region_start, r.region_end, r.target_start, r.target_end) for r in windows.tiles(df).collect())
    assert got == [("x", 1, 0, 700, 100, 600), ("x", 2, 425, 1000, 100, 575)]


def test_band_pairs_and_clusters(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(12)]
    seqs = []
    for k in range(70):
        s = list(base[rng.randrange(12)])
        if rng.random() < 0.5:
            s[rng.randrange(60)] = rng.choice("ACGTN")
        seqs.append("".join(s))
    df = spark.createDataFrame([(k, f"l{k % 7}", s) for k, s in enumerate(seqs)], "window_idx bigint, serotype string, sequence string")
    sets = [{s[i : i + 8] for i in range(53) if "N" not in s[i : i + 8]} for s in seqs]
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(70) for j in range(i + 1, min(70, i + 10)) if sets[i] | sets[j]}
    want = {k: v for k, v in want.items() if v >= 0.6}
    pairs = similarity.band_pairs(df, 8, 0.6, 10)
    assert {(r.i, r.j): r.sim for r in pairs.collect()} == want and want
    root = list(range(70))
    for _ in range(70):
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j])
    got = {r.window_idx: (r.root, r.cluster_no) for r in similarity.clusters(df, pairs).collect()}
    order = sorted(set(root))
    assert got == {k: (r, order.index(r)) for k, r in enumerate(root)}


def test_consensus(spark):
    rows = [(0, 0, "ACGT"), (0, 1, "ACCT"), (0, 2, "ACTN"), (1, 3, "AC"), (1, 4, "AG"), (2, 5, "GGG")] + [(3, 10 + k, "A" * (5 + k % 3)) for k in range(11)]
    df = spark.createDataFrame(rows, "cluster_no int, window_idx bigint, sequence string")
    got = {r.cluster_no: r.sequence for r in consensus.representatives(df).collect()}
    assert got == {0: "ACNT", 1: "AN", 2: "GGG", 3: "A" * 7}
    assert {r.cluster_no: r.sequence for r in consensus.representatives(df, mode="first").collect()}[0] == "ACGT"


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, None)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in nodes}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([((k * 37) % 101,) for k in range(101)], "x int")
    assert sorted((r.x, r.n) for r in numbered(df, "n", "x").collect()) == [(k, k) for k in range(101)]
    assert numbered(df.limit(0), "n", "x").count() == 0


def hamming_best(probe, seq, limit):
    best = None
    for k in range(len(seq) - len(probe) + 1):
        m = sum(a != b for a, b in zip(probe, seq[k:]))
        if best is None or m < best[0]:
            best = (m, k)
    return best if best and best[0] <= limit and probe else None


def test_best_sites():
    rng = random.Random(9)
    for limit in (0, 1, 2, 3):
        probes = ["".join(rng.choice("ACGN") for _ in range(rng.choice([1, 5, 8, 13, 25, 30]))) for _ in range(40)]
        index = pcr.Probes(probes, limit)
        for _ in range(20):
            seq = list("".join(rng.choice("ACG") for _ in range(rng.randrange(150))))
            for p in rng.sample(probes, 3):
                if len(seq) > len(p):
                    at = rng.randrange(len(seq) - len(p))
                    seq[at : at + len(p)] = p
                    seq[at + rng.randrange(len(p))] = "T"
            seq = "".join(seq)
            assert index.best(seq) == {k: b for k, p in enumerate(probes) if (b := hamming_best(p, seq, limit))}


def test_amplify(spark):
    left, right = "ACGTACGTACGTACGTACGTACGTA", "TTGACCATTGACCATTGACCATTGA"
    rc = right[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seq = "C" * 50 + left + "G" * 200 + rc + "C" * 30
    loci = spark.createDataFrame([(0, "a", seq), (1, "b", rc + "G" * 10 + left), (2, "c", ""), (3, "d", None), (4, "e", seq.replace("ACGTACGTAC", "ACGTTCGTAC", 1))], "locus_ord bigint, serotype string, sequence string")
    primers = spark.createDataFrame([(0, "p", "AAAA", "AAAA"), (1, "p", left, right), (2, "q", "A" * 25, "C" * 25)], "primer_ord bigint, name string, left_seq string, right_seq string")
    got = {(r.primer_ord, r.serotype): (r.start, r.end, r.size, r.left_mismatches, r.mismatches) for r in pcr.amplify(loci, primers).collect()}
    assert got == {(0, "a"): (50, 300, 250, 0, 0), (0, "e"): (50, 300, 250, 1, 1)}
    counts = {r.serotype: (r.amplicons, r.status) for r in pcr.per_locus(pcr.amplify(loci, primers), loci, 1).collect()}
    assert counts == {"a": (1, "OK"), "b": (0, "LOW"), "c": (0, "LOW"), "d": (0, "LOW"), "e": (1, "OK")}


def test_coverage(spark):
    rng = random.Random(2)
    rows = [(g, s, s + rng.randrange(0, 30)) for g in range(4) for s in (rng.randrange(270) for _ in range(15))] + [(1, 10, 10)]
    loci = spark.createDataFrame([(g, 300) for g in range(6)], "serotype int, length int")
    df = spark.createDataFrame(rows, "serotype int, start int, end int")
    for r in coverage.summary(df, loci).collect():
        places = {p for g, s, e in rows if g == r.serotype for p in range(s, e)}
        assert r.covered_bases == len(places) and r.coverage_percent == len(places) / 300 * 100
        assert r.num_amplicons == sum(g == r.serotype for g, _, _ in rows)
    gaps = {}
    for r in coverage.gaps(df, loci, "serotype", 1).collect():
        gaps.setdefault(r.serotype, set()).update(range(r.gap_start, r.gap_end))
    for g in range(6):
        assert gaps.get(g, set()) == set(range(300)) - {p for k, s, e in rows if k == g for p in range(s, e)}


def test_bins_leave_100_out(spark):
    df = spark.createDataFrame([(str(k), c) for k, c in enumerate([0.0, 24.9, 25.0, 89.9, 90.0, 100.0, 100.0])], "serotype string, coverage_percent double")
    assert {r.bin: r.loci for r in coverage.bins(df).collect()} == {"0-25": 2, "25-50": 1, "50-75": 0, "75-90": 1, "90-100": 1}
    assert {r.bin: r.loci for r in coverage.bins(df, overflow=True).collect()}["100+"] == 2
    assert [r.serotype for r in coverage.top(df, 3).collect()] == ["5", "6", "4"]


def test_read_mapping(spark):
    rng = random.Random(6)
    amps = ["".join(rng.choice("ACGT") for _ in range(90)) for _ in range(6)]
    amps[3] = amps[0]
    amplicons = spark.createDataFrame([(k // 2, k, f"s{k}", a) for k, a in enumerate(amps)], "primer_ord bigint, locus_ord bigint, serotype string, amplicon_seq string")
    reads = []
    for k in range(40):
        a = rng.choice(amps)
        s = rng.randrange(50)
        r = list(a[s : s + 40])
        for _ in range(rng.randrange(8)):
            r[rng.randrange(40)] = rng.choice("ACGT")
        reads.append((f"r{k}", "".join(r)))
    reads += [("short", "ACG"), ("none", "N" * 40), ("empty", "")]
    df = spark.createDataFrame(reads, "read_id string, read string")

    def by_kmers(read, k=12):
        index = {}
        for n, a in enumerate(amps):
            for p in range(len(a) - k + 1):
                index.setdefault(a[p : p + k], []).append(n)
        score, first = {}, {}
        for p in range(len(read) - k + 1):
            for n in index.get(read[p : p + k], []):
                score[n] = score.get(n, 0) + 1
                first.setdefault(n, p)
        return min(score, key=lambda n: (-score[n], first[n], n // 2, n)) if score else None

    got = {r.read_id: r.locus_ord for r in readmap.map_by_kmers(df, amplicons, 12).collect()}
    assert got == {i: b for i, r in reads if (b := by_kmers(r)) is not None}

    def naive(read):
        best = None
        for n, a in enumerate(amps):
            b = hamming_best(read, a, 5)
            if b and (best is None or b[0] < best[0]):
                best = (b[0], n)
        return best

    got = {r.read_id: (r.mismatches, r.locus_ord) for r in readmap.map_by_mismatches(df, amplicons).collect()}
    assert got == {i: b for i, r in reads if (b := naive(r))}
    blocks = {r.read_id: (r.mismatches, r.locus_ord) for r in readmap.map_by_mismatches(df, amplicons, block=2).collect()}
    assert blocks == got
