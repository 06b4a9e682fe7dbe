"""Queries over small tables whose rows are longer than one tile."""

import random

from tilewright import queries
from tilewright.operators import design


def test_read_map_naive_takes_whole_documents(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    docs = [(k, text(n)) for k, n in enumerate([0, 100, 400, 700, 1500, 4000])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    long = {r.locus_ord: r.sequence for r in queries.loci(spark, str(tmp_path)).collect() if len(r.sequence) >= queries.READ}

    amplicons = {(r.locus_ord, r.primer_ord): r.amplicon_seq for r in queries._tiled(spark, str(tmp_path)).collect()}
    step = queries.AMP - 2 * queries.REACH - queries.P.overlap
    for locus, sequence in long.items():
        own = {(k - 1) * step: s for (i, k), s in amplicons.items() if i == locus}
        assert all(sequence[a : a + len(s)] == s and len(s) <= queries.AMP for a, s in own.items())
        assert {p for a, s in own.items() for p in range(a, a + len(s))} == set(range(len(sequence)))

    reads = {r.read_id: r.read for r in queries._tiled_reads(spark, str(tmp_path)).collect()}
    assert len(reads) == queries.PER * len(amplicons)

    def brute(read):
        found = []
        for (locus, tile), s in amplicons.items():
            wrong = [sum(a != b for a, b in zip(read, s[k : k + len(read)])) for k in range(len(s) - len(read) + 1)]
            found += [(min(wrong), tile, locus)] if wrong else []
        return min(found)

    got = {r.read_id: (r.mismatches, r.primer_ord, r.locus_ord) for r in queries.read_map_naive(spark, str(tmp_path)).collect()}
    assert set(got) == set(reads) and {t for _, t, _ in got.values()} > {1, 2, 3}
    assert all(got[i] == brute(read) for i, read in reads.items())


def test_primer_pick_designs_every_tile(spark, tmp_path):
    rng = random.Random(6)
    pages = [(k, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))) for k, n in enumerate([50, 650, 3000])]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    own = spark.createDataFrame(pages, "gene bigint, html string").select("gene", queries.sq.dna(queries.F.col("html")).alias("sequence"))
    want = {}
    for r in own.collect():
        for start in range(0, len(r.sequence), 425):
            region = r.sequence[start : start + 700]
            got = design.pick_pair(region, 100, min(600, len(region))) if len(region) >= 400 else None
            if got:
                want[r.gene, start // 425 + 1] = (got["left_pos"] + start, got["right_pos"] + start, got["penalty"])
    rows = queries.primer_pick(spark, str(tmp_path)).collect()
    assert {(r.gene, r.amp_num): (r.left_pos, r.right_pos, r.penalty) for r in rows} == want and len(rows) == len(want)
    assert len({k for _, k in want}) > 2


def test_oligos_equal_plain_loops():
    rng = random.Random(7)
    for n in [0, 5, 21, 22, 23, 60, 100, 100, 100, 100]:
        seq = "".join(rng.choice(rng.choice(["ACGT", "ACGGT", "ACGTN", "AAACGT"])) for _ in range(n + 20))
        want = []
        for size in range(22, 31):
            for start in range(10, 10 + n - size + 1):
                s = seq[start : start + size]
                gc, tm = 100.0 * (s.count("G") + s.count("C")) / size, design.melting(s)
                if 40 <= gc <= 60 and "N" not in s and design.longest_run(s) <= 4 and 59 <= tm <= 63:
                    want.append((abs(tm - 61) + abs(size - 25), start, size, tm, gc))
        assert design.oligos(seq, 10, 10 + n) == sorted(want)


def test_cluster_summary_finds_copies_beyond_the_band(spark, tmp_path):
    """Equal and near copies that stand further apart than the band are one cluster."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    first = text(1000)
    docs = [(0, first), (1, text(60_000)), (2, first), (3, text(60_000)), (4, first[:500] + "q" + first[501:])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.cluster_summary(spark, str(tmp_path)).collect()
    assert [(r.cluster_no, r.num_windows, r.num_serotypes) for r in rows if r.serotypes_covered == "0,2,4"] == [(0, 3, 3)]
    assert len(rows) == 1 + 2 * 119 and sum(r.num_windows for r in rows) == 3 + 2 * 119
