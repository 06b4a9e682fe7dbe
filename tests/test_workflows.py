import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tilewright.operators import design, evaluate, simulate
from tilewright.params import Design, Simulation
from tilewright.plans import workflows
from tilewright.sources import fasta, tables
from tilewright.streaming.reads import hits


def sequence(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    db = tmp_path_factory.mktemp("db")
    a, b = sequence(1600, 1), sequence(1700, 2)
    (db / "reference.fasta").write_text(f">01 first\n{a[:800].lower()}\n{a[800:]}\n>19F x\n{b}\n>01 again\n{a}\n")
    for name, text in (("19F", ">zzz\nAAAA\n"), ("23F", f">one\r\n{b[:900]}{sequence(300, 3)}\r\n>two\nCCCC\n"), ("14", f">x\n{a[:1200]}")):
        (db / name).mkdir()
        (db / name / "reference.fasta").write_text(text)
    return str(db)


def test_fasta_precedence(spark, database):
    rows = fasta.read_database(spark, database).orderBy("locus_ord").collect()
    assert [(r.serotype, r.record_id, r.length, r.source) for r in rows] == [("01", "01", 1600, "root"), ("19F", "19F", 1700, "root"), ("14", "x", 1200, "14"), ("23F", "one", 1200, "23F")]
    assert rows[0].sequence == sequence(1600, 1)


def test_design_to_reports(spark, database, tmp_path):
    loci = fasta.read_database(spark, database)
    got = workflows.design_primers(loci, Design(band=100))
    primers = got["primers"].collect()
    assert primers and {p.pool for p in primers} == {"pool2"} and all(p.amplicon_num == 1 for p in primers)
    for p in primers:
        assert 400 <= p.product_size <= 600 and 59 <= p.left_tm <= 63 and 40 <= p.right_gc <= 60 and math.isclose(p.left_tm, design.melting(p.left_seq))
    written = tables.write_primers(got["primers"], str(tmp_path / "primers"))
    assert [w.rsplit("/", 1)[1] for w in written] == ["all", "pool2"]
    again = tables.read_primers(spark, written[0])
    assert again.count() == len(primers) and dict(again.dtypes)["penalty"] == "double"
    assert tables.write_primers(got["primers"].limit(0), str(tmp_path / "none")) is None
    # the designed pairs are found where they were designed
    chosen = workflows.select_primers(loci, again)
    assert chosen["amplicons"].where("mismatches = 0").count() >= len(primers)
    assert 0 < chosen["chosen"].count() <= len(primers)
    per = workflows.select_primers(loci, again, per_locus=True)
    assert per["chosen"].count() >= 1
    cover = workflows.cover(loci, again)
    assert cover["summary"].count() == 4 and cover["stats"].first().most > 20
    assert "Loci: 4" in tables.coverage_text(cover["stats"].first().asDict(), [(r.bin, r.loci) for r in cover["bins"].collect()], [])
    mixtures = spark.createDataFrame([("m", 1, ["01", "19F"], [0.5, 0.5]), ("m", 2, ["01", "19F"], [0.5, 0.5]), ("bad", 1, ["6A"], [1.0]), ("sum", 1, ["01"], [0.5])], "mixture string, replicate int, serotypes array<string>, proportions array<double>")
    out = workflows.simulate_suite(loci, again, mixtures, Simulation(depth=20))
    results = out["results"].collect()
    assert {(r.mixture, r.replicate) for r in results} == {("m", 1), ("m", 2)} and all(r.sensitivity > 0 for r in results)
    assert out["stats"].count() == 1


def test_reports():
    assert "Reduction: 57.1%" in tables.design_text(130, 4156, 3383, 1867, {"pool1": 0, "pool2": 1867}, 2174020, 500, [("g", 7)])
    assert "Without sharing: 4348" in tables.design_text(130, 4156, 3383, 1867, {}, 2174020, 500, [])
    assert "Reduction: 65.9%" in tables.selection_text(555, 189, [("03", 4, "LOW")])
    assert round((1 - 555 / 1867) * 100, 1) == 70.3 and round(evaluate.reduction(4348.04, 1867), 1) == 57.1
    assert evaluate.reduction(0, 0) == 0.0 and tables.selection_text(0, 0, []).count("0.0%") == 1


def test_growth_and_reads(spark):
    got = spark.range(1).select(simulate.grown(F.lit(1000)).alias("n"), simulate.grown(F.lit(0)).alias("z"), simulate.grown(F.lit(1000), noise=0.05, seed=3).alias("r")).first()
    assert got.n == 9307147167 and got.z == 0 and got.r > 10**9
    df = spark.createDataFrame([("p", "s", "ACGT" * 50, 30), ("q", "s", "ACGTA", 2), ("r", "s", "", 1)], "primer string, serotype string, amplicon_seq string, num_reads bigint")
    reads = simulate.reads(df, 150).collect()
    assert len(reads) == 33 and all(r.read in r.amplicon_seq and len(r.read) == min(150, len(r.amplicon_seq)) for r in reads)
    assert len({r.start for r in reads if r.primer == "p"}) > 5
    assert sorted(map(tuple, simulate.reads(df, 150).collect())) == sorted(map(tuple, reads))
    wrong = simulate.reads(df.limit(1), 150, error_rate=0.2, seed=1).collect()
    rate = sum(a != b for r in wrong for a, b in zip(r.read, r.amplicon_seq[r.start :])) / sum(len(r.read) for r in wrong)
    assert 0.1 < rate < 0.2


def test_suite(spark):
    every = simulate.suite(spark, replicates=3)
    assert every.count() == 21
    known = spark.createDataFrame([(x,) for x in ("19F", "19A", "23F", "23A", "06A", "06B", "14")], "serotype string")
    ran = {r.mixture for r in simulate.members(every.where("replicate = 1"), known).collect()}
    assert ran == {"equal_19F_19A", "equal_23F_23A", "unequal_19F_19A_80_20", "unequal_19F_19A_90_10"}  # 6A and 6B are no ids


def test_allocation_and_accuracy(spark):
    counts = spark.createDataFrame([("p", "a", 60), ("p", "b", 30), ("q", "a", 10), ("r", "c", 0)], "primer string, serotype string, copies bigint")
    assert {(r.primer, r.serotype): r.num_reads for r in simulate.allocation(counts, 10).collect()} == {("p", "a"): 18, ("p", "b"): 9, ("q", "a"): 3}
    assert simulate.allocation(counts.where("copies = 0"), 10).count() == 0
    truth = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5), ("n", "a", 1.0)], "mixture string, serotype string, proportion double")
    guess = spark.createDataFrame([("m", "a", 0.75), ("m", "c", 0.25)], "mixture string, serotype string, proportion double")
    got = {r.mixture: tuple(r)[1:] for r in evaluate.accuracy(truth, guess).collect()}
    assert got == {"m": (1, 1, 1, 0.5, 0.5, 0.25), "n": (0, 0, 1, 0.0, 0.0, None)}
    stats = evaluate.suite_stats(evaluate.accuracy(truth, guess).withColumn("mixture", F.lit("x"))).first()
    assert stats.sensitivity_mean == 0.25 and stats.mae_std is None


def test_streaming_hits(spark, tmp_path):
    amplicons = spark.createDataFrame([(0, 0, "ACGTACGGTTACGATCAGCATCAGCATCAGGACT")], "primer_ord bigint, locus_ord bigint, amplicon_seq string")
    spark.createDataFrame([("r1", "ACGTACGGTTACGATCAGCATCAGCATCAGGAC"), ("r2", "TTTT")], "read_id string, read string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("read_id string, read string").parquet(str(tmp_path / "in"))
    run = hits(stream, amplicons).writeStream.outputMode("complete").format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [tuple(r) for r in spark.table("hits").collect()] == [("r1", 0, 0, 3)]


def test_dimers(spark):
    df = spark.createDataFrame([("a", "GGGGGAACGT"), ("b", "TTTTACGTT"), ("c", "CCCCCCC")], "name string, seq string")
    assert [(r.name, r.other) for r in design.dimers(df).collect()] == [("a", "b")]


def test_entry_module():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and "coverage_summary" in names and "greedy_global" in names


def test_bad_proportions_are_an_error_if_strict(spark):
    known = spark.createDataFrame([("a",), ("b",)], "serotype string")
    mixtures = spark.createDataFrame([("good", ["a", "b"], [0.5, 0.5]), ("unknown", ["c"], [0.2]), ("bad", ["a"], [0.5])], "mixture string, serotypes array<string>, proportions array<double>")
    assert {r.mixture for r in simulate.members(mixtures, known).collect()} == {"good"}
    assert simulate.members(mixtures.where("mixture <> 'bad'"), known, strict=True).count() == 2
    with pytest.raises(Exception, match="don't add up to 1: bad"):
        simulate.members(mixtures, known, strict=True).collect()
