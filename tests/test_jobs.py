import json
import os
import subprocess
import sys

import duckdb
import pytest

from jobs import locus_intake, panel_coverage
from jobs import queries as jobs
from tests.conftest import ROOT

SF = "/root/testdata/sf0.001"
LETTERS = "acgtacgatcgatgcatgcatcgatcagctagctagcatcgatcagcatcgacta"


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, amp_num int, n bigint").coalesce(1)


def sequence(k, n):
    return "".join(LETTERS[(i * k + i // 7) % len(LETTERS)] for i in range(n))


def as_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def by_sql(name, **tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(jobs.SQL[name])
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in order) for r in got.fetchall()), key=repr)


def test_intake_takes_only_new_files(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    first = [(1, sequence(3, 2000), 1, 1), (2, sequence(5, 900), 1, 1), (3, None, 1, 1), (4, "", 1, 1), (5, "too short", 1, 1)]
    texts(spark, first).write.parquet(source)
    done = locus_intake.run(spark, source, out, check)
    assert done["texts"] == 5 and done["tiles"] == done["all_tiles"] > 0
    again = locus_intake.run(spark, source, out, check)
    assert again == {"texts": 0, "tiles": 0, "all_tiles": done["all_tiles"]}
    # a copy of the first locus on the other strand, a repeated row, a row without an id
    other = sequence(3, 700)[::-1].translate(str.maketrans("acgt", "acgt"))
    texts(spark, [(6, sequence(3, 2000), 1, 1), (7, other, 1, 1), (7, other, 1, 1), (None, sequence(11, 800), 1, 1)]).write.mode("append").parquet(source)
    more = locus_intake.run(spark, source, out, check)
    assert more["texts"] == 4 and more["all_tiles"] == done["all_tiles"] + more["tiles"]
    got = locus_intake.read_back(spark, out)
    assert as_rows(got) == by_sql("job1_locus_intake", documents=f"{source}/*.parquet")
    assert {r.n_loci for r in got.where("locus_ord = 1").collect()} >= {2}


def test_strands_share_a_key(spark):
    docs = texts(spark, [(1, sequence(3, 700), 1, 1)])
    cut = locus_intake.tiles_of(docs, 500, 75, 400).collect()[0]
    from pyspark.sql import functions as F

    from tilewright.functions.sequences import dna, reverse_complement

    flipped = docs.select("doc_id", F.translate(F.lower(reverse_complement(dna(F.col("text")))), "acgt", "abcd").alias("text"))
    assert locus_intake.tiles_of(flipped, 500, 75, 400).collect()[0].tile_key == cut.tile_key


def test_empty_intake(spark, tmp_path):
    texts(spark, []).write.parquet(str(tmp_path / "in"))
    done = locus_intake.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert done["all_tiles"] == 0 and locus_intake.read_back(spark, str(tmp_path / "out")).count() == 0


@pytest.fixture()
def parts(spark, tmp_path):
    """Placements in three steps of arrival, copied from the given table."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    limits = rows.approxQuantile("l_orderkey", [0.4, 0.7], 0)
    yield [rows.where(f"l_orderkey <= {limits[0]}"), rows.where(f"l_orderkey > {limits[0]} AND l_orderkey <= {limits[1]}"), rows.where(f"l_orderkey > {limits[1]}")], str(tmp_path)


def panel(spark, top, **more):
    return panel_coverage.run(spark, f"{top}/in", f"{SF}/supplier.parquet", f"{top}/out", f"{top}/check", **more)


def test_coverage_follows_growing_input(spark, parts):
    steps, top = parts
    before = 0
    for k, rows in enumerate(steps):
        rows.write.mode("append").parquet(f"{top}/in")
        done = panel(spark, top)
        assert done["read"] == rows.count() and (done["low"] is None) == (k == 0)
        before += done["read"]
        assert as_rows(panel_coverage.read_back(spark, f"{top}/out").drop("bucket")) == by_sql("job2_panel_coverage", lineitem=f"{top}/in/*.parquet", supplier=f"{SF}/supplier.parquet")
    assert panel(spark, top)["read"] == 0
    assert spark.read.parquet(f"{top}/in").count() == before


def test_a_run_that_ends_before_its_mark_is_repeated(spark, parts, monkeypatch):
    steps, top = parts
    steps[0].write.parquet(f"{top}/in")
    panel(spark, top)
    steps[1].write.mode("append").parquet(f"{top}/in")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(panel_coverage, "read_back", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        panel(spark, top)
    steps[2].write.mode("append").parquet(f"{top}/in")  # and more has arrived meanwhile
    assert panel(spark, top)["read"] == steps[1].count() + steps[2].count()
    assert as_rows(panel_coverage.read_back(spark, f"{top}/out").drop("bucket")) == by_sql("job2_panel_coverage", lineitem=f"{top}/in/*.parquet", supplier=f"{SF}/supplier.parquet")


def test_odd_placements(spark, tmp_path):
    schema = "l_orderkey bigint, l_suppkey bigint, l_shipdate date, l_quantity double, bucket int, n bigint"
    day = panel_coverage.DAY_0
    rows = spark.sql(f"SELECT * FROM VALUES (1, 1, DATE'{day}', 10, 0, 0), (1, 1, DATE'{day}', 10, 0, 0), (2, 1, NULL, 5, 0, 0), (3, NULL, DATE'{day}', 5, 0, 0), (NULL, 1, DATE'{day}', 50, 0, 0), (4, 99, DATE'{day}', 5, 0, 0), (5, 2, DATE'{day}', NULL, 0, 0) AS t(l_orderkey, l_suppkey, l_shipdate, l_quantity, bucket, n)")
    rows.select([f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in []] or "*").selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", ")]).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(1,), (2,), (2,), (None,)], "s_suppkey bigint").write.parquet(str(tmp_path / "loci"))
    args = (str(tmp_path / "in"), str(tmp_path / "loci"), str(tmp_path / "out"), str(tmp_path / "check"))
    done = panel_coverage.run(spark, *args, min_per_locus=2)
    got = {r.locus: r for r in panel_coverage.read_back(spark, args[2]).collect()}
    assert done["read"] == 6 and done["loci"] == 2 and sorted(got) == [1, 2]
    assert (got[1].num_placements, got[1].covered_bases, got[1].num_gaps, got[1].longest_gap, got[1].status) == (2, 10, 1, 2590, "OK")
    assert (got[2].num_placements, got[2].covered_bases, got[2].longest_gap, got[2].status) == (0, 0, 2600, "LOW")
    empty = str(tmp_path / "none")
    rows.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", ")]).limit(0).write.parquet(empty)
    assert panel_coverage.run(spark, empty, args[1], str(tmp_path / "o2"), str(tmp_path / "c2")) == {"read": 0, "low": None, "high": None, "loci": 0}


def test_repeated_loci_are_reported_as_often_as_in_sql(spark, tmp_path):
    for name, times in (("lineitem", 2), ("supplier", 3)):
        for _ in range(times):
            spark.read.parquet(f"{SF}/{name}.parquet").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}.parquet")
    got = jobs.QUERIES["job2_panel_coverage"](spark, str(tmp_path))
    want = by_sql("job2_panel_coverage", lineitem=f"{tmp_path}/lineitem.parquet/*.parquet", supplier=f"{tmp_path}/supplier.parquet/*.parquet")
    assert as_rows(got) == want and len(want) == 3 * spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_settings_and_registered_queries(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    for name, tables in (("job1_locus_intake", ["documents"]), ("job2_panel_coverage", ["lineitem", "supplier"])):
        got = jobs.QUERIES[name](spark, SF)
        assert as_rows(got) == by_sql(name, **{t: f"{SF}/{t}.parquet" for t in tables})
    assert before == {k: spark.conf.get(k) for k in before} and not spark.streams.active


def test_command_line(tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"buckets": 4}))
    command = [sys.executable, f"{ROOT}/jobs/panel_coverage.py", "--placements", f"{SF}/lineitem.parquet", "--loci", f"{SF}/supplier.parquet", "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "check"), "--config", str(config)]
    said = subprocess.run(command, env=os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir={tmp_path}/shared pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0 and "wrote runs, counts and the report" in said.stderr
    assert 1 <= len([x for x in os.listdir(tmp_path / "out" / "report") if x.startswith("bucket=")]) <= 4
