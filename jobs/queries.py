"""The jobs as queries: each runs twice into one new folder and returns its output as it stands after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tilewright.functions.sequences import dna_sql
from tilewright.operators.graph import shared_folder
from tilewright.queries import INTERVALS, LOCUS, RUNS

from . import locus_intake, panel_coverage


def job1_locus_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile of every document, with how many loci share it; both strands of a tile are one key."""
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        locus_intake.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint")
    return locus_intake.read_back(spark, f"{folder}/output").select("locus_ord", "amp_num", "region_start", "region_end", "n_gc", "gc_bin", "tile_key", "n_tiles", "n_loci")


def job2_panel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, gaps and status of every locus, from all placements."""
    folder = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        panel_coverage.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/supplier.parquet", f"{folder}/output", f"{folder}/checkpoint", length=LOCUS)
    return panel_coverage.read_back(spark, f"{folder}/output").drop("bucket")


QUERIES = {"job1_locus_intake": job1_locus_intake, "job2_panel_coverage": job2_panel_coverage}

SQL = {
    "job1_locus_intake": f"""
WITH loci AS (SELECT doc_id AS locus_ord, {dna_sql('text')} AS s FROM documents),
cut AS (SELECT locus_ord, s, unnest(range(0, length(s), 425)) AS a FROM loci WHERE length(s) > 0),
t AS (SELECT locus_ord, (a // 425 + 1)::INT AS amp_num, a::INT AS region_start, least(a + 700, length(s))::INT AS region_end, substr(s, a + 1, 700) AS r FROM cut WHERE least(a + 700, length(s)) - a >= 400),
k AS (SELECT * EXCLUDE (r), (length(r) - length(replace(replace(r, 'G', ''), 'C', '')))::INT AS n_gc, length(r) AS n, sha256(least(r, reverse(translate(r, 'ACGT', 'TGCA')))) AS tile_key FROM t),
g AS (SELECT tile_key, count(*)::BIGINT AS n_tiles, count(DISTINCT locus_ord)::BIGINT AS n_loci FROM k GROUP BY 1)
SELECT locus_ord, amp_num, region_start, region_end, n_gc, (n_gc * 10 // n * 10)::INT AS gc_bin, tile_key, n_tiles, n_loci FROM k JOIN g USING (tile_key)""",
    "job2_panel_coverage": f"""
WITH {INTERVALS}, {RUNS}, l AS (SELECT s_suppkey AS locus FROM supplier),
n AS (SELECT l_suppkey AS locus, count(*)::BIGINT AS n FROM lineitem GROUP BY 1), c AS (SELECT serotype AS locus, sum(e - s)::BIGINT AS c FROM runs GROUP BY 1),
pts AS (SELECT serotype AS locus, s, e FROM runs WHERE serotype IN (SELECT locus FROM l) UNION ALL SELECT locus, 0, 0 FROM l UNION ALL SELECT locus, {LOCUS}, {LOCUS} FROM l),
gap AS (SELECT locus, s - max(e) OVER (PARTITION BY locus ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM pts),
w AS (SELECT locus, count(*)::BIGINT AS k, max(g)::INT AS m FROM gap WHERE g >= 2 GROUP BY 1)
SELECT locus, {LOCUS}::INT AS locus_length, coalesce(n, 0)::BIGINT AS num_placements, coalesce(c, 0)::BIGINT AS covered_bases, coalesce(c, 0)::BIGINT / {LOCUS} * 100 AS coverage_percent, coalesce(k, 0)::BIGINT AS num_gaps, coalesce(m, 0)::INT AS longest_gap,
 CASE WHEN coalesce(n, 0) >= 5 THEN 'OK' ELSE 'LOW' END AS status
FROM l LEFT JOIN n USING (locus) LEFT JOIN c USING (locus) LEFT JOIN w USING (locus)""",
}
