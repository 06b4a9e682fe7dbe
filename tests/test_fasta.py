import random

import pytest

from tilewright.sources import fasta


def plain(text):
    """(id, sequence) of a file's records, line by line."""
    out = []
    for line in text.replace("\r", "").split("\n"):
        if line.startswith(">"):
            out.append([" ".join(line[1:].split()).split(" ")[0], ""])
        elif out:
            out[-1][1] += "".join(line.split()).upper()
    return [tuple(x) for x in out]


def world(seed, end):
    rng = random.Random(seed)
    out = []
    for k in range(400):
        lines = ["".join(rng.choice("acgtN") for _ in range(60)) for _ in range(rng.randrange(0, 12))]
        out += [f">rec{k} of >{seed}\tsome words", *lines, *([""] if k % 7 == 0 else [])]
    return end.join(out) + (end if seed % 2 else "")


@pytest.mark.parametrize("size", ["128m", "700", "64"])
def test_records_over_split_borders(spark, tmp_path, size):
    """A file in many splits: every record once, in order, wherever the borders fall."""
    texts = {"a.fasta": world(1, "\n"), "b.fasta": world(2, "\r\n"), "c.fasta": "; a comment\n; more\n" + world(3, "\n"), "d.fasta": "\n\n>only\nAC GT\n", "e.fasta": "", "f.fasta": ">bare"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    before, opened = (spark.conf.get(x) for x in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = fasta.records(spark, *[f"{tmp_path}/{name}" for name in texts])
        rows, tasks = found.collect(), found.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
    for name, text in texts.items():
        own = sorted((r.record_ord, r.record_id, r.sequence) for r in rows if r.path.endswith(name))
        assert [x[1:] for x in own] == plain(text), name
    assert tasks > 100 if size != "128m" else tasks < 20
