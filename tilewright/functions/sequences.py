"""Column functions over nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC complement.
BASES = "ACGTRYKMBVDHacgtrykmbvdh"
COMPLEMENT = "TGCAYRMKVBHDtgcayrmkvbhd"

LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = "".join("ACGT"[k % 4] for k in range(26))


def dna(text: Column, unknown: str = "") -> Column:
    """Any text as a sequence: its letters a-z in lower case become bases; those in `unknown` become N."""
    to = "".join("N" if c in unknown else b for c, b in zip(LETTERS, AS_BASES))
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", ""), LETTERS, to)


def dna_sql(text: str, unknown: str = "") -> str:
    to = "".join("N" if c in unknown else b for c, b in zip(LETTERS, AS_BASES))
    return f"translate(regexp_replace(lower(coalesce({text}, '')), '[^a-z]', '', 'g'), '{LETTERS}', '{to}')"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENT))


def count_base(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def gc_percent(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, (count_base(seq, "G") + count_base(seq, "C")) * 100.0 / F.length(seq)).otherwise(0.0)


def few_unknown(seq: Column, window: int, share: float = 0.1) -> Column:
    """At most share * window bases are N."""
    return count_base(seq, "N") <= share * window


def sanitise(seq: Column) -> Column:
    return F.regexp_replace(seq, "[^ACGTN]", "N")


def cut(seq: Column, start: Column, end: Column) -> Column:
    """seq[start:end], 0-based, half-open."""
    return F.substring(seq, start + 1, end - start)


def kmers(seq: Column, k: int, skip_unknown: bool = True) -> Column:
    """All k-mers in order; none of sequences shorter than k. skip_unknown leaves those with an N out."""
    every = F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.filter(every, lambda x: ~x.contains("N")) if skip_unknown else every


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct k-mers; 0 if either has none."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / F.size(F.array_union(a, b)))


def mismatches(a: Column, b: Column) -> Column:
    """Places at which two sequences of one length differ."""
    places = F.sequence(F.lit(1), F.length(a))
    return F.when(F.length(a) == 0, 0).otherwise(F.aggregate(places, F.lit(0), lambda s, i: s + F.when(F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), 0).otherwise(1)))


def sorted_names(column: str | Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def pool_of(number: Column) -> Column:
    return F.when(number % 2 == 0, "pool1").otherwise("pool2")


def hashed(*parts: Column) -> Column:
    """A replayable non-negative integer below 2 ** 32 from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def hashed_sql(*parts: str) -> str:
    return f"concat('0x', left(md5(concat_ws('|', {', '.join(parts)})), 8))::BIGINT"
