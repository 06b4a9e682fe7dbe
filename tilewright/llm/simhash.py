"""SimHash near-duplicates by ball hashing from both sides.

A document's fingerprint takes each of its 64 bits from the majority of its shingles' XXH64 values. Two fingerprints differ in at most
RADIUS = 3 bits exactly if some 64-bit value, a variant, lies within 1 bit of the one and within 2 bits of the other. So
every fingerprint emits the variants of both balls, half the radius rounded down and up; fingerprints that meet on a variant, one
of them on its inner ball, are linked, and no link is missed.

A ball of radius 2 has 2081 variants, too many to move. Variants are therefore shuffled by their leading bits: a fingerprint goes
once to each leading part that its variants can have, with the number of bits that are left to differ, and the task that gets
a part makes the variants behind it. The number of leading bits follows the number of different fingerprints; parts where more than
LIMIT fingerprints meet are cut by further bits, as often as it takes, so a dense family never stands in one task. After 64 bits
a part is one variant, which at most 2081 different fingerprints can have.

All who meet on a variant with one inner fingerprint are linked with that one. So each part gives back a spanning
forest of verified links, no more than it has fingerprints, and never all pairs. Components of the links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_steps, raw
from .components import components, tidy

SHINGLE, SEED, BITS = 3, 42, 64
RADIUS, INNER, OUTER = 3, 1, 2
#: Fingerprints that share a part of the variants before it is cut further; a part's variants then take some 100 MB.
LIMIT = 20_000
#: Leading bits at least, and by which a crowded part is cut further.
LEAST_BITS, STEP_BITS = 8, 8
#: Fingerprints whose outer variants are made together.
TOGETHER = 2000
#: A fingerprint of more than this share of all rows is looked up by broadcast, so fewer than its inverse are.
HOT_SHARE = 0.001
#: Shingles that are counted together.
SHINGLES = 200_000


def fingerprint(text: bytes) -> int:
    """The SimHash of a text, as an unsigned number. Without words it is 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = min(SHINGLE, len(words))
    starts = np.append(0, ends[:-1] + 1)[: len(words) - n + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    counts, total = np.zeros(BITS, np.int64), len(starts)
    ends = ends[n - 1 :].tolist()
    for at in range(0, total, SHINGLES):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + SHINGLES], ends[at : at + SHINGLES])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > total).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, f) of every row of docs (id, text); f is the fingerprint as a signed 64-bit number. No shuffle."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            f = np.array([fingerprint(t) for t in raw(part, "text")], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(f)], ["id", "f"])

        return run

    return map_steps(docs, "text", make, "id bigint, f bigint")


def masks(bits: int, weight: int) -> np.ndarray:
    """All numbers of `bits` bits of which `weight` are set."""
    return np.array([sum(1 << k for k in own) for own in combinations(range(bits), weight)], np.uint64)


def _cut(rows: DataFrame, done: int, bits: int) -> DataFrame:
    """Rows (f, left, part), whose parts have `done` leading bits, in the parts that `bits` further ones make.

    part holds the leading bits of a variant, left how many bits behind them may still differ from f.
    """
    flips = F.array(*[F.struct(F.lit(int(m)).cast("bigint").alias("m"), F.lit(w).alias("w")) for w in range(OUTER + 1) for m in masks(bits, w)])
    own = F.shiftrightunsigned("f", BITS - done - bits).bitwiseAND(F.lit((1 << bits) - 1))
    cut = rows.select("f", "left", "part", F.explode(flips).alias("x")).where(F.col("x.w") <= F.col("left"))
    return cut.select("f", (F.col("left") - F.col("x.w")).alias("left"), F.shiftleft("part", bits).bitwiseOR(own.bitwiseXOR(F.col("x.m"))).alias("part"))


def _meet(f: np.ndarray, left: np.ndarray, part: int, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints that meet on a variant whose leading `bits` bits are `part`."""
    rest = BITS - bits
    lead = np.uint64((part << rest) & (2**BITS - 1)) if rest < BITS else np.uint64(0)
    low = f & np.uint64((1 << rest) - 1)
    flips = [masks(rest, w) for w in range(OUTER + 1)]
    # the inner ball: its variants, and who made them
    inner = [(lead | (low[at][:, None] ^ flips[w])).ravel() for w in range(INNER + 1) for at in [np.flatnonzero(left >= w + OUTER - INNER)]]
    owners = [np.repeat(np.flatnonzero(left >= w + OUTER - INNER), flips[w].size) for w in range(INNER + 1)]
    made, who = np.concatenate(inner), np.concatenate(owners)
    if not made.size:
        return []
    order = np.argsort(made, kind="stable")
    made, who = made[order], who[order]
    first = np.flatnonzero(np.append(True, made[1:] != made[:-1]))
    values, lead_of = made[first], who[first]  # one inner fingerprint stands for each variant
    met = [np.column_stack([np.repeat(lead_of, np.diff(np.append(first, made.size))), who])]
    shift = np.uint64(BITS - max(1, min(22, int(values.size).bit_length() + 3)))
    mix = lambda v: ((v * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
    known = np.zeros(1 << int(BITS - shift), bool)
    known[mix(values)] = True
    for w in range(OUTER + 1):
        all_of = np.flatnonzero(left >= w)
        for k in range(0, all_of.size, TOGETHER):
            at = all_of[k : k + TOGETHER]
            v = (lead | (low[at][:, None] ^ flips[w])).ravel()
            maybe = np.flatnonzero(known[mix(v)])
            place = np.minimum(np.searchsorted(values, v[maybe]), values.size - 1)
            hit = values[place] == v[maybe]
            met.append(np.unique(np.column_stack([lead_of[place[hit]], at[maybe[hit] // flips[w].size]]), axis=0))
    root = list(range(f.size))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for a, b in np.unique(np.concatenate(met), axis=0).tolist():
        x, y = find(a), find(b)
        if x != y and (int(f[a]) ^ int(f[b])).bit_count() <= RADIUS:
            root[x] = y
            out.append((a, b))
    return out


def _links(parts: DataFrame, bits: int) -> DataFrame:
    """(a, b): links between the fingerprints of each part, found in Arrow groups of a bounded size."""

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        f, left = group.column("f").to_numpy().view(np.uint64), group.column("left").to_numpy()
        found = np.array(_meet(f, left, key[0].as_py() & (2**BITS - 1), bits), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(f[found[:, 0]].view(np.int64)), "b": pa.array(f[found[:, 1]].view(np.int64))})

    return parts.groupBy("part").applyInArrow(meet, "a bigint, b bigint")


def links(different: DataFrame, n: int) -> DataFrame:
    """A spanning forest, or somewhat more, of the links between n different fingerprints f: pairs (a, b) at RADIUS bits or fewer."""
    copies = lambda b: 1 + b + b * (b - 1) // 2
    bits = next(b for b in range(LEAST_BITS, BITS) if n * copies(b) <= LIMIT // 2 << b)
    rows = _cut(different.select("f", F.lit(OUTER).alias("left"), F.lit(0).cast("bigint").alias("part")), 0, bits)
    found = None
    while True:  # what is cut is made again wherever it is read: that costs less than to store it
        sizes = durable(rows.groupBy("part").agg(F.count("*").alias("n")).where("n > 1"))  # parts of one row link nothing
        crowded = sizes.where((F.col("n") > LIMIT) & F.lit(bits < BITS))
        more = not crowded.isEmpty()
        own = rows.join(crowded.select("part"), "part", "left_anti") if more else rows
        one = durable(_links(own, bits))
        found = one if found is None else found.unionByName(one)
        if not more:
            return found.distinct()
        step = min(STEP_BITS, BITS - bits)
        rows = _cut(durable(rows.join(crowded.select("part"), "part", "left_semi")), bits, step)
        bits += step


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 lowercase hex digits), component_id (the smallest id reachable over links, itself included).

    Rows link where their fingerprints differ in 3 bits or fewer. A text without words, empty or null, has fingerprint zero and links
    like any other. Rows of one id with different texts are fingerprints of their own, which don't link for their id alone. A row with
    a null id connects others like any row, but is no component's name; without a named one its component is null. Ids are integers.
    """
    rows = durable(fingerprints(docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))))
    different = durable(rows.groupBy("f").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    total = different.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    found = durable(components(links(different, total.n))).select(F.col("node").alias("f"), F.col("component").alias("c"))
    tidy(docs)
    own = durable(different.join(found, "f", "left").withColumn("c", F.coalesce("c", "f")))
    named = durable(own.join(own.groupBy("c").agg(F.min("least").alias("component")), "c").select("f", "rows", "component"))
    # copies may be a third of all rows: what few fingerprints have so many is broadcast, the others are joined
    hot = F.col("rows") > F.lit(HOT_SHARE * total.rows)
    few = named.where(hot).select("f", F.col("component").alias("hot"), F.lit(True).alias("is_hot"))
    marked = rows.join(F.broadcast(few), "f", "left")
    rest = marked.where("is_hot IS NULL").join(named.where(~hot).select("f", "component"), "f")
    out = marked.where("is_hot").select("id", "f", F.col("hot").alias("component")).unionByName(rest.select("id", "f", "component"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
