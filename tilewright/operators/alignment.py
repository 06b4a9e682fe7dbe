"""Alignment of a cluster's sequences: each is laid on the columns of those before it, inside a band around their common diagonal.

The columns of what is aligned so far hold how many sequences have which base there. A sequence is laid on them by dynamic programming
over sums of pairs: a base in a column scores MATCH for each equal base and costs MISMATCH for each other one, a column that is left
out costs GAP for each base in it, a base without a column GAP for each sequence so far and becomes a column of its own. What
hangs over at either end is free, so windows cut at shifted places meet in step. N neither scores nor costs.

The band follows the diagonal on which most seeds agree. Where the best path touches the band's edge, the band is doubled and
the path is sought again, until it lies inside or the band holds every cell.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import dealt

MATCH, MISMATCH, GAP = 2, 3, 5
#: Cells on either side of the diagonal at first, and bases of a seed.
BAND, SEED = 32, 12
#: Clusters that are aligned together, and windows of a large cluster whose places are counted together.
TOGETHER, PART = 64, 500
BASES = b"ACGT"
CODES = np.full(256, 4, np.uint8)
CODES[np.frombuffer(BASES, np.uint8)] = range(4)
LOW, LOW32 = np.iinfo(np.int64).min // 4, np.iinfo(np.int32).min // 4


def encode(seq: str) -> np.ndarray:
    """Codes 0 to 3 of A, C, G, T; 4 of everything else."""
    return CODES[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def _seeded(x: np.ndarray) -> np.ndarray:
    """All SEED neighbours as one number, put together from stretches of half the size."""
    h, size = x, 1
    for bit in bin(SEED)[3:]:
        h, size = h[: h.size - size] * 5**size + h[size:], size * 2
        if bit == "1":
            h, size = h[:-1] * 5 + x[size:], size + 1
    return h


def diagonal(columns: np.ndarray, seq: np.ndarray) -> int:
    """Column minus place on which most seeds agree; 0 without common seeds. columns: the commonest base of each."""
    if min(columns.size, seq.size) < SEED:
        return 0
    hashes = [_seeded(x) for x in (columns.astype(np.int64), seq.astype(np.int64))]
    known, first = np.unique(hashes[0], return_index=True)
    at = np.minimum(np.searchsorted(known, hashes[1]), known.size - 1)
    hit = known[at] == hashes[1]
    if not hit.any():
        return 0
    shifts, n = np.unique(first[at[hit]] - np.flatnonzero(hit), return_counts=True)
    return int(shifts[np.lexsort((np.abs(shifts), -n))[0]])


class Job(NamedTuple):
    """A sequence to be laid on columns; members: over how many sequences they count."""

    counts: np.ndarray
    members: int
    seq: np.ndarray


#: A path as columns and places, from left to right; -1 stands for none.
Path = tuple[np.ndarray, np.ndarray]


def _advance(jobs: list[Job], shifts: list[int], band: int) -> list[tuple[int, Path, bool]]:
    """Per job: score, path, whether the band's edge was touched. All jobs advance together, a place at a time.

    Row i of a band holds the columns i + shift - band to i + shift + band. What is known of columns is laid out by column - shift + band,
    so a row of all jobs is one slice. Numbers have 32 bits where sums can't outgrow them.
    """
    n, m = (np.array([len(x) for x in y]) for y in ([j.seq for j in jobs], [j.counts for j in jobs]))
    most, wide, width, all_jobs, move = int(n.max()), int(m.max()), 2 * band + 1, np.arange(len(jobs)), np.array(shifts)
    members = max(j.members for j in jobs)
    kind, low = (np.int32, LOW32) if 2 * GAP * (members + 1) * (most + wide + 1) < -LOW32 else (np.int64, LOW)
    frame = most + width + 1
    column = np.arange(frame) + move[:, None] - band
    out, start = (column < 0) | (column > m[:, None]), column == 0
    score, paid, places_of = np.full((len(jobs), 5, frame), low, kind), np.zeros((len(jobs), frame), kind), np.full((len(jobs), most + 1), 4)
    for k, (counts, _, seq) in enumerate(jobs):
        places_of[k, : seq.size] = seq
        # the frame's places that stand for columns from 1 on
        first, last = max(0, band - shifts[k] + 1), min(frame, band - shifts[k] + 1 + len(counts))
        present = counts.sum(1)
        if first < last:
            own = slice(first + shifts[k] - band - 1, last + shifts[k] - band - 1)
            score[k, :4, first:last] = ((MATCH + MISMATCH) * counts[own] - MISMATCH * present[own, None]).T
            score[k, 4, first:last] = 0  # N scores nothing
        # what leaving out all columns up to this one costs
        paid[k] = np.append(0, np.cumsum(GAP * present))[np.clip(column[k], 0, len(counts))]
    insert = (GAP * np.array([j.members for j in jobs])).astype(kind)[:, None]
    score = np.lib.stride_tricks.sliding_window_view(score, width, axis=2)
    reach = lambda x: np.convolve(x.any(0), np.ones(width, np.int64), "valid") > 0
    any_out, any_start = reach(out), reach(start)
    came = np.zeros((most + 1, len(jobs), width), np.int8)  # 0 start, 1 both, 2 place without a column, 3 column without a place
    rows = np.empty((most + 1, len(jobs), width), kind)
    rows[0] = np.where(out[:, :width], low, 0)
    above = np.empty((len(jobs), width), kind)
    above[:, -1:] = low - insert
    for i in range(1, most + 1):
        here, before, row, step = slice(i, i + width), rows[i - 1], rows[i], came[i]
        both = score[all_jobs, places_of[:, i - 1], i]
        both += before
        np.subtract(before[:, 1:], insert, out=above[:, :-1])
        own = np.maximum(both, above)
        np.subtract(2, both >= above, out=step, casting="unsafe")
        if any_start[i]:  # places before the first column are free
            np.copyto(own, 0, where=start[:, here])
            np.copyto(step, 0, where=start[:, here])
        if any_out[i]:
            np.copyto(own, low, where=out[:, here])
        # columns without a place: a running maximum, what has been passed taken off
        passed = paid[:, here]
        np.maximum.accumulate(own + passed, 1, out=row)
        row -= passed
        if any_out[i]:
            np.copyto(row, low, where=out[:, here])
        np.copyto(step, 3, where=row > own)
    # places behind the last column are free: the best cell of that column, and its row
    at = m - np.arange(most + 1)[:, None] - move + band
    inside = (at >= 0) & (at < width) & (np.arange(most + 1)[:, None] <= n)
    last_column = np.where(inside, rows[np.arange(most + 1)[:, None], all_jobs, np.clip(at, 0, width - 1)], low)
    return [_walk(int(n[k]), int(m[k]), shifts[k], band, came[:, k], last_column[:, k], rows[n[k], k], low) for k in range(len(jobs))]


def _walk(n: int, m: int, shift: int, band: int, came: np.ndarray, last_column: np.ndarray, final: np.ndarray, low: int) -> tuple[int, Path, bool]:
    i, k = int(np.argmax(last_column[: n + 1])), int(np.argmax(final))
    total, i, j = (int(last_column[i]), i, m) if last_column[i] >= final[k] else (int(final[k]), n, n + shift - band + k)
    none = np.zeros(0, np.int64)
    if total <= low // 2:
        return total, (none, none), True
    down = lambda high, end: np.arange(high - 1, end - 1, -1)
    blank = lambda size: np.full(size, -1)
    parts = [(blank(n - i), down(n, i)), (down(m, j), blank(m - j))]
    touched = False
    while i > 0 and j > 0:
        k = j - i - shift + band
        touched |= k in (0, 2 * band)
        step = came[i, k]
        if step == 1:  # up to where the diagonal is left
            other = np.flatnonzero(came[1:i, k] != 1)
            size = min(i - (int(other[-1]) + 1 if other.size else 0), j)
            parts.append((down(j, j - size), down(i, i - size)))
            i, j = i - size, j - size
        elif step == 2:
            i -= 1
            parts.append((blank(1), np.array([i])))
        else:
            j -= 1
            parts.append((np.array([j]), blank(1)))
    parts += [(blank(i), down(i, 0)), (down(j, 0), blank(j))]
    columns, places = (np.concatenate(x)[::-1] for x in zip(*parts))
    return total, (columns, places), touched


def _lay(jobs: list[Job], shifts: list[int], band: int) -> list[tuple[int, list[tuple[int, int]], bool]]:
    """`_advance` with paths as pairs."""
    return [(total, _pairs(path), touched) for total, path, touched in _advance(jobs, shifts, band)]


def _pairs(path: Path) -> list[tuple[int, int]]:
    return list(zip(*(x.tolist() for x in path)))


def _laid(jobs: list[Job], band: int) -> list[tuple[int, Path]]:
    shifts = [diagonal(np.where(j.counts.any(1), j.counts.argmax(1), 4), j.seq) if len(j.counts) else 0 for j in jobs]
    found: list = [None] * len(jobs)
    left = list(range(len(jobs)))
    while left:
        again = []
        for k, (total, path, touched) in zip(left, _advance([jobs[k] for k in left], [shifts[k] for k in left], band)):
            whole = band >= abs(shifts[k]) + len(jobs[k].counts) + jobs[k].seq.size
            if touched and not whole:
                again.append(k)
            else:
                found[k] = total, path
        left, band = again, band * 2
    return found


def lay(jobs: list[Job], band: int = BAND) -> list[tuple[int, list[tuple[int, int]]]]:
    """The best score and path of each sequence on its columns. Those whose path touches the band's edge are laid again in a wider band."""
    return [(total, _pairs(path)) for total, path in _laid(jobs, band)]


def columns(clusters: list[list[str]], band: int = BAND) -> list[np.ndarray]:
    """Per cluster, counts of A, C, G, T by column of its aligned sequences, which are laid down in the given order. The clusters'
    second sequences are laid down together, then their third ones, and so on."""
    out = [_bases(encode(c[0])) if c else np.zeros((0, 4), np.int64) for c in clusters]
    for k in range(1, max(map(len, clusters), default=0)):
        own = [c for c, texts in enumerate(clusters) if len(texts) > k]
        jobs = [Job(out[c], k, encode(clusters[c][k])) for c in own]
        for c, job, (_, (column, place)) in zip(own, jobs, _laid(jobs, band)):
            merged = np.zeros((column.size, 4), np.int64)
            merged[column >= 0] = job.counts  # all columns and places are in a path, in order
            merged[place >= 0] += _bases(job.seq)
            out[c] = merged
    return out


def _bases(seq: np.ndarray) -> np.ndarray:
    """One row a place, 1 under its base."""
    return (seq[:, None] == np.arange(4)).astype(np.int64)


def vote(counts: np.ndarray) -> str:
    """Per column the base that more than half of its bases are, else N; columns without a base are left out."""
    counts = counts[counts.any(1)]
    best = counts.argmax(1)
    letters = np.frombuffer(BASES, np.uint8)[best]
    return np.where(2 * counts[np.arange(len(counts)), best] > counts.sum(1), letters, ord("N")).astype(np.uint8).tobytes().decode()


def places(sequences: list[str]) -> np.ndarray:
    """Counts by place from the left, for sequences that are aligned as they are."""
    counts = np.zeros((max(map(len, sequences), default=0), 4), np.int64)
    for text in sequences:
        seq = encode(text)
        known = np.flatnonzero(seq < 4)
        counts[known, seq[known]] += 1
    return counts


def _runs(group: pa.Table, *by: str) -> tuple[list[int], list[int]]:
    """Where each run of equal values of the columns begins and ends."""
    keys = list(zip(*(group[c].to_pylist() for c in by)))
    first = [k for k, x in enumerate(keys) if not k or x != keys[k - 1]]
    return first, [*first[1:], len(keys)]


def consensus(members: DataFrame, key: str, aligned: bool, order: str = "window_idx", seq_col: str = "sequence", together: int = 0) -> DataFrame:
    """(key, sequence): the voted sequence of each key's members, laid down by `order`.

    A key's members meet in one group. About `together` keys (TOGETHER) make a group. Groups are dealt to all tasks of a shuffle: they are
    small for the work that they make.
    """
    source = members.select(key, order, seq_col)
    out = T.StructType([source.schema[key], T.StructField("sequence", T.StringType())])
    schema = to_arrow_schema(out)
    groups = max(1, -(-source.select(key).distinct().count() // (together or TOGETHER)))

    def run(group: pa.Table) -> pa.Table:
        own = group.sort_by([(key, "ascending"), (order, "ascending")])
        texts = [t or "" for t in own[seq_col].to_pylist()]
        first, last = _runs(own, key)
        clusters = [texts[a:b] for a, b in zip(first, last)]
        counts = columns(clusters) if aligned else map(places, clusters)
        return pa.table([own[key].take(pa.array(first, pa.int64())), pa.array([vote(c) for c in counts], pa.string())], schema)

    return dealt(source.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups))), "_group").groupBy("_group").applyInArrow(run, out)


def place_majority(members: DataFrame, key: str, size: str, order: str = "window_idx", seq_col: str = "sequence") -> DataFrame:
    """(key, sequence): as `consensus` by places, for keys of any number of members, of which the column `size` tells.

    Members are dealt to parts of about PART; a part becomes its counts by place, and a key's counts are added up.
    """
    parts = F.ceil(F.col(size) / PART).cast("int")
    source = members.select(key, seq_col, F.pmod(F.xxhash64(order), parts).cast("int").alias("_part"))
    out = T.StructType([source.schema[key], T.StructField("counts", T.BinaryType())])
    last = T.StructType([source.schema[key], T.StructField("sequence", T.StringType())])

    def count(group: pa.Table) -> pa.Table:
        own = group.sort_by([(key, "ascending"), ("_part", "ascending")])
        texts = [t or "" for t in own[seq_col].to_pylist()]
        first, end = _runs(own, key, "_part")
        return pa.table([own[key].take(pa.array(first, pa.int64())), pa.array([places(texts[a:b]).astype(np.int32).tobytes() for a, b in zip(first, end)], pa.binary())], to_arrow_schema(out))

    def add(group: pa.Table) -> pa.Table:
        own = group.sort_by(key)
        counts, voted = own["counts"], []
        first, end = _runs(own, key)
        for a, b in zip(first, end):
            total = np.zeros((0, 4), np.int64)
            for k in range(a, b):
                one = np.frombuffer(counts[k].as_py(), np.int32).reshape(-1, 4)
                if len(one) > len(total):
                    total = np.concatenate([total, np.zeros((len(one) - len(total), 4), np.int64)])
                total[: len(one)] += one
            voted.append(vote(total))
        return pa.table([own[key].take(pa.array(first, pa.int64())), pa.array(voted, pa.string())], to_arrow_schema(last))

    keys = source.select(key, "_part").distinct().count()
    many = lambda n: F.lit(max(1, n))
    counted = dealt(source.withColumn("_group", F.pmod(F.xxhash64(key, "_part"), many(-(-keys // 8)))), "_group").groupBy("_group").applyInArrow(count, out)
    return dealt(counted.withColumn("_group", F.pmod(F.xxhash64(key), many(-(-keys // TOGETHER)))), "_group").groupBy("_group").applyInArrow(add, last)
