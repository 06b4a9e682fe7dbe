"""In-silico PCR: the best approximate site of every primer in every locus, paired into amplicons."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import BASES, COMPLEMENT
from .graph import durable

#: Primers that are sent to the executors at once; a larger table goes in as many rounds as it needs.
BLOCK_PRIMERS = 50_000
#: Bases of a seed.
LEAST_SEED, MOST_SEED = 4, 8
#: Bases that are searched together, cells that are compared together, and loci whose texts a task holds beside Arrow's batch.
TOGETHER, CELLS, HELD = 1 << 18, 1_000_000, 200
_MAP = str.maketrans(BASES, COMPLEMENT)


class Probes:
    """Probe sequences indexed by exact seeds: a site with at most m mismatches holds one of m + 1 disjoint pieces unchanged.

    Many loci are searched together: their bases stand in one array, so a step of the search is one operation over all of them.
    """

    def __init__(self, probes: list[str], max_mismatches: int):
        self.probes = [np.frombuffer(p.encode("ascii", "replace"), np.uint8) for p in probes]
        self.sizes = np.array([p.size for p in self.probes], np.int64)
        self.limit = max_mismatches
        self.reach = int(self.sizes.max(initial=1))
        pieces = self.sizes // (max_mismatches + 1)
        self.scanned = np.flatnonzero((pieces < LEAST_SEED) & (self.sizes > 0)).tolist()  # too short for seeds
        self.seeds = {}
        for size in np.unique(np.minimum(pieces, MOST_SEED)):
            own = np.flatnonzero(np.minimum(pieces, MOST_SEED) == size)
            if size < LEAST_SEED:
                continue
            at = np.arange(max_mismatches + 1) * pieces[own][:, None]
            codes = np.array([[int.from_bytes(self.probes[n][x : x + size].tobytes(), "big") for x in row] for n, row in zip(own, at)], np.uint64).ravel()
            order = np.argsort(codes, kind="stable")
            known, first = np.unique(codes[order], return_index=True)
            likely = np.zeros(1 << 16, bool)
            likely[self._mix(known)] = True
            owner = np.repeat(own, max_mismatches + 1)[order]
            self.seeds[int(size)] = known, np.append(first, owner.size), owner, at.ravel()[order], likely
        # all probes of a length as one matrix, and each probe's row in it
        self.rows = np.zeros(len(probes), np.int64)
        self.matrix = {}
        for size in np.unique(self.sizes):
            own = np.flatnonzero(self.sizes == size)
            self.rows[own] = np.arange(own.size)
            self.matrix[int(size)] = np.array([self.probes[n] for n in own], np.uint8).reshape(own.size, size)

    @staticmethod
    def _mix(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def best(self, seq: str) -> dict[int, tuple[int, int]]:
        """probe -> (mismatches, position) in one locus."""
        _, probe, wrong, start = self.search([seq])
        return {p: (m, s) for p, m, s in zip(probe.tolist(), wrong.tolist(), start.tolist())}

    def search(self, loci: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(locus, probe, mismatches, position), ascending: fewest mismatches, then leftmost; no row without a site within the limit."""
        found = []
        pieces, held = [], 0
        for k, text in enumerate(loci):
            own = text.encode("ascii", "replace")
            for at in range(0, max(1, len(own) - self.reach + 1), TOGETHER):  # a long locus goes in pieces that overlap
                part = own[at : at + TOGETHER + self.reach - 1]
                pieces.append((k, at, part))
                held += len(part)
                if held >= TOGETHER:
                    found.append(self._sites(pieces))
                    pieces, held = [], 0
        if pieces:
            found.append(self._sites(pieces))
        rows = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
        rows = rows[:, np.lexsort(rows[::-1])]
        return tuple(rows[:, np.append(True, np.diff(rows[0]) | np.diff(rows[1])).astype(bool)[: rows.shape[1]]])

    def _sites(self, pieces: list[tuple[int, int, bytes]]) -> np.ndarray:
        """Rows of (locus, probe, mismatches, position) of all sites within the limit that stand in the pieces."""
        data = np.frombuffer(b"\0".join([x[2] for x in pieces]) + b"\0", np.uint8)
        ends = np.cumsum([len(x[2]) + 1 for x in pieces]) - 1
        begins = np.append(0, ends[:-1] + 1)
        out = []
        for size, (known, first, owner, at, likely) in self.seeds.items():
            if data.size < size:
                continue
            here = np.zeros(data.size - size + 1, np.uint64)
            for k in range(size):
                here = (here << np.uint64(8)) | data[k : k + here.size]
            place = np.flatnonzero(likely[self._mix(here)])
            which = np.minimum(np.searchsorted(known, here[place]), known.size - 1)
            hit = known[which] == here[place]
            place, which = place[hit], which[hit]
            n = first[which + 1] - first[which]
            index = np.repeat(first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(place, n) - at[index], owner[index]))
        for p in self.scanned:
            out.append((np.arange(data.size), np.full(data.size, p)))
        start, probe = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        piece = np.searchsorted(ends, start, "right")
        inside = (start >= 0) & (piece < ends.size)
        inside[inside] = start[inside] + self.sizes[probe[inside]] <= ends[piece[inside]]
        inside[inside] &= start[inside] >= begins[piece[inside]]
        start, probe, piece = start[inside], probe[inside], piece[inside]
        wrong = np.full(start.size, self.limit + 1)
        for size, matrix in self.matrix.items():
            own = np.flatnonzero(self.sizes[probe] == size)
            for part in np.array_split(own, max(1, -(-own.size * size // CELLS))):
                wrong[part] = (data[start[part][:, None] + np.arange(size)] != matrix[self.rows[probe[part]]]).sum(1)
        good = wrong <= self.limit
        locus, offset = (np.array([x[k] for x in pieces], np.int64)[piece[good]] for k in (0, 1))
        return np.array([locus, probe[good], wrong[good], start[good] - begins[piece[good]] + offset], np.int64)


AMPLICONS = "primer_ord bigint, primer_name string, locus_ord bigint, serotype string, start int, end int, size int, left_mismatches int, right_mismatches int, mismatches int"


def amplify(loci: DataFrame, primers: DataFrame, max_mismatches: int = 2) -> DataFrame:
    """Every (primer pair, locus) whose best left site lies before the best site of the right primer's reverse complement.

    loci: locus_ord, serotype, sequence. primers: primer_ord, name, left_seq, right_seq; of rows with one name the last one's
    sequences count, at the first one's place. Both sites are searched on their own. The primer table is broadcast in blocks of
    BLOCK_PRIMERS; loci are scanned where they lie.
    """
    known = primers.groupBy("name").agg(F.min("primer_ord").alias("primer_ord"), F.max_by("left_seq", "primer_ord").alias("left_seq"), F.max_by("right_seq", "primer_ord").alias("right_seq"))
    rounds = -(-known.count() // BLOCK_PRIMERS)
    out = None
    for k in range(rounds):
        rows = (known if rounds == 1 else known.where(F.pmod(F.xxhash64("name"), F.lit(rounds)) == k)).orderBy("primer_ord").collect()
        sent = loci.sparkSession.sparkContext.broadcast([(r.primer_ord, r.name, r.left_seq or "", (r.right_seq or "").translate(_MAP)[::-1]) for r in rows])
        one = _amplify(loci, sent, max_mismatches)
        if rounds > 1:  # a block's amplicons are written before the next block is sent
            one = durable(one)
            sent.destroy()
        out = one if out is None else out.unionByName(one)
    return out if out is not None else loci.sparkSession.createDataFrame([], AMPLICONS)


_built: dict[str, tuple[Probes, Probes]] = {}


def _probes(name: str, rows: list[tuple[int, str, str, str]], limit: int) -> tuple[Probes, Probes]:
    """Built once a worker: workers are used again for later tasks. Only the last ones are kept."""
    if name not in _built:
        _built.clear()
        _built[name] = Probes([r[2] for r in rows], limit), Probes([r[3] for r in rows], limit)
    return _built[name]


def _amplify(loci: DataFrame, sent: Broadcast, limit: int) -> DataFrame:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        left, right = _probes(name, rows, limit)
        ordinals, names = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, HELD):
                batch = whole.slice(at, HELD)
                texts = [t or "" for t in batch.column(2).to_pylist()]
                (la, pa_, ma, a), (lb, pb, mb, b) = left.search(texts), right.search(texts)
                _, x, y = np.intersect1d(la * len(rows) + pa_, lb * len(rows) + pb, assume_unique=True, return_indices=True)
                ahead = b[y] > a[x]
                x, y = x[ahead], y[ahead]
                end = b[y] + right.sizes[pb[y]]
                primer, locus = pa.array(pa_[x]), pa.array(la[x])
                numbers = [pa.array(v.astype(np.int32)) for v in (a[x], end, end - a[x], ma[x], mb[y], ma[x] + mb[y])]
                yield pa.RecordBatch.from_arrays([ordinals.take(primer), names.take(primer), batch.column(0).take(locus), batch.column(1).take(locus), *numbers], [c.split()[0] for c in AMPLICONS.split(", ")])
        pa.default_memory_pool().release_unused()  # workers live on

    return loci.select(F.col("locus_ord").cast("bigint").alias("locus_ord"), "serotype", "sequence").mapInArrow(run, AMPLICONS)


def by_size(low: int = 200, high: int = 1000) -> Column:
    return F.col("size").between(low, high)


def by_product(low: float = 0.3, high: float = 3.0) -> Column:
    return (F.col("size") >= low * F.col("product_size")) & (F.col("size") <= high * F.col("product_size"))


def per_locus(amplicons: DataFrame, loci: DataFrame, least: int = 5) -> DataFrame:
    """serotype, amplicons (primers that amplify it), status OK or LOW; loci without any have 0."""
    counts = amplicons.groupBy("serotype").agg(F.count_distinct("primer_name").alias("n"))
    return loci.select("serotype").join(counts, "serotype", "left").select("serotype", F.coalesce("n", F.lit(0)).alias("amplicons"), F.when(F.coalesce("n", F.lit(0)) >= least, "OK").otherwise("LOW").alias("status"))
