"""Primer pair design on tiles. The scoring is this package's own: nearest-neighbour melting temperature, distance from the optima.

It isn't bit-compatible with any design library.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import pool_of, reverse_complement

# Nearest-neighbour enthalpy (kcal/mol) and entropy (cal/mol/K) of SantaLucia (1998).
STACK = {
    "AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}
ENDS = {"A": (2.3, 4.1), "T": (2.3, 4.1), "C": (0.1, -2.8), "G": (0.1, -2.8)}
SALT, OLIGO = 0.05, 50e-9
#: least, best, most
SIZE, TM, GC, PRODUCT, POLY, UNKNOWN = (22, 25, 30), (59.0, 61.0, 63.0), (40.0, 60.0), (400, 600), 4, 1
#: Most complementarity: anywhere and at a 3' end, of an oligo with itself and of a pair.
SELF_ANY, SELF_END, PAIR_ANY, PAIR_END = 8, 3, 8, 3


def wallace(gc: float, at: float) -> float:
    return 4 * gc + 2 * at


def melting(seq: str) -> float:
    """Degrees Celsius at SALT and OLIGO; NaN for sequences with other letters than ACGT."""
    try:
        h, s = (sum(x) for x in zip(*[STACK[seq[k : k + 2]] for k in range(len(seq) - 1)], ENDS[seq[0]], ENDS[seq[-1]]))
    except KeyError:
        return math.nan
    return 1000 * h / (s + 0.368 * (len(seq) - 1) * math.log(SALT) + 1.987 * math.log(OLIGO / 4)) - 273.15


def longest_run(seq: str) -> int:
    best = run = 0
    last = ""
    for c in seq:
        run = run + 1 if c == last else 1
        last, best = c, max(best, run)
    return best


def _revcomp(seq: str) -> str:
    return seq.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Enthalpy and entropy of two neighbours by their codes (0 for A to 3 for T, 4 for others), and of an end by its code."""
    pairs, ends = np.zeros((5, 5, 2), np.longdouble), np.zeros((5, 2), np.longdouble)
    for k, a in enumerate("ACGT"):
        ends[k] = ENDS[a]
        for j, b in enumerate("ACGT"):
            pairs[k, j] = STACK[a + b]
    return pairs, ends


#: Sums of some hundred of these are exact in 64 bits, so differences of running sums are the rounded sums that `melting` has.
PAIRS, EDGES = _tables()
CODES = np.full(256, 4)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
#: Bases that running sums are taken over; those of longer sequences begin anew.
SUMMED = 512
#: Starts and sizes of all oligos of a stretch, by its size.
PLACES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in PLACES:
        starts, sizes = np.meshgrid(np.arange(n - SIZE[0] + 1), np.arange(SIZE[0], SIZE[2] + 1))
        inside = starts + sizes <= n
        PLACES[n] = starts[inside], sizes[inside]
    return PLACES[n]


def _allowed(code: np.ndarray) -> tuple[np.ndarray, ...]:
    """Penalties, starts, sizes, melting temperatures and shares of G and C of the oligos that pass all limits; from running sums."""
    sums = lambda x: np.concatenate([np.zeros((1, *x.shape[1:]), x.dtype), np.cumsum(x, 0)])
    a, n = _places(code.size)
    strong, other = sums((code == 1) | (code == 2)), sums(code == 4)
    same = np.ones(max(0, code.size - POLY), bool)  # POLY + 1 equal bases begin here
    for k in range(1, POLY + 1):
        same &= code[: same.size] == code[k : k + same.size]
    runs = sums(same)
    gc = 100.0 * (strong[a + n] - strong[a]) / n
    ok = (gc >= GC[0]) & (gc <= GC[1]) & (other[a + n] == other[a]) & (runs[a + n - POLY] == runs[a])
    a, n, gc = a[ok], n[ok], gc[ok]
    stacked = sums(PAIRS[code[:-1], code[1:]])
    h, s = (stacked[a + n - 1] - stacked[a] + EDGES[code[a]] + EDGES[code[a + n - 1]]).astype(np.float64).T
    tm = 1000 * h / (s + 0.368 * (n - 1) * math.log(SALT) + 1.987 * math.log(OLIGO / 4)) - 273.15
    ok = (tm >= TM[0]) & (tm <= TM[2])
    a, n, tm, gc = a[ok], n[ok], tm[ok], gc[ok]
    return np.abs(tm - TM[1]) + np.abs(n - SIZE[1]), a, n, tm, gc


def oligos(seq: str, low: int, high: int) -> list[tuple[float, int, int, float, float]]:
    """(penalty, start, size, tm, gc) of the allowed oligos of seq that lie in [low, high), best first."""
    code = CODES[np.frombuffer(seq[low:high].encode("ascii", "replace"), np.uint8)]
    parts = []
    step = SUMMED - SIZE[2] + 1
    for at in range(0, max(1, code.size - SIZE[2] + 1), step):
        part = code[at : at + SUMMED]
        if part.size >= SIZE[0]:
            found = _allowed(part)
            # oligos that begin behind the step are the next part's
            own = slice(None) if at + SUMMED >= code.size else found[1] < step
            parts.append([x[own] if c != 1 else x[own] + low + at for c, x in enumerate(found)])
    if not parts:
        return []
    penalty, a, n, tm, gc = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((n, a, penalty))
    return list(zip(*(x[order].tolist() for x in (penalty, a, n, tm, gc))))


def _bits(seq: str) -> list[int]:
    """Per base the places at which it stands, as bits, the first place lowest."""
    return [sum(1 << k for k, c in enumerate(seq) if c == b) for b in "ACGT"]


@lru_cache(maxsize=1 << 16)
def complementarity(a: str, b: str) -> tuple[int, int]:
    """(anywhere, at a 3' end): how well two oligos bind to one another, without gaps: 1 for each pair of complementary bases, -1 for each
    other one, over the best stretch of any way to lay them side by side; at an end: over stretches that begin at the 3' end of either.

    All pairs of one way are one number's bits; ways with fewer complementary pairs than the best stretch so far are passed over.
    """
    turned = b[::-1]  # b runs the other way
    own, other, anywhere, end = _bits(a), _bits(turned)[::-1], 0, 0  # A meets T, C meets G
    for shift in range(1 - len(b), len(a)):  # turned[k] lies under a[k + shift]
        pairs = 0
        for x, y in zip(own, other):
            pairs |= x & (y << shift if shift >= 0 else y >> -shift)
        low, high = max(0, shift), min(len(a), len(b) + shift)
        if (n := pairs.bit_count()) > anywhere:
            run = 0
            for k in range(low, high):
                run = max(0, run + (1 if pairs >> k & 1 else -1))
                anywhere = max(anywhere, run)
        if n > end:
            # the 3' end of a is its last base, that of b the first of the turned one
            for places in ((range(high - 1, low - 1, -1)) if high == len(a) else (), range(low, high) if low == shift else ()):
                run = 0
                for k in places:
                    run += 1 if pairs >> k & 1 else -1
                    end = max(end, run)
    return anywhere, end


#: Pairs of oligos that are laid on each other together, the first time and at most, and tiles that are designed together.
FIRST, MOST, TILES = 16, 512, 64
#: What stands beside a shorter oligo, and what a place there scores.
BESIDE, OUTSIDE = 50, -100
#: A code's partner, and the most that a place of the code scores.
OTHER, LIMIT = np.full(BESIDE + 1, -1, np.int8), np.ones(BESIDE + 1, np.int8)
OTHER[:4], LIMIT[BESIDE] = [3, 2, 1, 0], OUTSIDE  # A meets T, C meets G


def _rows(oligos: list[str], last: bool) -> np.ndarray:
    """Codes of the oligos, one a row; shorter ones end with the others (last), or begin with them."""
    sizes = np.array([len(x) for x in oligos], np.int64)
    out = np.full((sizes.size, sizes.max(initial=1)), BESIDE, np.int8)
    place = np.arange(out.shape[1])
    out[place >= out.shape[1] - sizes[:, None] if last else place < sizes[:, None]] = CODES[np.frombuffer("".join(oligos).encode("ascii", "replace"), np.uint8)]
    return out


def complementarities(own: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`complementarity` of many pairs at once: own as _rows that end together, the others turned, as _rows that begin together. A stretch's
    best sum up to a pair of bases comes from that of the pair before."""
    score = (own.T[:, None, :] == OTHER[turned.T]).view(np.int8)  # place of one, place of the other, pair
    score += score
    score -= 1
    if (own == BESIDE).any() or (turned == BESIDE).any():
        np.minimum(score, LIMIT[own.T][:, None, :], out=score)
        np.minimum(score, LIMIT[turned.T], out=score)
    top = np.zeros(score.shape[1:], np.int8)
    first, more = np.zeros(score.shape[2], np.int8), np.zeros(score.shape[1:], np.int8)  # the first base of the turned one
    more = more[1:]
    for k, row in enumerate(score[::-1]):  # stretches that begin here
        if k:
            best = row.copy()
            best[:-1] += more
        else:
            best = row
        np.maximum(first, best[0], out=first)
        np.maximum(best[1:], 0, out=more)
    more[:] = 0
    for k, row in enumerate(score):  # stretches that end here, in place
        if k:
            row[1:] += more
        np.maximum(top, row, out=top)
        np.maximum(row[:-1], 0, out=more)
    return top.max(0), np.maximum(first, np.maximum(row.max(0), 0))  # the last base of one


def _bind(own: np.ndarray, turned: np.ndarray, most_any: int, most_end: int) -> np.ndarray:
    anywhere, end = complementarities(own, turned)
    return (anywhere > most_any) | (end > most_end)


def _bind_themselves(oligos: list[str]) -> np.ndarray:
    parts = [oligos[k : k + MOST] for k in range(0, len(oligos), MOST)]
    found = [_bind(_rows(x, True), _rows([o[::-1] for o in x], False), SELF_ANY, SELF_END) for x in parts]
    return np.concatenate(found) if found else np.zeros(0, bool)


class Sides(NamedTuple):
    """The allowed oligos on both sides of a target, best first, right ones with their sequence; and which bind themselves, as far as known."""

    region: str
    left: list[tuple[float, int, int, float, float]]
    right: list[tuple[float, int, int, float, float, str]]


def sides(region: str, target_start: int, target_end: int) -> Sides | None:
    """None where a side has no allowed oligo."""
    left = oligos(region, 0, target_start)
    n, turned = len(region), _revcomp(region)
    right = [(p, n - s - k, k, tm, gc, turned[s : s + k]) for p, s, k, tm, gc in oligos(turned, 0, n - target_end)] if left else []
    return Sides(region, left, right) if right else None


def pick_pairs(tiles: list[tuple[str, int, int]]) -> list[dict | None]:
    """`pick_pair` of each tile (region, target_start, target_end). Which oligos bind themselves is found for all tiles together."""
    both = [sides(*t) for t in tiles]
    texts = [x for s in both if s for x in (*(s.region[a : a + k] for _, a, k, _, _ in s.left), *(r[5] for r in s.right))]
    bound, at, out = _bind_themselves(texts), 0, []
    for s in both:
        if s is None:
            out.append(None)
            continue
        low, at = at, at + len(s.left) + len(s.right)
        own = bound[low:at]
        left = [x for x, bad in zip(s.left, own[: len(s.left)].tolist()) if not bad]
        right = [x for x, bad in zip(s.right, own[len(s.left) :].tolist()) if not bad]
        out.append(_pair(s.region, left, right) if left and right else None)
    return out


def pick_pair(region: str, target_start: int, target_end: int) -> dict | None:
    """The pair with the least penalty around the target of those that bind neither themselves nor each other too well; ties by left,
    then right place. None if there is none."""
    return pick_pairs([(region, target_start, target_end)])[0]


def _pair(region: str, left: list, right: list) -> dict | None:
    """The best pair of oligos that don't bind themselves."""
    q, b, end = np.array([r[0] for r in right]), np.array([r[1] for r in right], np.int64), np.array([r[1] + r[2] for r in right], np.int64)
    laid = _rows([r[5][::-1] for r in right], False)
    starts = _rows([region[a : a + k] for _, a, k, _, _ in left], True)
    best, at, most = None, 0, FIRST

    def fitting(p: float, a: int) -> np.ndarray:
        fits = (end - a >= PRODUCT[0]) & (end - a <= PRODUCT[1])
        if best is not None:  # whatever comes from the first one that is no better
            worse = (p + q > best[0]) | ((p + q == best[0]) & ((a > best[1]) | ((a == best[1]) & (b >= best[2]))))
            if worse.any():
                fits[int(np.argmax(worse)) :] = False
        return fits

    while at < len(left) and not (best and left[at][0] >= best[0]):
        orders, pairs = [], 0  # those of the next left ones together
        while at + len(orders) < len(left) and pairs < most:
            orders.append(np.flatnonzero(fitting(*left[at + len(orders)][:2])))
            pairs += orders[-1].size
        some = np.concatenate(orders)
        free = ~_bind(starts[np.repeat(np.arange(at, at + len(orders)), [x.size for x in orders])], laid[some], PAIR_ANY, PAIR_END) if some.size else np.zeros(0, bool)
        for order in orders:
            p, a, k, tm, gc = left[at]
            own, free = order[free[: order.size]], free[order.size :]
            at += 1
            if best and p >= best[0]:
                break
            own = own[fitting(p, a)[own]]
            if own.size:
                x = right[own[0]]
                best = (p + x[0], a, x[1], k, x[2], tm, gc, x[3], x[4], x[1] + x[2] - a)
        most = MOST
    if best is None:
        return None
    penalty, a, b, k, m, tm, gc, tm2, gc2, size = best
    return {"left_seq": region[a : a + k], "left_tm": tm, "left_gc": gc, "left_pos": a, "right_seq": _revcomp(region[b : b + m]), "right_tm": tm2, "right_gc": gc2, "right_pos": b + m - 1, "product_size": size, "penalty": penalty}


PICKED = "left_seq string, left_tm double, left_gc double, left_pos int, right_seq string, right_tm double, right_gc double, right_pos int, product_size int, penalty double"


def design(tiles: DataFrame, keys: list[str], offset: str | None = None) -> DataFrame:
    """keys and the picked pair of each tile (region, target_start, target_end); tiles without a pair have no row.

    Places are relative to the template: region_start (or the column named by offset) is added.
    """
    base = F.col(offset or "region_start").cast("int")
    slim = tiles.select(*keys, base.alias("_base"), "region", "target_start", "target_end")
    known = [f.name for f in slim.schema if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keys) + ", " + PICKED

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out, rows = [], df.to_dict("records")
            for at in range(0, len(rows), TILES):
                some = rows[at : at + TILES]
                for row, got in zip(some, pick_pairs([(r["region"], int(r["target_start"]), int(r["target_end"])) for r in some])):
                    if got:
                        got["left_pos"] += row["_base"]
                        got["right_pos"] += row["_base"]
                        out.append({k: row[k] for k in known} | got)
            yield pd.DataFrame(out, columns=known + [x.split()[0] for x in PICKED.split(", ")])

    return slim.mapInPandas(run, schema)


def named(pairs: DataFrame, gene: str, number: str = "amp_num") -> DataFrame:
    """Adds name ({gene}_amp{n}), amplicon_num, pool, left_name and right_name."""
    name = F.concat(F.col(gene), F.lit("_amp"), F.col(number))
    return pairs.withColumns({"name": name, "amplicon_num": F.col(number).cast("int"), "pool": pool_of(F.col(number)), "left_name": F.concat(name, F.lit("_LEFT")), "right_name": F.concat(name, F.lit("_RIGHT"))})


def dimers(primers: DataFrame, seq_col: str = "seq", name_col: str = "name", bases: int = 5) -> DataFrame:
    """Pairs of primers whose last `bases` bases are each other's reverse complement: an equi-join, each pair once."""
    ends = primers.select(F.col(name_col).alias("name"), F.substring(seq_col, -bases, bases).alias("e"))
    other = ends.select(F.col("name").alias("other"), reverse_complement(F.col("e")).alias("e"))
    return ends.join(other, "e").where("name <= other").select("name", "other", F.col("e").alias("end"))


