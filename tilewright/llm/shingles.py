"""Word shingles as 64-bit hashes, computed for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SEED = np.uint64(0x5851F42D4C957F2D)
#: Longer words are hashed one by one.
LONG = 64
#: Masks that keep the first 0 to 8 bytes of a little-endian 64-bit number.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Shingle hashes of texts: lower-cased A-Z, words parted by ASCII white space, `size` words to a shingle.

    A text of fewer words is one shingle; without words it has none. A word's hash mixes its bytes eight at a time through a
    nonlinear function (longer words: xxh3), so no family of words coincides by construction; a shingle's mixes those of its
    words in order.
    """

    def __init__(self, size: int):
        self.size = size

    def words(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and how many of them each text has."""
        joined = b"\n".join([*batch, b""]).lower()
        data = np.frombuffer(joined, np.uint8)
        gap = np.append(True, SPACES[data])
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        lengths = ends - starts
        eight = np.ndarray(data.size + 1, "<u8", joined + bytes(8), strides=(1,))  # the eight bytes from each place on
        h = SEED + lengths.astype(np.uint64) * MIX
        short = np.flatnonzero(lengths <= LONG)
        for at in range(0, int(min(LONG, lengths.max(initial=0))), 8):
            short = short[lengths[short] > at]
            part = eight[starts[short] + at] & FIRST[np.minimum(lengths[short] - at, 8)]
            h[short] = finish((h[short] ^ part) * MIX + SEED)
        for k in np.flatnonzero(lengths > LONG).tolist():
            h[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]])
        limits = np.cumsum([len(t) + 1 for t in batch])
        return h, np.diff(np.append(0, np.searchsorted(starts, limits)))

    def shingles(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles, repeated ones included, and where each text's end."""
        flat, counts = self.words(batch)
        n = self.size
        ends = np.cumsum(counts)
        h = np.full(max(0, flat.size - n + 1), np.uint64(n))
        for k in range(n):
            h = finish(h * MIX + flat[k : k + h.size])
        inside = np.maximum(counts - n + 1, 0)
        short = np.flatnonzero((counts > 0) & (counts < n))
        keep = np.repeat(ends - counts, inside) + np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside)
        h = h[keep]
        if short.size:
            one = []
            for k in short.tolist():
                x = np.array([counts[k]], np.uint64)
                for w in flat[ends[k] - counts[k] : ends[k]]:
                    x = finish(x * MIX + w)
                one.append(x[0])
            h = np.insert(h, (np.cumsum(inside) - inside)[short], np.array(one, np.uint64))
            inside[short] = 1
        return h, np.cumsum(inside)

    def sets(self, batch: list[bytes]) -> list[np.ndarray]:
        """Each text's distinct hashes, ascending."""
        h, ends = self.shingles(batch)
        return [np.unique(h[a:b]) for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]
