"""SentencePiece BPE encoding and decoding, without the library's own encoder.

Method: vectorised merge rounds. The words of a batch lie one behind the other in one flat symbol array. Each round
looks up the rank of every adjacent pair, takes the least rank of each word (segmented minimum), merges its occurrences from
the left, and compacts the array; words without a pair leave it. Rounds end when no pair remains.

A merge of all occurrences at once equals the library's one-by-one order only if no pair that a merge creates ranks before
(or with) the merged one. Pieces for which the vocabulary has such an extension are found when the model is loaded; of them a
round merges the leftmost occurrence only.

A word of more than LONG symbols would need rounds over its whole length for nearly every rank. Its merges are taken from a heap
instead, by rank, then from the left: the library's own order, in a time that grows with its length only.

Pieces of spaces alone all have one, the worst, score: they merge last and from the left, so a run of spaces is cut into
longest pieces from the left; this is done in closed form.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_steps, sha, texts

SPACE = "▁"
BYTE, CONTROL, UNKNOWN, NORMAL = 6, 3, 2, 1
#: Distinct words whose ids a task remembers; beyond it the memory is emptied and filled again.
REMEMBERED = 300_000
#: Symbols of a word above which its merges come from a heap.
LONG = 4096


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class Pieces:
    """A BPE model file with byte fallback, identity normalisation and a dummy space in front."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.text, score, self.kind = [], [], []
        rules = {number: dict(_fields(value)) for number, value in _fields(model) if number in (2, 3)}
        trainer, normaliser = rules.get(2, {}), rules.get(3, {})
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("not a BPE model with byte fallback and spaces in front")
        if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("the model normalises texts")
        for number, value in _fields(model):
            if number == 1:
                got = dict(_fields(value))
                self.text.append(got[1].decode())
                score.append(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0])
                self.kind.append(got.get(3, NORMAL))
        self.n = len(self.text)
        self.begin, self.end = self.text.index("<s>"), self.text.index("</s>")
        self.unknown = self.kind.index(UNKNOWN)
        ids = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        self.byte0 = self.text.index("<0x00>")
        self.char = {t: i for t, i in ids.items() if len(t) == 1}
        self.space = ids[SPACE]
        self.longest_run = max(len(t) for t in ids if not t.strip(SPACE))
        self.runs = {t: i for t, i in ids.items() if not t.strip(SPACE)}
        if len({score[i] for t, i in self.runs.items() if len(t) > 1}) > 1 or any(score[i] < score[j] for t, i in ids.items() if t.strip(SPACE) and len(t) > 1 for j in [self.runs[SPACE * 2]]):
            raise ValueError("pieces of spaces must have one score, the least")
        keys, made, rank, careful = [], [], np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        order = {s: k for k, s in enumerate(sorted(set(score), reverse=True))}
        for t, i in ids.items():
            rank[i] = order[score[i]]
        for t, i in ids.items():
            if len(t) < 2 or not t.strip(SPACE):
                continue
            for cut in range(1, len(t)):
                x, y = ids.get(t[:cut], self.n), ids.get(t[cut:], self.n)
                if x < self.n and y < self.n:
                    keys.append(x << 32 | y)
                    made.append(i)
                    careful[x] |= rank[i] <= rank[x]
                    careful[y] |= rank[i] <= rank[y]
        at = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[at], np.array(made, np.int64)[at]
        self.rank, self.careful = rank, careful
        self.surface = [b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else t.replace(SPACE, " ").encode() for t, k in zip(self.text, self.kind)]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of words that hold a SPACE in front at most."""
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        if long:
            rest = iter(self.merge([w for w in words if len(w) <= LONG]))
            return [self._merge_long(w) if len(w) > LONG else next(rest) for w in words]
        n = len(words)
        if not n:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        kinds, where = np.unique(points, return_inverse=True)
        sym = np.array([self.char.get(chr(c), self.n + c) for c in kinds], np.int64)[where]
        word = np.repeat(np.arange(n), lengths)
        done_sym, done_word = [], []
        none = np.int64(1) << 40
        made, rank = self._pairs(sym, word, np.arange(sym.size))
        while sym.size:
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, sym.size))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            keep = least < none
            hit = np.flatnonzero((rank == least) & keep)
            if not keep.all():
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
            if not hit.size:
                break
            new, in_word = made[hit], word[hit]
            # of touching occurrences (aaa) every second one from the left merges; of careful pieces only a word's first
            first_of_word = np.append(True, in_word[1:] != in_word[:-1])
            begin = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1) | first_of_word)
            place = np.arange(hit.size) - np.repeat(begin, np.diff(np.append(begin, hit.size)))
            take = np.where(self.careful[new], first_of_word, place % 2 == 0)
            hit, new = hit[take], new[take]
            sym[hit] = new
            keep[hit + 1] = False
            at = (np.cumsum(keep) - 1)[hit]
            sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
            changed = np.concatenate([at, np.maximum(at - 1, 0)])
            made[changed], rank[changed] = self._pairs(sym, word, changed)
        if done_sym:
            sym, word = np.concatenate(done_sym), np.concatenate(done_word)
            at = np.argsort(word, kind="stable")
            sym, word = sym[at], word[at]
        if sym.size and sym.max() >= self.n:
            spelt = [self._bytes(s - self.n) if s >= self.n else (s,) for s in sym.tolist()]
            word = np.repeat(word, [len(x) for x in spelt])
            sym = np.array([i for x in spelt for i in x], np.int64)
        bounds = (np.searchsorted(word, np.arange(n + 1)) * 4).tolist()
        flat = sym.astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    @property
    def pairs(self) -> dict[int, int]:
        """The piece that a pair of pieces makes; made when the first long word comes."""
        if not hasattr(self, "_made"):
            self._made = dict(zip(self.keys.tolist(), self.made.tolist()))
        return self._made

    def _merge_long(self, word: str) -> bytes:
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        kinds, where = np.unique(points, return_inverse=True)
        start = np.array([self.char.get(chr(c), self.n + c) for c in kinds], np.int64)[where]
        _, rank = self._pairs(start, np.zeros(start.size, np.int64), np.arange(start.size))
        at = np.flatnonzero(rank < 1 << 40)
        heap = np.sort(rank[at] << 32 | at).tolist()  # sorted, so it is a heap
        sym, after, before = start.tolist(), [*range(1, start.size), -1], [*range(-1, start.size - 1)]
        made_of, ranks, place = self.pairs, self.rank.tolist(), (1 << 32) - 1
        while heap:
            top = heappop(heap)
            left = top & place
            right = after[left]
            if sym[left] < 0 or right < 0:
                continue
            made = made_of.get(sym[left] << 32 | sym[right])
            if made is None or ranks[made] != top >> 32:
                continue  # one of the two has been merged since
            sym[left], sym[right] = made, -1
            after[left] = then = after[right]
            if then >= 0:
                before[then] = left
            for a, b in ((before[left], left), (left, then)):
                if a >= 0 and b >= 0 and (new := made_of.get(sym[a] << 32 | sym[b])) is not None:
                    heappush(heap, ranks[new] << 32 | a)
        out = [i for s in sym if s >= 0 for i in ((s,) if s < self.n else self._bytes(s - self.n))]
        return np.array(out, "<u4").tobytes()

    def _pairs(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece and the rank of the pairs that begin at these places."""
        right = np.minimum(at + 1, sym.size - 1)
        pair = (sym[at] << 32) | sym[right]
        k = np.minimum(np.searchsorted(self.keys, pair), self.keys.size - 1)
        ok = (self.keys[k] == pair) & (word[at] == word[right]) & (right > at)
        made = np.where(ok, self.made[k], 0)
        return made, np.where(ok, self.rank[made], np.int64(1) << 40)

    def _bytes(self, point: int) -> list[int]:
        return [self.byte0 + b for b in chr(point).encode()]

    @lru_cache(maxsize=4096)  # noqa: B019
    def _few_spaces(self, n: int) -> list[int]:
        """One merge after the other, always the leftmost that makes a piece."""
        parts = [1] * n
        while True:
            k = next((k for k in range(len(parts) - 1) if SPACE * (parts[k] + parts[k + 1]) in self.runs), None)
            if k is None:
                return [self.runs[SPACE * x] for x in parts]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def spaces(self, n: int) -> bytes:
        """The leftmost piece grows to the longest before the merges reach what follows it."""
        full = max(0, n // self.longest_run - 1)
        return np.array([self.runs[SPACE * self.longest_run]] * full + self._few_spaces(n - full * self.longest_run), "<u4").tobytes()

    def tokens(self, pieces: list[str]) -> list[bytes]:
        """The ids (little-endian, 32 bits) of strings of the form SPACE* other*, as SPLIT makes them."""
        runs = [len(p) - len(p.lstrip(SPACE)) if p.startswith(SPACE * 2) else 1 for p in pieces]
        out = self.merge([p[r - 1 :] for p, r in zip(pieces, runs)])
        space = np.array([self.space], "<u4").tobytes()
        for k, r in enumerate(runs):
            if r > 1:
                out[k] = self.spaces(r) + out[k][4:] if out[k][:4] == space else self.spaces(r - 1) + out[k]
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """What the library's decode() returns, in UTF-8. Bytes that make no character become U+FFFD each."""
        surface, kind, byte0 = self.surface, self.kind, self.byte0
        if ids.size and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("an id outside the vocabulary")
        is_byte = (ids >= byte0) & (ids < byte0 + 256)
        out = []
        cuts = np.flatnonzero(np.diff(is_byte.astype(np.int8))) + 1
        parts = np.split(ids, cuts) if cuts.size else [ids]
        begun = False
        for part in parts:
            if not part.size:
                continue
            if byte0 <= int(part[0]) < byte0 + 256:
                out.append(_valid((part - byte0).astype(np.uint8).tobytes()))
                begun = True
                continue
            listed = part.tolist()
            if not begun:
                k = next((k for k, i in enumerate(listed) if kind[i] != CONTROL), None)
                if k is None:
                    continue
                begun = True
                first = listed[k]
                if kind[first] == NORMAL and self.text[first][0] == SPACE:
                    out.append(surface[first][1:])
                    listed = listed[k + 1 :]
            out.append(b"".join([surface[i] for i in listed]))
        return b"".join(out)


def _valid(data: bytes) -> bytes:
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode().encode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�".encode())
                at += 1
        return b"".join(out)


SPLIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker; Spark reuses workers, so later tasks know the words of earlier ones."""
    return Encoder(load(path))


class Encoder:
    """Encodes texts; remembers the ids of the words it has seen, up to REMEMBERED of them."""

    def __init__(self, model: Pieces):
        self.model, self.known = model, {}

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        model, known = self.model, self.known
        split = [SPLIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in batch]
        new = list({w for s in split for w in s if w not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({w for s in split for w in s})
        known.update(zip(new, model.tokens(new)))
        head, tail = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))
        return [np.frombuffer(b"".join([head, *map(known.__getitem__, s), tail]), "<u4") for s in split]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256; with_ids adds the ids and the decoded text.

    A null text counts as empty (begin and end ids only); repeated rows give repeated results; a null id stays null.
    model_path is read by every executor. There is no shuffle; a task holds a few MB of text at a time, or one longer text with
    some 150 bytes for each symbol of an unbroken word.
    """

    def make():
        encoder = encoder_of(model_path)

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.encode(texts(part, "text"))
            decoded = [encoder.model.decode_bytes(i) for i in ids]
            cols = [part.column(0), pa.array([i.size for i in ids], pa.int64()), pa.array([sha(i.tobytes()) for i in ids], pa.string()), pa.array([sha(d) for d in decoded], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array([i.tolist() for i in ids], pa.list_(pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(cols, names)

        return run

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return map_steps(source, "text", make, schema, 1 << 20).withColumnRenamed("id", id_col)
