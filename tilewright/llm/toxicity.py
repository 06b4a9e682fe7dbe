"""Toxicity by compression distance.

zstandard dictionaries are trained, one on windows of toxic documents and one on windows of ordinary ones. A window, here one
word (a run of letters) with a space on both sides, is compressed with the one dictionary and with the other. How often each pair of lengths
occurs, by the window's own length, in documents of either kind calibrates it: the logarithm of the ratio is the window's evidence.

The labelled sample is dealt into FOLDS. Each fold has its own pair of dictionaries, trained on all windows of all other folds, so
evidence is always measured on documents that the dictionaries haven't seen. Most windows of a toxic document are ordinary, so there
are two rounds: the first round's dictionaries are large and trained on everything; in the second round both kinds share the ordinary
one, and behind it stands a small one of their own, trained on the windows that the first round takes for toxic: for the toxic kind
those of toxic documents, for the ordinary kind those that ordinary documents have by mistake.

A window's evidence is the mean over the folds' pairs of dictionaries; a logistic threshold weighs a document's windows up.
Fitting takes a bounded sample of labelled rows: SAMPLE documents of each class at most, chosen by a hash of the id, until
SAMPLE_BYTES, and all text of them. Every document is scored over its whole text.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fold_of, hashed_sample, map_steps, raw

#: Labelled documents of each class, and bytes of text, that fitting may take.
SAMPLE, SAMPLE_BYTES = {0: 3000, 1: 1200}, 16_000_000
FOLDS, LEVEL = 4, 13
#: Sizes of the first round's dictionaries and of the second's, with the trainer's segment and pattern lengths; windows that are one
#: sample to it.
FIRST, OWN, JOINED = (112_640, 24, 8), (4096, 16, 6), 20
#: Bytes of frequent windows that are put back behind a trained dictionary.
RESTORED = 512
#: Evidence from which a window is trained on in the second round.
LIKELY = 1.0
#: Compressed lengths are counted up to LENGTHS bytes above the least, windows' own lengths in steps of WIDTH bytes up to WIDTHS steps.
LENGTHS, WIDTH, WIDTHS = 16, 4, 5
#: Evidence of so many ordinary windows stands in for what hasn't been seen.
PRIOR = 10
#: Windows whose evidence a worker remembers.
REMEMBERED = 500_000
#: Stands at the end of every dictionary and before each window: one match, without which zstandard would store short windows as they are.
LEAD = bytes(range(240, 252))
#: Stands behind each window: zstandard looks for no match in a block's last bytes.
TAIL = bytes(range(8))


#: Everything beyond ASCII counts as letters.
TO_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def windows(text: bytes) -> list[bytes]:
    """The words of a text, runs of letters in lower case, with the spaces that part them."""
    return [b" %s " % w for w in text.decode("utf-8", "replace").lower().encode().translate(TO_LETTERS).split()]


def trained(samples: list[bytes], size: int, segment: int, pattern: int) -> bytes:
    """A zstandard dictionary of the windows; where they are too few to train on, the windows themselves, the most frequent last.

    The trainer puts its best segments last, and cuts off as many bytes there as its header takes. So the most frequent
    windows that the dictionary then lacks are put back behind it, up to RESTORED bytes.
    """
    counts = Counter(samples)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    try:
        content = zstd.train_dictionary(size, [b"".join(samples[k : k + JOINED]) for k in range(0, len(samples), JOINED)], k=segment, d=pattern).as_bytes()
    except zstd.ZstdError:
        return b"".join(ranked[::-1])[-size:]
    back, room = [], RESTORED
    for w in ranked:
        if room < len(w):
            break
        if w not in content:
            back.append(w)
            room -= len(w)
    return content + b"".join(back[::-1])


@lru_cache(maxsize=4 * FOLDS)
def _compressor(content: bytes) -> zstd.ZstdCompressor:
    own = zstd.ZstdCompressionDict(content + LEAD, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    how = zstd.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    own.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(compression_params=how, dict_data=own)


def lengths(content: bytes, batch: list[bytes], threads: int = 1) -> np.ndarray:
    """Compressed length of each window with a dictionary, without what LEAD and TAIL take."""
    out, c = np.zeros(len(batch), np.int64), _compressor(content)
    for k in range(0, len(batch), 20_000):
        part = [LEAD + w + TAIL for w in batch[k : k + 20_000]]
        out[k : k + len(part)] = [len(x) for x in c.multi_compress_to_buffer(part, threads=threads)]
    return out - len(LEAD) - len(TAIL)


def cells(pair: tuple[bytes, bytes], batch: list[bytes], threads: int = 1) -> np.ndarray:
    """The cell of the calibration in which each window is: its lengths with the ordinary and the toxic dictionary, and its own."""
    ordinary, toxic = (np.clip(lengths(x, batch, threads), 0, LENGTHS - 1) for x in pair)
    own = np.minimum(np.fromiter(map(len, batch), np.int64, len(batch)) // WIDTH, WIDTHS - 1)
    return (toxic * LENGTHS + ordinary) * WIDTHS + own


class _Windows:
    """The different windows of some documents, and which of them each document has."""

    def __init__(self, texts: list[bytes]):
        known: dict[bytes, int] = {}
        self.own = [np.array([known.setdefault(w, len(known)) for w in dict.fromkeys(windows(t))], np.int64) for t in texts]
        self.distinct = list(known)

    def all(self, keep: np.ndarray | None = None) -> list[bytes]:
        """Each document's windows, one after the other; only those that keep marks."""
        return [self.distinct[k] for x in self.own for k in (x if keep is None else x[keep[x]])]

    def counts(self, cell: np.ndarray) -> np.ndarray:
        return sum((np.bincount(cell[x], minlength=LENGTHS * LENGTHS * WIDTHS) for x in self.own), np.zeros(LENGTHS * LENGTHS * WIDTHS))


def features(evidence: np.ndarray) -> list[float]:
    """Of a document's windows: 1, all evidence, also by their number, that number, how many have each amount or more, the largest."""
    e = np.sort(evidence)[::-1]
    return [1.0, e.sum() / 10, e.sum() / np.sqrt(e.size + 4), np.log1p(e.size), *[np.log1p(np.count_nonzero(e > x)) for x in (0.5, 1, 1.5, 2, 2.5, 3)], *np.append(e[:3], np.zeros(3))[:3]]


class Model:
    """The folds' pairs of dictionaries (ordinary, toxic), the evidence of each cell and the weights of a document's features.

    odds: how many labelled documents are toxic for each ordinary one, where the sample's own odds differ. Without FOLDS documents
    of each class there are no weights.
    """

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], odds: float | None = None, threads: int = 4):
        self.weights, self.pairs = None, []
        if min(len(toxic), len(ordinary)) < FOLDS:
            return
        folds = [[_Windows(x[f::FOLDS]) for f in range(FOLDS)] for x in (ordinary, toxic)]
        train = lambda lists, how: [trained([w for g, x in enumerate(lists) if g != f for w in x], *how) for f in range(FOLDS)]
        first = [train([w.all() for w in own], FIRST) for own in folds]
        found = self._calibrate(folds, list(zip(*first)), threads)
        own = [train([w.all(self.evidence[c] >= LIKELY) for w, c in zip(*x)], OWN) for x in zip(folds, found)]
        found = self._calibrate(folds, [(b + o, b + t) for b, o, t in zip(first[0], *own)], threads)
        x = [features(self.evidence[c][d]) for kind, at in zip(folds, found) for w, c in zip(kind, at) for d in w.own]
        self.weights = logistic(np.array(x), np.repeat([0.0, 1.0], [len(ordinary), len(toxic)]))
        if odds:
            self.weights[0] += np.log(odds * len(ordinary) / len(toxic))

    def _calibrate(self, folds: list[list[_Windows]], pairs: list[tuple[bytes, bytes]], threads: int) -> list[list[np.ndarray]]:
        """Sets the evidence; returns the cells of each fold's windows under its own pair."""
        self.pairs = pairs
        found = [[cells(p, w.distinct, threads) for p, w in zip(pairs, own)] for own in folds]
        o, t = (sum(w.counts(c) for w, c in zip(own, at)) for own, at in zip(folds, found))
        usual = (o + 0.5) / (o.sum() + 0.5 * o.size)
        self.evidence = np.log((t + PRIOR * usual) / (t.sum() + PRIOR)) - np.log(usual)
        return found

    @property
    def ordinary(self) -> bytes:
        return b"".join(o for o, _ in self.pairs)

    @property
    def toxic(self) -> bytes:
        return b"".join(t for _, t in self.pairs)

    def scores(self, batch: list[bytes], known: dict[bytes, float] | None = None) -> np.ndarray:
        """known: evidence of windows met before; it is added to, and emptied when it is full."""
        if self.weights is None or not batch:
            return np.zeros(len(batch))
        known = {} if known is None else known
        own = [list(dict.fromkeys(windows(t))) for t in batch]
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list(dict.fromkeys(w for x in own for w in x if w not in known))
        known.update(zip(fresh, np.mean([self.evidence[cells(p, fresh)] for p in self.pairs], 0).tolist()))
        x = np.array([features(np.array([known[w] for w in d])) for d in own])
        return 1 / (1 + np.exp(-np.clip((x * self.weights).sum(1), -30, 30)))  # the same number whatever else is in the batch


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the intercept isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.append(1e-6, np.full(x.shape[1] - 1, ridge))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> Model:
    """Learns from labelled documents whose crc32(id as text) modulo folds isn't 0. Null labels, ids and texts are not learnt from.

    Several labels of one id count as toxic if any is; of several texts of one id the smallest is taken. Without FOLDS documents of
    each class the model scores everything 0.
    """
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (fold_of("id", folds) != 0))
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen, counts = hashed_sample(marked, "id", "toxic", SAMPLE)
    if not chosen:
        return Model([], [])
    ids = docs.sparkSession.createDataFrame([(i, k) for k in chosen for i in chosen[k]], marked.select("id", F.col("toxic").cast("int").alias("toxic")).schema)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
    # one row for each of the ids: a repeated id's rows are reduced before they are moved
    rows = durable(source.join(F.broadcast(ids), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")))
    sizes = sorted(rows.select(F.xxhash64("id").alias("h"), "id", F.octet_length("text").alias("n")).collect(), key=lambda r: (r.h, r.id))
    keep, total = [], 0
    for r in sizes:
        if total + r.n <= SAMPLE_BYTES:
            keep.append(r.id)
            total += r.n
    got = sorted(rows.where(F.col("id").isin(keep)).collect(), key=lambda r: r.id)
    return Model(*[[r.text.encode() for r in got if r.toxic == k] for k in (1, 0)], odds=counts.get(1, 0) / max(1, counts.get(0, 0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), predicted (1 if score >= 0.5). Null texts count as empty. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value
        known = own.__dict__.setdefault("known", {})  # a worker keeps the model, and with it what it has met, for its later tasks

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            got = own.scores(raw(part, "text"), known)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

        return run

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_steps(source, "text", make, f"id {source.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
