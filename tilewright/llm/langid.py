"""Language identification with error-correcting output codes.

Each language gets a codeword of bits; for every bit one binary classifier over hashed byte n-grams (two and three bytes of
lower-cased letters) predicts it. Decoding is loss-weighted: a codeword's distance is the mean exponential loss of the
classifiers' margins against its bits, each weighted by how well that classifier does on rows it wasn't fitted to; the nearest
codeword wins, and a small gap to the second marks the row as ambiguous.

Every language of the labelled rows is learnt. Fitting takes a bounded sample of them (PER_LANGUAGE, at most SAMPLE in all or
LEAST a language, chosen by a hash of the id); the classifiers are ridge regressions solved in the sample's own space, so leave-one-out margins come with the solution and
calibrate weights and scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, hashed_sample, map_steps, texts

#: Labelled rows that fitting may take, for a language and in all; beyond SAMPLE / LEAST languages it takes LEAST of each.
PER_LANGUAGE, SAMPLE, LEAST = 400, 2000, 5
BITS3, BITS2 = 13, 12
FEATURES = (1 << BITS3) + (1 << BITS2)
RIDGE = 0.3
#: Rows whose features are held at once; each has FEATURES counts.
ROWS = 128
#: Features that are spread out together in fitting: a divisor of FEATURES.
COLUMNS = 1024
#: Rows whose two best scores differ by less are ambiguous.
AMBIGUOUS = 0.1
UNKNOWN = "und"

LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(batch: list[str]) -> np.ndarray:
    """Square roots of n-gram counts, each row of length 1 (or 0 where there is none)."""
    coded = [b" " + t.lower().encode().translate(LETTERS) + b"   " for t in batch]
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    n = len(coded)
    if not n:
        return np.zeros((0, FEATURES), np.float32)
    doc = np.repeat(np.arange(n, dtype=np.int64), [len(x) for x in coded])[:-2]
    two = data[:-1] << 8 | data[1:]
    three = two[:-1] << 8 | data[2:]
    blank3 = three != 0x202020
    h3 = ((three * np.uint32(2654435761)) >> np.uint32(32 - BITS3)).astype(np.int64)
    h2 = ((two[:-1] * np.uint32(2246822519)) >> np.uint32(32 - BITS2)).astype(np.int64) + (1 << BITS3)
    base = doc * FEATURES
    counts = np.bincount((base + h3)[blank3], minlength=n * FEATURES) + np.bincount((base + h2)[two[:-1] != 0x2020], minlength=n * FEATURES)
    x = np.sqrt(counts.reshape(n, FEATURES).astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n rows of bits, -1 or 1: all distinct splits of up to seven languages, else the random code with the largest least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1] + [1 if split >> k & 1 else -1 for k in range(n - 1)] for split in range((1 << (n - 1)) - 1)]).T
    bits = int(np.ceil(10 * np.log2(n)))
    codes = [np.random.default_rng(seed).choice([-1, 1], (n, bits)) for seed in range(50)]
    least = [(bits - (c @ c.T)[np.tril_indices(n, -1)].max()) // 2 for c in codes]
    return codes[int(np.argmax(least))]


class Rows:
    """Feature rows of which only the counts above 0 are held; they are spread out COLUMNS features at a time."""

    def __init__(self, at: list[np.ndarray], values: list[np.ndarray]):
        self.sizes = np.array([a.size for a in at], np.int64)
        row, column = np.repeat(np.arange(len(at)), self.sizes), np.concatenate([*at, np.zeros(0, np.int32)])
        order = np.argsort(column, kind="stable")
        self.row, self.column, self.value = row[order], column[order], np.concatenate([*values, np.zeros(0, np.float32)])[order]

    def __len__(self) -> int:
        return self.sizes.size

    def _parts(self) -> Iterator[tuple[int, np.ndarray]]:
        for low in range(0, FEATURES, COLUMNS):
            a, b = np.searchsorted(self.column, (low, low + COLUMNS))
            part = np.zeros((len(self), COLUMNS), np.float32)
            part[self.row[a:b], self.column[a:b] - low] = self.value[a:b]
            yield low, part

    def products(self) -> np.ndarray:
        """Of each row with each."""
        out = np.zeros((len(self), len(self)))
        for _, part in self._parts():
            out += part @ part.T
        return out

    def combined(self, dual: np.ndarray) -> np.ndarray:
        """The features' coefficients from the rows'."""
        out = np.zeros((FEATURES, dual.shape[1]), np.float32)
        for low, part in self._parts():
            out[low : low + COLUMNS] = part.T @ dual.astype(np.float32)
        return out


class Model:
    """languages, code, weights of the bits, coefficients, sharpness of the score."""

    def __init__(self, languages: list[str], x: Rows, y: np.ndarray):
        """x: feature rows; y: index into languages."""
        self.languages = languages
        self.code = codewords(len(languages))
        if not languages:
            return
        targets = self.code[y].astype(np.float64)
        inverse = np.linalg.inv(x.products() + RIDGE * np.eye(len(x)))
        dual = inverse @ targets
        self.coefficients = x.combined(dual)
        held = targets - dual / np.diag(inverse)[:, None]  # margins of rows as if they had been left out
        wrong = np.clip((np.sign(held) != targets).mean(0), 0.5 / len(x), 0.499)
        self.weights = np.log((1 - wrong) / wrong)
        self.weights /= self.weights.sum()
        loss = self.losses(held)
        grid = np.geomspace(1, 64, 25)
        fit = [-np.log(np.maximum(self.soft(loss, b)[np.arange(len(y)), y], 1e-12)).mean() for b in grid]
        self.sharpness = float(grid[int(np.argmin(fit))])

    def losses(self, margins: np.ndarray) -> np.ndarray:
        return np.exp(-margins[:, None, :] * self.code[None]) @ self.weights

    @staticmethod
    def soft(loss: np.ndarray, sharpness: float) -> np.ndarray:
        e = np.exp(-(loss - loss.min(1, keepdims=True)) * sharpness)
        return e / e.sum(1, keepdims=True)

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores from 0 to 1, ambiguity."""
        ok = np.array([has_letter(t) for t in batch], bool)
        if not self.languages or not batch:
            return [UNKNOWN] * len(batch), np.zeros(len(batch)), np.zeros(len(batch), bool)
        p = self.soft(self.losses((features(batch) @ self.coefficients).astype(np.float64)), self.sharpness)
        best = p.argmax(1)
        top = np.sort(p, 1)[:, ::-1]
        gap = top[:, 0] - (top[:, 1] if top.shape[1] > 1 else 0)
        return [self.languages[k] if o else UNKNOWN for k, o in zip(best, ok)], np.where(ok, top[:, 0], 0.0), ok & (gap < AMBIGUOUS)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", held_out: tuple[int, int] = (4, 2)) -> Model:
    """Learns from labelled rows with a letter that aren't held out: crc32 of the id as text, modulo held_out[0], is not held_out[1].

    Null ids, labels and texts are not learnt from; of several texts of one id and label the smallest is. Without any labelled row the
    model predicts `und` for all.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[label_col].alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (fold_of("id", held_out[0]) != held_out[1]))
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model([], Rows([], []), np.zeros(0, int))
    each = min(PER_LANGUAGE, max(LEAST, SAMPLE // len(languages)))
    chosen, _ = hashed_sample(rows, "id", "lang", dict.fromkeys(languages, each))
    # at most SAMPLE ids, or LEAST a language, are broadcast
    ids = docs.sparkSession.createDataFrame([(i, k) for k in chosen for i in chosen[k]], rows.select("id", "lang").schema)
    sample = rows.where("text is not null").join(F.broadcast(ids), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).select("text", "lang")

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            batch = texts(part, "text")
            keep = [k for k, t in enumerate(batch) if has_letter(t)]
            x = features([batch[k] for k in keep])
            at = [np.flatnonzero(r).astype(np.int32) for r in x]
            return pa.RecordBatch.from_arrays([part.column(1).take(pa.array(keep, pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(x, at)], pa.list_(pa.float32()))], ["lang", "at", "x"])

        return run

    got = map_steps(sample, "text", make, "lang string, at array<int>, x array<float>", 1 << 20, ROWS).toArrow()
    order = sorted(range(got.num_rows), key=lambda k: (got["lang"][k].as_py(), got["x"][k].as_py()))
    known = sorted(set(got["lang"].to_pylist()))
    y = np.array([known.index(got["lang"][k].as_py()) for k in order], int)
    x = Rows(*[[np.asarray(got[c][k].values) for k in order] for c in ("at", "x")])
    return Model(known, x, y)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred (`und` for texts that are null or without a letter), score, ambiguous. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, unsure = own.predict(texts(part, "text"))
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure)], ["id", "lang_pred", "score", "ambiguous"])

        return run

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_steps(source, "text", make, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean", 1 << 20, ROWS).withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text gets a language; where the model knows none, those whose text has a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            batch = texts(part, text_col)
            keep = [x != UNKNOWN for x in own.predict(batch)[0]] if own.languages else [has_letter(t) for t in batch]
            return part.filter(pa.array(keep, pa.bool_()))

        return run

    return map_steps(docs, text_col, make, docs.schema, 1 << 20, ROWS)
