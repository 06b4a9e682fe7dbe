"""Canonical exact document digests.

A text's canonical form is its NFKC normal form, case folded, with every run of white space as one space; its digest is the
128-bit xxh3 of that form. Documents are grouped by digest, and inside a group of several the canonical bytes themselves are
compared: where two differ, that digest's fingerprints carry the SHA-256 of the bytes as well.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, steps

#: Ids of documents in groups are broadcast up to this number of rows, else joined.
BROADCAST_ROWS = 2_000_000
#: A digest with more than one in so many rows is looked up by broadcast (there are fewer than this of them), the others by a join.
HOT = 1000
#: Canonical bytes that a task remembers for comparison; beyond, it hands them on and begins anew.
REMEMBERED = 16 << 20
#: Characters of a text by which rows of one id are dealt to partitions.
PREFIX = 64


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def wide(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down, code points) replaced by as much of the beginning of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


class Digester:
    """digest(data) may be narrower than wide() in tests; `shared` are digests that differing texts have."""

    def __init__(self, digest: Callable[[bytes], bytes] = wide, shared: frozenset[bytes] = frozenset()):
        self.digest, self.shared = digest, shared

    def __call__(self, data: bytes) -> bytes:
        d = self.digest(data)
        return d + hashlib.sha256(data).digest() if d in self.shared else d


FIELDS = "part int, kind string, id {}, n_chars bigint, edited_sha binary, digest binary, edited_digest binary, near_edited double, near_next double, text string"


def _row(digester: Digester, part: int, ident, text: str, following: str) -> tuple:
    changed = edited(text, following)
    own, other, after = canonical(text), canonical(changed), canonical(following)
    return (part, "row", ident, len(text), hashlib.sha256(changed.encode()).digest(), digester(own), digester(other), float(own == other), float(own == after), None)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _stream(docs: DataFrame, digester: Digester) -> DataFrame:
    """Rows in descending id order, each with the next; the first and last text of every partition are handed on as rows.

    Rows of one id may be many: they are dealt by the beginnings of their texts and, where these tie, by where they were read.
    """
    kind = docs.schema["id"].dataType
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("prefix", F.substring("text", 1, PREFIX)).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("id").desc(), F.col("prefix").desc()]
    ordered = keyed.repartitionByRange(n, *order, "row").sortWithinPartitions(*order, F.col("text").desc()).select("id", "text")
    schema = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("id", to_arrow_type(kind)), ("n_chars", pa.int64()), ("edited_sha", pa.binary()), ("digest", pa.binary()), ("edited_digest", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
    kind = kind.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            for step in steps(batch, "text"):
                out = []
                for ident, text in zip(step.column(0).to_pylist(), step.column(1).to_pylist()):
                    text = text or ""
                    if before is None:
                        out.append((part, "head", ident, None, None, None, None, None, None, text))
                    else:
                        out.append(_row(digester, part, *before, text))
                    before = ident, text
                yield _batch(out, schema)
        if before is not None:
            yield _batch([(part, "tail", before[0], None, None, None, None, None, None, before[1])], schema)

    found = durable(ordered.mapInArrow(run, FIELDS.format(kind)))
    # one head and one tail for each partition that has rows: only their numbers come to the driver
    parts = sorted(r.part for r in found.where("kind = 'head'").select("part").collect())
    if not parts:
        return found.where("kind = 'row'")
    follow = F.broadcast(docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int"))
    heads = found.where("kind = 'head'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    tails = found.where("kind = 'tail'").select("part", "id", "text").join(follow, "part").join(heads, "after").select("part", "id", "text", "following")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch([_row(digester, *r.values()) for r in batch.to_pylist()], schema)

    return found.where("kind = 'row'").unionByName(tails.mapInArrow(close, FIELDS.format(kind)))


def _members(digests: DataFrame) -> DataFrame:
    """Ids of the rows whose digest another row has as well. A digest that very many rows have never meets in one task."""
    total = digests.count()
    counted = durable(digests.groupBy("digest").count().where("count > 1"))
    hot = F.broadcast(counted.where(F.col("count") * HOT > total).select("digest"))  # fewer than HOT rows
    other = counted.where(F.col("count") * HOT <= total).select("digest")
    return digests.join(hot, "digest", "left_semi").select("id").unionByName(digests.join(hot, "digest", "left_anti").join(other, "digest", "left_semi").select("id")).distinct()


def _shared(docs: DataFrame, digests: DataFrame, digest: Callable[[bytes], bytes]) -> frozenset[bytes]:
    """Digests of groups in which the canonical bytes differ. Each task compares its own members and hands on one a digest."""
    ids = durable(_members(digests))
    members = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", "left_semi")

    def rows(pairs: Iterable[tuple[bytes, bytes]]) -> pa.RecordBatch:
        pairs = list(pairs)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.binary()) for k in (0, 1)], ["digest", "data"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = {}, 0
        for batch in batches:
            for step in steps(batch, "text"):
                for text in step.column(1).to_pylist():
                    data = canonical(text or "")
                    d = digest(data)
                    if d not in known:
                        known[d] = data
                        size += len(data)
                    elif known[d] != data:
                        yield rows([(d, data)])
                if size > REMEMBERED:
                    yield rows(known.items())
                    known, size = {}, 0
        yield rows(known.items())

    differ = members.mapInArrow(run, "digest binary, data binary").groupBy("digest").agg(F.min("data").alias("a"), F.max("data").alias("b")).where("a <> b")
    return frozenset(bytes(r.digest) for r in differ.select("digest").toLocalIterator())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = wide) -> DataFrame:
    """Per row: id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty. Rows follow each other by descending id, null ids last, rows of one id by descending beginnings of their
    texts (PREFIX characters; rows that tie there in any order); after the last comes the first. Ids are of any type that has an
    order. An empty table gives an empty table. An exact digest is equal or not, so the likenesses are 1.0 or 0.0, decided on the canonical bytes. Equal
    texts have equal fingerprints, and so have texts that differ in case, white space or compatibility forms only. The text is
    moved once, to range partitions that are read as streams; no partition is held whole.
    """
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = _stream(docs, Digester(digest))
    shared = _shared(docs, rows.select("id", "digest"), digest)
    if shared:
        rows = _stream(docs, Digester(digest, shared))
    return rows.select(F.col("id").alias(id_col), "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), F.lower(F.hex("digest")).alias("fingerprint"), F.lower(F.hex("edited_digest")).alias("edited_fingerprint"), "near_edited", "near_next")
