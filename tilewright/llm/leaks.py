"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of shards (index_documents). A shard holds a few MB of documents: its terms, and for each term the ascending
positions at which it stands, in one flat position space with a hole behind every document. The table is written before it is searched,
so several blocks of a benchmark, or several benchmarks, read the stored postings and not the texts.

A window of the benchmark is looked up from its rarest term in the shard: the position lists are intersected after their
offsets are taken off, rarest first, so that what remains are exact phrase occurrences. Proximity matches (all terms of a window
within a span, in any order) come from the same lists and tell which items a document holds in another order or with words
between. Sharding by document keeps all of a document's postings together: nothing of the corpus is shuffled.

The benchmark is sent to the executors in blocks of at most BLOCK_CHARS characters, as many as it needs; a worker builds a block's
windows once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_steps, raw, sha, steps

#: Lower-cases A-Z and makes every other ASCII byte that is no word byte a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WINDOW = 10
#: Words within which all terms of a window make a proximity match; exact occurrences are among them.
SPAN = 20
#: Characters of benchmark text that are sent to the executors at once; their windows take some 200 MB in a worker.
BLOCK_CHARS = 8_000_000
#: Bytes of text of a shard; a longer document is one shard.
SHARD_BYTES = 2 << 20
#: Places that are looked at together.
PLACES = 2_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Phrases:
    """The windows of benchmark items, deduplicated: by length (terms [w, length], owners of each: ranks[ends[w - 1] : ends[w]])."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.terms: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        rank = {name: k for k, name in enumerate(self.names)}
        flat: list[int] = []
        sizes = []
        for _, text in items:
            own = words_of(text)
            flat.extend([self.terms.setdefault(w, len(self.terms)) for w in own])
            sizes.append(len(own))
        tokens, n = np.array(flat, np.int32), np.array(sizes, np.int64)
        own, starts = np.array([rank[name] for name, _ in items], np.int64), np.cumsum(n) - n
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted({min(window, x) for x in sizes if x}):
            fits = n >= window if length == window else n == length
            places = n[fits] - length + 1
            at = np.repeat(starts[fits], places) + np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
            rows, which = np.unique(tokens[at[:, None] + np.arange(length)], axis=0, return_inverse=True)
            pairs = np.unique(which.ravel() * len(self.names) + np.repeat(own[fits], places))
            self.groups.append((rows, np.cumsum(np.bincount(pairs // len(self.names), minlength=len(rows))), pairs % len(self.names)))

    def owners(self, group: int, w: int) -> list[int]:
        _, ends, ranks = self.groups[group]
        return ranks[ends[w - 1] if w else 0 : ends[w]].tolist()


_built: dict[tuple, Phrases] = {}


def _phrases(name: str, items: list[tuple[str, bytes]], window: int) -> Phrases:
    """Built once a worker: workers are used again for later tasks. Only the last one is kept."""
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = Phrases(items, window)
    return _built[name, window]


class Index:
    """Positional postings of some documents: positions of all terms one after the other, and how many each term has."""

    def __init__(self, terms: list[bytes], n_words: np.ndarray, lists: np.ndarray, counts: np.ndarray):
        self.terms, self.n_words, self.lists, self.counts = terms, n_words, lists, counts

    @classmethod
    def of(cls, batch: list[bytes]) -> Index:
        known: dict[bytes, int] = {}
        words = [words_of(t) for t in batch]
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        tokens = np.fromiter((known.setdefault(x, len(known)) for w in words for x in w), np.int32, int(n_words.sum()))
        place = np.arange(tokens.size) + np.repeat(np.arange(n_words.size), n_words)  # a hole behind each document
        return cls(list(known), n_words, place[np.argsort(tokens, kind="stable")], np.bincount(tokens, minlength=len(known)))

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return b" ".join(self.terms), *(x.astype("<i4").tobytes() for x in (self.n_words, self.lists, self.counts))

    @classmethod
    def unpacked(cls, terms: bytes, *arrays: bytes) -> Index:
        return cls(terms.split(), *(np.frombuffer(x, "<i4").astype(np.int64) for x in arrays))


class Shard:
    """An index seen by the terms of the phrases: a term's number is the phrases' own; terms that the index lacks have no places."""

    def __init__(self, phrases: Phrases, batch: list[bytes] | Index):
        index = batch if isinstance(batch, Index) else Index.of(batch)
        self.phrases, self.n_words = phrases, index.n_words
        self.begin = np.append(0, np.cumsum(self.n_words + 1))
        self.size = int(self.begin[-1])
        at = np.cumsum(index.counts) - index.counts
        self.counts, self.first = np.zeros(len(phrases.terms), np.int64), np.zeros(len(phrases.terms), np.int64)
        shared = [(g, k) for k, t in enumerate(index.terms) if (g := phrases.terms.get(t)) is not None]
        if shared:
            g, k = np.array(shared).T
            self.counts[g], self.first[g] = index.counts[k], at[k]
        self.lists = index.lists
        own = np.repeat(np.arange(len(index.terms)), index.counts)
        self.keys = own * (self.size + 1) + self.lists  # ascending: by the index's term, then position
        self.key = np.zeros(len(phrases.terms), np.int64)
        if shared:
            self.key[g] = k * (self.size + 1)

    def _possible(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows all of whose terms are here, and the order of each one's terms, rarest first."""
        counts = self.counts[group]
        possible = np.flatnonzero(counts.min(1) > 0) if len(group) else np.zeros(0, np.int64)
        return possible, np.argsort(counts[possible], axis=1, kind="stable")

    def _places(self, group: np.ndarray, possible: np.ndarray, rarest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into possible, position) of all places of each window's rarest term, about PLACES at a time."""
        sizes = self.counts[group[possible, rarest]]
        for at in np.split(np.arange(possible.size), np.flatnonzero(np.diff(np.cumsum(sizes) // PLACES)) + 1):
            n = sizes[at]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(at, n), self.lists[np.repeat(self.first[group[possible[at], rarest[at]]], n) + step]

    def phrase_starts(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the window, start position) of every occurrence of the windows."""
        length = group.shape[1]
        possible, order = self._possible(group)
        if not possible.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out_w, out_p = [], []
        for index, place in self._places(group, possible, order[:, 0]):
            start = place - order[index, 0]
            ok = (start >= 0) & (start + length <= self.size)
            index, start = index[ok], start[ok]
            for k in range(1, length):  # intersect with the next rarest term's list, its offset taken off
                if not index.size:
                    break
                offset = order[index, k]
                wanted = self.key[group[possible[index], offset]] + start + offset
                at = np.searchsorted(self.keys, wanted)
                ok = self.keys[np.minimum(at, self.keys.size - 1)] == wanted
                index, start = index[ok], start[ok]
            out_w.append(possible[index])
            out_p.append(start)
        return np.concatenate(out_w), np.concatenate(out_p)

    def near(self, group: np.ndarray, span: int) -> list[tuple[int, int]]:
        """(document, window index) where every term of the window occurs within `span` words, in any order."""
        possible, order = self._possible(group)
        if not possible.size:
            return []
        hits: set[tuple[int, int]] = set()
        for index, anchor in self._places(group, possible, order[:, 0]):
            doc = np.searchsorted(self.begin, anchor, "right") - 1
            low, high = np.maximum(self.begin[doc], anchor - span + 1), np.minimum(self.begin[doc + 1] - 1, anchor + span)
            for k in range(1, group.shape[1]):  # keep the anchors that have the next rarest term on either side
                if not index.size:
                    break
                base = self.key[group[possible[index], order[index, k]]]
                place = np.searchsorted(self.keys, base + low)
                ok = (place < self.keys.size) & (self.keys[np.minimum(place, self.keys.size - 1)] < base + high)
                index, doc, low, high = index[ok], doc[ok], low[ok], high[ok]
            for d, w, a, b in zip(doc.tolist(), possible[index].tolist(), low.tolist(), high.tolist()):
                if (d, w) not in hits and self._within(set(group[w].tolist()), a, b, span):
                    hits.add((d, w))
        return sorted(hits, key=lambda x: (x[1], x[0]))

    def _within(self, need: set[int], low: int, high: int, span: int) -> bool:
        """Whether `span` consecutive words of [low, high) hold all terms of need."""
        found = []
        for t in need:
            a, b = np.searchsorted(self.keys, (self.key[t] + low, self.key[t] + high))
            found += [(p, t) for p in (self.keys[a:b] - self.key[t]).tolist()]
        last = dict.fromkeys(need, -1)
        for p, t in sorted(found):
            last[t] = p
            if (least := min(last.values())) >= 0 and p - least < span:
                return True
        return False

    def near_items(self, span: int) -> list[set[int]]:
        """Ranks of the items by document of which a window's terms occur within `span` words."""
        items: list[set[int]] = [set() for _ in range(self.n_words.size)]
        for k, (group, *_) in enumerate(self.phrases.groups):
            for d, w in self.near(group, span):
                items[d].update(self.phrases.owners(k, w))
        return items

    def matches(self) -> tuple[np.ndarray, list[set[int]]]:
        """Hit words by document and ranks of the items by document; self.covered marks the words."""
        docs = self.n_words.size
        cover = np.zeros(self.size + 1, np.int32)
        items: list[set[int]] = [set() for _ in range(docs)]
        for k, (group, *_) in enumerate(self.phrases.groups):
            w, p = self.phrase_starts(group)
            if not p.size:
                continue
            np.add.at(cover, p, 1)
            np.add.at(cover, p + group.shape[1], -1)
            doc = np.searchsorted(self.begin, p, "right") - 1
            for d, x in np.unique(np.column_stack([doc, w]), axis=0).tolist():
                items[d].update(self.phrases.owners(k, x))
        self.covered = np.cumsum(cover[:-1]) > 0
        n_hit = np.add.reduceat(np.append(self.covered, False).astype(np.int64), self.begin[:-1]) if docs else np.zeros(0, np.int64)
        return n_hit, items

    def spans(self) -> list[list[str]]:
        """After matches(): the covered stretches of each document, as begin:end in words."""
        out = []
        for a, b in zip(self.begin[:-1].tolist(), self.begin[1:].tolist()):
            inside = np.diff(self.covered[a:b].astype(np.int8), prepend=0, append=0)
            out.append([f"{x}:{y}" for x, y in zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist())])
        return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items with words, in blocks of about `limit` characters at most; each block is one small collect."""
    source = benchmark.select(F.col(id_col).cast("string").alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("name is not null")
    total = source.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    n = -(-total // limit)
    for k in range(n):
        own = source if n == 1 else source.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k)
        yield [(name, text.encode()) for name, text in own.collect()]


SHARDS = "shard bigint, ids array<{}>, terms binary, n_words binary, lists binary, counts binary"


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of docs, one row a shard: its number, the ids of its documents, its terms and their postings.

    Null texts have no words; rows of one id are documents of their own. An empty table has no shards. Written to a table it
    can be searched again with search().
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = source.schema["id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in steps(batch, "text", SHARD_BYTES):
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, *(pa.array([x], pa.binary()) for x in Index.of(raw(part, "text")).packed())], ["shard", "ids", "terms", "n_words", "lists", "counts"])
                number += 1

    return source.mapInArrow(run, SHARDS.format(kind.simpleString()))


def _one_block(benchmark: DataFrame, text_col: str, limit: int) -> bool:
    return (benchmark.agg(F.sum(F.length(text_col)).alias("n")).first().n or 0) <= limit


def _names(phrases: Phrases, items: list[set[int]]) -> list[list[str]]:
    return [[phrases.names[k] for k in sorted(x)] for x in items]


def _search_block(index: DataFrame, sent: Broadcast, window: int, span: int | None) -> DataFrame:
    """(shard, place, id, n_words, spans, items, near) of every document. sent: the block's items, broadcast."""
    name = uuid.uuid4().hex
    kind = index.schema["ids"].dataType.elementType.simpleString()
    strings = pa.list_(pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(name, sent.value, window)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                shard = Shard(phrases, Index.unpacked(*(row.column(c)[0].as_py() for c in range(2, 6))))
                _, found = shard.matches()
                near = shard.near_items(span) if span else [set()] * shard.n_words.size
                ids = row.column(1).flatten()
                yield pa.RecordBatch.from_arrays([pa.repeat(row.column(0)[0], len(ids)), pa.array(np.arange(len(ids)), pa.int32()), ids, pa.array(shard.n_words), *(pa.array(x, strings) for x in (shard.spans(), _names(phrases, found), _names(phrases, near)))], ["shard", "place", "id", "n_words", "spans", "items", "near"])

    return index.mapInArrow(run, f"shard bigint, place int, id {kind}, n_words bigint, spans array<string>, items array<string>, near array<string>")


def _kept(before: DataFrame | None, one: DataFrame, sent: Broadcast) -> DataFrame:
    """What a block hit, beside what those before it did, written; the block's items are given up by driver and executors. So neither
    memory nor the plan nor the number of tasks grows with the number of blocks."""
    tasks = one.rdd.getNumPartitions()
    out = durable(one if before is None else before.unionByName(one).coalesce(max(tasks, before.rdd.getNumPartitions())))
    sent.destroy()
    return out


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text", limit: int = BLOCK_CHARS, span: int | None = SPAN) -> DataFrame:
    """decontaminate()'s rows from a stored index, with the column `id`."""
    send = index.sparkSession.sparkContext.broadcast
    if _one_block(benchmark, item_text_col, limit):
        blocks = list(item_blocks(benchmark, item_col, item_text_col, limit))
        found = _search_block(index, send(blocks[0] if blocks else []), window, span)
    else:  # each block tells which documents it hits; a document's parts are united
        hits = None
        for items in item_blocks(benchmark, item_col, item_text_col, limit):
            one = _search_block(index, sent := send(items), window, span).where("size(items) > 0 OR size(near) > 0").drop("id", "n_words")
            hits = _kept(hits, one, sent)
        united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        hits = hits.groupBy("shard", "place").agg(F.flatten(F.collect_list("spans")).alias("spans"), united("items"), united("near"))
        every = _search_block(index, send([]), window, None).select("shard", "place", "id", "n_words")
        none = F.array().cast("array<string>")
        found = every.join(hits, ["shard", "place"], "left").withColumns({c: F.coalesce(c, none) for c in ("spans", "items", "near")})
    spans = F.array_sort(F.transform(F.array_distinct("spans"), lambda x: F.struct(F.split(x, ":")[0].cast("bigint").alias("a"), F.split(x, ":")[1].cast("bigint").alias("b"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    merged = F.aggregate(spans, zero, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("bigint"), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")))
    counted = found.withColumn("n_hit", merged["n"])
    near = [F.size("near").cast("bigint").alias("n_near"), "near"] if span else []
    return counted.select("id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", *near)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text", limit: int = BLOCK_CHARS, span: int | None = SPAN) -> DataFrame:
    """Per document row: id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated, items,
    n_near and near (the items of which a window's distinct terms all stand within `span` consecutive words, in any order and with
    any words between). The other columns tell of exact occurrences only. Without a span n_near and near are left out.

    Null or empty texts have no words and are clean. Items without words have no window; items of fewer words than a window
    are one window; repeated items count once by id. An empty benchmark leaves all documents clean. Null item ids are left out.
    """
    return search(durable(index_documents(docs, id_col, text_col)), benchmark, window, item_col, item_text_col, limit, span).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, limit: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, without those that hold a benchmark window. Null texts hold none; repeated rows stay or go
    together; an empty table or benchmark changes nothing. Each task indexes its own rows and needs the index no further.

    A benchmark beyond one block makes one pass a block, which writes the digests of the texts that it hits before the next begins; rows
    with such a text go. One block is in memory at a time.
    """
    if not _one_block(benchmark, "text", limit):
        return _clean_blocks(docs, item_blocks(benchmark, "item_id", "text", limit), text_col, window)
    blocks = list(item_blocks(benchmark, "item_id", "text", limit))
    sent, name = docs.sparkSession.sparkContext.broadcast(blocks[0] if blocks else []), uuid.uuid4().hex

    def make():
        phrases = _phrases(name, sent.value, window)

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            n_hit, _ = Shard(phrases, raw(part, text_col)).matches()
            return part.filter(pa.array(n_hit == 0))

        return run

    return map_steps(docs, text_col, make, docs.schema, SHARD_BYTES)


def _clean_blocks(docs: DataFrame, blocks: Iterable[list[tuple[str, bytes]]], text_col: str, window: int) -> DataFrame:
    hit, column = None, f"hit_{uuid.uuid4().hex}"
    for items in blocks:
        sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def make(sent=sent, name=name):
            phrases = _phrases(name, sent.value, window)

            def run(part: pa.RecordBatch) -> pa.RecordBatch:
                batch = raw(part, "text")
                n_hit, _ = Shard(phrases, batch).matches()
                return pa.RecordBatch.from_arrays([pa.array([sha(batch[k]) for k in np.flatnonzero(n_hit)], pa.string())], [column])

            return run

        one = map_steps(docs.select(docs[text_col].alias("text")), "text", make, f"{column} string", SHARD_BYTES)
        hit = _kept(hit, one.distinct(), sent)
    return docs.join(hit.distinct(), F.sha2(docs[text_col].cast("binary"), 256) == F.col(column), "left_anti")
