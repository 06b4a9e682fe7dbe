"""Near-duplicate detection by bottom-k sketches of one hash function.

Every shingle has one hash. A document retains the values that come first in one order of all hashes, and the inverted lists
of retained values give the candidates; the bottom-k sketch of the union, made of the two documents' own, estimates their similarity and
filters them; exact Jaccard on the full sets decides. A packed sketch of 16 bytes, which the lists carry, filters before that.

Two changes make the plain method lossless and safe against skew:

* A fixed k of the smallest hashes can miss pairs and makes lists as long as the corpus for frequent shingles. So the order is
  (frequent or not, hash): values whose bucket in a fixed-size table of corpus frequencies is overfull come last. Two sets with
  Jaccard similarity t or more share one of their first floor((1 - t) n) + 1 values in any order (the prefix argument), so no
  document needs to retain more. Of n values with a share f of frequent ones, k of the others do: two such sets have
  similarity (t - f) / (1 - f) or more on the values that aren't frequent, so none of the k is shared with a chance below
  ((1 - t) / (1 - f)) ** k; k is taken so that this is below MISS.
* Identical sets are one class before anything is paired. A list never makes all its pairs: each of its members meets the
  list's leader first; what is linked needs no further comparison, and only members of different components meet later. Where
  many documents stand just below the threshold of a large family, or a list is long, they are compared in blocks of a bounded
  size, which give back a spanning forest of the links and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_steps, raw, steps
from .components import components, tidy
from .shingles import Shingler, finish

#: The table of corpus frequencies: 2 ** BUCKET_BITS counters in CHUNKS pieces, whatever the size of the corpus.
BUCKET_BITS, CHUNKS = 21, 256
#: Chance that a pair at the least similarity shares no retained value.
MISS = 1e-12
#: Bits of the packed sketch, in 64-bit words; pairs that differ in more than FAR bits are dropped. At similarity 0.8 a
#: tenth of the bits differ (12.8, deviation 3.4), so FAR is eight deviations away. Every shingle that one set alone has changes
#: one bit at most, so pairs that differ in more bits than the similarity allows shingles are dropped as well.
SKETCH_WORDS, FAR = 2, 40
#: Values of a bottom-k sketch. Of the union's first UNION_K values a share as large as the similarity is in both sets; of a pair at
#: 0.8 fewer than UNION_LEAST are with a chance below MISS.
UNION_K, UNION_LEAST = 48, 16
#: A list whose largest component has this many members is compared in blocks: at most BLOCK documents and BLOCK_VALUES
#: values a side, so a task's memory is bounded whatever the size of the list.
FAMILY, BLOCK, BLOCK_VALUES, COLUMNS = 16, 1000, 1_500_000, 4096
#: Other lists are compared in blocks as well, where they would make more pairs than this; up to it the packed sketches are compared
#: inside the join, which costs far less than moving whole sets.
LIST_PAIRS = 1_000_000
#: Pairs that one leader's set is sent to together; a leader of more is dealt to several tasks.
LEADER_PAIRS = 256
#: Ids are broadcast up to this number of rows, else joined.
BROADCAST_ROWS = 2_000_000
STEP = 1 << 20


def _counts(docs: DataFrame, size: int) -> np.ndarray:
    """Occurrences of all shingles of all documents, by the first BUCKET_BITS bits of their hash."""
    width = (1 << BUCKET_BITS) // CHUNKS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(size), np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in batches:
            for part in steps(batch, "text", STEP):
                h, _ = shingler.shingles(raw(part, "text"))
                total += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=total.size).astype(np.uint32)
        for c in range(CHUNKS):
            own = total[c * width : (c + 1) * width]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([own.astype(np.min_scalar_type(own.max())).tobytes()], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(data, f"u{len(data) // width}")
                total[c] = total.get(c, 0) + own.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    parts = docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in parts.toLocalIterator():  # CHUNKS rows at most
        out[row.chunk * width : (row.chunk + 1) * width] += np.frombuffer(row.counts, "<i8")
    return out


def frequent(docs: DataFrame, size: int) -> np.ndarray:
    """One bit for each bucket: whether it holds far more than chance would put there."""
    counts = _counts(docs, size)
    mean = counts.mean()
    return np.packbits(counts > mean + 6 * np.sqrt(mean) + 16)


def retained(s: np.ndarray, mask: np.ndarray, percent: int) -> np.ndarray:
    """The values of an ascending set that its document is listed under."""
    n = s.size
    full = n - -(-percent * n // 100) + 1
    bucket = (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    hot = (mask[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1
    miss = (1 - percent / 100) / max(1 - hot.sum() / n, 1e-9)
    k = min(full, int(np.ceil(np.log(MISS) / np.log(miss)))) if miss < 0.9 else full
    return s[np.lexsort((finish(s), hot))[:k]]


def packed(s: np.ndarray) -> np.ndarray:
    """One bit of the smallest hash in each of 64 * SKETCH_WORDS equal ranges of hashes; 0 where there is none."""
    bins = 64 * SKETCH_WORDS
    edges = (np.arange(bins, dtype=np.uint64) << np.uint64(64 - bins.bit_length() + 1)).astype(np.uint64)
    at = np.searchsorted(s, edges)
    inside = at < np.append(at[1:], s.size)
    bits = np.zeros(bins, np.uint64)
    bits[inside] = finish(s[at[inside]] + np.uint64(1)) & np.uint64(1)
    return (bits.reshape(SKETCH_WORDS, 64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def bottom(s: np.ndarray) -> np.ndarray:
    """The UNION_K smallest values of an ascending set in the order of signed numbers, which is the order of the SQL below."""
    s = s.view(np.int64)
    at = int(np.searchsorted(s.view(np.uint64), np.uint64(1 << 63)))  # negative ones stand behind
    return np.concatenate([s[at:], s[:at]])[:UNION_K]


def sketches(docs: DataFrame, mask: np.ndarray, size: int, percent: int) -> DataFrame:
    """(id, n, key, s0, s1, retained, bottom) of every row; key: digest of the full set, null for empty sets; bottom: the sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(mask)

    def make():
        shingler, own = Shingler(size), sent.value

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingler.sets(raw(part, "text"))
            bits = np.array([packed(s) for s in sets], np.int64).reshape(-1, SKETCH_WORDS)
            keep = [retained(s, own, percent).view(np.int64) if s.size else s.view(np.int64) for s in sets]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if s.size else None for s in sets]
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [k.size for k in own]), pa.int32()), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))) for own in (keep, [bottom(s) for s in sets])]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([s.size for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1]), *lists], ["id", "n", "key", "s0", "s1", "retained", "bottom"])

        return run

    return map_steps(docs, "text", make, "id bigint, n bigint, key binary, s0 bigint, s1 bigint, retained array<bigint>, bottom array<bigint>", STEP)


def _full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, s): the whole set of each of these documents, made again from its text; of several texts of one id, that of its class."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    def make():
        shingler = Shingler(size)

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s.tobytes() for s in shingler.sets(raw(part, "text"))]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(s) if s else None for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["id", "key", "s"])

        return run

    return map_steps(docs.join(ids, "id", "left_semi"), "text", make, "id bigint, key binary, s binary", STEP).groupBy("id").agg(F.min_by("s", "key").alias("s"))


def union_likely(x: str, y: str) -> F.Column:
    """The bottom-k sketch of the union, made of two sketches, allows the similarity."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, UNION_K)
    return F.size(F.array_intersect(F.array_intersect(x, y), union)) * F.lit(UNION_K) >= F.lit(UNION_LEAST) * F.size(union)


def _linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    A leader has many pairs: they are dealt to one more key for every LEADER_PAIRS of them, and its set goes to each.
    """
    bottoms = classes.select("id", "bottom")
    likely = pairs.join(bottoms.select(F.col("id").alias("a"), F.col("bottom").alias("x")), "a").join(bottoms.select(F.col("id").alias("b"), F.col("bottom").alias("y")), "b")
    pairs = durable(likely.where(union_likely("x", "y")).select("a", "b"))
    sets = _full_sets(docs, durable(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()), size)
    keys = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_PAIRS).cast("int").alias("keys"))
    dealt = pairs.join(keys, "a").select("a", "b", F.pmod(F.xxhash64("b"), "keys").cast("int").alias("k"))
    leaders = sets.withColumnsRenamed({"id": "a", "s": "x"}).join(keys, "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("k"))

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                inter = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * inter >= percent * (x.size + y.size - inter))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = dealt.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b").join(leaders, ["a", "k"])
    return durable(both.select("a", "b", "x", "y").mapInArrow(decide, "a bigint, b bigint"))


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices over COLUMNS values at a time."""
    out = np.zeros((len(x), len(y)), np.float32)
    a, b = np.concatenate(x), np.concatenate(y)
    own_a, own_b = np.repeat(np.arange(len(x)), [s.size for s in x]), np.repeat(np.arange(len(y)), [s.size for s in y])
    values = np.intersect1d(a, b)
    place_a, place_b = np.searchsorted(values, a), np.searchsorted(values, b)
    keep_a = values[np.minimum(place_a, values.size - 1)] == a if values.size else np.zeros(a.size, bool)
    keep_b = values[np.minimum(place_b, values.size - 1)] == b if values.size else np.zeros(b.size, bool)
    sides = []
    for place, own, keep in ((place_a, own_a, keep_a), (place_b, own_b, keep_b)):
        place, own = place[keep], own[keep]
        order = np.argsort(place, kind="stable")
        sides.append((place[order], own[order]))
    for low in range(0, values.size, COLUMNS):
        width = min(COLUMNS, values.size - low)
        m = []
        for (place, own), n in zip(sides, (len(x), len(y))):
            i, j = np.searchsorted(place, (low, low + width))
            one = np.zeros((n, width), np.float32)
            one[own[i:j], place[i:j] - low] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _forest(ids: np.ndarray, others: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between ids (rows) and others (columns)."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = int(ids[i]), int(others[j])
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _linked_blocks(docs: DataFrame, family: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of each family's documents outside its main component with all of its documents. family: main, whole, id, outside, n.

    The outsiders are dealt to nx blocks, the others and the outsiders to ny; every pair of blocks is one small group.
    """
    blocks = lambda c: F.greatest(F.ceil(F.count_if(c) / BLOCK), F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / BLOCK_VALUES), F.lit(1)).cast("int")
    sizes = family.groupBy("main", "whole").agg(blocks(F.col("outside")).alias("nx"), blocks(F.lit(True)).alias("ny"))
    own = family.join(sizes, ["main", "whole"]).withColumn("h", F.xxhash64("id"))
    i, j = F.pmod("h", "nx").cast("int"), F.pmod("h", "ny").cast("int")
    left = own.where("outside").select("main", "whole", "id", F.lit(True).alias("x"), i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j"))
    right = own.select("main", "whole", "id", F.lit(False).alias("x"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("i"), j.alias("j"))
    ids = durable(family.select("id").distinct())
    sets = _full_sets(docs, ids, size)
    dealt = left.unionByName(right).join(sets, "id")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        x = group.column("x").to_numpy(zero_copy_only=False).astype(bool)
        ident, data = group.column("id").to_numpy(), [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("s")]
        a, b = np.flatnonzero(x), np.flatnonzero(~x)
        edges: list[tuple[int, int]] = []
        if a.size and b.size:
            sa, sb = [data[k] for k in a], [data[k] for k in b]
            inter = _intersections(sa, sb)
            n, m = np.array([s.size for s in sa]), np.array([s.size for s in sb])
            linked = 100 * inter >= percent * (n[:, None] + m[None] - inter)
            linked &= ident[a][:, None] != ident[b][None]
            edges = _forest(ident[a], ident[b], linked)
        return pa.table({"a": pa.array([min(e) for e in edges], pa.int64()), "b": pa.array([max(e) for e in edges], pa.int64())})

    return durable(dealt.groupBy("main", "whole", "i", "j").applyInArrow(compare, "a bigint, b bigint"))


def _likely(a: str, b: str, percent: int):
    """Sizes and packed sketches allow the similarity."""
    far = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (n * percent <= m * 100) & (m * percent <= n * 100) & (far <= FAR) & (far * (100 + percent) <= (n + m) * (100 - percent))


def _pairs(joined: DataFrame) -> DataFrame:
    return durable(joined.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct())


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable over links, itself included), kept (id = component_id).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of `size`-word shingles. Empty and null
    texts have empty sets, which link with nothing. Rows with one id are one document: they get one component, and where
    their texts differ, the set of the smallest digest stands for it. A row with a null id is linked with nothing, has a null component and is kept. An empty table
    gives an empty table. Ids are integers.
    """
    docs = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    rows = durable(sketches(docs, frequent(docs, size), size, percent))
    known = rows.where("id is not null and key is not null")
    # ids with several texts: the class of the smallest digest is theirs
    several = durable(known.groupBy("id").agg(F.min("key").alias("own"), F.max("key").alias("last")).where("own <> last").select("id", "own"))
    many = several.count() if not several.isEmpty() else 0
    if many:
        rows = rows.join(F.broadcast(several) if many <= BROADCAST_ROWS else several, "id", "left").withColumn("own", F.coalesce("own", "key"))
        known = rows.where("id is not null and key is not null and key = own")
    else:
        rows = rows.withColumn("own", F.col("key"))
    first = lambda c: F.first(c).alias(c)
    classes = durable(known.groupBy("key").agg(F.min("id").alias("id"), *map(first, ("n", "s0", "s1", "retained", "bottom"))))
    listed = classes.select("id", "n", "s0", "s1", F.explode("retained").alias("v"))
    # values that one class alone retains make no pair
    shared = durable(listed.groupBy("v").agg(F.count("*").alias("members")).where("members > 1"))
    posted = durable(listed.join(shared, "v"))
    common = posted.groupBy("v").agg(F.min(F.struct("id", "n", "s0", "s1")).alias("r"))
    led = posted.alias("l").join(common.select("v", "r.*").alias("r"), F.col("l.v") == F.col("r.v"))
    pairs = _pairs(led.where((F.col("l.id") != F.col("r.id")) & _likely("l", "r", percent)))
    edges = _linked(docs, pairs, classes, size, percent)
    found = durable(components(edges))
    tidy(docs)
    # what is left to compare: members of a list outside its largest component with all members of other components
    now = posted.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = now.groupBy("v", "component").agg(F.count("*").alias("k")).groupBy("v").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("size"), F.count("*").alias("parts"))
    parts = parts.where("parts > 1").select("v", F.col("m.component").alias("main"), F.col("m.k").alias("k"), "size")
    now = durable(now.join(parts.withColumn("whole", F.col("k") < FAMILY).withColumn("blocks", ~F.col("whole") | ((F.col("size") - F.col("k")) * F.col("size") > LIST_PAIRS)), "v"))
    short = now.where("not blocks")
    rest = short.where("component <> main").alias("l").join(short.alias("r"), (F.col("l.v") == F.col("r.v")) & (F.col("l.component") != F.col("r.component")) & ((F.col("l.id") < F.col("r.id")) | (F.col("r.component") == F.col("r.main"))) & _likely("l", "r", percent))
    pairs = _pairs(rest)
    if not pairs.isEmpty():
        edges = edges.unionByName(_linked(docs, pairs, classes, size, percent))
    # a family goes by its main component, whichever lists it is in; a long list without one by its own value
    family = now.where("blocks").select(F.when(F.col("whole"), F.col("v")).otherwise(F.col("main")).alias("main"), "whole", "id", "n", (F.col("component") != F.col("main")).alias("outside"))
    family = durable(family.groupBy("main", "whole", "id").agg(F.bool_or("outside").alias("outside"), F.first("n").alias("n")))
    if not family.isEmpty():
        edges = edges.unionByName(_linked_blocks(docs, family, size, percent))
    tidy(docs)
    found = durable(components(edges))
    labelled = classes.select(F.col("key").alias("own"), "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("own", F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "n", "own").join(labelled, "own", "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, with one document of each group.

    Rows with one id count as one document, as in groups(): one of them stays. Rows with a null id all stay.
    """
    found = groups(docs, id_col, text_col, size, percent)
    name = next(x for k in range(len(docs.columns) + 1) if (x := f"_gone{k}") not in docs.columns)
    gone = durable(found.where("not kept").select(F.col(id_col).alias(name)).distinct())
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, docs[id_col].cast("bigint") == F.col(name), "left_anti")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if repeated.isEmpty():
        return left
    return left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(left.where(F.col(id_col).isNull()))
