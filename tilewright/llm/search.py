"""Ranked lexical search over a tiered inverted index.

build() reads the documents once and writes two tables to the shared folder:

* forward: a row for each document with its terms and how often each occurs, to score single documents exactly;
* postings: (term, row, c), where c is what one mention of the term in a query adds to the document's score. They are
  partitioned by tier: tier 0 holds the largest c of the whole index, the last tier the smallest. The limits come from
  a histogram of c, so that the tiers hold about the SHARES of all postings. With each term goes its residual bound per
  tier: the largest c that it has in lower tiers.

search() reads the highest tier for all items. What it has seen of a document bounds its score from below, and the residual
bounds of the terms that it hasn't seen there bound it from above. The k documents of an item that look best are scored exactly,
which gives a score that k documents reach. An item is proved where all residual bounds together stay below that score: no
unseen document can enter, so the documents whose upper bound reaches it are scored exactly and ranked. Items without that
proof fall through to the next tier; in the last tier nothing is residual. The result is exact whatever the tiers.

Only the terms of the items are indexed where they are few enough to be sent to the tasks (TERMS), else all terms.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from .common import map_steps, raw, steps
from .leaks import words_of

#: Share of all postings that the tiers down to this one hold, about.
SHARES = (0.1, 0.5, 0.85, 1.0)
#: c is counted in steps of 2 ** STEP for the histogram; there are under a thousand.
STEP = 25
#: Distinct query terms up to which they are sent to the tasks that read the documents.
TERMS = 500_000
#: Rows of query terms that are joined at once; more items go in blocks.
QUERY_ROWS = 200_000
#: Tables of at most so many rows are broadcast.
SMALL = 200_000


class Index(NamedTuple):
    folder: str
    documents: int
    tiers: int
    spark: object

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small. df is a written table."""
    return F.broadcast(df) if df.count() <= SMALL else df


def impact(tf: Column, n: Column, documents: int, total: int) -> Column:
    """(1000000000 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L; all in 64-bit integers."""
    div = lambda a, b: F.call_function("div", a, b)
    m = F.lit(75) + div(F.lit(25).cast("bigint") * n * F.lit(documents).cast("bigint"), F.lit(max(1, total)).cast("bigint"))
    tf = tf.cast("bigint")
    return div(F.lit(1_000_000_000).cast("bigint") * tf, F.lit(1000) * tf + F.lit(12) * m)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, q): how often each term occurs in each item. Null ids and texts have none; of several texts of an id the
    smallest stands."""
    source = items.select(items[id_col].alias("item"), items[text_col].alias("text")).where("item is not null").groupBy("item").agg(F.min("text").alias("text"))
    kind = source.schema["item"].dataType.simpleString()

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [Counter(words_of(t)) for t in raw(part, "text")]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array([w.decode() for x in found for w in x], pa.string()), pa.array([q for x in found for q in x.values()], pa.int64())], ["item", "term", "q"])

        return run

    return map_steps(source, "text", make, f"item {kind}, term string, q bigint")


def _forward(docs: DataFrame, only: frozenset[bytes] | None, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, terms, tfs) of every row; n counts all terms, terms and tfs only those of `only`."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, number = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in steps(batch, "text"):
                words = [words_of(t) for t in raw(part, "text")]
                own = [Counter(w if wanted is None else filter(wanted.__contains__, w)) for w in words]
                ends = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
                terms = pa.ListArray.from_arrays(ends, pa.array([t.decode() for x in own for t in x], pa.string()))
                tfs = pa.ListArray.from_arrays(ends, pa.array([k for x in own for k in x.values()], pa.int32()))
                rows = pa.array(np.arange(number, number + part.num_rows))
                yield pa.RecordBatch.from_arrays([rows, part.column(0), pa.array([len(w) for w in words], pa.int64()), terms, tfs], ["row", "id", "n", "terms", "tfs"])
                number += part.num_rows

    return source.mapInArrow(run, f"row bigint, id {source.schema['id'].dataType.simpleString()}, n bigint, terms array<string>, tfs array<int>")


def build(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Writes the index of docs. terms: a written table whose column `term` holds what will be asked for; None: anything.

    Every row is a document of its own, whatever its id. Null and empty texts have no terms and don't count as documents.
    """
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/search-{uuid.uuid4().hex}"
    only = None
    if terms is not None:
        known = [r.term for r in terms.select("term").distinct().limit(TERMS + 1).collect()]
        only = frozenset(t.encode() for t in known) if len(known) <= TERMS else None
    _forward(docs, only, id_col, text_col).write.parquet(f"{folder}/forward")
    forward = spark.read.parquet(f"{folder}/forward")
    total = forward.where("n > 0").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counted = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total.documents + 2) / (2 * F.col("df") + 1)))
    counted.select("term", "df", weight.cast("bigint").alias("w")).write.parquet(f"{folder}/weights")
    weights = _small(spark.read.parquet(f"{folder}/weights").select("term", "w"))
    posted = forward.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", F.col("p.terms").alias("term"), impact(F.col("p.tfs"), F.col("n"), total.documents, total.terms).alias("i"))
    posted = posted.join(weights, "term").select("term", "row", (F.col("w") * F.col("i")).alias("c")).where("c > 0")
    level = F.shiftright("c", STEP)
    sizes = sorted(((r.level, r.k) for r in posted.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    tier, seen, want = F.lit(len(SHARES) - 1), 0, sum(k for _, k in sizes)
    lows: list[int] = []  # the lowest level of each tier but the last
    for at, k in sizes:
        seen += k
        if len(lows) < len(SHARES) - 1 and seen >= SHARES[len(lows)] * want:
            lows.append(at)
    for t in reversed(range(len(lows))):
        tier = F.when(level >= lows[t], F.lit(t)).otherwise(tier)
    posted.withColumn("tier", tier).write.partitionBy("tier").parquet(f"{folder}/postings")
    # a search over an empty index reads it like any other
    schema = "term string, row bigint, c bigint, tier int"
    tiers = spark.read.schema(schema).parquet(f"{folder}/postings")
    most = tiers.groupBy("term", "tier").agg(F.max("c").alias("most"))
    bound = lambda t: F.coalesce(F.max(F.when(F.col("tier") > t, F.col("most"))), F.lit(0)).cast("bigint").alias(f"r{t}")
    most.groupBy("term").agg(*map(bound, range(len(SHARES)))).write.parquet(f"{folder}/bounds")
    index = Index(folder, total.documents, len(SHARES), spark)
    spark.createDataFrame([(total.documents, total.terms)], "documents bigint, terms bigint").write.parquet(f"{folder}/totals")
    return index


def _exact(index: Index, pairs: DataFrame, query: DataFrame) -> DataFrame:
    """(item, row, id, score) of the pairs (item, row), from the forward table. pairs is a written table."""
    total = index.read("totals").first()
    own = index.read("forward").join(_small(pairs), "row").select("item", "row", "id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    terms = own.select("item", "row", "id", F.col("p.terms").alias("term"), impact(F.col("p.tfs"), F.col("n"), total.documents, total.terms).alias("i"))
    return terms.join(query.select("item", "term", "q", "w"), ["item", "term"]).groupBy("item", "row").agg(F.first("id").alias("id"), F.sum(F.col("q") * F.col("w") * F.col("i")).alias("score"))


def _best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each item, with their rank. Spark keeps k rows an item in each task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(index: Index, terms: DataFrame, k: int = 20) -> DataFrame:
    """(item, rank, id, score): the k highest-scoring documents of each item with a score above 0, equal scores by ascending id
    (null ids last). terms: item_terms() as a written table. Items that match nothing have no rows."""
    spark, folder = index.spark, f"{index.folder}/result-{uuid.uuid4().hex}"
    rows = terms.count()
    blocks = max(1, -(-rows // QUERY_ROWS))
    for b in range(blocks):
        own = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        _search_block(index, own, k, folder, f"{folder}-work-{b}")
    schema = f"item {terms.schema['item'].dataType.simpleString()}, rank int, id {index.read('forward').schema['id'].dataType.simpleString()}, score bigint"
    return spark.read.schema(schema).parquet(folder)


def _search_block(index: Index, terms: DataFrame, k: int, folder: str, work: str) -> None:
    spark = index.spark
    terms.join(index.read("weights"), "term").join(index.read("bounds"), "term").write.parquet(f"{work}/query")
    query = spark.read.parquet(f"{work}/query")  # QUERY_ROWS rows at most, but for a single item with more
    query.select("item").distinct().withColumn("least", F.lit(0).cast("bigint")).write.parquet(f"{work}/open-0")
    for t in range(index.tiers):
        last = t == index.tiers - 1
        items = F.broadcast(spark.read.parquet(f"{work}/open-{t}"))  # (item, least): without proof yet; k documents score `least` or more
        asked = F.broadcast(query.select("item", "term", "q", F.col(f"r{t}").alias("r")).join(items, "item"))
        rest = asked.groupBy("item", "least").agg(F.sum(F.col("q") * F.col("r")).alias("rest"))
        posted = spark.read.schema("term string, row bigint, c bigint, tier int").parquet(f"{index.folder}/postings").where(F.col("tier") <= t)
        seen = posted.join(asked, "term").groupBy("item", "row").agg(F.sum(F.col("q") * F.col("c")).alias("low"), F.sum(F.col("q") * F.col("r")).alias("known"))
        seen = seen.join(F.broadcast(rest), "item").withColumn("high", F.col("low") + F.col("rest") - F.col("known")).where("high >= least")
        seen.select("item", "row", "low", "high", "rest").write.parquet(f"{work}/seen-{t}")
        seen = spark.read.parquet(f"{work}/seen-{t}")
        best = _best(seen, k, F.desc("low"), F.asc("row")).select("item", "row")
        best.write.parquet(f"{work}/best-{t}")
        scored = _exact(index, spark.read.parquet(f"{work}/best-{t}"), F.broadcast(query))
        reached = scored.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("now"))
        state = rest.join(reached, "item", "left").select("item", "rest", F.greatest("least", F.coalesce("now", F.lit(0))).alias("least"))
        state.write.parquet(f"{work}/state-{t}")
        state = F.broadcast(spark.read.parquet(f"{work}/state-{t}"))
        proved = (F.col("rest") == 0) | (F.col("rest") < F.col("least"))
        state.where(~proved).select("item", "least").write.parquet(f"{work}/open-{t + 1}")
        seen.drop("rest").join(state.where(proved), "item").where("high >= least").select("item", "row").write.parquet(f"{work}/pairs-{t}")
        found = _exact(index, spark.read.parquet(f"{work}/pairs-{t}"), F.broadcast(query))
        _best(found, k, F.desc("score"), F.asc_nulls_last("id"), F.asc("row")).select("item", "rank", "id", "score").write.mode("append").parquet(folder)
        if last or spark.read.parquet(f"{work}/open-{t + 1}").isEmpty():
            return


def rank(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k highest-scoring documents with a score above 0.

    Null item ids are left out; of several texts of one item the smallest stands. Every row of docs is a document of its own: repeated
    rows are ranked each. Null and empty texts, of either side, match nothing; empty tables give an empty result.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/items-{uuid.uuid4().hex}"
    item_terms(items, item_col, item_text_col).write.parquet(path)
    terms = spark.read.parquet(path)
    found = search(build(docs, terms, id_col, text_col), terms, k)
    return found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
