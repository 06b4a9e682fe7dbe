import math
import random
import re
from collections import Counter

import pytest

from tilewright.llm import search

from .rows import documents, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """The contract, word by word. docs: (id, text), items: (id, text)."""
    own = [(i, Counter(terms_of(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            m, s = 75 + 25 * sum(c.values()) * n // total, 0
            for t in terms_of(text):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return out


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 3000}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(1, 120)))) for k in range(n)]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 30)))) for k in range(30)] + [(30 + k, docs[k][1][:150]) for k in range(10)]
    return docs + [(1000 + k, docs[3][1]) for k in range(30)], items


@pytest.mark.parametrize("shares, terms", [((0.1, 0.5, 0.85, 1.0), 500_000), ((0.01, 1.0), 500_000), ((1.0,), 3)])
def test_against_brute_force(spark, monkeypatch, shares, terms):
    monkeypatch.setattr(search, "SHARES", shares)
    monkeypatch.setattr(search, "TERMS", terms)
    docs, items = corpus()
    items += [(90, "nothing matches zzz"), (91, ""), (92, None), (93, "W1 w1 W1"), (None, "w1 w2")]
    got = search.rank(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == brute(docs, sorted((i for i in items if i[0] is not None)))


def test_items_fall_through_tiers(spark):
    """An item whose 20 best documents stand out is proved early, one of frequent words alone isn't."""
    rng = random.Random(4)
    docs = [(k, " ".join(f"c{rng.randrange(30)}" for _ in range(12)) + (" rareone raretwo rarethree" if k < 25 else "")) for k in range(600)]
    items = [(0, "rareone raretwo rarethree"), (1, "c0 c1 c2 c3 c4 c5 c6 c7 c8 c9")]
    frame, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    path = f"{search.shared_folder(spark)}/test-items"
    search.item_terms(asked).write.mode("overwrite").parquet(path)
    terms = spark.read.parquet(path)
    index = search.build(frame, terms)
    found = search.search(index, terms)
    assert sorted((r.item, r.rank, r.id, r.score) for r in found.collect()) == brute(docs, items)
    hadoop = spark._jvm.org.apache.hadoop.fs
    names = [f.getPath() for f in hadoop.Path(index.folder).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop.Path(index.folder))]
    work = next(p.toString() for p in names if "-work-" in p.getName())
    assert [r.item for r in spark.read.parquet(f"{work}/open-1").collect()] == [1]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROWS", 60)
    monkeypatch.setattr(search, "SMALL", 10)
    docs, items = corpus(120)
    got = search.rank(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), k=5)
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 5)


def test_odd_rows(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "The MIT License brown fox", 1), (2, "漢字 ünïcode alpha", 1), (2, "漢字 ünïcode alpha", 1), (3, "one id here", 1)], "item_id bigint, text string, term int")
    got = [tuple(r) for r in search.rank(docs, items).collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(1, "The MIT License brown fox"), (2, "漢字 ünïcode alpha"), (3, "one id here")])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[2] is None for r in got)  # a row without an id is ranked like any other


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "the fox")], "item_id bigint, text string")
    assert search.rank(empty(spark), items).collect() == []
    assert search.rank(documents(spark), items.limit(0)).collect() == []
