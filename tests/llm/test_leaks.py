import hashlib
import random

import numpy as np

from tilewright.llm import leaks

from .rows import collected, documents, empty


def brute(text, items, window=10):
    words = leaks.words_of((text or "").encode())
    hit, found = set(), set()
    for name, own in items:
        terms = leaks.words_of((own or "").encode())
        size = min(window, len(terms))
        if not size:
            continue
        wanted = {tuple(terms[k : k + size]) for k in range(len(terms) - size + 1)}
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in wanted:
                hit |= set(range(k, k + size))
                found.add(name)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def tables(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "Ünï", "a1", *[f"w{k}" for k in range(30)]]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([0, 3, 9, 10, 11, 40]))) for k in range(25)] + [(25, None), (26, "the"), (3, "of of of of of of of of of of of"), (None, "the of")]
    docs = []
    for k in range(100, 160):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(own) - 12))
            parts += [" ".join(own[a : a + rng.choice([9, 10, 14])]).upper() if k % 2 else ", ".join(own[a : a + 12]), text(4)]
        docs.append((k, " ".join(parts)))
    return documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), [(str(i), t) for i, t in items if i is not None]


def test_equals_brute_force(spark):
    docs, bench, items = tables(spark)
    for limit in (leaks.BLOCK_CHARS, 900):  # one block, and several
        got = leaks.decontaminate(docs, bench, limit=limit).collect()
        want = sorted((r.doc_id, *brute(r.text, items)) for r in docs.where("doc_id is not null").collect())
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got if r.doc_id is not None) == want
        assert sum(r[5] for r in want) > 20
    kept = leaks.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if not w[5]} | {None}


def test_empty(spark):
    docs, bench, _ = tables(spark)
    assert leaks.decontaminate(empty(spark), bench).count() == 0
    assert leaks.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_near_finds_terms_in_any_order():
    phrases = leaks.Phrases([("x", b"red green blue")], 10)
    shard = leaks.Shard(phrases, [b"blue and red or green", b"red " + b"x " * 20 + b"green blue", b""])
    assert shard.near(phrases.groups[0][0], 6) == [(0, 0)]


def near_brute(text, items, span, window=10):
    words = leaks.words_of((text or "").encode())
    found = set()
    for name, own in items:
        terms = leaks.words_of((own or "").encode())
        size = min(window, len(terms))
        wanted = [set(terms[k : k + size]) for k in range(len(terms) - size + 1)] if size else []
        if any(w <= set(words[k : k + span]) for w in wanted for k in range(len(words))):
            found.add(name)
    return sorted(found)


def test_proximity_equals_brute_force(spark):
    docs, bench, items = tables(spark)
    for span in (10, leaks.SPAN):
        want = sorted((r.doc_id, near_brute(r.text, items, span)) for r in docs.where("doc_id is not null").collect())
        for limit in (leaks.BLOCK_CHARS, 900):
            got = leaks.decontaminate(docs, bench, limit=limit, span=span).collect()
            assert sorted((r.doc_id, r.near) for r in got if r.doc_id is not None) == want
            assert all(r.n_near == len(r.near) and set(r.items) <= set(r.near) for r in got)
            assert any(set(r.near) - set(r.items) for r in got)
    assert leaks.decontaminate(docs, bench, span=None).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]


def test_clean_takes_a_benchmark_of_many_blocks(spark):
    docs, bench, items = tables(spark)
    assert sum(1 for _ in leaks.item_blocks(bench, "item_id", "text", 300)) > 2
    kept = leaks.clean(docs, bench, limit=300)
    want = [r for r in docs.collect() if not brute(r.text, items)[4]]
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, want)) and len(want) < docs.count()


def test_a_stored_index_serves_several_benchmarks(spark, tmp_path):
    docs, bench, items = tables(spark)
    path = str(tmp_path / "index")
    leaks.index_documents(docs.repartition(3)).write.parquet(path)
    index = spark.read.parquet(path)
    for k in (0, 1):
        own = bench.where(f"item_id % 2 = {k}")
        listed = [(i, t) for i, t in items if int(i) % 2 == k]
        got = sorted((r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in leaks.search(index, own).collect() if r.id is not None)
        assert got == sorted((r.doc_id, *brute(r.text, listed)) for r in docs.where("doc_id is not null").collect())


def test_clashing_columns(spark):
    docs, bench, _ = tables(spark)
    more = bench.selectExpr("*", "1 AS name", "2 AS id", "3 AS shard", "4 AS items")
    names = docs.selectExpr("*", "1 AS shard", "2 AS place", "3 AS spans", "4 AS n_hit", "5 AS _hit")
    for limit in (leaks.BLOCK_CHARS, 900):
        got = leaks.decontaminate(names, more, limit=limit)
        assert got.columns[:6] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] and got.count() == docs.count()
        assert leaks.clean(names, more, limit=limit).columns == names.columns


def test_index_round_trip():
    texts = [b"", b"a b a", "É é c".encode(), b"x" * 9]
    index = leaks.Index.of(texts)
    again = leaks.Index.unpacked(*index.packed())
    words = {}
    for term, at in zip(again.terms, np.split(again.lists, np.cumsum(again.counts)[:-1])):
        words |= {int(p): term for p in at}
    place = 0
    for text in texts:
        for w in leaks.words_of(text):
            assert words.pop(place) == w
            place += 1
        place += 1
    assert not words


def test_fifty_blocks_one_at_a_time(spark, monkeypatch):
    """As by one block; each block is given up before the next is sent, and the plan is no longer for it."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 3 + j) % 97}" for j in range(30))) for k in range(60)] + [(99, None), (None, "w1 w2 w3")], "doc_id bigint, text string")
    items = spark.createDataFrame([(f"i{k}", " ".join(f"w{(k + j) % 97}" for j in range(12 if k % 5 else 4))) for k in range(70)], "item_id string, text string")
    alive, most, plain = [], [], type(spark.sparkContext).broadcast

    def counted(self, value):
        sent = plain(self, value)
        if isinstance(value, list) and value and isinstance(value[0], tuple):
            alive.append(sent)
            most.append(len(alive))
            gone = sent.destroy
            sent.destroy = lambda *a, **b: (alive.remove(sent), gone(*a, **b))
        return sent

    with monkeypatch.context() as m:
        m.setattr(type(spark.sparkContext), "broadcast", counted)
        many = leaks.decontaminate(docs, items, limit=80)
        kept = leaks.clean(docs, items, limit=80)
    assert len(most) >= 50 and max(most) == 1 and not alive
    one = leaks.decontaminate(docs, items)
    assert collected(many, *one.columns) == collected(one, *one.columns)
    assert collected(kept, "doc_id") == collected(leaks.clean(docs, items), "doc_id")
    assert many._jdf.queryExecution().optimizedPlan().toString().count("Scan") + many._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4
