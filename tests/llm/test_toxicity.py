import random

from tilewright.llm import toxicity
from tilewright.llm.common import py_fold

from .rows import documents, empty

BAD = "nastyword vilething hatefulone".split()


def tables(spark, n=500):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "st"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randrange(10, 80))]
        if k % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((1000 + k, " ".join(words)))
        labels.append((1000 + k, int(k % 4 == 0)))
    labels += [(5, None), (None, 1), (77777, 1)]
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out(spark):
    docs, labels = tables(spark)
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.doc_id and r.doc_id >= 1000 and py_fold(r.doc_id, 5) == 0]
    assert len(held) > 60
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[3] == by[4] and len(rows) == 512 and by[3] < 0.5


def test_without_labels(spark):
    docs, labels = tables(spark, 8)
    model = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(empty(spark), model).count() == 0


def test_all_windows_of_the_sample_take_part(monkeypatch):
    seen, own = set(), toxicity.lengths
    monkeypatch.setattr(toxicity, "lengths", lambda content, batch, threads=1: seen.update(batch) or own(content, batch, threads))
    rng = random.Random(3)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n)).encode()
    late = [text("tuvwxyz", 400) for _ in range(40)]
    ordinary = [text("abcdefg", 60_000), *late]
    toxic = [text("klmnop", 50) + b" nastyword and more" for _ in range(12)]
    model = toxicity.Model(toxic, ordinary)
    rest = [t for k, t in enumerate(ordinary) if k % 3]  # every third one is the base's
    assert model.weights is not None and {w for t in toxic + rest for w in toxicity.windows(t)} <= seen
    assert b"nastyword" in model.toxic and b"nastyword" not in model.ordinary


def test_windows_cover_a_text():
    text = b"One two  three\nfour five"
    assert b"".join(toxicity.windows(text)).split() == text.lower().split()


def test_few_documents_and_repeated_ids(spark):
    docs, labels = tables(spark, 12)
    assert toxicity.fit(docs, labels).weights is None
    docs, labels = tables(spark, 200)
    extra = labels.selectExpr("doc_id", "toxic", "'x' AS text", "1 AS n", "2 AS h", "3 AS g")
    assert toxicity.fit(docs.unionByName(docs), extra).weights.tolist() == toxicity.fit(docs, labels).weights.tolist()


def test_long_texts_ties_and_what_a_worker_remembers(monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice(["an", "er", "th", "on"]) for _ in range(3)) for _ in range(n))
    toxic, ordinary = [f"{text(40)} {rng.choice(BAD)} {text(9)}".encode() for _ in range(60)], [text(50).encode() for _ in range(150)]
    model = toxicity.Model(toxic, ordinary)
    long = (text(200_000) + " " + " ".join(BAD * 50)).encode()
    batch = [long, toxic[0], toxic[0], b"", b" \n", b"...", ordinary[0], b"\xff\xfe odd bytes"]
    whole, known = model.scores(batch), {}
    assert whole[1] == whole[2] > 0.5 and len({whole[k] for k in (3, 4, 5)}) == 1 and whole[6] < 0.5 and whole[0] > model.scores([long[:1000]])[0]
    assert [model.scores([t], known)[0] for t in batch] == whole.tolist() == model.scores(batch, known).tolist()
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    assert [model.scores([t], known)[0] for t in batch] == whole.tolist()


def test_better_than_half_of_the_words_unseen():
    """Words that only the other folds' documents hold are found by their dictionaries."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "st"]) for _ in range(rng.randrange(1, 5)))
    bad = [f"{a}{b}" for a in ("grob", "fluk", "zwip") for b in ("an", "er", "ish", "ing")]
    make = lambda n, k: [" ".join([word() for _ in range(60)] + [rng.choice(bad) for _ in range(k)]).encode() for _ in range(n)]
    model = toxicity.Model(make(150, 2), make(500, 0))
    assert (model.scores(make(200, 2)) >= 0.5).mean() > 0.9 and (model.scores(make(200, 0)) >= 0.5).mean() < 0.03
