import random

from pyspark.sql import functions as F

from tilewright.llm import langid
from tilewright.llm.common import py_fold

from .rows import documents, empty

WORDS = {"en": "the of and house tree walks with which there".split(), "de": "der und haus baum läuft mit welche straße".split(), "fr": "le et maison arbre marche avec très élève".split()}


def labelled(spark, n=120):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        lang = list(WORDS)[k % 3]
        rows.append((1000 + k, " ".join(rng.choice(WORDS[lang]) for _ in range(12)), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(spark):
    docs = labelled(spark)
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    held = [r for r in docs.collect() if py_fold(r.doc_id, 4) == 2]
    assert len(held) > 15
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    docs = labelled(spark).unionByName(documents(spark).select("doc_id", "text", "lang"))
    model = langid.fit(docs)
    rows = langid.predict(documents(spark), model).collect()
    got = {r.doc_id: r.lang_pred for r in rows}
    assert [got[k] for k in (3, 4, 5, 9)] == ["und"] * 4 and got[1] == "en" and len(rows) == 12
    kept = langid.keep_known(documents(spark), model)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, 8, None, 10} and kept.columns == documents(spark).columns
    assert langid.predict(empty(spark), model).count() == 0


def test_nothing_to_learn_from(spark):
    model = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.predict(documents(spark), model).collect()} == {"und"}


def test_without_labels_only_texts_without_a_letter_go(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = langid.keep_known(docs, langid.fit(docs))
    assert {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, 8, None, 10} and kept.columns == docs.columns


def test_codewords_are_apart():
    for n in (2, 4, 7, 12):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n


def test_every_language_is_learnt(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    own = {f"l{k:03}": [word() for _ in range(6)] for k in range(130)}
    rows = [(j * 1000 + k, " ".join(rng.choice(own[lang]) for _ in range(30)), lang) for k, lang in enumerate(own) for j in range(6 if k % 3 else 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    seen = {r[2] for r in rows if py_fold(r[0], 4) != 2}
    assert model.languages == sorted(seen) and len(seen) > 120
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) / len(rows) > 0.9


def test_codewords_as_by_pairs():
    for n in (8, 12, 30):
        bits = int(langid.np.ceil(10 * langid.np.log2(n)))
        codes = [langid.np.random.default_rng(seed).choice([-1, 1], (n, bits)) for seed in range(50)]
        least = [min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) for c in codes]
        assert (langid.codewords(n) == codes[int(langid.np.argmax(least))]).all()


def test_two_thousand_languages(spark):
    """Plans don't get deeper with the number of languages, and none is left out."""
    rows = [(j * 10_000 + k, f"{chr(97 + k % 26) * 3} {chr(97 + k // 26 % 26) * 3} x{k} some text", f"l{k:04}") for k in range(2000) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    want = {r[2] for r in rows if py_fold(r[0], 4) != 2}
    chosen, sizes = langid.hashed_sample(docs.where((langid.fold_of("doc_id", 4) != 2)), "doc_id", "lang", dict.fromkeys(want, 5))
    assert set(chosen) == set(sizes) == want
    assert langid.fit(docs).languages == sorted(want)
