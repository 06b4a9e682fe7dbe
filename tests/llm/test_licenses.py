import re
import time

from tilewright.llm import licenses

from .rows import documents, empty


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    places = [(t, k) for t in licenses.TEMPLATES for k in range(len(words)) if words[k : k + len(t.words)] == t.words]
    base = [k for t, k in places if t.base]
    labels = lambda only: ",".join(sorted({t.label for t, _ in places if t.base or not only}))
    return len(words), len(base), min(base, default=None), max(base, default=None), labels(True), labels(False)


TEXTS = ["MIT License, mit-license; MIT license", "cc by cc by-sa 4.0 CC BY NC", "GNU General Public License version 3", "gnu lesser general public license", "x" * 50 + " apache license version 2.0 apache license", "mit LİCENSE mit licenKe mit éLicense Élicense", "license mit", "Permission is hereby granted, free of charge, to any person obtaining a copy", "gnu gnu general public gnu general public license"]


def test_equals_brute_force(spark):
    df = documents(spark, [(100 + k, t) for k, t in enumerate(TEXTS)])
    got = licenses.digest_columns(licenses.scan(df)).collect()
    want = sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got), key=repr) == want
    assert all(r.score == 1.0 if r.labels else 0 <= r.score <= licenses.UNVERIFIED for r in got)
    assert {r.doc_id: r.score for r in got}[106] == licenses.UNVERIFIED  # both rare words, no phrase


def test_counts_choose_the_index_but_not_the_result(spark):
    df = documents(spark, [(100 + k, t) for k, t in enumerate(TEXTS)])
    odd = {w: k for k, w in enumerate(sorted({w for t in licenses.TEMPLATES for w in t.words}))}
    key = lambda d: sorted((tuple(r)[:7] for r in licenses.digest_columns(d).collect()), key=repr)
    assert key(licenses.scan(df)) == key(licenses.scan(df, counts=odd))


def test_empty_and_native(spark):
    assert licenses.digest_columns(licenses.scan(empty(spark))).count() == 0
    plan = licenses.scan(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.split("== Physical Plan ==")[1])


def test_any_number_of_templates(spark):
    df = spark.createDataFrame([(1, "a b c a b"), (2, "x"), (3, None)], "doc_id bigint, text string").selectExpr("*", "1 AS x", "2 AS w", "3 AS found")
    one = (licenses.Template("ab", "a b", True),)
    many = tuple(licenses.Template(f"t{k}", f"a b w{k}") for k in range(300)) + one + (licenses.Template("single", "c"),)
    for templates, want in ((one, [("ab", 0), ("ab", 3)]), (many, [("ab", 0), ("ab", 3), ("single", 2)]), ((), [])):
        got = {r.doc_id: sorted((m.label, m.start) for m in r.matches) for r in licenses.scan(df, templates).collect()}
        assert got == {1: want, 2: [], 3: []}


def test_many_notices_in_one_text(spark):
    """Work in proportion to the hits: two million bytes of repeated notices are seconds, not hours."""
    n = 50_000
    df = spark.createDataFrame([(1, "gnu general public license version 2 " * n), (2, "Apache License, " * n)], "doc_id bigint, text string")
    began = time.time()
    got = {r.doc_id: r for r in licenses.digest_columns(licenses.scan(df)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (n, 0, 6 * (n - 1), "gpl,gpl-2")
    assert (got[2].n_base, got[2].last_word, got[2].base_labels) == (n, 2 * (n - 1), "apache")
    assert time.time() - began < 60
