import hashlib

from tilewright.llm import fingerprints

from .rows import documents, empty


def test_edited_and_next(spark):
    own = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in own.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprint(own).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        changed = fingerprints.edited(t, following)
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fingerprints.wide(fingerprints.canonical(t)).hex()
        assert r.edited_fingerprint == fingerprints.wide(fingerprints.canonical(changed)).hex()
        assert r.near_edited == float(fingerprints.canonical(t) == fingerprints.canonical(changed))
        assert r.near_next == float(fingerprints.canonical(t) == fingerprints.canonical(following))
    assert got[1].fingerprint == got[2].fingerprint and got[3].fingerprint == got[4].fingerprint == got[5].fingerprint


def test_odd_rows(spark):
    rows = fingerprints.fingerprint(documents(spark)).collect()
    assert len(rows) == 12 and len({r.fingerprint for r in rows if r.doc_id == 8}) == 1
    assert fingerprints.fingerprint(empty(spark)).count() == 0
    one = fingerprints.fingerprint(documents(spark).where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_collisions_are_told_apart(spark):
    """With a digest of four bits many texts share a bucket; the bytes decide."""
    narrow = lambda data: bytes([hashlib.md5(data).digest()[0] & 15])
    df = spark.createDataFrame([(k, f"text {k % 40}") for k in range(80)], "doc_id bigint, text string")
    got = fingerprints.fingerprint(df, digest=narrow).collect()
    names = {}
    for r in got:
        names.setdefault(r.fingerprint, set()).add(r.doc_id % 40)
    assert len(names) == 40 and all(len(x) == 1 for x in names.values())


def test_canonical_form():
    same = ["Straße  ﬁn", " strasse\tFIN\n", "STRASSE fin"]
    assert len({fingerprints.canonical(t) for t in same}) == 1


def test_ids_of_other_types_and_clashing_columns(spark):
    rows = [(3, "c c"), (1, "a"), (2, "B"), (None, None)]
    for kind in ("int", "smallint", "string", "bigint"):
        df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr(f"cast(doc_id AS {kind}) AS doc_id", "text", "1 AS id", "2 AS part", "3 AS digest", "4 AS prefix", "5 AS row")
        got = fingerprints.fingerprint(df)
        assert got.schema["doc_id"].dataType.simpleString() == kind
        by = {r.doc_id if r.doc_id is None else int(r.doc_id): r for r in got.collect()}
        assert by[3].n_chars == 3 and by[None].n_chars == 0
        assert by[2].edited_sha256 == hashlib.sha256(fingerprints.edited("B", "a").encode()).hexdigest()


def test_one_id_and_one_text_hold_most_rows(spark, monkeypatch):
    """A third of all rows are one id's, another third one text; the order of the others is unchanged, every row comes back."""
    monkeypatch.setattr(fingerprints, "HOT", 4)
    monkeypatch.setattr(fingerprints, "REMEMBERED", 20)
    rows = [(7, f"text {k % 50} of seven") for k in range(200)] + [(1000 + k, "the same text") for k in range(200)] + [(5000 + k, f"own {k}") for k in range(100)]
    got = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert len(got) == 500 and len({r.fingerprint for r in got}) == 151
    assert len({r.fingerprint for r in got if 1000 <= r.doc_id < 1200}) == 1
    narrow = lambda data: bytes([hashlib.md5(data).digest()[0] & 15])
    got = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), digest=narrow).collect()
    assert len({r.fingerprint for r in got}) == 151
