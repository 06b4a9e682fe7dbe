import random

import numpy as np

from tilewright.llm import neardup
from tilewright.llm.shingles import Shingler

from .rows import documents, empty


def word_sets(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute(rows, size, percent=80):
    sets = word_sets(rows, size)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed=1):
    """Families of near copies around the threshold, chains, exact copies, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    passage = [word() for _ in range(60)]
    rows, i = [], 100
    for family in range(8):
        base = [word() for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.choice([2, 6, 40])):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 12)):
                own[rng.randrange(len(own))] = word()
            if family % 3 == 0:
                own = own + passage
            rows.append((i, (" " if rng.random() < 0.5 else "\n").join(own)))
            i += 1
    rows += [(i + k, rows[k][1].upper()) for k in range(5)]
    rows += [(i + 10 + k, " ".join(rng.choice(["of", "the", "a"]) for _ in range(rng.randrange(5)))) for k in range(25)]
    return rows


def test_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (2, 5):
        got = neardup.groups(df, size=size).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, size)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_families_in_small_blocks(spark, monkeypatch):
    """Lists of three linked documents are compared in blocks of four documents, over two columns at a time."""
    for name, value in (("FAMILY", 3), ("BLOCK", 4), ("COLUMNS", 2)):
        monkeypatch.setattr(neardup, name, value)
    rows = corpus(2)
    got = neardup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), size=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)


def test_odd_rows(spark):
    rows = neardup.groups(documents(spark), size=2).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 12
    assert got[2].component_id == 1 and not got[2].kept and got[1].kept
    assert all(got[k].component_id == k and got[k].n_shingles == 0 for k in (3, 4, 5))
    assert got[None].component_id is None and got[None].kept
    assert neardup.groups(empty(spark), size=2).count() == 0


def test_keep_one(spark):
    own = documents(spark)
    kept = neardup.keep_one(own, size=2)
    assert kept.columns == own.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, 10, None]))


def test_hashes_tell_sets_apart():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "c", "É", "\xa0", " ", "\n", "\x0b", "\x1c", "D"]) for _ in range(rng.randrange(30))) for _ in range(1500)] + ["", " "]
    for size in (2, 5):
        seen = {}
        for want, got in zip(word_sets(enumerate(texts), size).values(), Shingler(size).sets([t.encode() for t in texts])):
            assert len(want) == got.size
            assert seen.setdefault(frozenset(want), got.tobytes()) == got.tobytes()
        assert len(set(seen.values())) == len(seen)


def test_packed_sketches_differ_in_no_more_bits_than_shingles():
    rng = np.random.default_rng(1)
    for n in (1, 5, 50, 500):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.append(a[: max(1, n - n // 5)], rng.integers(0, 1 << 64, n // 10, np.uint64)))
        bits = sum(int(x ^ y).bit_count() for x, y in zip(neardup.packed(a).view(np.uint64), neardup.packed(b).view(np.uint64)))
        assert bits <= np.setxor1d(a, b).size


def thue_morse(n, flip=False):
    s = "ab" if not flip else "ba"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_made_to_coincide_do_not(spark):
    """Words that any polynomial modulo a power of two gives the same hash, alone and as shingles of texts."""
    for n in (8, 64, 128, 1024, 2048, 4096):
        h, _ = Shingler(2).words([thue_morse(n).encode(), thue_morse(n, True).encode()])
        assert h[0] != h[1]
    rows = [(1, " ".join([thue_morse(2048), "x"] * 3)), (2, " ".join([thue_morse(2048, True), "x"] * 3))]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), size=2).collect()
    assert {r.component_id for r in got} == {1, 2}


def test_long_lists_go_to_blocks(spark, monkeypatch):
    for name, value in (("LIST_PAIRS", 3), ("LEADER_PAIRS", 2), ("BLOCK", 5)):
        monkeypatch.setattr(neardup, name, value)
    rows = corpus(4)
    got = neardup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), size=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)


def test_several_texts_of_one_id(spark):
    """Such an id has one component, whichever order the rows come in; repeated rows change nothing."""
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "q r s t u v w x y z", "a b c d e f g h i j"]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (3, texts[2]), (2, texts[2])]
    got = [sorted({(r.doc_id, r.component_id) for r in neardup.groups(spark.createDataFrame(x, "doc_id bigint, text string"), size=2).collect()}) for x in (rows, rows[::-1])]
    assert got[0] == got[1] and [i for i, _ in got[0]] == [1, 2, 3]
    assert len(neardup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS _gone0", "2 AS id", "3 AS own"), size=2).collect()) in (2, 3)


def test_union_estimate_keeps_what_is_similar(spark):
    rng = np.random.default_rng(5)
    rows, same = [], []
    for k in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        own = a[rng.random(a.size) > rng.choice([0.02, 0.1, 0.6])]
        b = np.unique(np.append(own, rng.integers(0, 1 << 64, int(rng.integers(0, 1 + n // 10)), np.uint64)))
        rows.append((k, neardup.bottom(a).tolist(), neardup.bottom(b).tolist()))
        same.append(100 * np.intersect1d(a, b).size >= 80 * np.union1d(a, b).size)
    kept = {r.k for r in spark.createDataFrame(rows, "k int, x array<bigint>, y array<bigint>").where(neardup.union_likely("x", "y")).collect()}
    assert {k for k, s in enumerate(same) if s} <= kept and len(kept) < 300
