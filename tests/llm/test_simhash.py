import random

import numpy as np
import pytest
import xxhash

from tilewright.llm import simhash

from .rows import collected, documents, empty


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes):
    """nodes: (name or None, fingerprint). The smallest name that each reaches."""
    seen, out = set(), [None] * len(nodes)
    for k in range(len(nodes)):
        if k in seen:
            continue
        stack, own = [k], set()
        while stack:
            x = stack.pop()
            if x in own:
                continue
            own.add(x)
            stack += [y for y in range(len(nodes)) if y not in own and (nodes[x][1] ^ nodes[y][1]).bit_count() <= 3]
        seen |= own
        least = min((nodes[x][0] for x in own if nodes[x][0] is not None), default=None)
        for x in own:
            out[x] = least
    return out


def near_prints(n=120, seed=5):
    """Random fingerprints with others at 1 to 5 bits, and a dense family around one."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n)]
    flip = lambda f, k: f ^ sum(1 << b for b in rng.sample(range(64), k))
    out = set(base)
    for f in base:
        out |= {flip(f, rng.randrange(1, 6)) for _ in range(2)}
    dense = rng.getrandbits(64)
    out |= {flip(dense, rng.randrange(0, 5)) for _ in range(200)}
    return sorted(out | {0, 1, 2**64 - 1, 2**63, 15})


@pytest.mark.parametrize("limit", [20_000, 15])
def test_links_are_whole(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIMIT", limit)
    prints = near_prints()
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in prints], "f bigint")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(frame, len(prints)).collect()]
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in found)
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(f) for f in prints] == brute_components([(f, f) for f in prints])


def test_fingerprints_against_brute_force(spark):
    docs = documents(spark, [(20, "A b C d e F"), (21, "a B c D e f"), (22, "x\x0by\x1fz w"), (23, "two words"), (24, "word " * 3000), (25, "ÄÖ a b c d")])
    got = simhash.groups(docs)
    texts = {(r.doc_id, brute_print(r.text)) for r in docs.collect()}
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got.collect()} == texts and got.count() == docs.count()
    nodes = sorted(((r.doc_id, brute_print(r.text)) for r in docs.collect()), key=repr)
    want = sorted(zip([n[0] for n in nodes], [f"{n[1]:016x}" for n in nodes], brute_components(nodes)), key=repr)
    assert collected(got, "doc_id", "fingerprint", "component_id") == want


def test_hot_copies_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 0.2)
    rows = [(k, "the same text over and over again", 1, 2, "x") for k in range(50)] + [(100 + k, f"text number {k} stands alone here {k * k}", 1, 2, "y") for k in range(40)]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id bigint, text string, f bigint, rows bigint, hot string")).collect()
    assert len(got) == 90 and {r.component_id for r in got if r.doc_id < 50} == {0}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id >= 100 and (int(r.fingerprint, 16)) not in (0,))


def test_long_texts_and_pieces(monkeypatch):
    text = " ".join(f"w{k % 977} and{k}" for k in range(30_000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES", 777)
    assert simhash.fingerprint(text) == whole and simhash.fingerprint(b" \n") == 0


def test_empty(spark):
    assert simhash.groups(empty(spark)).collect() == []
