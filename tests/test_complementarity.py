import random

from tilewright.operators import design

PAIR = {"A": "T", "T": "A", "C": "G", "G": "C"}


def brute(a, b):
    """Every stretch of every way to lay b, turned, beside a."""
    turned, anywhere, end = b[::-1], 0, 0
    for shift in range(-len(b), len(a) + 1):
        places = [k for k in range(len(a)) if 0 <= k - shift < len(b)]
        for i in range(len(places)):
            for j in range(i, len(places)):
                score = sum(1 if PAIR.get(a[k]) == turned[k - shift] else -1 for k in places[i : j + 1])
                anywhere = max(anywhere, score)
                if places[j] == len(a) - 1 or places[i] - shift == 0:
                    end = max(end, score)
    return anywhere, end


def test_as_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice(rng.choice(["ACGT", "AT", "ACGTN"])) for _ in range(rng.randrange(0, 15))) for _ in range(2))
        assert design.complementarity(a, b) == brute(a, b) == design.complementarity(b, a)
        assert design.complementarity(a, a) == brute(a, a)


def test_known_oligos():
    assert design.complementarity("ACGTACGT", "ACGTACGT") == (8, 8)  # its own reverse complement
    assert design.complementarity("AAAAAAAA", "AAAAAAAA") == (0, 0)
    assert design.complementarity("CCCCCAAGG", "CCCCCAAGG")[1] >= 2  # the last GG meets a CC


def test_picked_pairs_keep_the_limits():
    """As by plain loops over all pairs of oligos, best first."""
    rng = random.Random(2)
    found = 0
    for _ in range(25):
        region = "".join(rng.choice("ACGT") for _ in range(700))
        left, turned = design.oligos(region, 0, 100), design._revcomp(region)
        right = [(p, 700 - s - k, k, turned[s : s + k]) for p, s, k, *_ in design.oligos(turned, 0, 100)]
        ok = lambda x, y, any_, end: (got := brute(x, y))[0] <= any_ and got[1] <= end
        keys = sorted((p + q, a, b, region[a : a + k], other) for p, a, k, *_ in left for q, b, m, other in right if 400 <= b + m - a <= 600)
        want = next((x for x in keys if ok(x[3], x[3], 8, 3) and ok(x[4], x[4], 8, 3) and ok(x[3], x[4], 8, 3)), None)
        got = design.pick_pair(region, 100, 600)
        assert (got is None) == (want is None)
        if got:
            found += 1
            ties = [x[1:2] + x[3:] for x in keys if x[0] == want[0] and x[1] == want[1]]  # of one penalty and left place any may be taken
            assert got["penalty"] == want[0] and (got["left_pos"], got["left_seq"], got["right_seq"]) in ties
            assert all(ok(x, y, 8, 3) for x, y in [(got["left_seq"],) * 2, (got["right_seq"],) * 2, (got["left_seq"], got["right_seq"])])
    assert found > 5


def test_many_pairs_at_once_are_those_of_one_by_one():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    left = [word(rng.randrange(1, 31)) for _ in range(300)]
    right = [design._revcomp(x)[: rng.randrange(1, 31)] if k % 3 else word(rng.randrange(1, 31)) for k, x in enumerate(left)]
    got = design.complementarities(design._rows(left, True), design._rows([x[::-1] for x in right], False))
    assert list(zip(*(x.tolist() for x in got))) == [design.complementarity(a, b) for a, b in zip(left, right)]


def test_tiles_are_designed_together_as_one_by_one():
    """Oligos of many tiles are laid on themselves together, and a tile's pairs of several left oligos at once."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    tiles = [(t, 100, min(600, len(t))) for t in [*(word(rng.choice([400, 640, 700])) for _ in range(40)), "A" * 700, "", word(90), word(300) + "N" * 40 + word(360)]]
    tiles += [(word(1500), 650, 900)]  # a side longer than SUMMED
    got = design.pick_pairs(tiles)
    assert got == [design.pick_pair(*t) for t in tiles] and 5 < sum(x is not None for x in got) < len(tiles)

    def plain(region, low, high):
        left, turned, n = design.oligos(region, 0, low), region.translate(str.maketrans("ACGT", "TGCA"))[::-1], len(region)
        right = [(p, n - s - k, k, turned[s : s + k]) for p, s, k, _, _ in design.oligos(turned, 0, n - high)]
        alone = lambda s: design.complementarity(s, s)[0] <= design.SELF_ANY and design.complementarity(s, s)[1] <= design.SELF_END
        free = lambda s, t: design.complementarity(s, t)[0] <= design.PAIR_ANY and design.complementarity(s, t)[1] <= design.PAIR_END
        left = [(p, a, k, region[a : a + k]) for p, a, k, _, _ in left if alone(region[a : a + k])]
        right = [x for x in right if alone(x[3])]
        return min(((p + q, a, b) for p, a, k, s in left for q, b, m, t in right if design.PRODUCT[0] <= b + m - a <= design.PRODUCT[1] and free(s, t)), default=None)

    for tile, one in list(zip(tiles, got))[:12]:
        assert (one and (one["penalty"], one["left_pos"], one["right_pos"] - len(one["right_seq"]) + 1)) == plain(*tile)


def test_melting_from_running_sums_is_the_plain_one():
    rng = random.Random(12)
    seq = "".join(rng.choice("ACGT") for _ in range(1300))
    found = design.oligos(seq, 0, 1300)
    assert len(found) > 500 and all(tm == design.melting(seq[a : a + n]) for _, a, n, tm, _ in found)
    assert max(a for _, a, _, _, _ in found) > 2 * design.SUMMED
