import tracemalloc

from tilewright.operators import pcr


def test_search_holds_little_beside_the_text():
    """Many places with a seed and no site: what is held at once follows TOGETHER and CELLS, not the text."""
    probes = pcr.Probes(["A" * 8 + "C" * 17], 2)
    texts = ["A" * 1_200_000]
    tracemalloc.start()
    found = probes.search(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0].size == 0 and peak < 60e6
