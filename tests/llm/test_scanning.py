"""Places at which patterns of addresses are tried, against searching whole texts for them."""

import random

from tessera.llm import pii


def test_addresses_tried_at_their_signs_are_those_of_a_search():
    rng = random.Random(1)
    parts = ["a", "b.c", "x-1", "é", "_", "+", "%", ".", " ", " ", " at ", " AT ", "at ", " ät ", " arobase ", " dot ", " point ", "dot ", " PUNKT ", "@", "x@y.de", "(at)", "[ ät ]", "{AT)", "(", "]", "\n", "ann at host dot org", "█"]
    found = 0
    for _ in range(20000):
        t = "".join(rng.choices(parts, k=rng.randrange(16)))
        assert [m.span() for m in pii._ats(t)] == [m.span() for m in pii._AT.finditer(t)]
        spans = [m.span() for m in pii._spelled(t)]
        assert spans == [m.span() for m in pii._SPELLED.finditer(t)], t
        found += len(spans)
    assert found > 1000
