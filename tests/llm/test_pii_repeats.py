import numpy as np

from saltmarsh.llm import pii
from saltmarsh.llm.pii import KINDS


def test_all_repeats_take_the_label_of_a_match_however_many_there_are():
    plain = pii.Weights(np.zeros((pii.SLOTS, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), np.eye(pii.LABELS) * 6)
    filler = " and then a good deal later in this long text "
    for n, place in ((40, 0), (40, 39), (40, 20), (200, 0)):
        parts = ["(407) 555-7710"] * n
        parts[place] = "+1 (407) 555-7710"
        text = filler.join(parts)
        ((base, spans),) = pii.found([text], plain)
        assert [text[s.start : s.end] for s in base] == ["+1 (407) 555-7710"]
        more = [s for s in spans if s not in base]
        assert [(KINDS[s.kind], text[s.start : s.end]) for s in more] == [("phone", "(407) 555-7710")] * (n - 1)


def test_edges_stay_in_proportion_to_the_repeats():
    text = " then ".join(["+1 4075557710", *["4075557710"] * 500, "+1 4075557710"])
    g = pii.graph(text, *pii.matches(text))
    assert len(g.skip) <= 3 * len(g.starts)
    fixed = {i for i, x in enumerate(g.fixed) if x >= 0}
    assert len(fixed) == 4 and {i for e in g.skip for i in e if fixed & set(e)} == set(range(len(g.starts)))
