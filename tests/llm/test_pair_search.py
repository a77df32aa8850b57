"""Places of pairs that a round replaces are found by their bins; few are searched for."""

import numpy as np

from meshframe.llm import repair


def test_few_places_are_searched(monkeypatch):
    r = np.random.default_rng(4)
    ids = (r.zipf(1.3, 200_000) % 5000).astype(np.int32)
    searched, search = [], np.searchsorted
    monkeypatch.setattr(repair.np, "searchsorted", lambda a, v, *k, **w: searched.append(np.size(v)) or search(a, v, *k, **w))
    rules, seq = repair.compress(ids, 5000)
    monkeypatch.undo()
    assert sum(searched) < len(ids) / 2 and len(rules) > 100
    assert (repair.Grammar(rules, repair.lengths(rules, 5000), seq, 5000).all() == ids).all()
