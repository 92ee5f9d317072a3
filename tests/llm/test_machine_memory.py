"""What scoring the sample takes beside the sample itself."""

import tracemalloc

import numpy as np

from flowtab.llm.learn import Rows
from flowtab.llm.toxicity import FactorizationMachine


def test_logits_take_little_memory():
    g = np.random.default_rng(3)
    sizes = g.integers(0, 400, 3000)
    sizes[:3] = 0
    model = FactorizationMachine(list(range(5000)))
    model.w0, model.w, model.v = 0.25, g.normal(0, 0.1, 5000), g.normal(0, 0.1, (5000, 8))
    rows = Rows(g.integers(0, 5000, sizes.sum()), sizes)
    tracemalloc.start()
    got = model.logits(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * rows.flat.nbytes  # their vectors alone are eight times that
    ends = np.cumsum(sizes)
    for k in (0, 3, 255, 256, 257, 2999):
        assert np.isclose(got[k], model.logit(rows.flat[ends[k] - sizes[k] : ends[k]].tolist()) if sizes[k] else 0.25)
    assert model.logits(Rows([], [])).shape == (0,)
