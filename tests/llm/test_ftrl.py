"""The learner against a plain version that keeps its state in dictionaries."""

import math
import random

import pytest

from lexaudit.llm.toxicity import Ftrl, features, train


def plain(rows, how):
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == 1 << how.bits else how.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    examples = [(sorted(set(features(t, how.bits).tolist())) + [1 << how.bits], y) for t, y in rows]
    for _ in range(how.epochs):
        for x, y in examples:
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i in x:
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / how.alpha * w[i]
    return {i: weight(i) for i in z if weight(i) != 0.0}


@pytest.mark.parametrize("how", [Ftrl(bits=10), Ftrl(alpha=0.3, beta=2.0, l1=0.5, l2=0.1, epochs=2, bits=14)])
def test_same_as_plain_version(how):
    rnd = random.Random(2)
    rows = [(" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 25))), rnd.randint(0, 1)) for _ in range(120)]
    rows += [(None, 0), ("", 1), *[(f"bad {t}", 1) for t, _ in rows[:30]]]
    at, w = train(rows, how)
    want = plain(rows, how)
    assert set(at.tolist()) == set(want) and all(math.isclose(x, want[i], rel_tol=1e-9, abs_tol=1e-12) for i, x in zip(at.tolist(), w.tolist(), strict=True))
