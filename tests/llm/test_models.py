import numpy as np

from leafmill.llm import linear
from leafmill.llm.boost import Boost


def test_boost_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (2_000, 4))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0.3)).astype(float)
    model = Boost(depth=3).fit(x[:1_500], y[:1_500])
    assert ((model.probability(x[1_500:]) > 0.5) == y[1_500:]).mean() > 0.95
    assert Boost().fit(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((3, 2))).shape == (3,)


def test_linear_learns_words():
    texts = [f"good {i}" if i % 2 else f"bad {i}" for i in range(400)]
    rows = linear.Rows.of([[linear.slot(w) for w in t.split()] for t in texts])
    y = np.array([[i % 2] for i in range(400)], dtype=np.float32)
    s = linear.scores(linear.fit(rows, y), rows)[:, 0]
    assert ((s > 0) == (y[:, 0] > 0)).all()
    assert len(rows + rows.take(np.array([3, 5]))) == 402


def test_groups_have_equal_say():
    rows = linear.Rows.grouped(2, [(np.array([0, 0, 0, 0]), np.arange(4, dtype=np.uint64), 1.0), (np.array([1, 0]), np.array([9, 9], dtype=np.uint64), 2.0)])
    assert rows.start.tolist() == [0, 5, 6] and rows.value.tolist() == [0.5] * 4 + [2.0, 2.0]


def test_reliability_and_prior():
    x, p = linear.reliability(np.array([0.9, 0.8, 0.3, 0.1, 0.85]), np.array([True, True, False, False, False]), np.ones(5))
    assert (np.diff(p) >= 0).all() and np.interp(0.0, x, p) == 0 and np.interp(0.95, x, p) == 1
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.05
    s = rng.normal(size=20_000) + 3 * truth
    assert abs(linear.prior(1 / (1 + np.exp(-(3 * s - 4.5))), 0.5) - 0.05) < 0.01
