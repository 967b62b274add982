import numpy as np

from siftloom.llm.pitman_yor import Draws, Hierarchy, Tables, seat, seat_alone


def toy(seed=3, contexts=12, dishes=20, n=4000):
    r = np.random.default_rng(seed)
    base = r.dirichlet(np.full(dishes, 0.3))
    p = np.array([r.dirichlet(30 * base + 1e-3) for _ in range(contexts)])
    u = r.integers(0, contexts, n)
    w = np.array([r.choice(dishes, p=p[x]) for x in u])
    return u, w, p


def test_predictions_sum_to_one_and_beat_the_parent():
    u, w, p = toy()
    pairs, n = np.unique(np.stack([u, w]), axis=1, return_counts=True)
    h = Hierarchy(pairs[0], pairs[1], n, 20, 1, 100)
    m = h.average()
    every = np.array([m.probability([np.zeros(20, np.int64), np.full(20, c)], np.arange(20)) for c in range(13)])
    assert np.allclose(every.sum(axis=1), 1, atol=1e-6)
    assert np.abs(every[:12] - p).mean() < 0.01
    u2, w2, _ = toy(3, n=6000)
    own = np.log(every[u2[4000:], w2[4000:]]).mean()
    assert own > np.log(np.bincount(w, minlength=20)[w2[4000:]] / 4000 + 1e-9).mean()


def test_counts_stay_whole():
    u, w, _ = toy(5)
    pairs, n = np.unique(np.stack([u, w]), axis=1, return_counts=True)
    h = Hierarchy(pairs[0], pairs[1], n, 20, 1, 100)
    for _ in h.sample(8, 0):
        for lv, up in zip(h.levels[1:], h.levels):
            assert (lv.t >= np.minimum(lv.c, 1)).all() and (lv.t <= lv.c).all()
            assert up.c.sum() == lv.t.sum()
        assert h.levels[-1].c.sum() == len(u)


def test_gibbs_keeps_to_the_posterior():
    """One pair of three customers: the share of each number of tables, against listing all seatings."""
    d, strength, p = 0.5, 1.0, 0.3
    weight = {1: strength * p * (1 - d) * (2 - d), 2: 3 * strength * p * (strength + d) * p * (1 - d), 3: strength * p * (strength + d) * p * (strength + 2 * d) * p}
    total = sum(weight.values())
    rng = np.random.default_rng(1)
    n = 20_000
    c = np.full(n, 3)
    t = seat(c, np.arange(n), n, np.full(n, p), d, strength, rng)
    tables = Tables(c, t, rng)
    seen = np.zeros(4)
    for i in range(30):
        tables.sweep((strength + d * tables.count()) * p, np.full(n, p), d, rng)
        assert (np.bincount(tables.owner, weights=tables.size, minlength=n) == 3).all()
        if i >= 10:
            seen += np.bincount(tables.count(), minlength=4)
    share = seen / seen.sum()
    assert np.abs(share[1:] - np.array([weight[k] / total for k in (1, 2, 3)])).max() < 0.01


def test_seating_alone_keeps_to_the_posterior_and_to_the_keys():
    """As above, with draws by key; a subset of the keys has the same tables."""
    d, p, strength = 0.5, 0.3, 1.0
    new = 0.6  # held fixed
    weight = {1: new * (1 - d) * (2 - d), 2: 3 * new * new * (1 - d), 3: new**3}
    total = sum(weight.values())
    n = 20_000
    keys = np.random.default_rng(4).integers(0, 1 << 63, n).astype(np.uint64)

    def run(of):
        c = np.full(len(of), 3)
        t = seat_alone(c, np.full(len(of), new), d, Draws(of))
        draws = Draws(of ^ Draws.STEP)
        tables, seen = Tables(c, t, draws), []
        for i in range(20):
            tables.sweep(np.full(len(of), new), np.zeros(len(of)), d, draws)
            if i >= 8:
                seen.append(tables.count())
        return np.array(seen)

    got = run(keys)
    share = np.bincount(got.ravel(), minlength=4) / got.size
    assert np.abs(share[1:] - np.array([weight[k] / total for k in (1, 2, 3)])).max() < 0.01
    assert (run(keys[::7]) == got[:, ::7]).all()


def test_empty():
    e = np.empty(0, np.int64)
    m = Hierarchy(e, e, e, 5, 1, 100).average()
    assert np.allclose(m.probability([np.zeros(5, np.int64)] * 2, np.arange(5)), 0.2)
