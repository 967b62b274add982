"""A hierarchy of Pitman-Yor restaurants, seated by Gibbs sampling.

Level 0 has one restaurant, with a uniform base.  A restaurant of level n + 1
belongs to a context; its parent, at level n, belongs to the shorter context, so
restaurants share parents.  A pair (context, dish) has c customers at t tables;
tables of a child are customers of its parent.

Customers of the lowest level are given.  A sweep takes one customer of every
pair out of its seat and seats it again: at a table of n others with weight
n - d, at a new table with weight (strength + d * tables) * p, p being what the
parent predicts.  All pairs move at once, on the totals that the sweep began
with.  The levels above have other customers after each sweep and are seated
anew.  Predictive probabilities are averaged over the sweeps after burn-in.
"""

from __future__ import annotations

import numpy as np


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), the usual estimate, between 0.1 and 0.95."""
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return float(min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5)))


def seat(c: np.ndarray, rest: np.ndarray, n_rest: int, p: np.ndarray, d: float, strength: float, rng: np.random.Generator, elsewhere: float = 0) -> np.ndarray:
    """Tables of each pair when its c customers come in one after the other.  elsewhere: tables of the restaurants that are not among these pairs.

    Pairs go on together.  The customers of a pair come in parties of an eighth
    of those already there, one at least; a party meets the chances at its start.
    """
    t = np.minimum(c, 1).astype(np.int64)
    done = t.copy()
    total = elsewhere + np.bincount(rest, weights=t, minlength=n_rest)
    live = np.nonzero(done < c)[0]
    while len(live):
        party = np.minimum(np.maximum(1, done[live] // 8), c[live] - done[live])
        new = (strength + d * total[rest[live]]) * p[live]
        opened = rng.binomial(party, new / (new + done[live] - d * t[live]))
        t[live] += opened
        total += np.bincount(rest[live], weights=opened, minlength=n_rest)
        done[live] += party
        live = live[done[live] < c[live]]
    return t


class Draws:
    """Uniform numbers for each key, which depend on the key and on how many went before, not on the keys beside it."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.state = keys.astype(np.uint64)

    @staticmethod
    def _uniform(x: np.ndarray) -> np.ndarray:
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return ((x ^ x >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53

    def random(self, n: int) -> np.ndarray:
        """One for each key, of which there are n."""
        self.state = self.state + self.STEP
        return self._uniform(self.state)

    def exponential(self, owner: np.ndarray) -> np.ndarray:
        """One for each entry; entries of a key stand in a row."""
        self.state = self.state + self.STEP
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        return -np.log1p(-self._uniform(self.state[owner] + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def seat_alone(c: np.ndarray, new: np.ndarray, d: float, draws: Draws) -> np.ndarray:
    """Tables of each pair when its c customers come in and the weight of a new table stays as it is.

    Parties as in seat.  Of a party as many open a table as the chance says on
    average, rounded up or down at random.
    """
    t = np.minimum(c, 1).astype(np.int64)
    done = t.copy()
    while (done < c).any():
        party = np.minimum(np.maximum(1, done // 8), c - done)
        expected = party * new / np.maximum(new + done - d * t, 1e-300)
        t += np.minimum(party, (expected + draws.random(len(c))).astype(np.int64))
        done += party
    return t


class Tables:
    """Table sizes of pairs, table by table in the order of the pairs; kept for pairs of two customers or more."""

    def __init__(self, c: np.ndarray, t: np.ndarray, rng: np.random.Generator):
        self.pairs = np.nonzero(c > 1)[0]
        self.c = c[self.pairs].astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.pairs)), t[self.pairs])
        share = rng.exponential(self.owner) if isinstance(rng, Draws) else rng.exponential(size=len(self.owner))
        share /= np.bincount(self.owner, weights=share, minlength=len(self.pairs))[self.owner] if len(self.owner) else 1
        free = self.c - t[self.pairs]
        self.size = 1 + np.floor(share * free[self.owner]).astype(np.int64)
        first = np.searchsorted(self.owner, np.arange(len(self.pairs)))
        self.size[first] += self.c - np.bincount(self.owner, weights=self.size, minlength=len(self.pairs)).astype(np.int64)

    def count(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=len(self.pairs))

    def sweep(self, new: np.ndarray, p: np.ndarray, d: float, rng: np.random.Generator) -> None:
        """One customer of each pair leaves and is seated again.  new: weight of a new table, for each pair; p: what its parent predicts."""
        n = len(self.pairs)
        if not n:
            return
        ends = np.cumsum(self.size)
        start = np.concatenate([[0], np.cumsum(self.c)[:-1]])
        left = np.searchsorted(ends, start + np.minimum((rng.random(n) * self.c).astype(np.int64), self.c - 1), side="right")
        self.size[left] -= 1
        keep = self.size > 0
        new = new - d * p * (self.size[left] == 0)  # the table is gone with its only customer
        size, owner = self.size[keep], self.owner[keep]
        t = np.bincount(owner, minlength=n)
        old = self.c - 1 - d * t
        opens = rng.random(n) * (old + new) < new
        stay, where = np.nonzero(~opens)[0], rng.random(n)
        weight = np.cumsum(size - d)
        before = np.concatenate([[0.0], weight])[np.searchsorted(owner, np.arange(n))]
        at = np.searchsorted(weight, before[stay] + where[stay] * old[stay], side="right")
        first, last = np.searchsorted(owner, stay), np.searchsorted(owner, stay, side="right") - 1
        np.add.at(size, np.clip(at, first, last), 1)
        added = np.nonzero(opens)[0]
        order = np.argsort(np.concatenate([owner, added]), kind="stable")
        self.size = np.concatenate([size, np.ones(len(added), np.int64)])[order]
        self.owner = np.concatenate([owner, added])[order]


def one_restaurant(c: np.ndarray, p: np.ndarray, d: float, strength: float, rng: np.random.Generator, sweeps: int, burn_in: int) -> np.ndarray:
    """Tables of each dish of one restaurant, the sum over the sweeps past burn_in.  c: customers; p: what the parent predicts."""
    one = np.zeros(len(c), np.int64)
    t = seat(c, one, 1, p, d, strength, rng)
    tables, total = Tables(c, t, rng), np.zeros(len(c), np.int64)
    for i in range(sweeps):
        new = (strength + d * t.sum()) * p[tables.pairs]
        tables.sweep(new, p[tables.pairs], d, rng)
        t[tables.pairs] = tables.count()
        if i >= burn_in:
            total += t
    return total


class Level:
    """Pairs of a level in the order of (context, dish)."""

    def __init__(self, context: np.ndarray, dish: np.ndarray, dishes: int):
        self.contexts, self.rest = np.unique(context, return_inverse=True)
        self.key = self.rest.astype(np.int64) * dishes + dish
        self.dish, self.dishes = dish, dishes
        self.up: np.ndarray | None = None  # the pair's pair in the level above
        self.c = self.t = np.zeros(len(dish), np.int64)
        self.d = self.strength = 0.0

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.contexts)
        return np.bincount(self.rest, weights=self.c, minlength=n), np.bincount(self.rest, weights=self.t, minlength=n)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair, its own share of the prediction; of each context, the weight of its parent's."""
        customers, tables = self.totals()
        below = self.strength + customers
        return (self.c - self.d * self.t) / below[self.rest], (self.strength + self.d * tables) / below


class Hierarchy:
    """context, dish, count: the lowest level's pairs, each once.  A context of level n is a number of n digits to the base; without its first digit it is its parent."""

    def __init__(self, context: np.ndarray, dish: np.ndarray, count: np.ndarray, dishes: int, depth: int, base: int, strength: float = 1.0, seed: int = 0):
        order = np.lexsort((dish, context))
        context, dish = context[order], dish[order]
        self.dishes, self.rng = dishes, np.random.default_rng(seed)
        self.levels = [Level(context, dish, dishes)]
        self.levels[0].c = count[order].astype(np.int64)
        for digits in range(depth - 1, -1, -1):
            low = self.levels[0]
            up_context = (low.contexts % base**digits)[low.rest]
            pairs = np.unique(np.stack([up_context, low.dish]), axis=1)
            up = Level(pairs[0], pairs[1], dishes)
            low.up = np.searchsorted(up.key, np.searchsorted(up.contexts, up_context) * dishes + low.dish)
            up.c = np.bincount(low.up, weights=np.minimum(low.c, 1), minlength=len(up.dish)).astype(np.int64)
            self.levels.insert(0, up)
        for lv in self.levels:
            lv.d, lv.strength, lv.t = discount(lv.c), strength, np.minimum(lv.c, 1)

    def predicted(self) -> list[np.ndarray]:
        """What each level predicts for its pairs."""
        p, out = np.full(len(self.levels[0].dish), 1 / self.dishes), []
        for lv in self.levels:
            own, back = lv.parts()
            p = own + back[lv.rest] * (p if lv.up is None else p[lv.up])
            out.append(p)
        return out

    def sample(self, sweeps: int, burn_in: int):
        """Yields after each sweep past burn_in."""
        low, tables = self.levels[-1], None
        for i in range(sweeps):
            p = self.predicted()
            for depth in range(len(self.levels) - 1, -1, -1):
                lv = self.levels[depth]
                base = p[depth - 1][lv.up] if depth else np.full(len(lv.dish), 1 / self.dishes)
                if lv is low and tables is not None:
                    new = (lv.strength + lv.d * lv.totals()[1])[lv.rest] * base
                    tables.sweep(new[tables.pairs], base[tables.pairs], lv.d, self.rng)
                    lv.t[tables.pairs] = tables.count()
                else:
                    lv.t = seat(lv.c, lv.rest, len(lv.contexts), base, lv.d, lv.strength, self.rng)
                    if lv is low:
                        tables = Tables(lv.c, lv.t, self.rng)
                if depth:
                    up = self.levels[depth - 1]
                    up.c = np.bincount(lv.up, weights=lv.t, minlength=len(up.dish)).astype(np.int64)
            if i >= burn_in:
                yield i

    def average(self, sweeps: int = 12, burn_in: int = 6) -> "Predictive":
        parts, n = None, 0
        for _ in self.sample(sweeps, burn_in):
            now = [x for lv in self.levels for x in lv.parts()]
            parts, n = (now if parts is None else [a + b for a, b in zip(parts, now)]), n + 1
        parts = [x / n for x in parts]
        return Predictive(self.dishes, [(lv.contexts, lv.key, parts[2 * i], parts[2 * i + 1]) for i, lv in enumerate(self.levels)])


class Predictive:
    """Predictive probabilities from parts that are averaged over the samples: of each pair its own share, of each context its parent's weight."""

    def __init__(self, dishes: int, levels: list[tuple]):
        self.dishes, self.levels = dishes, levels

    def _find(self, known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
        return at, known[at] == wanted if len(known) else np.zeros(len(wanted), bool)

    def probability(self, contexts: list[np.ndarray], dish: np.ndarray) -> np.ndarray:
        """contexts: of each level from 0, for each dish."""
        p = np.full(len(dish), 1 / self.dishes)
        for context, (known, keys, own, back) in zip(contexts, self.levels):
            if not len(known):
                continue
            at, ok = self._find(known, context)
            pair, has = self._find(keys, at.astype(np.int64) * self.dishes + dish)
            p = np.where(ok, np.where(has, own[pair], 0.0) + back[at] * p, p)
        return p
