"""Chinese-restaurant seating of many dishes at once, by Gibbs sampling.

A dish with c customers has tables; a customer joins a table with weight (its customers - discount)
or opens one with weight (strength + discount * tables of the restaurant) * base probability. A sweep
takes each customer of each dish from its table and seats it again. All dishes take their i-th
customer at the same time; within a dish that is exact Gibbs sampling, while the restaurant's
tables are those of before the sweep.

A dish of more than ``PARTY`` customers comes in parties of that size, each of which sits at tables
of its own. So no dish makes a sweep longer than ``PARTY`` steps, and a dish has at least one table
for each party: its tables are overstated by at most one in ``PARTY`` customers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PARTY = 1024
#: Tables that are proposed at once to customers that did not take the first.
PROPOSALS = 12


def seatings(c: np.ndarray, restaurant: np.ndarray, base: np.ndarray, elsewhere: np.ndarray, discount: float, strength: float, burn: int, samples: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Tables of each dish (customers c, at least 1), as often as samples says, after a first seating and burn sweeps.

    restaurant: the place of each dish's restaurant in elsewhere, which holds its tables of other dishes.
    """
    lanes = -(-c // PARTY)
    dish = np.repeat(np.arange(len(c)), lanes)
    nth = np.arange(len(dish)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    size = np.minimum(PARTY, c[dish] - nth * PARTY)
    by = np.argsort(-size, kind="stable")
    dish, size = dish[by], size[by]
    # one customer has a table; two share one or not, which is drawn at once; more are seated one by one
    many, some = np.searchsorted(-size, [-2, -1], side="left")
    state = _Seats(size[:many], discount)
    room, chance = restaurant[dish], base[dish]
    sat = np.ones(len(dish), np.int64)
    tables = lanes.astype(np.int64)
    for sweep in range(1 + burn + samples):
        held = elsewhere + np.bincount(restaurant, tables, len(elsewhere))
        weight = (strength + discount * held[room]) * chance
        state.sweep(weight[:many], sweep == 0, rng)
        sat[:many] = state.tables
        two = weight[many:some]
        sat[many:some] = 1 + (rng.random(len(two)) * (two + 1 - discount) < two)
        tables = np.bincount(dish, sat, len(c)).astype(np.int64)
        if sweep > burn:
            yield tables


class _Seats:
    """Customers of lanes, largest lane first: the table of each, the customers at each table, and the free tables of each lane."""

    def __init__(self, size: np.ndarray, discount: float):
        self.size, self.discount = size, discount
        self.at = np.cumsum(size) - size
        total = int(size.sum())
        self.table, self.seated, self.spare = (np.zeros(total, np.int32) for _ in range(3))
        self.tables, self.used, self.spares = (np.zeros(len(size), np.int32) for _ in range(3))
        # lanes that have an i-th customer
        self.active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")

    def sweep(self, weight: np.ndarray, first: bool, rng: np.random.Generator) -> None:
        for i, k in enumerate(self.active.tolist()):
            place = self.at[:k] + i
            if not first:
                self._leave(place, k)
            self._sit(place, k, weight[:k], np.full(k, i) if first else self.size[:k] - 1, None if first else i, rng)

    def _leave(self, place: np.ndarray, k: int) -> None:
        table = self.table[place]
        where = self.at[:k] + table
        self.seated[where] -= 1
        gone = np.flatnonzero(self.seated[where] == 0)
        self.tables[gone] -= 1
        self.spare[self.at[gone] + self.spares[gone]] = table[gone]
        self.spares[gone] += 1

    def _sit(self, place: np.ndarray, k: int, weight: np.ndarray, others: np.ndarray, skip: int | None, rng: np.random.Generator) -> None:
        opens = rng.random(k) * (weight + others - self.discount * self.tables[:k]) < weight
        opens |= others == 0
        new = np.flatnonzero(opens)
        again = self.spares[new] > 0
        old, fresh = new[again], new[~again]
        self.spares[old] -= 1
        self.table[place[old]] = self.spare[self.at[old] + self.spares[old]]
        self.table[place[fresh]] = self.used[fresh]
        self.used[fresh] += 1
        self.tables[new] += 1
        # the table of any other customer, which is by size; kept with what the discount leaves of it
        left = np.flatnonzero(~opens)
        tries = 1
        while len(left):
            j = (rng.random((tries, len(left))) * others[left]).astype(np.int64)
            if skip is not None:
                j += j >= skip
            at = self.at[left]
            table = self.table[at + j]
            stays = rng.random(j.shape) * self.seated[at + table] >= self.discount
            some = stays.any(axis=0)
            first = stays.argmax(axis=0)[some]
            self.table[place[left[some]]] = table[first, np.flatnonzero(some)]
            left, tries = left[~some], PROPOSALS
        self.seated[self.at[:k] + self.table[place]] += 1
