"""Draws and boards against a plain board that takes one event after the other."""

import random

import pytest

from loamworks.operators import brackets

SLOTS, EVENTS = "bracket int, slot int, entrant int", "bracket int, seq int, round int, match int, winner int"


class Board:
    def __init__(self, slots):
        self.slots, self.win = slots, []
        size = len(slots)
        while size > 1:
            size //= 2
            self.win.append([None] * size)
        for m in range(len(self.win[0])):
            a, b = slots[2 * m : 2 * m + 2]
            if (a is None) != (b is None):
                self.win[0][m] = b if a is None else a

    def entrants(self, r, m):
        return tuple((self.slots if r == 0 else self.win[r - 1])[2 * m : 2 * m + 2])

    def set(self, r, m, w):
        a, b = self.entrants(r, m)
        if w not in (a, b) or w is None or (r and None in (a, b)):
            return
        old, self.win[r][m] = self.win[r][m], w
        if old is not None and old != w:
            for k in range(r + 1, len(self.win)):
                m //= 2
                if self.win[k][m] is None:
                    break
                self.win[k][m] = None

    def rows(self, bracket):
        return [(bracket, r, m, *self.entrants(r, m), w, w is None and None not in self.entrants(r, m)) for r, row in enumerate(self.win) for m, w in enumerate(row)]


def drawn(r, size, n):
    seats = list(range(n)) + [None] * (size - n)
    while any(seats[k] is None and seats[k + 1] is None for k in range(0, size, 2)):
        r.shuffle(seats)
    return seats


@pytest.mark.parametrize("seed", [0, 1])
def test_boards(spark, seed):
    r = random.Random(seed)
    slots, events, want = [], [], []
    for bracket, (size, n) in enumerate([(4, 3), (8, 8), (8, 5), (16, 16), (16, 11), (2, 2)]):
        seats = drawn(r, size, n)
        board = Board(seats)
        slots += [(bracket, k, e) for k, e in enumerate(seats)]
        for seq in range(0, 90):
            k = r.randrange(len(board.win))
            m = r.randrange(len(board.win[k]))
            known = [x for x in board.entrants(k, m) if x is not None]
            w = r.choice(known) if known and r.random() < 0.85 else r.randrange(n)
            events.append((bracket, seq, k, m, w))
            board.set(k, m, w)
        want += board.rows(bracket)
    r.shuffle(events)
    got = brackets.boards(spark.createDataFrame(slots, SLOTS), spark.createDataFrame(events + [(0, 500, 9, 9, 1), (77, 1, 0, 0, 1)], EVENTS))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_changed_result_clears_what_hangs_on_it(spark):
    slots = spark.createDataFrame([(0, k, k) for k in range(8)], SLOTS)
    events = [(0, 0, 0, 0, 0), (0, 1, 0, 1, 2), (0, 2, 1, 0, 0), (0, 3, 0, 2, 4), (0, 4, 0, 3, 6), (0, 5, 1, 1, 4), (0, 6, 2, 0, 0), (0, 7, 0, 1, 3)]
    got = {(r["round"], r["match"]): (r["winner"], r["ready"]) for r in brackets.boards(slots, spark.createDataFrame(events, EVENTS)).collect()}
    assert got == {(0, 0): (0, False), (0, 1): (3, False), (0, 2): (4, False), (0, 3): (6, False), (1, 0): (None, True), (1, 1): (4, False), (2, 0): (None, False)}


def test_draws(spark):
    sizes = {0: (16, 16), 1: (16, 9), 2: (8, 5), 3: (16, 11), 4: (4, 4)}
    pairs = {0: [(1, 2), (3, 9), (15, 5)], 1: [(0, 8)], 3: [(0, 1), (2, 3), (4, 5), (6, 7)], 4: [(0, 3)]}
    entrants = spark.createDataFrame([(b, e) for b, (_, n) in sizes.items() for e in range(n)], "bracket int, entrant int")
    asked = spark.createDataFrame([(b, *p) for b, ps in pairs.items() for p in ps], "bracket int, a int, b int")
    looks = set()
    for seed in range(4):
        got = {}
        for r in brackets.draw(entrants, asked, spark.createDataFrame([(b, s) for b, (s, _) in sizes.items()], "bracket int, size int"), seed).collect():
            got.setdefault(r["bracket"], {})[r["slot"]] = r["entrant"]
        for b, (size, n) in sizes.items():
            seats = [got[b][k] for k in range(size)]
            assert len(got[b]) == size and sorted(x for x in seats if x is not None) == list(range(n))
            assert not any(seats[k] is None and seats[k + 1] is None for k in range(0, size, 2))
            if b != 3:  # four pairs don't fit beside five byes
                assert all(seats.index(x) ^ 1 == seats.index(y) for x, y in pairs.get(b, []))
        looks.add(str(got[0]))
    assert len(looks) > 1


def test_query(spark, sf):
    from loamworks.plans import catalogue
    from loamworks.plans.graphs import bracket_tables

    slots, events = (x.collect() for x in bracket_tables(spark, sf))
    plain = {}
    for r in slots:
        plain.setdefault(r["bracket"], {})[r["slot"]] = r["entrant"]
    plain = {b: Board([seats[k] for k in range(8)]) for b, seats in plain.items()}
    for r in sorted(events, key=lambda r: r["seq"]):
        plain[r["bracket"]].set(r["round"], r["match"], r["winner"])
    got = sorted(map(tuple, catalogue.QUERIES["bracket_boards"](spark, sf).collect()), key=str)
    assert got == sorted((row for b, board in plain.items() for row in board.rows(b)), key=str)
