"""Votes that lie on the edges of cells: crops at multiples of half a cell, turns of odd multiples of 15 degrees."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from basketlake.llm import media


@pytest.mark.parametrize(("sx", "sy", "turn", "grow"), list(product((0.0, 0.5), (0.0, 0.5), (0.0, 0.5, 11.999, 1.5), (0.0, 0.5))))
def test_votes_around_an_edge_are_one_group(sx, sy, turn, grow):
    n = 6
    jitter = np.where(np.arange(n) % 2, 0.01, -0.01)
    votes = {"x": np.arange(n) * 1.0, "y": np.zeros(n), "q_x": np.arange(n) * 1.0, "q_y": np.ones(n)}
    # each of the four has its own half below the edge
    votes |= {c: v + jitter[np.roll(np.arange(n), i)] for i, (c, v) in enumerate({"sx": sx, "sy": sy, "turn": turn, "grow": grow}.items())}
    votes["turn"] %= media.TURNS
    assert media.most_agreeing(np.zeros(n, dtype=np.int64), votes, 1).tolist() == [n]


def test_votes_of_pairs_stay_apart():
    votes = {c: np.zeros(6) for c in "x y q_x q_y sx sy turn grow".split()} | {"x": np.arange(6.0), "q_x": np.array([0.0, 1, 2, 0, 0, 0])}
    assert media.most_agreeing(np.array([0, 0, 0, 2, 2, 2]), votes, 4).tolist() == [3, 0, 1, 0]
    assert media.most_agreeing(np.zeros(0, dtype=np.int64), {c: np.zeros(0) for c in votes}, 2).tolist() == [0, 0]
