"""Composition of finite-state maps over arrays of symbols, without a step per symbol.

A symbol is a map of states to states, and a stretch of symbols is the composition of theirs. Neighbouring maps
are composed pair by pair, level by level; going back down the levels, the state that enters a stretch gives those that
enter its halves. The work is linear in the symbols, the number of steps is the logarithm.
"""

from __future__ import annotations

import numpy as np


def levels(maps: np.ndarray) -> list[np.ndarray]:
    """``maps`` (n, states), and the maps of ever longer stretches up to that of all; n is 1 at least."""
    out = [maps]
    while len(maps) > 1:
        if len(maps) % 2:
            maps = np.concatenate([maps, np.arange(maps.shape[1], dtype=maps.dtype)[None]])
        maps = np.take_along_axis(maps[1::2], maps[0::2], 1)
        out.append(maps)
    return out


def whole(maps: np.ndarray) -> np.ndarray:
    """The state that each entering state leaves with."""
    return levels(maps)[-1][0] if len(maps) else np.arange(maps.shape[1])


def entering(maps: np.ndarray, start: int) -> np.ndarray:
    """The state before each map if ``start`` is that before the first."""
    if not len(maps):
        return np.zeros(0, np.int64)
    state = np.array([start])
    for maps in levels(maps)[-2::-1]:
        both = np.empty(2 * len(state), np.int64)
        both[0::2] = state
        both[1::2] = maps[0 : 2 * len(state) : 2][np.arange(len(state)), state]
        state = both[: len(maps)]
    return state


def states(maps: np.ndarray, start: int) -> np.ndarray:
    """The state after each map."""
    before = entering(maps, start)
    return maps[np.arange(len(maps)), before] if len(maps) else before
