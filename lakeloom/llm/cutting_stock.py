"""Cutting stock by column generation: patterns of piece lengths that fill sequences of a fixed capacity.

The linear program asks for the fewest sequences that hold a histogram of pieces. Its columns are patterns;
new ones are priced by a knapsack over the duals, solved by dynamic programming, until none would lower the
objective. Solutions are rounded down, and what is left is filled largest first. The histogram has at most
as many entries as there are lengths, so everything here has a fixed bound whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Pattern:
    """``uses`` sequences that each hold these sizes, largest first."""

    sizes: tuple[int, ...]
    uses: int


def best_knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value, and how often each size is taken, within the capacity."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    for room in range(1, capacity + 1):
        best[room], taken[room] = best[room - 1], -2
        fits = useful[sizes[useful] <= room]
        if len(fits):
            worth = best[room - sizes[fits]] + values[fits]
            k = int(worth.argmax())
            if worth[k] > best[room] + 1e-12:
                best[room], taken[room] = worth[k], fits[k]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if taken[room] >= 0:
            counts[taken[room]] += 1
            room -= sizes[taken[room]]
        elif taken[room] == -2:
            room -= 1
        else:
            break
    return float(best[capacity]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 1e-3, patience: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (columns) and their fractional uses.

    Ends when the duals prove the uses to be within ``tolerance`` of the optimum, or when ``patience`` columns
    in a row have gained less than a tenth of that. A slight slope on the demand keeps the basis from cycling.
    """
    m = len(sizes)
    demand = demand + 1e-3 * (1 + np.arange(m)) / m
    copies = np.maximum(1, capacity // sizes)
    basis = np.diag(copies).astype(float)
    inverse = np.diag(1.0 / copies)
    uses = demand / copies
    step, mark = 0, uses.sum()
    while True:
        value, column = best_knapsack(inverse.sum(axis=0), sizes, capacity)
        if value <= 1 + tolerance:
            break
        direction = np.einsum("ij,j->i", inverse, column)  # no threaded library in the driver
        rising = np.flatnonzero(direction > 1e-9)
        ratios = uses[rising] / direction[rising]
        out = int(rising[ratios.argmin()])
        amount = uses[out] / direction[out]
        uses -= amount * direction
        uses[out] = amount
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        step += 1
        if step % patience == 0:
            error = -np.einsum("ij,jk->ik", basis, inverse)
            error[np.diag_indices(m)] += 2
            inverse = np.einsum("ij,jk->ik", inverse, error)  # a Newton step against drift
            uses = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
            if uses.sum() > mark * (1 - tolerance / 10):
                break
            mark = uses.sum()
    return basis.round().astype(np.int64), np.maximum(uses, 0)


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold exactly the pieces of ``histogram`` (size: count)."""
    sizes = np.array(sorted((s for s, n in histogram.items() if n), reverse=True), np.int64)
    if not len(sizes):
        return []
    if sizes[0] > capacity or sizes[-1] < 1:
        raise ValueError("sizes must be from 1 to the capacity")
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    columns, uses = solve(sizes, left.astype(float), capacity)
    out = []
    for k in np.argsort(-uses, kind="stable"):
        column, times = columns[:, k], int(uses[k] + 1e-9)
        held = np.flatnonzero(column)
        times = min([times, *(int(left[c] // column[c]) for c in held)])
        if times > 0:
            left[held] -= times * column[held]
            out.append(Pattern(tuple(np.repeat(sizes, column).tolist()), times))
    while left.any():
        column, room = np.zeros(len(sizes), np.int64), capacity
        for c, size in enumerate(sizes):
            column[c] = min(left[c], room // size)
            room -= column[c] * size
        held = np.flatnonzero(column)
        times = int((left[held] // column[held]).min())
        left[held] -= times * column[held]
        out.append(Pattern(tuple(np.repeat(sizes, column).tolist()), times))
    return out
