"""Regions of many images at once, in memory: arrays of horizontal runs ordered by image, row and start.

An image is small, so its regions are found where the image is: no step here looks at another image, and none needs a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Runs:
    """Runs ``row, start, stop`` (ends included) of images numbered from 0; ``height`` and ``width`` per image."""

    image: np.ndarray
    row: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    height: np.ndarray
    width: np.ndarray

    def take(self, which: np.ndarray) -> Runs:
        return Runs(self.image[which], self.row[which], self.start[which], self.stop[which], self.height, self.width)

    def area(self, images: int) -> np.ndarray:
        """Pixels per image."""
        return np.bincount(self.image, self.stop - self.start + 1, images).astype(np.int64)


def touching(runs: Runs, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring rows of an image that touch; ``reach`` 1 counts corners too."""
    if not len(runs.row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = runs.image * (runs.row.max() + 2) + runs.row  # the row after an image's last one is empty
    span = runs.stop.max() + reach + 2
    first = np.searchsorted(line * span + runs.stop, (line + 1) * span + runs.start - reach)
    last = np.searchsorted(line * span + runs.start, (line + 1) * span + runs.stop + reach, side="right")
    n = np.maximum(last - first, 0)
    above = np.repeat(np.arange(len(n)), n)
    return above, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def components(runs: Runs, connectivity: int) -> np.ndarray:
    """For each run the first run of its component: union-find over the touching pairs.

    A round hangs the larger of two roots under the smaller one and then shortens all paths, for every pair that is still apart.
    """
    a, b = touching(runs, 1 if connectivity == 8 else 0)
    parent = np.arange(len(runs.row))
    while len(a):
        x, y = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    return parent


def complement(runs: Runs) -> Runs:
    """The runs of all other pixels."""
    lines = int(runs.height.sum())
    offset = np.cumsum(runs.height) - runs.height
    image = np.repeat(np.arange(len(runs.height)), runs.height)
    row = np.arange(lines) - offset[image]
    line = np.concatenate([offset[runs.image] + runs.row, np.arange(lines)])  # each line ends with a run behind its last pixel
    start = np.concatenate([runs.start, runs.width[image]])
    stop = np.concatenate([runs.stop, runs.width[image]])
    order = np.lexsort((start, line))
    line, start, stop = line[order], start[order], stop[order]
    free = np.concatenate([[0], stop[:-1] + 1])
    free[np.concatenate([[True], line[1:] != line[:-1]])] = 0
    gap = free < start
    return Runs(image[line[gap]], row[line[gap]], free[gap], start[gap] - 1, runs.height, runs.width)


def filled(runs: Runs) -> Runs:
    """Background that is not 4-connected to the border becomes foreground."""
    ground = complement(runs)
    root = components(ground, 4)
    border = (ground.row == 0) | (ground.row == ground.height[ground.image] - 1) | (ground.start == 0) | (ground.stop == ground.width[ground.image] - 1)
    outside = np.zeros(len(root), bool)
    outside[root[border]] = True
    return complement(ground.take(outside[root]))


def dilated(runs: Runs, height: np.ndarray, width: int) -> Runs:
    """Dilation by a rectangle of ``height`` (per image) x ``width``. An even side reaches one cell further ahead than back."""
    high = height[runs.image]
    at = np.repeat(np.arange(len(high)), high)
    row = np.arange(high.sum()) - np.repeat(np.cumsum(high) - high, high) + (runs.row - high // 2)[at]
    at, row = at[inside := (row >= 0) & (row < runs.height[runs.image[at]])], row[inside]
    image = runs.image[at]
    start, stop = np.maximum(runs.start[at] - width // 2, 0), np.minimum(runs.stop[at] + (width - 1) // 2, runs.width[image] - 1)
    line, span = (np.cumsum(runs.height) - runs.height)[image] + row, int(runs.width.max(initial=0)) + 2
    order = np.argsort(line * span + start, kind="stable")
    first, last = (line * span + start)[order], np.maximum.accumulate((line * span + stop)[order])
    fresh = np.flatnonzero(np.append(True, first[1:] > last[:-1] + 1)) if len(first) else np.zeros(0, np.int64)
    order, last = order[fresh], last[np.append(fresh[1:], len(first)) - 1]
    return Runs(image[order], row[order], start[order], last - line[order] * span, runs.height, runs.width)


def largest(runs: Runs, root: np.ndarray, later_wins: bool) -> Runs:
    """The largest component of each image; of equal ones the later or the first."""
    size = np.bincount(root, runs.stop - runs.start + 1, len(root))
    roots = np.unique(root)
    order = roots[np.lexsort((roots if later_wins else -roots, size[roots], runs.image[roots]))]
    best = order[np.append(runs.image[order][1:] != runs.image[order][:-1], True)] if len(order) else order
    return runs.take(np.isin(root, best))


def smooth_labels(label: np.ndarray, energy: np.ndarray, row: np.ndarray, col: np.ndarray, height: np.ndarray, width: np.ndarray, first: np.ndarray, beta: float,
                  max_sweeps: int, tol: float) -> np.ndarray:
    """Iterated conditional modes on the dense label planes of many images, one after the other from ``first``.

    In a sweep every pixel takes the label of least energy plus ``beta`` for each of its four sides that has another label or none; first
    on ties. An image rests once fewer than ``tol`` of its pixels have moved.
    """
    size = np.diff(np.append(first, len(label)))
    image = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(label))
    sides = []  # for each side the pixels that have a neighbour there, and the neighbour
    for here, step in ((col > 0, -1), (col < width[image] - 1, 1), (row > 0, -width[image]), (row < height[image] - 1, width[image])):
        sides.append((here, at + step))
    label, restless = label.copy(), np.ones(len(first), bool)
    for _ in range(max_sweeps):
        live = np.flatnonzero(restless[image])
        equal = np.zeros((len(live), energy.shape[1]))
        for here, near in sides:
            have = np.flatnonzero(here[live])
            equal[have, label[near[live[have]]]] += 1
        new = (energy[live] + beta * (4.0 - equal)).argmin(1)
        moved = np.bincount(image[live], new != label[live], len(first))
        label[live] = new
        restless &= moved / size >= tol
        if not restless.any():
            break
    return label
