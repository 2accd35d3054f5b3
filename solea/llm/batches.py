"""Arrow batches in small slices, so that a Python step holds the results of few rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

SLICE_ROWS = 256


def slices(batches: Iterator, rows: int = SLICE_ROWS) -> Iterator:
    """Series, or tuples of Series, cut into pieces of at most ``rows`` rows; an empty batch gives one empty piece."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for first in range(0, max(1, len(columns[0])), rows):
            piece = tuple(c.iloc[first : first + rows] for c in columns)
            yield piece if isinstance(batch, tuple) else piece[0]


def arrow_slices(batches: Iterator, rows: int = SLICE_ROWS) -> Iterator[tuple[list, ...]]:
    """Tuples of Arrow arrays as Python lists of at most ``rows`` rows; what is not yet in a slice stays packed."""
    for batch in batches:
        for first in range(0, max(1, len(batch[0])), rows):
            yield tuple(c.slice(first, rows).to_pylist() for c in batch)
