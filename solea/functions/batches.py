"""Python steps over sorted partitions: frames that hold whole groups, many small ones at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

ROWS = 100_000  # a task holds several arrays of as many numbers, whatever the size of its partition


def starts(pdf: pd.DataFrame, key: list[str]) -> pd.Series:
    """True at the first row of each group; equal keys are neighbours, and nulls equal each other."""
    before = pdf[key].shift()
    differs = ((pdf[key] != before) & ~(pdf[key].isna() & before.isna())).any(axis=1)
    differs.iloc[:1] = True
    return differs


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    """Frames of about ``rows`` rows that end where a group ends; a larger group is a frame of its own."""
    held, size, wanted = [], 0, rows
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= wanted:
            whole = pd.concat(held, ignore_index=True)
            last = starts(whole, key).to_numpy().nonzero()[0][-1]
            if last:
                yield whole.iloc[:last].reset_index(drop=True)
            held, size = [whole.iloc[last:]], len(whole) - last
            wanted = max(rows, 2 * size)  # a long group is not copied again for each of its batches
    if size:
        yield pd.concat(held, ignore_index=True)
