"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd

Batches = Iterator[pd.DataFrame]


def filled(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` without its empty results: an empty object column has no Arrow form that Spark accepts."""

    def only_filled(batches: Batches) -> Batches:
        for pdf in run(batches):
            if len(pdf):
                yield pdf

    return only_filled
