"""Arrow functions that are declared without a session and made at their first use."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import Iterator, Tuple

import pandas as pd
from pyspark.sql import functions as F

#: Rows, and characters or items, that a function takes at a time at most; a single longer row is taken by itself.
PART_ROWS, PART_SIZE = 500, 1 << 18


def parts(columns: Sequence[pd.Series], most: int = PART_SIZE) -> Iterator[tuple[pd.Series, ...]]:
    """A batch in parts, so that what a function makes of one part is sent off before the next is begun."""
    begin, size = 0, 0
    for at, row in enumerate(zip(*columns)):
        own = sum(len(v) for v in row if hasattr(v, "__len__"))
        if at - begin == PART_ROWS or at > begin and size + own > most:
            yield tuple(c.iloc[begin:at].reset_index(drop=True) for c in columns)
            begin, size = at, 0
        size += own
    yield tuple(c.iloc[begin:].reset_index(drop=True) for c in columns)


def arrow(returns: str, once: bool = False, size: int = PART_SIZE):
    """Like pandas_udf, for modules that are imported before any session exists; batches are taken in parts, so memory does not grow with a batch's rows.

    `once` is for costly functions: filters of what they return do not call them a second time. `size` is for those whose results are many times what they are given.
    """

    def declare(function):
        def run(batches):
            for batch in batches:
                for part in parts(batch if isinstance(batch, tuple) else (batch,), size):
                    yield function(*part)

        made = pd.DataFrame if function.__annotations__.get("return") in ("pd.DataFrame", pd.DataFrame) else pd.Series

        @functools.wraps(function)
        def column(*columns):
            given = Tuple[pd.Series, ...] if len(columns) > 1 else pd.Series
            run.__annotations__ = {"batches": Iterator[given], "return": Iterator[made]}
            udf = F.pandas_udf(run, returns)
            return (udf.asNondeterministic() if once else udf)(*columns)

        return column

    return declare
