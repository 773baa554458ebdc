"""Recurrences over the ordered rows of a key, carried from batch to batch.

Rows are partitioned by key and sorted by key and order; a task reads them batch by batch and hands each key's fold from
one batch to the next. So a key of any length is worked on in the memory of one Arrow batch and of the fold's state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Fold(Protocol):
    """Takes the next rows of its key and returns result rows; ``end`` gives those left at the key's end."""

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame: ...

    def end(self) -> pd.DataFrame | None: ...


def _same(a: tuple, b: tuple | None) -> bool:
    return b is not None and all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b, strict=True))


def carried(df: DataFrame, key: Sequence[str], order: Sequence[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """(key, <schema>): what a new fold of ``make`` for each key returns for the key's rows in the order of ``order``,
    nulls first. ``order`` has to be total within a key for a defined result. Null keys are one key."""
    names = list(key)
    columns = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold: Fold | None = None
        at: tuple | None = None

        def named(rows: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
            if rows is not None and len(rows):
                rows = rows[columns].copy()
                for i, (name, value) in enumerate(zip(names, at, strict=True)):
                    rows.insert(i, name, value)
                yield rows

        for pdf in batches:
            if not len(pdf):
                continue
            before = pdf[names].shift()
            new = (pdf[names].ne(before) & ~(pdf[names].isna() & before.isna())).any(axis=1).to_numpy()
            new[0] = True
            starts = [*new.nonzero()[0].tolist(), len(pdf)]
            for a, b in zip(starts, starts[1:], strict=False):
                rows = pdf.iloc[a:b].reset_index(drop=True)
                now = tuple(rows[n].iloc[0] for n in names)
                if fold is None or not _same(now, at):
                    if fold is not None:
                        yield from named(fold.end())
                    fold, at = make(), now
                yield from named(fold(rows))
        if fold is not None:
            yield from named(fold.end())

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInPandas(run, f"{kinds}, {schema}")
