"""Ordered scans for recursions that a window can't express.

A scan deals the rows out by series, sorts each task's rows by series and order,
and runs through them batch by batch. A kernel holds a series' state; it sees one
row at a time and returns the row's values. Only the state and the current batch
are in memory, so that a series of any length fits; several kernels of one call
share a single shuffle and pass. The same kernels drive the streaming operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

Row = dict[str, Any]


class Kernel:
    """State of one series. ``reads`` and ``makes`` name its input columns and its results (name and type)."""

    reads: tuple[str, ...] = ()
    makes: tuple[tuple[str, str], ...] = ()

    def step(self, *values: Any) -> tuple:
        raise NotImplementedError


def scan(df: DataFrame, kernels: list[Callable[[], Kernel]], keys: tuple[str, ...] = ("symbol", "tf"), order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """All columns of ``df`` and those that the kernels make."""
    samples = [k() for k in kernels]
    made = [StructField(n, _parse_datatype_string(t)) for s in samples for n, t in s.makes]
    names = [f.name for f in made]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = StructType([*kept, *made])
    reads = [s.reads for s in samples]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, []
        for batch in batches:
            if not len(batch):
                continue
            out: list[list] = [[] for _ in made]
            ids = list(zip(*(batch[k] for k in keys), strict=True))
            columns = [[_values(batch[c]) for c in r] for r in reads]
            for i, key in enumerate(ids):
                if key != current:
                    current, state = key, [k() for k in kernels]
                at = 0
                for kernel, cols in zip(state, columns, strict=True):
                    for value in kernel.step(*(c[i] for c in cols)):
                        out[at].append(value)
                        at += 1
            yield pd.concat([batch[[f.name for f in kept]], pd.DataFrame(dict(zip(names, out, strict=True)), index=batch.index, dtype=object)], axis=1)

    return df.drop(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _values(column: pd.Series) -> list:
    """Python values with None for nulls (NaN included)."""
    return column.astype(object).where(column.notna(), None).tolist()
