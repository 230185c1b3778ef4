"""Work that must pass the rows of a key in order, one after another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold_by_key(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple | None], schema: str) -> DataFrame:
    """Rows that ``step(state, row)`` returns (None: no row); ``start()`` gives the state at each new key. Rows stream through in batches, so
    that a key needs no more memory than its state, however many rows it has."""
    columns = rows.columns
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if row[0] != current:
                    current, state = row[0], start()
                made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    at = [key, *[c for c in columns if c != key]]
    return rows.where(rows[key].isNotNull()).select(*at).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
