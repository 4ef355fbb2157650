"""Order-dependent folds that a window cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any],
                 step: Callable[[Any, Any], tuple[Any, tuple | None]], schema: str) -> DataFrame:
    """Run ``step(state, row)`` over each key in order, batch by batch.

    Rows are hashed by key and sorted inside the partition; only the running state and one
    Arrow batch are in memory, whatever the length of a key."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        state: Any = None
        for pdf in batches:
            produced = []
            key_rows = pdf[keys].itertuples(index=False, name=None)
            for key, row in zip(key_rows, pdf.itertuples(index=False)):
                if key != current:
                    current, state = key, start()
                state, made = step(state, row)
                if made is not None:
                    produced.append(made)
            yield pd.DataFrame(produced, columns=names)

    ready = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ready.mapInPandas(run, schema)
