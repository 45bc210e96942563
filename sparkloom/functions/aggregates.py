"""Aggregates of the user's own, with partial results before the shuffle."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def user_aggregate(df: DataFrame, keys: list[str], state: str, partial: Callable[[pd.DataFrame], dict], merge: Callable[[pd.DataFrame], dict], result: str, finish: Callable[[dict], dict]) -> DataFrame:
    """A row a group: ``partial`` makes a state from some rows of a group, ``merge`` one from several states,
    ``finish`` the result's columns from the last one.

    Each Arrow batch gives a state a group at most, so a group with much of the table is a few states when it
    reaches one task.  state and result are schemas without the keys.
    """
    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [part.split()[0] for part in state.split(", ")]

    def before(batches):
        for batch in batches:
            rows = [(*(k if isinstance(k, tuple) else (k,)), *partial(group).values()) for k, group in batch.groupby(keys, dropna=False)]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    def behind(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | finish(merge(states[names]))])

    states = df.mapInPandas(before, f"{own}, {state}")
    return states.groupBy(*keys).applyInPandas(behind, f"{own}, {result}")
