"""A step function as a stateful stream: state per key, rows of a micro-batch in event order."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geostride.session import ship

Row = dict[str, Any]
Step = Callable[[Any, Row], tuple[Any, dict]]


def plain(value: Any) -> Any:
    """None for a missing value, Python numbers for numpy ones."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") and not hasattr(value, "__len__") else value


def rows_of(frame: pd.DataFrame) -> Iterator[Row]:
    for values in frame.itertuples(index=False, name=None):
        yield {c: plain(v) for c, v in zip(frame.columns, values, strict=True)}


def stream_fold(rows: DataFrame, step: Step, adds: str, key: str = "device", order: str = "ms", silent_ms: int | None = None, on_silence: Callable[[Any], tuple[Any, dict]] | None = None) -> DataFrame:
    """Each row with the columns that step adds, the state of each key kept between micro-batches (pickled). Late rows of
    an earlier micro-batch are folded when they come: the steps are of arrival, as in the device.

    With silent_ms, a key without rows for so long (by the clock) gives one row of its own: the key, nulls, and what
    on_silence adds to its state."""
    ship(rows.sparkSession)
    columns, names = rows.columns, [f.split()[0] for f in adds.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), adds])

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pickle.loads(state.get[0]) if state.exists else None  # noqa: S301  written by this function only
        if state.hasTimedOut:
            kept, added = on_silence(kept)
            state.update((pickle.dumps(kept),))
            row = dict.fromkeys(columns) | {key: name[0]} | {n: added[n] for n in names}
            yield pd.DataFrame([row], columns=[*columns, *names]).astype(object)
            return
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for r in rows_of(frame):
            kept, added = step(kept, r)
            out.append(tuple(added[n] for n in names))
        state.update((pickle.dumps(kept),))
        if silent_ms is not None:
            state.setTimeoutDuration(silent_ms)
        yield pd.concat([frame.reset_index(drop=True)[columns], pd.DataFrame(out, columns=names)], axis=1)

    timeout = GroupStateTimeout.NoTimeout if silent_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", timeout)


def batch_fold(frame: pd.DataFrame, step: Step, key: str = "device", order: str = "ms") -> list[dict]:
    """The same over rows in memory: what a stream has to give."""
    state: dict[Any, Any] = {}
    out = []
    for r in rows_of(frame.sort_values([key, order], kind="stable")):
        state[r[key]], added = step(state.get(r[key]), r)
        out.append(r | added)
    return out
