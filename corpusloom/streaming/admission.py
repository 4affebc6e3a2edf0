"""Sliding-window admission on a stream: the state of a key is its last accepted times."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.operators.admission import LIMIT, WINDOW_SECONDS


def admit_stream(requests: DataFrame, key: str, at: str, order: str, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> DataFrame:
    """(``key``, ``order``, accepted) for a stream with those columns and ``at`` (seconds as double).

    Requests of one trigger are taken in the order of time; one that arrives in a later trigger is judged by what has been accepted
    by then.  A key's state goes when a whole window has passed since its last request by the clock of processing.  Such time-outs make
    Spark run batches without data for ever; a query that shall end (trigger availableNow) must be started while the session's setting
    spark.sql.streaming.noDataMicroBatches.enabled is false, and its states go in a later run."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    types = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def run(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        rows = pd.concat(frames).sort_values([at, order], kind="stable")
        out = []
        for t in rows[at].tolist():
            ok = limit > 0 and (len(taken) < limit or taken[-limit] < t - window)
            if ok:
                taken = [*taken, t][-limit:]
            out.append(ok)
        state.update((taken,))
        state.setTimeoutDuration(max(1000, int(window * 1000)))
        yield pd.DataFrame({key: [k[0]] * len(out), order: rows[order].tolist(), "accepted": out})

    return requests.select(key, order, at).groupBy(key).applyInPandasWithState(
        run, f"`{key}` {types[key]}, `{order}` {types[order]}, accepted boolean", "taken array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
