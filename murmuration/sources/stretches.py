"""Long simulated series: a task walks many series side by side and gives their steps out in stretches.

A step needs the one before, so a series stays in its task; only the present
state of its series is kept there, whatever the number of steps. Noise is keyed
by series and step, so a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.noise_arrays import arrays_of
from ..functions.rng import Keyed, Scripted
from ..operators.models import Model, RsGarch
from ..operators.packed import gridded

#: Rows of a stretch, over all series of a batch.
ROWS = 1 << 16
STATE = ("r", "vol", "q")
THETA = tuple(f"p{k}" for k in range(9))

Walk = Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]]


def walked(starts: DataFrame, step: Walk, told: dict[str, str], steps: int, tasks: int | None = None) -> DataFrame:
    """``series_id, t`` and the ``told`` columns for t = 1..steps of each row of ``starts``.

    ``step(state, t)`` gives the next columns of all series of a batch from
    the last ones, and what it tells. The state has one row per series.
    """
    tasks = tasks or starts.sparkSession.sparkContext.defaultParallelism
    kind = starts.schema["series_id"].dataType.simpleString()

    def stretch(series: pa.Array, began: int, rows: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        n = len(series)
        places = pa.array(np.repeat(np.arange(n), len(rows)))
        t = np.tile(np.arange(began, began + len(rows), dtype=np.int32), n)
        columns = [pa.array(np.stack([r[c] for r in rows], axis=1).ravel()) for c in told]
        return pa.RecordBatch.from_arrays([series.take(places), pa.array(t), *columns], names=["series_id", "t", *told])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            series = batch.column(batch.schema.get_field_index("series_id"))
            state = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(batch.schema.names)}
            width, rows, began = max(1, ROWS // batch.num_rows), [], 1
            for t in range(1, steps + 1):
                state = {**state, **step(state, t)}
                rows.append(state)
                if len(rows) == width:
                    yield stretch(series, began, rows)
                    rows, began = [], t + 1
            if rows:
                yield stretch(series, began, rows)

    schema = ", ".join([f"series_id {kind}", "t int", *[f"{c} {k}" for c, k in told.items()]])
    return starts.repartition(tasks, "series_id").mapInArrow(run, schema)


def long_series(starts: DataFrame, model: Model, steps: int, source: Keyed | Scripted = Keyed(), dt: float = 1.0, grid: float | None = None) -> DataFrame:
    """``series_id, t, x, y`` for t = 1..steps from ``starts(series_id, x)``, in time proportional to steps.

    Rows without series_id or x are left out, other columns dropped; repeated
    rows of a series are the series twice; no rows or steps give no rows.
    """

    def step(state, t):
        noise = arrays_of(source)
        x = gridded(model.propagate(state["x"], t * dt, noise.normal("move", t, state["series_id"])), grid)
        return {"x": x, "y": model.observe(x, noise.normal("observe", t, state["series_id"]))}

    rows = starts.where("series_id is not null and x is not null").selectExpr("series_id", "cast(x as double) as x")
    return walked(rows, step, {"x": "double", "y": "double"}, steps)


def long_garch(starts: DataFrame, steps: int, source: Keyed | Scripted = Keyed(), grid: float | None = None) -> DataFrame:
    """``series_id, t, r, vol, q, y`` for t = 1..steps from ``starts(series_id, r, vol, q, p0..p8)``: mode, volatility, return, observation.

    Parameters stay with their series. Rows with a null among these columns
    are left out; otherwise as :func:`long_series`.
    """
    model = RsGarch()

    def step(state, t):
        noise, series = arrays_of(source), state["series_id"]
        p = lambda k: state[f"p{k}"]
        q = model.next_mode(state["q"], state["vol"], p, noise.uniform("mode", t, series)).astype(np.int32)
        vol = gridded(model.volatility(state["r"], state["vol"], q, p), grid)
        r = gridded(p(0) + np.sqrt(vol) * noise.normal("move", t, series), grid)
        return {"r": r, "vol": vol, "q": q, "y": model.observe(r, noise.normal("observe", t, series))}

    doubles = [f"cast({c} as double) as {c}" for c in ("r", "vol", *THETA)]
    rows = starts.select("series_id", *STATE, *THETA).dropna().selectExpr("series_id", "cast(q as int) as q", *doubles)
    return walked(rows, step, {"r": "double", "vol": "double", "q": "int", "y": "double"}, steps)
