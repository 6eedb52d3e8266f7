"""Live filtering with keyed state: a streaming DataFrame of observations becomes one of summaries.

Each series' set lives in the stream's state store under its own key, so a
batch reads and writes the sets of the series it has observations of, and no
others. The caller picks sink, trigger and checkpoint; what Spark restarts or
replays starts from the store's committed version and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.filters import COLUMNS, STEPS, FilterConfig, folds
from ..operators.models import MODELS, Model
from ..operators.packed import KINDS, Sets

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def live_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep state in RocksDB and commit the changes of a batch only."""
    session = spark.newSession()
    session.conf.set(PROVIDER, ROCKSDB)
    session.conf.set(CHANGES, "true")
    return session


class SeriesFilter(StatefulProcessor):
    """The set of one series after its last step, advanced by the observations of a batch."""

    def __init__(self, model: Model, filter_: str, config: FilterConfig, kind: str):
        self.model, self.filter_, self.config, self.kind = model, filter_, config, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("set", "step int, " + ", ".join(f"{c} binary" for c in Sets.names))

    def _observed(self, rows: Iterator[pd.DataFrame], after: int | None) -> dict[int, float]:
        """The least y of each step that is not past, in order of steps."""
        least: dict[int, float] = {}
        for part in rows:
            for t, y in zip(part["t"].tolist(), part["y"].tolist(), strict=True):
                if after is None or t > after:
                    least[t] = min(y, least.get(t, y))
        return dict(sorted(least.items()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        seen = self._observed(rows, known[0] if known else None)
        if not seen:
            return
        series = np.array([key[0]], {"bigint": np.int64, "int": np.int32}.get(self.kind, object))
        sets = Sets(self.model, self.filter_, self.config, series)
        if known:
            own = {c: np.frombuffer(bytes(v), KINDS[c])[None, :] for c, v in zip(Sets.names, known[1:], strict=True)}
        else:
            own = sets.started(1)
        first, end = known[0] + 1 if known else min(seen), max(seen)
        told = []
        for t in range(first, end + 1):
            y, has = np.array([seen.get(t, 0.0)]), np.array([t in seen])
            now, own = sets.step(own, sets.series, t, y, has)
            if t in seen:
                told.append((key[0], t, *(float(v[0]) for v in sets.told(now).values())))
        self.last.update((end, *(np.ascontiguousarray(own[c], KINDS[c]).tobytes() for c in Sets.names)))
        yield pd.DataFrame(told, columns=COLUMNS)

    def close(self) -> None:
        pass


def live_filter(stream: DataFrame, model: str | Model = "benchmark", filter_: str = "bootstrap", config: FilterConfig = FilterConfig()) -> DataFrame:
    """``series_id, t, mean, ess, q05, q95`` for each observation of a stream ``series_id, t, y``, as batches bring them.

    A series begins with its first observation. Those of a batch are taken
    step by step, of repeated rows of a step the one with the least y; one
    whose step its own series has passed is late and gives no row. A series
    moves through steps that it has no observation of when the next one comes,
    so a gap costs nothing until then. Rows without y or series_id are left
    out, other columns are dropped. A task holds one set and the steps of one series of a batch.
    Sets have ``config.packed`` particles at most; larger ones are for
    :class:`.online.OnlineFilter`. The stream must be of a
    :func:`live_session`; its output mode is append.
    """
    model = MODELS[model]() if isinstance(model, str) else model
    if filter_ not in STEPS or not isinstance(model, Model):
        raise ValueError(f"the filter {filter_!r} is not for this model")
    kind = dict(stream.dtypes)["series_id"]
    if not folds(config, model, kind):
        raise ValueError("sets of this size, key or resampler have no keyed state; use OnlineFilter")
    if stream.sparkSession.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError("keyed state needs RocksDB; read the stream in live_session(spark)")
    seen = stream.where("series_id is not null and y is not null").select("series_id", F.col("t").cast("int").alias("t"), F.col("y").cast("double").alias("y"))
    schema = f"series_id {kind}, t int, mean double, ess double, q05 double, q95 double"
    return seen.groupBy("series_id").transformWithStateInPandas(SeriesFilter(model, filter_, config, kind), schema, "Append", "None")
