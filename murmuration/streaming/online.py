"""Online filtering: each micro-batch of observations advances a particle table.

The state is a Parquet folder with each series' own last step beside its
particles, one per batch where sets are folded and one per step where they go
row by row. A batch writes its folders before the query commits it. What a
replayed batch has taken already is late then, and the rest, with keyed noise,
gives the same sets.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..lineage import cut, new_path
from ..operators import packed
from ..operators.filters import STEPS, FilterConfig, folds, initial
from ..operators.models import MODELS, BenchmarkModel


class OnlineFilter:
    """``start(stream)`` consumes ``series_id, t, y``; ``summaries()`` reads what is known so far.

    A series begins with its first observation. Observations of one batch are
    taken step by step; one whose step its own series has passed is late and
    left out, whatever steps other series have reached. A series moves through
    steps that it has no observation of.
    """

    def __init__(self, spark: SparkSession, model: str | BenchmarkModel = "benchmark", filter_: str = "bootstrap", config: FilterConfig = FilterConfig(), path: str | None = None):
        self.spark, self.filter_, self.config = spark, filter_, config
        self.model = MODELS[model]() if isinstance(model, str) else model
        self.path = path or new_path(spark, "online")
        self.version, self.last_step = self._recovered()

    def _recovered(self) -> tuple[int, int]:
        """The last state whose summary is whole and the furthest step of any series, where ``path`` is a folder of an earlier run."""
        try:
            version, step = self._told().agg(F.max("version"), F.max("t")).first()
            return version or 0, step or 0
        except AnalysisException:
            return 0, 0

    def _state(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/state/{self.version}") if self.version else None

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        seen = batch.where("y is not null and series_id is not null").groupBy("series_id", F.col("t").cast("int").alias("t")).agg(F.min("y").alias("y"))
        state = self._state()
        if state is None:
            seen = seen.withColumn("step", F.lit(None).cast("int"))
        else:
            seen = seen.join(state.groupBy("series_id").agg(F.max("step").alias("step")), "series_id", "left")
        seen = cut(seen.where("step is null or t > step"))
        (self._folded if folds(self.config, self.model, dict(seen.dtypes)["series_id"]) else self._by_steps)(seen, state)

    def _write(self, state: DataFrame, said: DataFrame) -> None:
        state.write.mode("overwrite").parquet(f"{self.path}/state/{self.version + 1}")
        said.write.mode("overwrite").parquet(f"{self.path}/summary/version={self.version + 1}")
        self.version += 1

    def _folded(self, seen: DataFrame, state: DataFrame | None) -> None:
        """All steps of a batch in one fold of each series' set; a series of very many new steps is folded again and again."""
        config, tasks = self.config, self.spark.sparkContext.defaultParallelism
        while low := seen.agg(F.min("t")).first()[0]:
            high = low + config.steps_at_once - 1
            now = packed.observed(seen.where(F.col("t") <= high)).withColumnRenamed("last", "high")
            if state is None:
                rows = now.select("series_id", *packed.nothing(), F.col("first").alias("low"), "high", "seen")
            else:
                rows = now.join(state, "series_id", "left").select("series_id", *packed.Sets.names, F.coalesce(F.col("step") + 1, F.col("first")).alias("low"), "high", "seen")
            after = cut(packed.advanced(rows.repartition(tasks, "series_id"), self.model, self.filter_, config).join(now.select("series_id", F.col("high").alias("step")), "series_id"))
            said = after.select("series_id", F.inline("said")).join(seen.select("series_id", "t"), ["series_id", "t"], "left_semi")
            moved = after.select("series_id", "step", *packed.Sets.names)
            self._write(moved if state is None else moved.unionByName(state.join(moved, "series_id", "left_anti")), said)
            self.last_step = max(self.last_step, seen.where(F.col("t") <= high).agg(F.max("t")).first()[0])
            seen, state = seen.where(F.col("t") > high), self._state()

    def _by_steps(self, seen: DataFrame, state: DataFrame | None) -> None:
        spans = cut(seen.groupBy("series_id").agg(F.max("step").alias("step"), F.coalesce(F.max("step") + 1, F.min("t")).alias("low"), F.max("t").alias("high")))
        steps = spans.select(F.explode(F.sequence("low", "high")).alias("t")).distinct().orderBy("t").collect()
        for t in [r["t"] for r in steps]:
            now, state = seen.where(F.col("t") == t), self._state()
            fresh, idle = initial(spans.where((F.col("low") == t) & F.col("step").isNull()), self.model, self.config), None
            if state is not None:
                moving = spans.where((F.col("low") <= t) & (F.col("high") >= t)).select("series_id")
                fresh = state.drop("step").join(moving, "series_id", "left_semi").unionByName(fresh)
                idle = state.join(moving, "series_id", "left_anti")
            after, said, _ = STEPS[self.filter_](fresh, now.select("series_id", "y"), t, self.model, self.config)
            after = after.withColumn("step", F.lit(t))
            after = after if idle is None else after.unionByName(idle)
            self._write(after, said.join(now.select("series_id"), "series_id", "left_semi"))
            self.last_step = max(self.last_step, t)

    def start(self, stream: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
        where = checkpoint or f"{self.path}/commits"
        return stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", where).trigger(availableNow=True).start()

    def _told(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/summary").parquet(f"{self.path}/summary")

    def summaries(self) -> DataFrame:
        return self._told().drop("version")
