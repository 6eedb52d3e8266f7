"""Whole runs of partitioned filters over sets of any size, in chunks of consecutive particles.

A chunk is a row: ``block`` particles of one sub-filter of one run, in order,
as the bytes of their states and log-weights. All runs take a step in the same
jobs. A step sums the weights of each chunk, which is all that goes by way of
the driver, one row a chunk. From these it knows on which points of the new set
each chunk's particles fall, so chunks are resampled by themselves, and pieces
of new chunks meet in a shuffle of rows of bytes, where they move and are
weighed. Selection sends the draws to the chunks that they hit and back. The
schemes are those of :mod:`.schemes` with the same draws, and give the same
numbers. Two folders are written in turn, so no more than two steps are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.noise_arrays import arrays_of
from ..lineage import new_path
from .packed import gridded, log_weights
from .packed_schemes import _dealt, _int, _points, _share
from .resample import BLOCK, ONE, cumulated
from .schemes import ALLOCATION

KEY = ["scheme", "part", "chunk"]
#: A chunk: its largest log-weight, states and log-weights as doubles, and under ``cen``, whose sub-filters are mixed, the sub-filters as ints.
CHUNK = "scheme string, part int, chunk long, top double, x binary, lw binary, of binary"
SUMS = "scheme string, part int, chunk long, n long, w long, wx double, ww double"
PIECE = "scheme string, part int, chunk long, first long, x binary, of binary"
DRAW = "scheme string, part int, chunk long, target int, draws long, at binary, place binary"
DRAWN = "scheme string, part int, chunk long, x binary, lw binary, place binary"
#: Draws made more of each sub-filter for each target by the schemes that select.
SELECTING = {"dpf": 0, "sub": 1}
#: Chunks of a task.
TASK = 16
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _batch(schema: str, *rows: tuple) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    columns = [pa.array([v.tobytes() if isinstance(v, np.ndarray) else v for v in column], _KINDS[kind]) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(names))


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(k)[i] for k, c in enumerate(batch.schema.names)}


def _read(value, kind=np.float64) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _key(row: dict) -> tuple[str, int, int]:
    return tuple(row[c].as_py() for c in KEY)


def _by_key(rows: DataFrame, tasks: int, order: list[str], schema: str, made: Callable[[tuple, Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """``made(key, rows)`` of each chunk's rows, which come in ``order``, one chunk after another."""

    def run(batches):
        for key, own in groupby(_rows(batches), _key):
            for out in made(key, own):
                yield _batch(schema, out)

    return rows.repartition(tasks, *KEY).sortWithinPartitions(*KEY, *order).mapInArrow(run, schema)


def _weights(lw: np.ndarray, top: float) -> np.ndarray:
    """Fixed-point weights shifted by the run's largest log-weight; equal ones where all vanish."""
    return np.full(len(lw), ONE, np.int64) if np.isneginf(top) else np.floor(np.exp(lw - top) * ONE + 0.5).astype(np.int64)


def _bound(n: int, c: np.ndarray, total: int, u: float) -> np.ndarray:
    """How many of the points (u + i) / n lie under the running weight ``c``."""
    return np.clip(np.ceil(float(n) * c / total - u), 0, n).astype(np.int64)


class _Step:
    """What tasks need to move and weigh the particles of step t."""

    def __init__(self, t: int, y: float, model, config):
        self.t, self.y, self.model, self.config = t, y, model, config

    def chunk(self, key: tuple, of: np.ndarray, ids: np.ndarray, w: int, before: np.ndarray) -> tuple:
        """The row of a chunk whose particles all weigh ``w``."""
        config = self.config
        x = gridded(self.model.propagate(before, self.t * config.dt, arrays_of(config.source).normal("move", self.t, of, ids)), config.grid)
        with np.errstate(over="ignore", invalid="ignore"):
            gain = self.model.log_likelihood(self.y, before if config.weight_on == "pre" else x)
            lw = log_weights(np.full(1, w, np.int64)) + gain if config.accumulate else gain
        lw = np.where(np.isnan(lw), -np.inf, lw)
        return *key, float(lw.max()), x, lw, of if key[0] == "cen" else None


def _started(particles: DataFrame, schemes: tuple[str, ...], step: _Step, size: int) -> DataFrame:
    """The chunks of the first step, which takes the set as it is."""

    def start(key, table):
        table = table.sort_by("id")
        x, ids, of = (table.column(c).to_numpy() for c in ("x", "id", "of"))
        return pa.Table.from_batches([_batch(CHUNK, step.chunk((key[0].as_py(), key[1].as_py(), key[2].as_py()), of, ids, ONE, x))])

    def chunks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        ranked = cumulated(rows.withColumn("__one", F.lit(1).cast("long")), "__one", keys)
        group = F.col("part") if keys else F.lit(0)
        named = ranked.select(F.lit(name).alias("scheme"), group.alias("part"), F.floor((F.col("cw") - 1) / size).alias("chunk"), F.col("part").alias("of"), "id", "x")
        return named.groupBy(*KEY).applyInArrow(start, CHUNK)

    rows = particles.select("id", F.col("part").cast("int").alias("part"), "x")
    out, apart = [], [s for s in schemes if s != "cen"]
    if apart:
        out.append(chunks(rows, ["part"], "").withColumn("scheme", F.explode(F.array(*map(F.lit, apart)))))
    if "cen" in schemes:
        out.append(chunks(rows, [], "cen"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _summed(chunks: DataFrame, tops: dict[str, float]) -> dict[tuple[str, int], list]:
    """The sums of each chunk, by run and sub-filter, in order."""

    def sums(batches):
        for row in _rows(batches):
            key = _key(row)
            w, x = _weights(_read(row["lw"]), tops[key[0]]), _read(row["x"])
            d = w.astype(np.float64)
            yield _batch(SUMS, (*key, len(w), int(w.sum()), float((d * x).sum()), float((d * d).sum())))

    out = defaultdict(list)
    for r in sorted(chunks.select(*KEY, "x", "lw").mapInArrow(sums, SUMS).collect(), key=lambda r: r["chunk"]):
        out[r["scheme"], r["part"]].append(r)
    return dict(sorted(out.items()))


def _selected(chunks: DataFrame, sizes: dict[tuple[str, int], int], parts: int, size: int, t: int, config) -> DataFrame:
    """Selection and exchange by the schemes that begin with it, as chunks: of a target, the draws of one sub-filter after another's."""
    spark = chunks.sparkSession
    draws = [(scheme, part, target, first, min(size, each - first)) for (scheme, part), n in sizes.items() if (each := n // parts + SELECTING[scheme]) for target in range(parts) for first in range(0, each, size)]
    tasks = _tasks(spark, len(draws))

    def drawn(batches):
        """Draws sorted by the chunk that they hit."""
        for row in _rows(batches):
            scheme, part, target, first, count = (row[c].as_py() for c in ("scheme", "part", "target", "first", "n"))
            n, j = sizes[scheme, part], np.arange(first, first + count, dtype=np.int64)
            rank = np.minimum(np.floor(arrays_of(config.source).uniform("draw", t - 1, _int(part), _int(target), j) * n), n - 1).astype(np.int64)
            order = np.argsort(rank, kind="stable")
            hit, starts = np.unique(rank[order] // size, return_index=True)
            for chunk, place in zip(hit.tolist(), np.split(order, starts[1:]), strict=True):
                yield _batch(DRAW, (scheme, part, chunk, target, part * (1 << 32) + first // size, (rank[place] - chunk * size).astype(np.int32), place.astype(np.int32)))

    def taken(key, rows):
        """The chunk itself comes first, without a place."""
        x, lw = (_read(v) for v in map(next(rows).get, ("x", "lw")))
        for row in rows:
            at = _read(row["at"], np.int32)
            yield key[0], row["target"].as_py(), row["draws"].as_py(), x[at], lw[at], row["place"].as_py()

    def gathered(key, rows):
        rows = list(rows)
        place = np.concatenate([_read(r["place"], np.int32) for r in rows])
        x, lw = np.empty(len(place)), np.empty(len(place))
        x[place], lw[place] = (np.concatenate([_read(r[c]) for r in rows]) for c in ("x", "lw"))
        yield *key, float(lw.max()), x, lw, None

    asked = spark.createDataFrame(draws, "scheme string, part int, target int, first long, n long").repartition(tasks).mapInArrow(drawn, DRAW)
    here = chunks.where(F.col("scheme").isin(*SELECTING)).select(*KEY, "x", "lw")
    met = _by_key(here.unionByName(asked, allowMissingColumns=True), tasks, ["target", "draws"], DRAWN, taken)
    return _by_key(met, tasks, [], CHUNK, gathered)


def _tasks(spark: SparkSession, chunks: int) -> int:
    return max(spark.sparkContext.defaultParallelism, chunks // TASK)


def _dealt_by_draws(spark: SparkSession, sums: dict[int, int], n: int, size: int, t: int, config) -> dict[int, int]:
    """How many of n draws fall on each sub-filter, made ``size`` at a time."""
    reach = np.cumsum([*sums.values()])

    def counted(batches):
        for row in _rows(batches):
            first = row["id"].as_py()
            at = np.floor(arrays_of(config.source).uniform("draw", t - 1, np.arange(first, min(n, first + size), dtype=np.int64)) * reach[-1])
            counts = np.bincount(np.searchsorted(reach, at, side="right"), minlength=len(reach))
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(counts)), pa.int32()), "n": pa.array(counts, pa.int64())})

    rows = spark.range(0, n, size, _tasks(spark, n // size)).mapInArrow(counted, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    found = {r["k"]: r["n"] for r in rows}
    return {part: found.get(k, 0) for k, part in enumerate(sums)}


def _plan(scheme: str, sums: dict[int, int], sizes: dict[int, int], n: int, parts: int, draw, by_draws) -> dict[int, list[tuple[int, int, float, float]]]:
    """Of each sub-filter the new ones made from it: number, points, the points' uniform, weight of a row."""
    u = lambda part: float(draw(_int(part))[0])
    total, share = sum(sums.values()), {p: _share(n, parts, p) for p in sums}
    allocated = lambda points: _dealt(sums, _points(np.array([*sums.values()]), points, u(ALLOCATION)))
    if scheme == "cen":
        return {0: [(0, n, u(0), 1.0 / n)]}
    if scheme == "dist1":
        total = sum(w for p, w in sums.items() if share[p] > 0)
        return {p: [(p, share[p], u(p), sums[p] / total / share[p])] for p in sums if share[p] > 0 and total}
    if scheme == "dist3":
        copies = np.repeat([*sums], [*allocated(parts).values()]).tolist()
        out = defaultdict(list)
        for copy, part in enumerate(copies):
            out[part].append((copy, _share(n, parts, copy), u(copy), 1.0 / n))
        return out
    if scheme == "decen":
        return {p: [(p, sizes[p], u(p), sums[p] / sizes[p] / total)] for p in sums}
    counts = {"sub": lambda: dict.fromkeys(sums, n // parts), "dist2": lambda: allocated(n), "hiera": lambda: by_draws(sums)}.get(scheme, lambda: share)()
    return {p: [(p, counts[p], u(p), 1.0 / n)] for p in sums}


def _resampled(chunks: DataFrame, sums: dict[tuple[str, int], list], tops: dict[str, float], plans: dict[str, dict], n: int, size: int, step: _Step) -> DataFrame:
    """The chunks of the next step."""
    base, total = {}, {}
    for (scheme, part), rows in sums.items():
        for r in rows:
            base[scheme, part, r["chunk"]] = total.get((scheme, part), 0)
            total[scheme, part] = base[scheme, part, r["chunk"]] + r["w"]
    weight = {(scheme, new[0]): new[3] for scheme, plan in plans.items() for made in plan.values() for new in made}
    tasks = _tasks(chunks.sparkSession, sum(new[1] // size + 1 for plan in plans.values() for made in plan.values() for new in made))

    def pieces(batches):
        for row in _rows(batches):
            scheme, part, _ = key = _key(row)
            all_ = total[scheme, part]
            if not all_:
                continue
            x, w = _read(row["x"]), _weights(_read(row["lw"]), tops[scheme])
            of = _read(row["of"], np.int32) if scheme == "cen" else None
            running = base[key] + np.cumsum(w)
            for new, points, u, _ in plans[scheme].get(part, ()):
                low = int(_bound(points, np.array([base[key]]), all_, u)[0])
                counts = np.diff(_bound(points, running, all_, u), prepend=low)
                source = np.repeat(np.arange(len(x)), counts)
                for chunk in range(low // size, (low + len(source) - 1) // size + 1) if len(source) else ():
                    first = max(low, chunk * size)
                    here = source[first - low : (chunk + 1) * size - low]
                    yield _batch(PIECE, (scheme, new, chunk, first, x[here], None if of is None else of[here]))

    def moved(key, rows):
        (scheme, part, chunk), rows = key, list(rows)
        x = np.concatenate([_read(r["x"]) for r in rows])
        ids = chunk * size + np.arange(len(x), dtype=np.int64) + (0 if scheme == "cen" else part * (1 << 32))
        of = np.concatenate([_read(r["of"], np.int32) for r in rows]) if scheme == "cen" else np.full(len(x), part, np.int32)
        # a row stands for about 1 of n, so n of its weight is near 1
        w = int(np.floor(weight[scheme, part] * n * ONE + 0.5))
        yield step.chunk(key, of, ids, w, x)

    return _by_key(chunks.select(*KEY, "x", "lw", "of").mapInArrow(pieces, PIECE), tasks, ["first"], CHUNK, moved)


def runs(particles: DataFrame, seen: dict[int, float], schemes: tuple[str, ...], model, config, n: int) -> DataFrame:
    """``scheme, t, mean, ess``: a run of each scheme over the n particles ``id, part, x``."""
    spark, size = particles.sparkSession, config.block or BLOCK
    path, said, new, last = new_path(spark, "chunks"), [], config.n_out or n, len(seen) - 1

    def kept(chunks: DataFrame, name: str) -> DataFrame:
        # bytes of random numbers: no dictionary is tried for them, and nothing is gained by compressing them
        chunks.write.mode("overwrite").options(**{"compression": "none", "parquet.enable.dictionary": "false"}).parquet(f"{path}/{name}")
        return spark.read.schema(CHUNK).parquet(f"{path}/{name}")

    state = None
    for k, t in enumerate(sorted(seen)):
        step = _Step(t, seen[t], model, config)
        if state is None:
            state = kept(_started(particles, schemes, step, size), "0")
        else:
            noise = arrays_of(config.source)
            draw = lambda *keys, t=t: noise.uniform("draw", t - 1, *keys)
            choosing, source, of = [s for s in schemes if s in SELECTING], state, sums
            if choosing:
                sizes = {key: sum(r["n"] for r in rows) for key, rows in sums.items() if key[0] in choosing}
                chosen = kept(_selected(state, sizes, config.parts, size, t, config), "selected")
                source = state.where(~F.col("scheme").isin(*choosing)).unionByName(chosen)
                of = {key: rows for key, rows in sums.items() if key[0] not in choosing} | _summed(chosen, tops)
            plans = {}
            for scheme in schemes:
                w, rows = ({part: sum(r[c] for r in rows) for (s, part), rows in of.items() if s == scheme} for c in ("w", "n"))
                plans[scheme] = _plan(scheme, w, rows, new, config.parts, draw, lambda w, t=t: _dealt_by_draws(spark, w, new, size, t, config))
            state = kept(_resampled(source, of, tops, plans, new, size, step), str(k % 2))
        tops = {r["scheme"]: r["top"] for r in state.groupBy("scheme").agg(F.max("top").alias("top")).collect()}
        sums = _summed(state, tops)
        for scheme in schemes:
            w, wx, ww = (sum(r[c] for (s, _), rows in sums.items() if s == scheme for r in rows) for c in ("w", "wx", "ww"))
            if w:
                said.append((scheme, int(t), wx / w, float(w) ** 2 / ww))
    return spark.createDataFrame(said, "scheme string, t int, mean double, ess double")
