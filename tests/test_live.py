"""The live filter: keyed state through batches, restarts and replays."""

import pytest

from murmuration.operators.filters import FilterConfig, run_filter
from murmuration.streaming.live import live_filter, live_session

SCHEMA = "series_id long, t int, y double"
CONFIG = FilterConfig(particles=40, seed=2)
#: Series 0 has a repeated row and a late one, series 1 is behind, series 2 comes later, series 3 has a gap and a null.
BATCHES = [
    [(0, 1, 2.0), (0, 3, 4.0), (0, 2, 3.0), (0, 2, 9.0), (1, 1, 2.5), (3, 1, 1.0), (None, 1, 1.0)],
    [(1, 2, 3.5), (2, 1, 1.5), (2, 2, 0.5), (0, 2, -7.0), (3, 2, None), (3, 4, 2.0)],
    [(1, 3, 1.0), (0, 4, 5.0), (2, 3, 6.0)],
]


def _run(session, where, path, model, filter_):
    stream = session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(where)
    query = live_filter(stream, model, filter_, CONFIG).writeStream.format("parquet").option("checkpointLocation", f"{path}/commits").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return query


@pytest.mark.parametrize("model,filter_", [("benchmark", "bootstrap"), ("growth", "auxiliary")])
def test_live_equals_the_whole_run(spark, tmp_path, model, filter_):
    """Each start is a restart from the store; a batch writes the sets that its rows move, three of four."""
    session, where, path = live_session(spark), str(tmp_path / "stream"), str(tmp_path / "live")
    updated = []
    for rows in BATCHES:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(where)
        progress = [p for p in _run(session, where, path, model, filter_).recentProgress if p["numInputRows"]]
        updated.append(sum(op["numRowsUpdated"] for p in progress for op in p["stateOperators"]))
    assert updated == [3, 3, 3]
    found = {(r["series_id"], r["t"]): r for r in session.read.parquet(f"{path}/out").collect()}
    taken = {(s, t) for rows in BATCHES for s, t, y in rows if s is not None and y is not None}
    assert found.keys() == taken and session.read.parquet(f"{path}/out").count() == len(taken)
    # the late row of series 0 does not count
    seen = spark.createDataFrame([r for rows in BATCHES for r in rows if r != (0, 2, -7.0)], SCHEMA)
    wanted = {(r["series_id"], r["t"]): r for r in run_filter(seen, model, filter_, CONFIG).collect()}
    for k, r in found.items():
        assert all(r[c] == pytest.approx(wanted[k][c], rel=1e-12) for c in ("mean", "ess", "q05", "q95")), k
    # nothing new: no batch, no rows
    _run(session, where, path, model, filter_)
    assert session.read.parquet(f"{path}/out").count() == len(taken)


def test_a_lost_commit_is_replayed(spark, tmp_path):
    """The last batch's commit is taken away; the batch runs again from the state before it and gives the same rows once."""
    session, where, path = live_session(spark), str(tmp_path / "stream"), tmp_path / "live"
    for rows in BATCHES[:2]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(where)
    _run(session, where, str(path), "benchmark", "bootstrap")
    before = sorted(map(tuple, session.read.parquet(f"{path}/out").collect()))
    for name in ("1", ".1.crc"):
        (path / "commits" / "commits" / name).unlink(missing_ok=True)
    _run(session, where, str(path), "benchmark", "bootstrap")
    assert sorted(map(tuple, session.read.parquet(f"{path}/out").collect())) == before


def test_what_has_no_keyed_state(spark, tmp_path):
    spark.createDataFrame(BATCHES[0], SCHEMA).write.parquet(str(tmp_path / "stream"))
    plain = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "stream"))
    stream = live_session(spark).readStream.schema(SCHEMA).parquet(str(tmp_path / "stream"))
    for args in ((stream, "rsgarch", "imm"), (stream, "benchmark", "bootstrap", FilterConfig(particles=5000)), (stream, "benchmark", "bootstrap", FilterConfig(resampler="residual")), (plain,)):
        with pytest.raises(ValueError):
            live_filter(*args)
