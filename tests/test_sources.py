from pyspark.sql import functions as F

from murmuration.sources.text import observation, read_observations, read_particles, read_step, write_numbers, write_particles, write_step


def test_text_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([(i, i * 0.5, float(-i)) for i in range(10)], "id long, w double, x double").coalesce(1)
    for order in ("state weight", "weight state"):
        path = str(tmp_path / order.replace(" ", "-"))
        write_particles(rows, path, order)
        found = read_particles(spark, path, order, parts=3).orderBy("id").collect()
        assert [(r["w"], r["x"]) for r in found] == [(i * 0.5, float(-i)) for i in range(10)]
        assert [r["part"] for r in found] == sorted(r["part"] for r in found) and {r["part"] for r in found} == {0, 1, 2}


def test_observations(spark, tmp_path):
    path = str(tmp_path / "obs")
    write_numbers(spark.createDataFrame([(1.5,), (2.5,), (-3.0,)], "y double").coalesce(1), path, "y")
    seen = read_observations(spark, path)
    assert [r["y"] for r in seen.orderBy("t").collect()] == [1.5, 2.5, -3.0]
    assert observation(seen, 2).first()["y"] == 2.5 and observation(seen, 9).count() == 0


def test_steps(spark, tmp_path):
    path = str(tmp_path / "steps")
    for t in (1, 2):
        write_step(spark.range(3).withColumn("w", F.lit(t)), path, t)
    assert {r["w"] for r in read_step(spark, path, 2).collect()} == {2}
