"""Checkpoint sets: markers, retention, and runs that die and go on."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators.checkpoints import CheckpointSets, train


@pytest.fixture
def sets(spark, tmp_path):
    return CheckpointSets(spark, f"file://{tmp_path}/sets")


def test_a_set_is_whole_when_its_marker_is_there(spark, sets):
    df = spark.range(5)
    assert sets.steps() == {} and sets.latest() is None
    sets.write(100, {"a": df, "b": df.where("id > 2")})
    sets.write(200, {"a": df}, mark=False)
    assert sets.steps() == {100: True, 200: False} and sets.latest() == 100
    assert {k: v.count() for k, v in sets.read(100).items()} == {"a": 5, "b": 2}
    with pytest.raises(ValueError):
        sets.read(200)
    with pytest.raises(ValueError):
        sets.read(300)
    sets.write(200, {"a": df.where("id = 0")})  # replaces what was left
    assert sets.read(200)["a"].count() == 1 and sets.latest() == 200
    with pytest.raises(Exception):
        sets.mark(200)
    sets.delete(200)
    sets.mark(300)
    assert sets.steps() == {100: True, 300: True}
    with pytest.raises(ValueError):
        sets.read(300)


def test_retention(spark, sets):
    for s in range(1, 9):
        sets.write(s * 100, {"a": spark.range(1)}, mark=s not in (3, 8))
    assert sets.retain(2, 400) == [100, 200, 300, 500]
    assert sets.steps() == {400: True, 600: True, 700: True, 800: False}  # 800 is being written
    assert sets.retain(0) == [] and sets.retain(1) == [400, 600]


def test_a_run_that_dies_goes_on_from_the_last_whole_set(spark, tmp_path):
    def step(n, tables):
        return {"p": tables["p"].withColumn("v", F.col("v") * 3 + n), "log": tables["log"].unionByName(spark.createDataFrame([(n,)], "n long"))}

    def first():
        return {"p": spark.range(3).withColumn("v", F.col("id")), "log": spark.createDataFrame([], "n long")}

    def result(tables):
        return sorted(tuple(r) for r in tables["p"].collect()), sorted(r.n for r in tables["log"].collect())

    want = result(train(CheckpointSets(spark, f"file://{tmp_path}/one"), first, step, 7, 100))
    assert want[1] == list(range(1, 8))
    sets = CheckpointSets(spark, f"file://{tmp_path}/two")
    train(sets, first, step, 7, 2, last=2, major=4, dies_at=6)
    assert sets.latest() == 4 and sets.steps()[6] is False
    asked = []
    got = train(sets, first, lambda n, t: asked.append(n) or step(n, t), 7, 2, last=2, major=4)
    assert result(got) == want and asked == [5, 6, 7]
    assert sets.steps() == {4: True, 6: True, 7: True}
