"""Many outputs by one job: one commit, nothing of a failed write, everything of a committed one."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F
from test_captures import folder

from wirelens.sources import outputs
from wirelens.sources.captures import store_of


def made(spark, n=3, rows=200):
    df = spark.range(0, rows, 1, 4).withColumn("ts", F.timestamp_micros(F.col("id") * 1_000_001))
    kinds = [
        df.select("id", "ts"),
        df.select(F.col("id").cast("string").alias("a b"), F.array("id").alias("list"), F.encode(F.col("id").cast("string"), "UTF-8").alias("raw")),
        df.filter("id < 0").select("id", F.lit(1.5).alias("x")),
    ]
    return {f"out {i}": kinds[i % 3] for i in range(n)}


def visible(path):
    return sorted(f[len(path) + 1 :] for f in glob.glob(f"{path}/**/*", recursive=True) if os.path.isfile(f) and "/_" not in f)


def jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_all_outputs_in_one_job(spark):
    path = folder() + "/o"
    for n in (3, 12):
        assert jobs(spark, lambda n=n: outputs.write_outputs(spark, made(spark, n), path)) == 1
    for name, df in made(spark, 12).items():
        back = spark.read.parquet(f"{path}/{name}")
        assert back.schema.simpleString() == df.schema.simpleString()
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert not any(f.startswith("_") for _, _, fs in os.walk(path) for f in fs)


def test_later_writes_replace_their_folder_only(spark):
    path = folder() + "/o"
    for batch in ("0", "1", "1"):
        outputs.write_outputs(spark, made(spark), path, into=f"batch={batch}")
    assert spark.read.parquet(f"{path}/out 0").groupBy("batch").count().orderBy("batch").collect() == [(0, 200), (1, 200)]
    assert spark.read.parquet(f"{path}/out 2").count() == 0


def test_other_formats(spark):
    path = folder() + "/o"
    df = made(spark)["out 0"].select("id")
    outputs.write_outputs(spark, {"a": df}, path, fmt="csv")
    back = spark.read.schema(df.schema).option("header", "true").csv(f"{path}/a")
    assert sorted(back.collect()) == [(i,) for i in range(200)]
    with pytest.raises(ValueError):
        outputs.write_outputs(spark, {"a": df}, path, fmt="xml")


def test_a_failed_task_leaves_nothing(spark):
    path = folder() + "/o"
    outputs.write_outputs(spark, made(spark), path)
    before = visible(path)
    bad = made(spark)
    bad["out 1"] = bad["out 0"].select(F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        outputs.write_outputs(spark, bad, path)
    assert visible(path) == before and os.listdir(f"{path}/_staged") == []


class Killed(Exception):
    pass


def staged_by_hand(spark, path):
    """A writer and its tasks' messages, as Spark would hand them to commit."""
    import base64
    import json

    from pyspark.sql.pandas.types import to_arrow_schema

    frames = made(spark)
    told = {n: base64.b64encode(to_arrow_schema(df.schema).serialize().to_pybytes()).decode() for n, df in frames.items()}
    writer = outputs.OutputsWriter({"path": path, "schemas": json.dumps(told)})
    store, root = store_of(path)
    files = []
    for n, df in frames.items():
        file, sink, out = writer._new_file(store, root, n, 0)
        out.write_table(df.toArrow().cast(writer._schema(n)))
        out.close()
        sink.close()
        files.append((n, file))
    return writer, [outputs._Files(files)]


@pytest.mark.parametrize("moves", [0, 1, 2, 3])
def test_a_commit_killed_anywhere(spark, monkeypatch, moves):
    """Killed before the manifest is there: nothing has changed. Killed after it: the next write or reader finishes it."""
    path = folder() + "/o"
    outputs.write_outputs(spark, {n: df.limit(1) for n, df in made(spark).items()}, path)
    before = visible(path)
    writer, messages = staged_by_hand(spark, path)
    real, left = outputs.store_of, [moves]

    class Dying:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            if name == "move":
                left[0] -= 1
                if left[0] < 0:
                    raise Killed
            return getattr(self.store, name)

    monkeypatch.setattr(outputs, "store_of", lambda p: (Dying(real(p)[0]), real(p)[1]))
    with pytest.raises(Killed):
        writer.commit(messages)
    monkeypatch.setattr(outputs, "store_of", real)
    if moves == 0:
        assert visible(path) == before
        assert outputs.recover(path) == 0 and visible(path) == before
    else:
        assert outputs.recover(path) == 1 and outputs.recover(path) == 0
        assert spark.read.parquet(f"{path}/out 0").count() == 200 and not set(visible(path)) & set(before)
